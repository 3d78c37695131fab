"""Text cut off by field limits.

*Length hazards* come first: per source, the chance that a text ends at length L
given that it reaches L, in characters and in bytes and over distinct texts, is
tested against the hazards of the neighbouring lengths.  Benjamini-Hochberg
control within each source and measure gives the significant lengths.  A text of
such a length is cut (reason "limit") unless its last unit (sentence or line,
digits masked) ends in a sentence mark or is an ending the corpus knows: one that
closes at least ``ENDING_RATE`` of all texts and at which at least
``STOP_SHARE_AT_LIMIT`` of the units that begin with it stop.  The length is the
evidence there, so whatever isn't known to be complete counts as cut.

Elsewhere nothing speaks for a cut but the ending itself.  Reason "transfer" needs
positive evidence: a remnant of an encoding, a word that the corpus only knows
longer, a unit that others merely begin with, or the opening words of sentences
that close with a mark everywhere else.
"""

from __future__ import annotations

import bisect
import math
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mailgrain.runtime import materialise, spread

#: Share of all distinct texts an unpunctuated ending must close to count as one; bounds the endings to 1 / rate.
ENDING_RATE = 3e-4
#: Least number of texts, for corpora so small that the rate is below it: of endings on their own line, and of others.
ENDING_LEAST, ENDING_LEAST_INLINE = 2, 3
#: Share of the units beginning with an ending that must stop there: anywhere, and at a significant length.
STOP_SHARE, STOP_SHARE_AT_LIMIT = 0.03, 0.5
#: Share of all units an opening must begin, and of all words a word must make up, to be evidence; bounds both tables to 1 / rate.
OPENING_RATE, WORD_RATE = 1e-5, 2e-6
#: Least count of either, for small corpora.
EVIDENCE_LEAST = 4
#: Share of the units with an opening that must end in a sentence mark for the opening to promise one.
PROSE_SHARE = 0.8
NEIGHBOURS = 10
FALSE_DISCOVERY = 0.01
LEAST_EXCESS = 3

_LINES = re.compile(r"\s*\n\s*")
_SENTENCES = re.compile(r"(?<=[.!?])[ \t\u00a0]+")
_CLOSED = re.compile(r"(?<!\.)[.!?][\"'”»›’)\]]*$")
_QUOTED_CLOSE = re.compile(r"[.!?]\s?»$")
_BULLETS = ("-", "*", "•", "–")
_MAY_CLOSE = frozenset(".!?\"'”»›’)]")
_NUMBER = re.compile(r"\d+")
_HOST = re.compile(r"\b([a-z]+://)[\w.-]+\.[a-z]{2,}(?=/)")
_REMNANT = re.compile(r"(?:�|=[0-9A-F]{0,2}|&#?\w{0,8}|%[0-9A-F]{0,2}|\\u[0-9a-fA-F]{0,3})$")
_WORDS = re.compile(r"[^\W\d_]+")
_LAST_WORD = re.compile(r"[^\W\d_]+$")


def masked(text: str) -> str:
    """Text with digits and link hosts masked."""
    text = _NUMBER.sub("0", text)
    return _HOST.sub(r"\1*", text) if "://" in text else text


def units(text: str) -> list[str]:
    """Sentences and lines of a masked text, with a mark for what begins a line."""
    out = []
    for k, line in enumerate(_LINES.split(text)):
        parts = [p for p in (x.strip() for x in _SENTENCES.split(line)) if p]
        if parts:
            out.append("\n" + parts[0] if k else parts[0])
            out += parts[1:]
    return out


def last_unit(text: str) -> str:
    """The last of ``units`` of the text, from its tail only where that is safe."""
    text = text.rstrip()
    line = text.rsplit("\n", 1)[-1]
    part = _SENTENCES.split(line.strip())[-1]
    begins = "\n" in text and part == line.strip()
    return masked(("\n" if begins else "") + part)


def is_closed(unit: str) -> bool:
    """Whether a unit ends in a sentence mark that isn't a row of dots."""
    return unit[-1:] in _MAY_CLOSE and bool(_CLOSED.search(unit) or _QUOTED_CLOSE.search(unit))


def bullet_word(unit: str) -> str | None:
    """Last word of a list entry of two or more words, else None."""
    if unit.lstrip()[:1] not in _BULLETS:
        return None
    words = unit.split()
    return words[-1] if len(words) > 2 and words[0] in _BULLETS else None


def endings(documents: DataFrame) -> DataFrame:
    """doc_id, source, chars, bytes, digest, unit, closed of every text that isn't null or blank."""
    source = spread(documents.select("doc_id", "source", "text").where(F.length(F.trim("text")) > 0))
    source = source.withColumns(
        {"chars": F.length("text"), "bytes": F.octet_length("text"), "digest": F.xxhash64("text")}
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = batch[["doc_id", "source", "chars", "bytes", "digest"]].copy()
            out["unit"] = [last_unit(t) for t in batch["text"]]
            out["closed"] = [is_closed(u) for u in out["unit"]]
            yield out

    id_type = documents.schema["doc_id"].dataType.simpleString()
    return source.mapInPandas(run, f"doc_id {id_type}, source string, chars int, bytes int, digest long, unit string, closed boolean")


def openings(unit: str) -> list[tuple[str, bool]]:
    """First word and first two words of a unit, each with whether the unit holds no more; a line start stays part of them."""
    words = unit.split(None, 2)
    start = "\n" if unit[:1] == "\n" else ""
    return [(start + " ".join(words[:k]), len(words) == k) for k in (1, 2) if len(words) >= k]


class Evidence:
    """What the whole corpus says about endings.

    ``shares``: known endings with the share of units that stop there.
    ``opening``: opening words -> (units, of these closed by a mark, of these nothing more).
    ``words``: frequent words and their counts.
    """

    def __init__(self, shares: dict[str, float], opening: dict[str, tuple[int, int, int]], words: dict[str, int]):
        self.shares, self.opening = shares, opening
        self.words = words
        self.sorted = sorted(words)
        self.sums = [0]
        for w in self.sorted:
            self.sums.append(self.sums[-1] + words[w])

    def share(self, unit: str) -> float | None:
        """Share of the units beginning like this one that stop here; None for an unknown ending."""
        word = bullet_word(unit)
        return self.shares.get(unit if word is None else "- " + word)

    def is_broken_word(self, unit: str) -> bool:
        """Whether the last word is almost only known as the beginning of longer words."""
        m = _LAST_WORD.search(unit)
        if not m:
            return False
        word = m.group()
        low = bisect.bisect_left(self.sorted, word)
        high = bisect.bisect_left(self.sorted, word + "\U0010ffff")
        own = self.words.get(word, 0)
        longer = self.sums[high] - self.sums[low] - own
        return longer >= EVIDENCE_LEAST and own < STOP_SHARE * longer

    def breaks_off(self, unit: str) -> bool:
        """Whether units that open like this one go on, or close with a mark."""
        known = [(self.opening[k], whole) for k, whole in openings(unit) if k in self.opening]
        if not known:
            return False
        (n, closed, nothing_more), whole = known[-1]
        if whole:
            return nothing_more < STOP_SHARE * n or closed >= PROSE_SHARE * n
        return closed >= PROSE_SHARE * n

    def reason(self, unit: str, closed: bool, at_limit: bool) -> str | None:
        """ "limit", "transfer", or None for a complete text."""
        if closed:
            return None
        share = self.share(unit)
        if at_limit:
            return "limit" if share is None or share < STOP_SHARE_AT_LIMIT else None
        if _REMNANT.search(unit):
            return "transfer"
        if share is not None and bullet_word(unit) is None:
            return "transfer" if share < STOP_SHARE else None
        return "transfer" if self.is_broken_word(unit) or self.breaks_off(unit) else None


def corpus_evidence(documents: DataFrame, ends: DataFrame) -> Evidence:
    """Counts over all documents: known endings, openings and words.

    At most 1 / ENDING_RATE endings reach the driver, since each distinct text
    has one, at most 1 / OPENING_RATE openings of either length and 1 / WORD_RATE
    words.  List entries are known by their last word, under the key "- word".
    """
    open_ends = ends.where(~F.col("closed")).groupBy("digest").agg(F.first("unit").alias("unit"))
    texts = ends.agg(F.count_distinct("digest")).first()[0]
    least = max(ENDING_LEAST, math.ceil(ENDING_RATE * texts))
    as_key = F.when(
        F.col("unit").rlike(r"^\n?[-*•–]\s+\S+\s+\S"), F.concat(F.lit("- "), F.regexp_extract("unit", r"(\S+)$", 1))
    ).otherwise(F.col("unit"))
    enough = F.when(F.col("k").rlike(r"^(\n|- )"), F.lit(least)).otherwise(F.lit(max(least, ENDING_LEAST_INLINE)))
    counted = open_ends.groupBy(as_key.alias("k")).count().where(F.col("count") >= enough).collect()
    candidates = {r["k"] for r in counted}
    entry_words = {k[2:] for k in candidates if k.startswith("- ")}
    plain = {k for k in candidates if not k.startswith("- ")}
    # lengths of the endings by their first letters: a unit is tried only against endings that may begin it
    by_start: dict[str, set[int]] = {}
    for k in plain:
        by_start.setdefault(k[:4], set()).add(len(k))
    starts = {k: sorted(v) for k, v in by_start.items()}
    short = sorted({len(k) for k in plain if len(k) < 4})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        begin, stop = Counter(), Counter()
        opened, closed, whole = Counter(), Counter(), Counter()
        seen = Counter()
        for batch in batches:
            for text in batch["text"]:
                text = masked(text.rstrip())
                seen.update(_WORDS.findall(text))
                for unit in units(text):
                    for n in (*short, *starts.get(unit[:4], ())):
                        if n <= len(unit) and (head := unit[:n]) in plain:
                            begin[head] += 1
                            stop[head] += n == len(unit)
                    if (last := bullet_word(unit)) is not None:
                        for word in unit.split()[1:]:
                            for n in range(1, len(word) + 1):
                                if (head := word[:n]) in entry_words:
                                    begin["- " + head] += 1
                        if last in entry_words:
                            stop["- " + last] += 1
                    ends_well = is_closed(unit)
                    for key, nothing_more in openings(unit):
                        opened[key] += 1
                        closed[key] += ends_well
                        whole[key] += nothing_more
        rows = [("e", k, n, stop[k], 0) for k, n in begin.items()]
        rows += [("o", k, n, closed[k], whole[k]) for k, n in opened.items()]
        rows += [("w", k, n, 0, 0) for k, n in seen.items()]
        yield pd.DataFrame(rows, columns=["t", "k", "n", "a", "b"])

    source = spread(documents.select("text").where(F.length(F.trim("text")) > 0))
    counts = source.mapInPandas(run, "t string, k string, n long, a long, b long").groupBy("t", "k").agg(*[F.sum(c).alias(c) for c in "nab"])
    counts = materialise(counts, "ending-counts")
    total = {r["t"]: r["s"] for r in counts.groupBy("t").agg(F.sum("n").alias("s")).collect()}
    # each unit counts under one and two opening words
    bound = {"o": OPENING_RATE * total.get("o", 0) / 2, "w": WORD_RATE * total.get("w", 0)}
    frequent = F.lit(False)
    for t, at_least in bound.items():
        frequent = frequent | ((F.col("t") == t) & (F.col("n") >= max(EVIDENCE_LEAST, math.ceil(at_least))))
    kept = counts.where((F.col("t") == "e") | frequent).collect()
    return Evidence(
        {r["k"]: r["a"] / r["n"] for r in kept if r["t"] == "e"},
        {r["k"]: (r["n"], r["a"], r["b"]) for r in kept if r["t"] == "o"},
        {r["k"]: r["n"] for r in kept if r["t"] == "w"},
    )


def length_limits(ends: DataFrame) -> DataFrame:
    """source, measure, length, n, hazard, around, p_value, limit: one row per source, measure and length.

    Copies of one text count once, since they say nothing new.  The histogram has at most one row per distinct length of a source, so its
    windows stay small even for a source with a third of all texts.
    """
    histogram = (
        ends.select("source", "digest", "chars", "bytes").distinct()
        .select("source", F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).alias("length")) for m in ("chars", "bytes")])).alias("x"))
        .groupBy("source", "x.measure", "x.length")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    by = Window.partitionBy("source", "measure")
    reach = by.orderBy(F.col("length").desc()).rowsBetween(Window.unboundedPreceding, 0)
    near = by.orderBy("length").rangeBetween(-NEIGHBOURS, NEIGHBOURS)
    h = histogram.withColumn("reached", F.sum("n").over(reach))
    # the neighbours' hazard, smoothed; lengths nobody has add exposure but no ends
    h = h.withColumn("ends_near", F.sum("n").over(near) - F.col("n")).withColumn(
        "exposed", F.greatest(F.col("reached"), F.lit(1)) * F.lit(2 * NEIGHBOURS)
    )
    h = h.withColumn("hazard", F.col("n") / F.col("reached")).withColumn("around", (F.col("ends_near") + F.lit(1.0)) / (F.col("exposed") + F.lit(1.0)))

    def tail(n: pd.Series, reached: pd.Series, around: pd.Series) -> pd.Series:
        return pd.Series([upper_tail(int(a), int(b), float(c)) for a, b, c in zip(n, reached, around, strict=True)], dtype="float64")

    p_value = F.pandas_udf(tail, "double")
    h = h.withColumn("p_value", p_value("n", "reached", "around"))
    # Benjamini-Hochberg within each source and measure
    ranked = by.orderBy("p_value", "length")
    h = h.withColumn("rank", F.row_number().over(ranked)).withColumn("tests", F.count(F.lit(1)).over(by))
    passes = F.when(F.col("p_value") <= F.lit(FALSE_DISCOVERY) * F.col("rank") / F.col("tests"), F.col("rank")).otherwise(0)
    h = h.withColumn("last", F.max(passes).over(by))
    limit = (F.col("rank") <= F.col("last")) & (F.col("n") >= LEAST_EXCESS) & (F.col("hazard") > 2 * F.col("around"))
    return h.select("source", "measure", "length", "n", "hazard", "around", "p_value", limit.alias("limit"))


def upper_tail(n: int, trials: int, p: float) -> float:
    """P(X >= n) for X Poisson with mean trials * p, summed in logarithms."""
    mean = trials * min(max(p, 1e-12), 1.0)
    if n <= mean:
        return 1.0
    term = -mean + n * math.log(mean) - math.lgamma(n + 1)
    total, k = 1.0, 1.0
    for i in range(1, 200):
        k *= mean / (n + i)
        total += k
        if k < 1e-12:
            break
    return min(1.0, math.exp(term) * total)


def truncated(documents: DataFrame) -> DataFrame:
    """doc_id, source, chars, bytes, at_limit, cut, reason for every text that isn't null or blank.

    ``reason`` is "limit", "transfer" or null.  Repeated rows stay; a null source
    is a source of its own.
    """
    ends = materialise(endings(documents), "endings")
    evidence = documents.sparkSession.sparkContext.broadcast(corpus_evidence(documents, ends))
    limits = length_limits(ends).where("limit")
    flagged = ends
    for measure in ("chars", "bytes"):
        at = limits.where(F.col("measure") == measure).select(F.col("source").alias("__s"), F.col("length").alias("__l")).withColumn(f"at_{measure}", F.lit(True))
        flagged = flagged.join(at, F.col("source").eqNullSafe(F.col("__s")) & (F.col(measure) == F.col("__l")), "left").drop("__s", "__l")
    flagged = flagged.withColumn("at_limit", F.coalesce("at_chars", F.lit(False)) | F.coalesce("at_bytes", F.lit(False)))

    def why(unit: pd.Series, closed: pd.Series, at_limit: pd.Series) -> pd.Series:
        known = evidence.value
        return pd.Series([known.reason(u, c, a) for u, c, a in zip(unit, closed, at_limit, strict=True)], dtype=object)

    reason = F.pandas_udf(why, "string")
    flagged = flagged.select("doc_id", "source", "chars", "bytes", "at_limit", reason("unit", "closed", "at_limit").alias("reason"))
    return flagged.select("doc_id", "source", "chars", "bytes", "at_limit", F.col("reason").isNotNull().alias("cut"), "reason")


def truncation_report(documents: DataFrame) -> DataFrame:
    """source, texts, cut, at_limit, share of every source."""
    t = truncated(documents)
    return t.groupBy("source").agg(
        F.count(F.lit(1)).alias("texts"),
        F.count_if("cut").alias("cut"),
        F.count_if(F.col("reason") == "limit").alias("at_limit"),
        (F.count_if("cut") / F.count(F.lit(1))).alias("share"),
    )
