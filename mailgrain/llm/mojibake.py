"""Garbled text from a wrong character encoding: a best-first search for the original.

From a token the search walks over encode, decode and unescape operations.
States are texts and byte strings, kept by hash with the least price they were
reached at and opened again where a cheaper way turns up; the state that promises
the cheapest text is expanded first.  The cost of a text is its length in bits
under a character-pair model counted over all rows of the data, so plausible is
what the corpus itself writes.  No operation touches ASCII but the unescapes, so
what the ASCII part of a text costs is a lower bound for all that can be reached
from it; states whose bound isn't below the best text found are left out.  The
search thus ends with the cheapest reachable text.  A token is garbled if that
text is cheaper than the token by ``MIN_GAIN`` bits after the price of every
step, or if it holds a replacement character, where letters are lost for good.
"""

from __future__ import annotations

import functools
import heapq
import html
import math
import re
import unicodedata
import urllib.parse
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailgrain.llm import confusables
from mailgrain.runtime import materialise, spread

#: Encodings a text may have been read in by mistake, and those it may really be in.
READ_AS = ("cp1252", "cp1250", "cp1251", "cp1253", "cp1254", "cp437", "cp850", "cp866", "mac_roman", "koi8_r", "iso8859_2", "iso8859_5", "iso8859_7", "iso8859_15")
WRITTEN_IN = ("utf-8", "cp1252", "cp1250", "cp1251", "cp1253", "cp437", "cp850", "cp866", "mac_roman", "koi8_r", "iso8859_7")
MIN_GAIN = 4.5
#: Price of a step into UTF-8 (its well-formedness is evidence of its own), of the first other one (the k-th costs k times
#: as much, as texts are seldom misread again and again without UTF-8), and of an unescape.
UTF8_BITS, STEP_BITS, ESCAPE_BITS = 0.0, 10.0, 2.0
#: Pairs of an encode and a decode, or unescapes, that a text may have gone through.
MAX_STEPS = 4
#: Code points that the model knows one by one; all others stand for their page of 256 or their plane.
OWN_RANGES = ((0x0000, 0x0600), (0x2000, 0x2600))
UNSEEN_COUNT = 0.3
#: What a sign costs besides that no text of the corpus holds: it is one of some thousand.
UNKNOWN_SIGN_BITS = 12.0
LOST = "�"

_DIGITS = re.compile(r"[0-9]+")
_ESCAPE = re.compile(r"&(?:#x?[0-9a-fA-F]+|[A-Za-z]+\d*);|\\u[0-9a-fA-F]{4}|%[0-9A-Fa-f]{2}|=[0-9A-F]{2}")
#: Letters that a UTF-8 lead byte shows as, at the end of a token.
_LEAD = re.compile(r"[ÂÃÄÅÎÏÐÑ├┬─Гв√¬]$")
_SUSPECT = re.compile(r"[^\x00-\x7f]|&#?\w+;|\\u[0-9a-fA-F]{4}|%[89A-Fa-f][0-9A-Fa-f]|=[89A-F][0-9A-F]")


@functools.lru_cache(maxsize=65536)
def _class_of(c: str) -> str:
    """Script of a letter ("latin", "greek", "cyrillic", "letter"), or "ascii", "mark", "control", "symbol"."""
    if c < "\x80":
        return "latin" if c.isalpha() else "ascii"
    kind = unicodedata.category(c)
    if kind[0] == "L" and kind != "Lm":
        script = unicodedata.name(c, "LETTER").split()[0].lower()
        return script if script in ("latin", "greek", "cyrillic") else "letter"
    if kind in ("Cc", "Cn", "Co", "Cf"):
        return "control"
    return "mark" if kind[0] == "M" else "symbol"


@functools.lru_cache(maxsize=65536)
def prior_bits(a: str, b: str) -> float:
    """What a pair of neighbours costs whatever the counts: symbols inside words, mixed scripts, controls."""
    x, y = _class_of(a), _class_of(b)
    bits = 10.0 if y == "control" else 0.0
    letters = ("latin", "greek", "cyrillic", "letter")
    if x in letters and y in letters:
        if x != y:
            bits += 8.0
        elif a.islower() and b.isupper():
            bits += 4.0
    elif (x in letters and y == "symbol") or (x == "symbol" and y in letters):
        bits += 3.0
    return bits


@functools.lru_cache(maxsize=65536)
def sign_of(c: str) -> str:
    """The character as the model counts it, in lower case.

    There are at most 3 072 signs of their own, 209 pages and 16 planes, so the
    model holds a bounded number of pairs whatever the data.
    """
    low = c.lower()
    c = low if len(low) == 1 else c
    code = ord(c)
    if any(first <= code < end for first, end in OWN_RANGES):
        return c
    return chr(code & 0xFF00) if code < 0x10000 else chr(code & 0xFF0000)


class Plausibility:
    """Bits of a token: joint frequency of its character pairs and what neighbours cost by kind."""

    def __init__(self, pairs: dict[str, int]):
        total = max(1, sum(pairs.values()))
        self.bits = {pair: math.log2(total / n) for pair, n in pairs.items()}
        self.unseen = math.log2(total / UNSEEN_COUNT)
        # the cheapest pairs of an ASCII sign and any other, by the ASCII sign
        self.into: dict[str, float] = {}
        self.out_of: dict[str, float] = {}
        for (a, b), bits in ((p, x) for p, x in self.bits.items() if len(p) == 2):
            if a < "\x80" <= b:
                self.into[a] = min(bits, self.into.get(a, self.unseen))
            elif b < "\x80" <= a:
                self.out_of[b] = min(bits, self.out_of.get(b, self.unseen))
        self.signs = {c for pair in pairs for c in pair}
        self.known: dict[tuple[str, str], float] = {}

    def _pair(self, a: str, b: str) -> float:
        """Bits of two neighbours as written: their signs, what the second sign leaves open, and what they cost by kind."""
        x, y = sign_of(a), sign_of(b)
        bits = self.bits.get(x + y, self.unseen)
        if y != "\x03" and not b.isascii():
            # a sign that stands for a page or a plane doesn't say which of its members it is
            bits += 0.0 if b < "\u0600" or "\u2000" <= b < "\u2600" else 8.0 if b < "\U00010000" else 16.0
            bits += 0.0 if y in self.signs else UNKNOWN_SIGN_BITS
        return bits + (0.0 if a == "\x02" or b == "\x03" else prior_bits(a, b))

    def cost(self, token: str) -> float:
        """Bits of a token."""
        known, padded = self.known, "\x02" + _DIGITS.sub("0", token) + "\x03"
        bits = 0.0
        for pair in zip(padded, padded[1:], strict=False):
            got = known.get(pair)
            if got is None:
                if len(known) > 500_000:
                    known.clear()
                got = known[pair] = self._pair(*pair)
            bits += got
        return bits

    def bound(self, token: str) -> float:
        """Bits that any text reached by encoding and decoding costs at least.

        Neighbours that are both ASCII stay; every other run of letters stays at
        least one letter beside the same neighbours.  Unescapes change ASCII: bound 0.
        """
        if _ESCAPE.search(token):
            return 0.0
        bits = 0.0
        padded = "\x02" + _DIGITS.sub("0", token).lower() + "\x03"  # lower case touches no ASCII sign's neighbourhood
        get, unseen = self.bits.get, self.unseen
        for a, b in zip(padded, padded[1:], strict=False):
            if a < "\x80":
                bits += get(a + b, unseen) if b < "\x80" else self.into.get(a, unseen)
            elif b < "\x80":
                bits += self.out_of.get(b, unseen)
        return bits


def reads_as_utf8(token: str) -> bool:
    """Whether the token's bytes in some one-byte encoding are well-formed UTF-8 with multi-byte letters."""
    for as_read in READ_AS:
        data = encode(token, as_read)
        if data is not None and decode(data, "utf-8") is not None:
            return True
    return False


def count_pairs(texts: DataFrame, column: str) -> dict[str, int]:
    """Character pairs of all tokens of all rows, by ``sign_of``.

    Tokens that read as UTF-8 or hold a replacement character are left out, so
    that the model isn't fed by what it has to find.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokens: Counter = Counter()
        for batch in batches:
            for text in batch[column]:
                tokens.update(_DIGITS.sub("0", text).split(" "))
        pairs: Counter = Counter()
        for token, n in tokens.items():
            if not token or LOST in token or (not token.isascii() and reads_as_utf8(token)):
                continue
            token = token.lower() if token.isascii() else "".join(map(sign_of, token))
            for pair in zip("\x02" + token, token + "\x03", strict=True):
                pairs["".join(pair)] += n
        yield pd.DataFrame(list(pairs.items()), columns=["pair", "n"])

    rows = texts.select(column).where(F.col(column).isNotNull()).mapInPandas(run, "pair string, n long").groupBy("pair").agg(F.sum("n").alias("n")).collect()
    return {r["pair"]: r["n"] for r in rows}


@functools.lru_cache(maxsize=64)
def _byte_of(encoding: str) -> dict[str, int]:
    """Character -> byte of a one-byte encoding; undefined bytes stand for their Latin-1 control."""
    table = {}
    for b in range(256):
        try:
            c = bytes([b]).decode(encoding)
        except UnicodeDecodeError:
            c = chr(b)
        table.setdefault(c, b)
    for b in range(0x80, 0xA0):
        table.setdefault(chr(b), b)
    return table


@functools.lru_cache(maxsize=64)
def _as_latin(encoding: str) -> dict[int, str]:
    """Translation that shows the bytes of a one-byte encoding as Latin-1; what it can't write is beyond Latin-1."""
    table = {ord(c): chr(b) for c, b in _byte_of(encoding).items()}
    return {code: "\uffff" for code in range(0x80, 0x100) if code not in table} | table


def encode(text: str, encoding: str) -> bytes | None:
    """Bytes of a text in a one-byte encoding, or None."""
    try:
        return text.translate(_as_latin(encoding)).encode("latin-1")
    except UnicodeEncodeError:
        return None


def decode(data: bytes, encoding: str) -> str | None:
    """Text of bytes, or None where they aren't valid."""
    try:
        return data.decode(encoding)
    except UnicodeDecodeError:
        return None


def unescape(text: str) -> Iterator[tuple[str, str]]:
    """(operation, text) for every kind of escape the text holds."""
    if not _ESCAPE.search(text):
        return
    if "&" in text:
        yield "html", html.unescape(text)
    if "\\u" in text:
        yield "backslash", re.sub(r"\\u([0-9a-fA-F]{4})", lambda m: chr(int(m.group(1), 16)), text)
    if "%" in text:
        yield "percent", urllib.parse.unquote(text, errors="replace")
    if "=" in text:
        raw = re.sub(rb"=([0-9A-F]{2})", lambda m: bytes([int(m.group(1), 16)]), text.encode("utf-8"))
        got = decode(raw, "utf-8")
        if got is not None:
            yield "quoted", got


def _key(state: str | bytes) -> int:
    """Hash of a state; a text and its bytes differ."""
    return hash((isinstance(state, bytes), state))


def search(token: str, model: Plausibility, to_beat: float = math.inf) -> tuple[str, tuple[str, ...], float]:
    """(cheapest reachable text, operations, bits gained after the price of the steps).

    Only texts cheaper than ``to_beat`` count; the token itself stays otherwise.
    Texts wait in the queue by cost plus price, byte strings by the bound of the
    text they come from.  A state is opened again if a cheaper way to it is found.
    """
    start = model.cost(token)
    best, best_cost, best_path = token, min(start, to_beat), ()
    tie = 0
    prices: dict[int, float] = {_key(token): 0.0}
    # (bits, tie breaker, state, operations, price so far, bound of the state): only unescapes change the bound
    queue: list[tuple] = [(start, tie, token, (), 0.0, model.bound(token))]

    def reach(text: str, steps: tuple[str, ...], price: float, least: float) -> None:
        nonlocal best, best_cost, best_path, tie
        if not text or prices.get(_key(text), math.inf) <= price:
            return
        prices[_key(text)] = price
        cost = model.cost(text) + price
        if cost < best_cost:
            best, best_cost, best_path = text, cost, steps
        tie += 1
        heapq.heappush(queue, (cost, tie, text, steps, price, least))

    while queue:
        _, _, state, path, price, least = heapq.heappop(queue)
        if prices[_key(state)] < price:
            continue
        if isinstance(state, bytes):
            other = STEP_BITS * (1 + sum(w != "utf-8" and r != w for r, w in zip(path[::2], path[1::2], strict=False)))
            for to in WRITTEN_IN:
                step = UTF8_BITS if to == "utf-8" else other
                if path[-1] == to or least + price + step >= best_cost:
                    continue
                text = decode(state, to)
                if text is not None:
                    reach(text, (*path, to), price + step, 0.0 if _ESCAPE.search(text) else least)
            continue
        if len(path) >= 2 * MAX_STEPS or least + price >= best_cost:
            continue
        for how, text in unescape(state):
            reach(text, (*path, how, how), price + ESCAPE_BITS, model.bound(text))
        if state.isascii():
            continue
        for as_read in READ_AS:
            data = encode(state, as_read)
            if data is None or prices.get(_key(data), math.inf) <= price:
                continue
            prices[_key(data)] = price
            tie += 1
            heapq.heappush(queue, (least + price, tie, data, (*path, as_read), price, least))
    return best, best_path, start - best_cost if best_path else 0.0


class Restorer:
    """Token search with a cache; one per worker and model."""

    def __init__(self, model: Plausibility):
        self.model = model
        self.known = functools.lru_cache(maxsize=100_000)(self._token)

    def _token(self, token: str) -> tuple[str, tuple[str, ...], float]:
        # what a consistent spelling already explains isn't garbled
        plain = self.model.cost(token)
        folded = confusables.transduce(token)[0]
        if folded != token:
            plain = min(plain, sum(self.model.cost(t) for t in folded.split(" ") if t))
        text, path, gain = search(token, self.model, plain - MIN_GAIN)
        return text, path, gain - (self.model.cost(token) - plain) if path else 0.0

    def restore(self, text: str) -> tuple[bool, str | None, str]:
        """(garbled, original text as far as it survives, operations)."""
        if not _SUSPECT.search(text):
            return False, text, ""
        tokens = self.rejoin(text.split(" "))
        found: dict[tuple[str, ...], float] = {}
        out = list(tokens)
        hit = False
        for k, token in enumerate(tokens):
            if not token or not _SUSPECT.search(token):
                continue
            digits = _DIGITS.findall(token)
            got, path, gain = self.known(_DIGITS.sub("0", token))
            if path and gain >= MIN_GAIN:
                hit = True
                found[path] = found.get(path, 0.0) + gain
                parts = re.split("0", got)
                out[k] = "".join(a + b for a, b in zip(parts, [*digits, ""], strict=True)) if len(parts) == len(digits) + 1 else got
        if hit:
            path = max(found, key=found.get)
            for k, token in enumerate(tokens):
                if out[k] == token and _SUSPECT.search(token) and LOST not in token:
                    again = self.apply(token, path)
                    if again is not None and self.model.cost(again) < self.model.cost(token):
                        out[k] = again
        lost = LOST in text
        if not hit and not lost:
            return False, text, ""
        steps = ",".join(">".join(p[i : i + 2]) for p in found for i in range(0, len(p), 2))
        return True, " ".join(out), steps or "lost"

    def rejoin(self, tokens: list[str]) -> list[str]:
        """Tokens with the blank put back that stands for a lost no-break space: a garbled letter may end in one."""
        k = 0
        while k + 1 < len(tokens):
            token = tokens[k]
            if token and not token.isascii() and _LEAD.search(token):
                joined = token + "\u00a0"
                _, path, gain = self.known(_DIGITS.sub("0", joined))
                if path and gain >= MIN_GAIN and gain > self.known(_DIGITS.sub("0", token))[2]:
                    # the next blank belongs to the letter; what follows it is the same token
                    tokens[k : k + 2] = [joined + tokens[k + 1]]
            k += 1
        return tokens

    @staticmethod
    def apply(token: str, path: tuple[str, ...]) -> str | None:
        """The text after a chain of operations, or None where one doesn't apply."""
        for as_read, written in zip(path[::2], path[1::2], strict=True):
            if as_read == written:
                token = dict(unescape(token)).get(as_read, token)
                continue
            data = encode(token, as_read)
            token = None if data is None else decode(data, written)
            if token is None:
                return None
        return token


#: Misreadings whose restoration is measured: (written in, read as) of each step.
MISREADINGS = {
    "utf-8 as cp1252": (("utf-8", "cp1252"),),
    "utf-8 as latin-1": (("utf-8", "latin-1"),),
    "utf-8 as mac_roman": (("utf-8", "mac_roman"),),
    "utf-8 as cp437": (("utf-8", "cp437"),),
    "utf-8 as cp1251": (("utf-8", "cp1251"),),
    "cp1252 as cp437": (("cp1252", "cp437"),),
    "cp1252 as mac_roman": (("cp1252", "mac_roman"),),
    "cp437 as cp1252": (("cp437", "cp1252"),),
    "utf-8 as cp1252 twice": (("utf-8", "cp1252"),) * 2,
    "utf-8 as cp1252, as mac_roman": (("utf-8", "cp1252"), ("utf-8", "mac_roman")),
}


def garble(text: str, steps) -> str | None:
    """The text after misreadings; None where one can't be carried out without loss."""
    for written, read in steps:
        try:
            data = text.encode(written)
        except UnicodeEncodeError:
            return None
        if read == "latin-1":
            text = data.decode("latin-1")
            continue
        table = {b: c for c, b in reversed(_byte_of(read).items())}
        if not all(b in table for b in data):
            return None
        text = "".join(table[b] for b in data)
    return text


def restoration_accuracy(texts: DataFrame, column: str) -> DataFrame:
    """misreading, steps, words, detected, restored: how much of garbled text comes back.

    Every word that isn't garbled and has a letter beyond ASCII is garbled in
    each way of MISREADINGS that loses nothing, and restored with the model of
    the same texts.  Equal words are tried once and counted as often as they occur.
    """
    source = spread(texts.select(F.col(column).alias("text")).where(F.col(column).isNotNull()))
    shared = source.sparkSession.sparkContext.broadcast(count_pairs(source, "text"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        restorer = Restorer(Plausibility(shared.value))
        count: Counter = Counter()
        for batch in batches:
            for text, times in zip(batch["text"], batch["times"], strict=True):
                if restorer.restore(text)[0]:
                    continue
                for name, steps in MISREADINGS.items():
                    bad = garble(text, steps)
                    if bad is None or bad == text:
                        continue
                    garbled, original, _ = restorer.restore(bad)
                    count[name, "words"] += times
                    count[name, "detected"] += times * garbled
                    count[name, "restored"] += times * (original == text)
        yield pd.DataFrame([(name, what, n) for (name, what), n in count.items()], columns=["misreading", "what", "n"])

    # each word once, with how often it occurs: digits survive all misreadings and don't count in the search
    words = source.select(F.explode(F.split(F.regexp_replace("text", "[0-9]", "0"), " ")).alias("text")).where(F.col("text").rlike("[^\\x00-\\x7f]"))
    distinct = words.groupBy("text").agg(F.count(F.lit(1)).alias("times"))
    counted = spread(distinct).mapInPandas(run, "misreading string, what string, n long")
    wide = counted.groupBy("misreading").agg(*[F.sum(F.when(F.col("what") == w, F.col("n")).otherwise(0)).alias(w) for w in ("words", "detected", "restored")])
    depth = F.create_map(*[x for name, steps in MISREADINGS.items() for x in (F.lit(name), F.lit(len(steps)))])
    return wide.select("misreading", F.element_at(depth, F.col("misreading")).alias("steps"), "words", "detected", "restored")


def restored(texts: DataFrame, column: str, keep: list[str]) -> DataFrame:
    """``keep`` plus text, garbled, original and operations of every row whose text isn't null.

    ``original`` equals the text where nothing is garbled; a lost letter stays a
    replacement character.  Empty texts are never garbled; repeated rows stay.
    """
    source = spread(texts.select(*keep, F.col(column).alias("text")).where(F.col(column).isNotNull()))
    pairs = count_pairs(source, "text")
    shared = source.sparkSession.sparkContext.broadcast(pairs)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        restorer = Restorer(Plausibility(shared.value))
        for batch in batches:
            got = [restorer.restore(t) for t in batch["text"]]
            batch = batch.copy()
            batch["garbled"] = [g[0] for g in got]
            batch["original"] = pd.Series([g[1] for g in got], dtype=object, index=batch.index)
            batch["operations"] = pd.Series([g[2] for g in got], dtype=object, index=batch.index)
            yield batch

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields)
    return source.mapInPandas(run, f"{schema}, garbled boolean, original string, operations string")


def garbled_headers(mail_headers: DataFrame, attachment_part: DataFrame) -> DataFrame:
    """fld, row_id, text, garbled, original, operations of subjects, senders and file names."""
    return restored(confusables.header_texts(mail_headers, attachment_part, sender=True), "text", ["fld", "row_id"])


def deviating_headers(mail_headers: DataFrame, attachment_part: DataFrame) -> DataFrame:
    """fld, row_id, text, normal, kinds of subjects and file names that deviate and aren't garbled."""
    texts = confusables.header_texts(mail_headers, attachment_part)
    found = confusables.normalise(texts, "text", ["fld", "row_id"]).where(F.size("kinds") > 0)
    found = materialise(found, "deviating")
    pairs = count_pairs(spread(confusables.header_texts(mail_headers, attachment_part, sender=True)), "text")
    shared = found.sparkSession.sparkContext.broadcast(pairs)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        restorer = Restorer(Plausibility(shared.value))
        for batch in batches:
            yield batch[[not restorer.restore(t)[0] for t in batch["text"]]]

    return found.mapInPandas(run, found.schema)
