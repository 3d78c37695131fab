"""Visually identical text with different characters, brought to one form.

A longest-match transducer reads a text once, grapheme cluster by grapheme
cluster.  Its mapping is compiled by rule from the Unicode character database
(widths, ligatures, letter-like signs, composable accents, blanks, hyphens,
invisible characters) plus a list of look-alike letters and what composes from
them, and checked for conflicts: no key twice with different outputs, no output
that holds a key, no look-alike that is a key of its own.  Entries of look-alikes
hold only inside a word that also has Latin letters, so the word is buffered
until it ends.
"""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailgrain.runtime import spread

KINDS = ("width", "accent", "invisible", "blank", "hyphen", "script")

# Letters of other scripts that look like a Latin letter, and that letter.
LOOKALIKES = dict(
    zip(
        "АВЕЅІЈКМНОРСТУХԚԜҮԌѴасԁеһіјӏорԛѕԝхуүѡѵ" "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹϜαινορυχγϲϳ" "ՏՕԼՍոսցհօզյառ" "ᎪᏴᏟᎬᎻᎫᏦᏞᎷᏢᏒᏚᎢᏙᎳᏃᎠᎡᎽᏀᏔᏕᏤᏳ",
        "ABESIJKMHOPCTYXQWYGVacdehijlopqswxyywv" "ABEZHIKMNOPTYXCFaivopuxycj" "SOLUnughoqjwn" "ABCEHJKLMPRSTVWZDRYGWSVG",
        strict=True,
    )
)
HYPHENS = "‐‑﹣－֊᠆"
#: Code point ranges that show nothing.
INVISIBLE_RANGES = (
    (0x00AD, 0x00AD), (0x034F, 0x034F), (0x061C, 0x061C), (0x115F, 0x1160), (0x17B4, 0x17B5), (0x180B, 0x180E),
    (0x200B, 0x200F), (0x202A, 0x202E), (0x2060, 0x2064), (0x2066, 0x206F), (0x3164, 0x3164), (0xFEFF, 0xFEFF),
    (0xFFA0, 0xFFA0), (0xE0001, 0xE0001), (0xE0020, 0xE007F),
)

_CLUSTER = regex.compile(r"\X")
_LATIN = regex.compile(r"\p{Latin}")
_FOREIGN = regex.compile(r"[\p{L}--[\p{Latin}\p{Common}\p{Inherited}]]", regex.V1)
_EMOJI = regex.compile(r"\p{Extended_Pictographic}")
_JOINING = regex.compile(r"[\p{Arabic}\p{Syriac}\p{Mongolian}\p{Devanagari}\p{Bengali}\p{Tamil}\p{Telugu}\p{Kannada}\p{Malayalam}\p{Sinhala}\p{Khmer}\p{Hebrew}]")
_ASCII_ALNUM = frozenset("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")


def _is_accent(c: str) -> bool:
    return unicodedata.combining(c) > 0 and (0x0300 <= ord(c) <= 0x036F or 0x1AB0 <= ord(c) <= 0x1AFF or 0x1DC0 <= ord(c) <= 0x1DFF)


def _mapping_of(c: str) -> tuple[str, str] | None:
    """(kind, output) of one character by rule, or None."""
    if c in HYPHENS:
        return "hyphen", "-"
    kind = unicodedata.category(c)
    if kind == "Zs" and c != " ":
        return "blank", " "
    how, _, _ = unicodedata.decomposition(c).partition(" ")
    flat = unicodedata.normalize("NFKC", c)
    if how in ("<wide>", "<narrow>", "<font>"):
        return ("width", flat) if flat != c else None
    if how == "<compat>" and kind[0] in "LN" and set(flat) <= _ASCII_ALNUM:
        return "width", flat
    if how and not how.startswith("<"):  # canonical: one sign for another, such as Kelvin for K
        single = unicodedata.normalize("NFC", c)
        if single != c and len(single) == 1 and not unicodedata.combining(c):
            return "width", single
    return None


#: Keys of the leaves of the trie: of entries that always hold, and of those that hold in a word with Latin letters.
ALWAYS, IN_WORD = "", "word"


def lookalike_map() -> dict[str, str]:
    """Look-alike letters and what they compose to, such as і with dots for ï."""
    out = dict(LOOKALIKES)
    for code in range(0x370, 0x2000):
        full = unicodedata.normalize("NFD", chr(code))
        if len(full) > 1 and full[0] in LOOKALIKES and all(map(_is_accent, full[1:])):
            single = unicodedata.normalize("NFC", LOOKALIKES[full[0]] + full[1:])
            if len(single) == 1:
                out[unicodedata.normalize("NFC", chr(code))] = single
    return out


@functools.lru_cache(maxsize=1)
def compiled() -> tuple[dict, dict[str, tuple[str, str]]]:
    """(trie, flat mapping), conflict-checked.  Look-alikes are in the flat mapping under the kind "script"."""
    flat: dict[str, tuple[str, str]] = {}

    def add(key: str, kind: str, out: str) -> None:
        if flat.setdefault(key, (kind, out)) != (kind, out):
            raise ValueError(f"two outputs for {key!r}")

    unseen = {chr(code) for low, high in INVISIBLE_RANGES for code in range(low, high + 1)}
    for code in range(0x80, 0x30000):
        c = chr(code)
        got = None if c in unseen else _mapping_of(c)
        if got:
            add(c, *got)
        pair = unicodedata.decomposition(c)
        if pair and not pair.startswith("<") and " " in pair and unicodedata.normalize("NFC", c) == c:
            full = unicodedata.normalize("NFD", c)
            if _is_accent(full[-1]):
                add(full, "accent", c)
                partly = "".join(chr(int(x, 16)) for x in pair.split())
                if partly != full:
                    add(partly, "accent", c)
    for c in unseen:
        add(c, "invisible", "")
    for key, (_, out) in flat.items():
        if any(c in flat for c in out):
            raise ValueError(f"output of {key!r} is itself mapped")
    similar = lookalike_map()
    for key, out in similar.items():
        if key in flat or out in flat or out in similar or not _LATIN.fullmatch(out):
            raise ValueError(f"look-alike {key!r} conflicts with another entry")
        flat[key] = "script", out
    trie: dict = {}
    for key, leaf in flat.items():
        node = trie
        for c in key:
            node = node.setdefault(c, {})
        node[IN_WORD if leaf[0] == "script" else ALWAYS] = leaf
    return trie, flat


@functools.lru_cache(maxsize=65536)
def read_cluster(cluster: str, in_word: bool = False) -> tuple[str, frozenset[str]]:
    """Output and kinds of one grapheme cluster by longest match; ``in_word`` takes look-alikes too."""
    if cluster.isascii():
        return cluster, frozenset()
    trie, _ = compiled()
    shown = "".join(c for c in cluster if trie.get(c, {}).get(ALWAYS, ("",))[0] != "invisible")
    keeps_joiners = bool(_EMOJI.search(shown) or _JOINING.search(shown))
    out, kinds, i = [], set(), 0
    while i < len(cluster):
        node, best, j = trie, None, i
        while j < len(cluster) and cluster[j] in node:
            node = node[cluster[j]]
            j += 1
            if ALWAYS in node:
                best = j, node[ALWAYS]
            elif in_word and IN_WORD in node:
                best = j, node[IN_WORD]
        if best and not (keeps_joiners and best[1][0] == "invisible"):
            kinds.add(best[1][0])
            out.append(best[1][1])
            i = best[0]
            continue
        if _is_accent(cluster[i]):
            kinds.add("accent")
        out.append(cluster[i])
        i += 1
    text = "".join(out)
    if "accent" in kinds or len(text) > 1:
        text = unicodedata.normalize("NFC", text)
    return text, frozenset(kinds)


def transduce(text: str) -> tuple[str, frozenset[str]]:
    """(consistent form, kinds of deviation found); one pass over the clusters."""
    if text.isascii():
        return text, frozenset()
    out: list[str] = []
    kinds: set[str] = set()
    word: list[str] = []
    latin = foreign = False

    def end_word() -> None:
        nonlocal latin, foreign
        if latin and foreign:
            kinds.add("script")
            out.extend(read_cluster(w, True)[0] for w in word)
        else:
            out.extend(word)
        word.clear()
        latin = foreign = False

    for cluster in _CLUSTER.findall(text):
        mapped, found = read_cluster(cluster)
        kinds |= found
        if mapped and all(c.isalpha() or unicodedata.combining(c) for c in mapped):
            word.append(mapped)
            latin = latin or bool(_LATIN.search(mapped))
            foreign = foreign or bool(_FOREIGN.search(mapped))
        elif mapped:
            end_word()
            out.append(mapped)
    end_word()
    return "".join(out), frozenset(kinds)


def normal_form(text: str | None) -> str | None:
    """Consistent form of a text; null stays null."""
    return None if text is None else transduce(text)[0]


def normalise(df: DataFrame, column: str, keep: list[str]) -> DataFrame:
    """``keep`` plus ``text``, ``normal`` and ``kinds`` (sorted names) of every row.

    Null texts give null ``normal`` and empty ``kinds``; repeated rows stay.
    Only rows with a character beyond ASCII pay for the transducer.
    """
    source = spread(df.select(*keep, F.col(column).alias("text")))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            got = [(None, frozenset()) if t is None else transduce(t) for t in batch["text"]]
            batch = batch.copy()
            batch["normal"] = pd.Series([g[0] for g in got], dtype=object, index=batch.index)
            batch["kinds"] = pd.Series([sorted(g[1]) for g in got], dtype=object, index=batch.index)
            yield batch

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields)
    return source.mapInPandas(run, f"{schema}, normal string, kinds array<string>")


def header_texts(mail_headers: DataFrame, attachment_part: DataFrame, sender: bool = False) -> DataFrame:
    """fld, row_id, text of subjects and file names, and of senders if asked."""
    fields = [("subject", "subject")] + ([("from_", "from_")] if sender else [])
    heads = mail_headers.select(
        F.explode(F.array(*[F.struct(F.lit(n).alias("fld"), F.col("hdr_id").alias("row_id"), F.col(c).alias("text")) for n, c in fields])).alias("x")
    ).select("x.*")
    names = attachment_part.select(F.lit("filename").alias("fld"), F.col("part_id").alias("row_id"), F.col("filename").alias("text"))
    return heads.unionByName(names)
