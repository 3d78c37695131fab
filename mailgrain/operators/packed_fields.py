"""Several values packed in one field: dialect choice by minimum description length.

A *dialect* says which characters separate values and whether double quotes
quote or are plain characters.  One pass over the data tokenises each field under
either quoting, lets every dialect propose a parse, and writes the parses with
the types of their values (bare address, display name plus address, quoted name,
...).  Type and dialect frequencies are then counted over the whole corpus, and
each field takes the parse with the shortest code under them: a value costs the
code length of its type, what fits no type is coded letter by letter, which is
dear.  Counting and choice are built-in expressions over the written parses; the
counts have at most ``len(TYPES) + len(DIALECTS)`` rows, whatever the size of the
data.
"""

from __future__ import annotations

import functools
import math
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailgrain.runtime import materialise, spread

#: name -> separators.  A blank separates only after a complete value.
SEPARATORS: dict[str, str] = {
    "comma": ",",
    "semicolon": ";",
    "pipe": "|",
    "slash": "/",
    "tab": "\t",
    "line": "\n",
    "blank": " ",
    "comma_semicolon": ",;",
    "list": ",;\t\n",
    "any": ",;|/\t\n",
    "any_blank": ",;|/\t\n ",
}
#: Dialects: separators with double quotes that quote, and the same with double quotes as plain characters.
DIALECTS: dict[str, tuple[str, bool]] = {n: (s, True) for n, s in SEPARATORS.items()} | {f"{n}_unquoted": (s, False) for n, s in SEPARATORS.items()}

TYPES = (
    "empty", "bare", "angle", "single_quoted", "quoted_local", "name_angle", "quoted_name_angle",
    "single_name_angle", "comment_angle", "bare_comment", "last_first_angle", "self_name", "group", "junk",
)

LITERAL_BITS = 6.5

_QUOTES = r"""(?P<qaddr>(?:mailto:)?"(?:\\.|[^"\\])*"@[\w.-]+)|(?P<dq>"(?:\\.|[^"\\])*")|"""
_REST = (
    r"(?P<sq>'(?:\"[^\"]*\"|[^'\s<>,;\"]+)@[^'\s<>,;\"]+')"
    r"|(?P<comment>\((?:\\.|[^()\\]|\([^()]*\))*\))"
    r"|(?P<angle><[^<>]*>)"
    r"|(?P<addr>(?:mailto:)?[^\s,;|/<>()\"':@]+(?:'[^\s,;|/<>()\"':@]+)*@[\w-]+(?:\.[\w-]+)*)"
    r"|(?P<delim>[,;|/])"
    r"|(?P<space>\s+)"
    r"|(?P<colon>:)"
    r"|(?P<word>[^\s,;|/<>()\":]+)"
    r"|(?P<other>.)"
)
_TOKEN = re.compile(_QUOTES + _REST, re.IGNORECASE | re.DOTALL)
_TOKEN_UNQUOTED = re.compile(_REST.replace("(?P<word>", '(?P<word>"|'), re.IGNORECASE | re.DOTALL)
#: Token kinds as one letter each; see ``shape_of``.
_LETTER = {"qaddr": "q", "dq": "d", "sq": "s", "comment": "c", "addr": "m", "colon": ":", "word": "w", "other": "o"}
_HOLDS = frozenset("qsame")
_NAMED = {"m": "bare", "a": "angle", "s": "single_quoted", "q": "quoted_local"}


def tokenise(text: str, quoted: bool = True) -> list[tuple[str, str]]:
    """Tokens of a packed field as (kind, text), double quotes quoting or not."""
    return [(m.lastgroup, m.group()) for m in (_TOKEN if quoted else _TOKEN_UNQUOTED).finditer(text)]


def _bare(kind: str, text: str) -> str:
    text = text.strip()
    if kind == "angle":
        text = text[1:-1].strip()
    if len(text) > 1 and text[0] == text[-1] == "'":
        text = text[1:-1].strip()
    if text[:7].lower() == "mailto:":
        text = text[7:]
    return text.strip().lower()


def shape_of(tokens: list[tuple[str, str]]) -> str:
    """One letter per token, all that parsing depends on.

    q s m: quoted, single-quoted and plain address; a: bracketed address, e: the
    same one as the plain address before it, A: brackets without address; d:
    quoted string, D: one that holds a bracketed address; c w o: comment, word,
    anything else; a delimiter and a colon stand for themselves, white space for
    a blank, tab, line break or (B) both of these.
    """
    out = []
    last = None
    for kind, text in tokens:
        if kind == "delim":
            out.append(text)
        elif kind == "space":
            out.append(" " if text == " " else {(True, True): "B", (True, False): "\n", (False, True): "\t"}.get(("\n" in text, "\t" in text), " "))
        elif kind == "angle":
            if "@" not in text:
                out.append("A")
            else:
                out.append("e" if last is not None and last[0] == "addr" and _bare(*last) == _bare(kind, text) else "a")
                last = kind, text
        else:
            out.append("D" if kind == "dq" and _HIDDEN.search(text) else _LETTER[kind])
            if kind in ("addr", "sq", "qaddr"):
                last = kind, text
    return "".join(out)


def _classify(kinds: str, at: list[int]) -> tuple[str, int | None, tuple[int, ...]]:
    """(type, place of the address, places to code letter by letter) of one value without blanks."""
    if not kinds:
        return "empty", None, ()
    holders = [k for k, kind in zip(at, kinds, strict=True) if kind in _HOLDS]
    if kinds == "me":
        return "self_name", holders[1], ()
    if kinds in ("sa", "se"):
        return "single_name_angle", holders[1], ()
    if len(holders) != 1:
        return "junk", None, tuple(at)
    place = holders[0]
    if len(kinds) == 1:
        return _NAMED["a" if kinds == "e" else kinds], place, ()
    if kinds[-1] in "aeA":
        head = kinds[:-1]
        if head in ("d", "D"):
            return "quoted_name_angle", place, ()
        if set(head) <= set("wdD"):
            return "name_angle", place, ()
        if "c" in head and set(head) <= set("wdDc"):
            return "comment_angle", place, ()
        if head[0] == head[-1] == "w" and set(head) <= set("w,") and head.count(",") == 1:
            return "last_first_angle", place, ()
    if kinds[-1] == "c" and len(kinds) == 2:
        return "bare_comment", place, ()
    return "junk", place, tuple(at)


_Value = tuple[str, int | None, tuple[int, ...]]
#: Values of a stretch without other separators where blanks separate: up to the first blank after an address that no comment or delimiter follows.
_BY_BLANK = re.compile(r"[^qsmaeA]*[qsmaeA][^ \t\nB]*(?:[ \t\nB](?:[c,;|/][^ \t\nB]*|$))*[ \t\nB]?|[^qsmaeA]+$")


@functools.lru_cache(maxsize=65_536)
def _segment(segment: str) -> _Value:
    """``_classify`` of a stretch of a shape, by places within it."""
    at = [k for k, c in enumerate(segment) if c not in " \t\nB"]
    return _classify("".join(segment[k] for k in at), at)


@functools.lru_cache(maxsize=64)
def _splitter(separators: str) -> re.Pattern:
    return re.compile("[" + re.escape(separators.replace(" ", "")) + ("B" if set(separators) & set("\t\n") else "") + "]")


@functools.lru_cache(maxsize=64)
def _blank_splits(separators: str) -> re.Pattern:
    """Where a blank may end a value: behind an address of the same stretch, no comment or delimiter next."""
    inner = "[^" + re.escape(separators) + ("B" if set(separators) & set("\t\n") else "") + "]" if separators else "(?:.|\n)"
    return re.compile(f"[qsmaeA]{inner}*?[ \\t\\nB](?=[^c,;|/])")


def parse(shape: str, separators: str) -> list[_Value]:
    """Values of a field's shape under one dialect, by places of its tokens; stretch by stretch unless there are groups."""
    if ":" in shape:
        return parse_by_token(shape, separators)
    plain, by_blank = separators.strip(" "), " " in separators
    values: list[_Value] = []
    waiting, waits_at = "", 0
    begin = 0
    for stretch in _splitter(plain).split(shape) if plain else [shape]:
        at = begin
        for piece in _BY_BLANK.findall(stretch) or (stretch,) if by_blank else (stretch,):
            if waiting:
                kind, place, _ = _segment(f"{waiting},{piece}")
                if kind == "last_first_angle":
                    values.append((kind, place - len(waiting) - 1 + at, ()))
                    waiting = ""
                    at += len(piece)
                    continue
                values.append(("junk", None, tuple(k + waits_at for k in _segment(waiting)[2])))
                waiting = ""
            got = kind, place, literal = _segment(piece)
            if literal:
                if piece.strip("w \t\nB") == "":
                    waiting, waits_at = piece, at
                else:
                    values.append((kind, None if place is None else place + at, tuple(k + at for k in literal)))
            elif place is None:
                values.append(got)
            else:
                values.append((kind, place + at, literal))
            at += len(piece)
        begin += len(stretch) + 1
    if waiting:
        values.append(("junk", None, tuple(k + waits_at for k in _segment(waiting)[2])))
    return values


def parse_by_token(shape: str, separators: str) -> list[_Value]:
    """``parse`` token by token.

    A name part without an address is joined to the next value when both make
    "Last, First <address>"; the comma between them is place -1.  A group name
    opens a group, ";" closes it.
    """
    values: list[tuple[str, int | None, tuple[int, ...]]] = []
    part: list[int] = []
    grouped = complete = False
    waiting: list[int] = []

    def kinds(at: list[int]) -> str:
        return "".join("," if k < 0 else shape[k] for k in at)

    def close() -> None:
        nonlocal part, waiting, complete
        body, part, complete = part, [], False
        if waiting:
            joined, before = [*waiting, -1, *body], waiting
            waiting = []
            got = _classify(kinds(joined), joined)
            if got[0] == "last_first_angle":
                values.append(got)
                return
            values.append(_classify(kinds(before), before))
        if body and set(kinds(body)) == {"w"}:
            waiting = body
            return
        values.append(_classify(kinds(body), body))

    for i, kind in enumerate(shape):
        if kind in " \t\nB":
            if (kind in "\nB" and "\n" in separators) or (kind in "\tB" and "\t" in separators):
                close()
            elif " " in separators and complete and shape[i + 1 : i + 2] not in ("", "c", ",", ";", "|", "/"):
                close()
            continue
        if kind in ",;|/" and (kind in separators or (grouped and kind == ";")):
            if kind == ";" and grouped and ";" not in separators:
                grouped = False
            close()
            continue
        if kind == ":" and part and not complete and not waiting and set(kinds(part)) <= set("wdD"):
            values.append(("group", None, ()))
            part, grouped = [], True
            continue
        part.append(i)
        complete = complete or kind in "qsmaeA"
    close()
    if waiting:
        values.append(_classify(kinds(waiting), waiting))
    return values


#: Fields of one plain value, which every dialect reads alike: type -> form.
_SINGLE = re.compile(
    r"(?P<bare>(?:mailto:)?[\w.+-]+@[\w-]+(?:\.[\w-]+)*)|(?P<angle><[^<>\"'@]+@[^<>\"'@]+>)"
    r"|(?P<name_angle>[^\W\d_][\w.-]*(?: [^\W\d_][\w.-]*)* <[^<>\"'@]+@[^<>\"'@]+>)"
    r'|(?P<quoted_name_angle>"(?:\\.|[^"\\])*" <[^<>"\'@]+@[^<>"\'@]+>)'
)


def plain_value(text: str) -> tuple[str, str] | None:
    """(type, address) of a field of one plain value, which all dialects read alike; None for any other."""
    single = _SINGLE.fullmatch(text)
    if not single:
        return None
    kind = single.lastgroup
    return kind, _bare("addr", text) if kind == "bare" else _bare("angle", text[text.rindex("<") :])


@functools.lru_cache(maxsize=50_000)
def parses_of(shape: str, quoted: bool) -> tuple[tuple[tuple[tuple[str, int], ...], tuple[int, ...], tuple[int, ...], tuple[str, ...]], ...]:
    """Distinct parses of a shape: (value types with their counts, places coded literally, places of addresses, dialects).

    Dialects that differ only in separators the field doesn't hold share one
    parse; those whose separators it doesn't hold at all are left to the first.
    Texts are many, shapes few, so parses are remembered by shape.
    """
    present = set(shape) & set(",;|/") | {c for k in shape for c in {" ": " ", "\t": "\t", "\n": "\n", "B": "\t\n"}.get(k, "")}
    seen: dict[frozenset, tuple] = {}
    out: dict[tuple, list[str]] = {}
    for name, (separators, quotes) in DIALECTS.items():
        if quotes != quoted:
            continue
        active = frozenset(present & set(separators))
        if " " in active and not _blank_splits("".join(sorted(active - {" "}))).search(shape):
            active -= {" "}
        if not active and (not quoted or out):
            continue
        if active not in seen:
            counts: dict[str, int] = {}
            literal, places = [], []
            for kind, place, letters in parse(shape, separators):
                counts[kind] = counts.get(kind, 0) + 1
                if place is not None:
                    places.append(place)
                if letters:
                    literal += letters
            seen[active] = tuple(counts.items()), tuple(literal), tuple(places)
        out.setdefault(seen[active], []).append(name)
    return tuple((*parsed, tuple(names)) for parsed, names in out.items())


def parses(text: str) -> list[tuple[tuple[tuple[str, int], ...], int, list[str], tuple[str, ...]]]:
    """Distinct parses of a field: (value types with counts, letters coded literally, addresses, dialects)."""
    plain = plain_value(text)
    return [(((plain[0], 1),), 0, [plain[1]], ("comma",))] if plain else all_parses(text)


def all_parses(text: str) -> list[tuple[tuple[tuple[str, int], ...], int, list[str], tuple[str, ...]]]:
    """``parses`` by tokens, whatever the field holds.

    Double quotes are tried as plain characters only where every parse in which
    they quote leaves letters to be coded literally: with none left, a parse costs
    less than one that pays for each quote as a letter.
    """
    out = []
    for quoted in (True, False) if '"' in text else (True,):
        if not quoted and any(letters == 0 for _, letters, _, _ in out):
            break
        tokens = tokenise(text, quoted)
        bare: dict[int, str] = {}
        shape = shape_of(tokens)
        # what quotes hide is coded letter by letter, and so are the quotes where they don't quote
        hidden = sum(len(tokens[k][1]) for k, c in enumerate(shape) if c == "D") if quoted else text.count('"')
        for types, literal, places, dialects in parses_of(shape, quoted):
            letters = sum(len(tokens[k][1]) if k >= 0 else 1 for k in literal)
            for k in places:
                if k not in bare:
                    bare[k] = _bare(*tokens[k])
            out.append((types, hidden + letters, [bare[k] for k in places], dialects))
    return out


#: A quoted string that holds a bracketed address is no name: its letters are coded one by one.
_HIDDEN = re.compile(r"<[^<>\s]+@[^<>\s]+>")
#: Signs between the parses of a field, the parts of a parse, and its addresses.
_NEXT_PARSE, _NEXT_PART, _NEXT_ADDRESS = "\x1d", "\x1e", "\x1f"
_TYPE_SIGN = {t: chr(97 + k) for k, t in enumerate(TYPES)}
_DIALECT_SIGN = {d: chr(65 + k) for k, d in enumerate(DIALECTS)}
_EQUAL_BITS = math.log2(len(TYPES))
_SEPARATOR_BITS = {d: 1.0 + math.log2(len(s)) for d, (s, _) in DIALECTS.items()}


#: What stands for one of these signs, and for the sign it begins with, inside an address.
_INSIDE = {"\x1c": "\x1c0", _NEXT_PARSE: "\x1c1", _NEXT_PART: "\x1c2", _NEXT_ADDRESS: "\x1c3"}


def _kept(address: str) -> str:
    return address.translate({ord(k): v for k, v in _INSIDE.items()}) if not address.isprintable() else address


def _given_back(address: Column) -> Column:
    out = address
    for sign, inside in reversed(_INSIDE.items()):
        out = F.replace(out, F.lit(inside), F.lit(sign))
    return F.when(address.contains("\x1c"), out).otherwise(address)


def written(text: str, min_values: int) -> tuple[str, str]:
    """(parses of a field as one string, types and dialect of the parse that is cheapest under equal code lengths).

    A parse holds value count, types with counts, literal letters, dialects and
    addresses; the latter are left out if there are fewer than ``min_values``.
    """
    out, first = [], None
    for types, literal, found, dialects in parses(text):
        n = sum(k for _, k in types)
        counted = ",".join(f"{_TYPE_SIGN[t]}{k}" for t, k in types)
        addresses = _NEXT_ADDRESS.join(map(_kept, found)) if len(found) >= min_values else ""
        out.append(_NEXT_PART.join((str(n), counted, str(literal), "".join(map(_DIALECT_SIGN.get, dialects)), addresses)))
        for d in dialects:
            bits = round(n * _EQUAL_BITS + literal * LITERAL_BITS + _SEPARATOR_BITS[d] * (n - 1), 9)
            if first is None or (bits, _DIALECT_SIGN[d]) < first[:2]:
                first = bits, _DIALECT_SIGN[d], counted
    return _NEXT_PARSE.join(out), first[1] + first[2]


def parsed_fields(fields: DataFrame, column: str, keep: list[str], min_values: int = 1) -> DataFrame:
    """``keep``, ``parses`` and ``first`` (see ``written``) of every field, by one pass over the texts."""
    source = spread(fields.select(*keep, F.col(column).alias("__packed")).where(F.col("__packed").contains("@")))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [written(x, min_values) for x in batch["__packed"]]
            out = batch[keep].copy()
            out["parses"] = [r[0] for r in rows]
            out["first"] = [r[1] for r in rows]
            yield out

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields if f.name in keep)
    return source.mapInPandas(run, f"{schema}, parses string, first string")


def code_lengths(counts: dict[str, int], names) -> dict[str, float]:
    """Bits of each name under smoothed counts."""
    total = sum(counts.get(n, 0) + 1 for n in names)
    return {n: -math.log2((counts.get(n, 0) + 1) / total) for n in names}


def _table(bits: dict[str, float], signs: dict[str, str]) -> Column:
    return F.create_map(*[x for k, v in bits.items() for x in (F.lit(signs[k]), F.lit(float(v)))])


def cheapest(types: dict[str, float], dialects: dict[str, float]) -> Column:
    """Struct of cost, dialect sign, types and addresses of the cheapest of ``parses``; ties go to the earlier dialect."""
    of_type, of_dialect = _table(types, _TYPE_SIGN), _table(dialects, _DIALECT_SIGN)
    of_separator = _table(_SEPARATOR_BITS, _DIALECT_SIGN)

    def of_parse(p: Column) -> Column:
        part = F.split(p, _NEXT_PART)
        bits = F.aggregate(F.split(part[1], ","), F.lit(0.0), lambda acc, t: acc + of_type[F.substring(t, 1, 1)] * F.substring(t, 2, 9).cast("int")) + part[2].cast("int") * LITERAL_BITS
        more = part[0].cast("int") - 1
        # dialects of one parse differ by their own bits only: the cheapest of them is enough
        best = F.array_min(F.transform(F.split(part[3], ""), lambda d: F.struct(F.round(of_separator[d] * more + of_dialect[d], 9).alias("bits"), d.alias("dialect"))))
        return F.struct(F.round(bits + best["bits"], 9).alias("cost"), best["dialect"].alias("dialect"), part[1].alias("types"), part[4].alias("addrs"))

    return F.array_min(F.transform(F.split("parses", _NEXT_PARSE), of_parse))


def only_parse() -> Column:
    """Dialect sign, types and addresses of a field with one parse in one dialect, else null; saves scoring it."""
    part = F.split("parses", _NEXT_PART)
    alone = ~F.col("parses").contains(_NEXT_PARSE) & (F.length(part[3]) == 1)
    return F.when(alone, F.struct(F.lit(0.0).alias("cost"), part[3].alias("dialect"), part[1].alias("types"), part[4].alias("addrs")))


def choice(types: dict[str, float], dialects: dict[str, float]) -> Column:
    """``cheapest``, at once where there is nothing to choose."""
    return F.coalesce(only_parse(), cheapest(types, dialects))


def learn_codes(parsed: DataFrame) -> tuple[dict[str, float], dict[str, float]]:
    """Code lengths of value types and dialects, counted over the parses cheapest under equal lengths.

    The driver gets one row per type or dialect name.
    """
    first = parsed.groupBy("first").agg(F.count(F.lit(1)).alias("n")).select("n", F.substring("first", 1, 1).alias("dialect"), F.substr("first", F.lit(2)).alias("types"))
    parts = F.concat(
        F.transform(F.split("types", ","), lambda t: F.struct(F.substring(t, 1, 1).alias("sign"), F.substring(t, 2, 9).cast("long").alias("k"))),
        F.when(F.col("types").rlike("^.1$"), F.array()).otherwise(F.array(F.struct(F.col("dialect").alias("sign"), F.lit(1).cast("long").alias("k")))),
    )
    rows = first.select("n", F.explode(parts).alias("x")).groupBy("x.sign").agg(F.sum(F.col("x.k") * F.col("n")).alias("n")).collect()
    seen = {r["sign"]: r["n"] for r in rows}
    return (
        code_lengths({t: seen.get(_TYPE_SIGN[t], 0) for t in TYPES}, TYPES),
        code_lengths({d: seen.get(_DIALECT_SIGN[d], 0) for d in DIALECTS}, DIALECTS),
    )


def split_packed(fields: DataFrame, column: str, keep: list[str], min_values: int = 1) -> DataFrame:
    """One row per recipient of ``column``.

    Returns ``keep`` plus ``pos`` (from 1, reading order), ``addr`` (bare, lower
    case) and ``dialect``.  Null, empty and address-free fields give no row.
    ``min_values`` keeps only fields with at least so many recipients.  Other
    columns, whatever their names, are not carried.
    """
    parsed = materialise(parsed_fields(fields, column, keep, min_values), "parses")
    types, dialects = learn_codes(parsed)
    names = F.create_map(*[F.lit(x) for d, sign in _DIALECT_SIGN.items() for x in (sign, d)])
    # a field none of whose parses holds enough recipients needs no choice
    worth = parsed.where(F.col("parses").rlike(_NEXT_PART + "[^" + _NEXT_PART + _NEXT_PARSE + "]+(?:" + _NEXT_PARSE + "|$)")) if min_values > 1 else parsed
    chosen = worth.select(*keep, choice(types, dialects).alias("__c")).where(F.length("__c.addrs") > 0)
    rows = chosen.select(*keep, names[F.col("__c.dialect")].alias("dialect"), F.posexplode(F.split("__c.addrs", _NEXT_ADDRESS)).alias("pos", "addr"))
    return rows.select(*keep, (F.col("pos") + 1).alias("pos"), _given_back(F.col("addr")).alias("addr"), "dialect")


def recipients(mail_headers: DataFrame, min_values: int = 1) -> DataFrame:
    """All recipients of ``to_``, ``cc`` and ``bcc``: hdr_id, fld, pos, addr, dialect."""
    stacked = mail_headers.select(
        "hdr_id",
        F.explode(
            F.array(
                *[F.struct(F.lit(n).alias("fld"), F.col(c).alias("packed")) for n, c in (("to", "to_"), ("cc", "cc"), ("bcc", "bcc"))]
            )
        ).alias("f"),
    ).select("hdr_id", "f.fld", "f.packed")
    return split_packed(stacked, "packed", ["hdr_id", "fld"], min_values)
