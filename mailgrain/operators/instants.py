"""Mixed timestamp formats and zones to UTC seconds.

Every text is reduced to a character-class shape mask (digits ``9``, letters
``A``, the rest as it stands).  A mask is compiled to a parser once per worker:
the parser is a set of column positions, so all texts of one mask are converted
together with array arithmetic.  Local times go through zone transition tables
that the driver builds once and names with the version of the zone database.
"""

from __future__ import annotations

import datetime as dt
import functools
import re
import zoneinfo
from collections.abc import Iterator
from dataclasses import dataclass, field
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mailgrain.runtime import spread

# Month names (first three letters, English and German) and zone abbreviations in minutes.
MONTHS = {
    "jan": 1, "feb": 2, "mar": 3, "mär": 3, "mae": 3, "apr": 4, "may": 5, "mai": 5, "jun": 6,
    "jul": 7, "aug": 8, "sep": 9, "oct": 10, "okt": 10, "nov": 11, "dec": 12, "dez": 12,
}
ABBREVIATIONS = {
    "Z": 0, "UT": 0, "UTC": 0, "GMT": 0, "WET": 0, "WEST": 60, "BST": 60, "CET": 60, "CEST": 120,
    "MEZ": 60, "MESZ": 120, "EET": 120, "EEST": 180, "MSK": 180, "IST": 330, "JST": 540, "KST": 540,
    "AEST": 600, "AEDT": 660, "EST": -300, "EDT": -240, "CST": -360, "CDT": -300, "MST": -420,
    "MDT": -360, "PST": -480, "PDT": -420,
}

#: Words after a clock time that name no zone.
NO_ZONES = frozenset(["uhr", "h", "local time"])

FIRST_YEAR, LAST_YEAR = 1900, 2100


def zone_version() -> str:
    """Version of the zone database in use."""
    for folder in zoneinfo.TZPATH:
        for name in ("tzdata.zi", "+VERSION"):
            path = Path(folder, name)
            if path.is_file():
                with path.open() as f:
                    return f.readline().replace("# version", "").strip()
    return "unversioned"


@dataclass(frozen=True)
class ZoneTable:
    """Offsets of one zone: ``offset[i]`` (seconds) holds from ``at[i]`` (UTC seconds)."""

    version: str
    at: np.ndarray
    offset: np.ndarray
    local_until: np.ndarray = field(repr=False, default=None)

    def to_utc(self, local: np.ndarray) -> np.ndarray:
        """UTC of local seconds.

        A local time that occurs twice is its first occurrence, a skipped one is
        read with the offset before the change: in both cases the earlier offset
        holds until the change as its own clock shows it, and in a gap beyond.
        """
        before, after = self.offset[:-1], self.offset[1:]
        # the earlier offset serves local times up to the later of both clock readings at the change
        ends = self.at[1:] + np.maximum(before, after)
        i = np.searchsorted(ends, local, side="right")
        return local - self.offset[i]


def build_zone(name: str, version: str | None = None) -> ZoneTable:
    """Transition table of an IANA zone, found by stepping and bisecting its offsets."""
    zone = zoneinfo.ZoneInfo(name)
    epoch = dt.datetime(1970, 1, 1, tzinfo=dt.timezone.utc)

    @functools.cache
    def offset(second: int) -> int:
        return int((epoch + dt.timedelta(seconds=second)).astimezone(zone).utcoffset().total_seconds())

    first = int((dt.datetime(FIRST_YEAR, 1, 1, tzinfo=dt.timezone.utc) - epoch).total_seconds())
    last = int((dt.datetime(LAST_YEAR, 1, 1, tzinfo=dt.timezone.utc) - epoch).total_seconds())
    at, offsets, step = [first], [offset(first)], 10 * 86400
    for low in range(first, last, step):
        high = low + step
        while offset(low) != offset(high):
            a, b = low, high
            while b - a > 1:
                mid = (a + b) // 2
                a, b = (mid, b) if offset(mid) == offset(a) else (a, mid)
            at.append(b)
            offsets.append(offset(b))
            low = b
    return ZoneTable(version or zone_version(), np.array(at, dtype=np.int64), np.array(offsets, dtype=np.int64))


_ZONES: dict[tuple[str, str], ZoneTable | None] = {}


def zone_table(name: str, version: str) -> ZoneTable | None:
    """A zone's table in this worker; None for a name the database doesn't know."""
    if (name, version) not in _ZONES:
        try:
            _ZONES[name, version] = build_zone(name, version)
        except (zoneinfo.ZoneInfoNotFoundError, ValueError, OSError):
            _ZONES[name, version] = None
    return _ZONES[name, version]


_DIGITS = re.compile(r"\d")


def mask_of(text: str) -> str:
    """Character-class shape of a text."""
    return "".join("9" if "0" <= c <= "9" else "A" if c.isalpha() else c for c in text)


_TAIL = r"(?: ?(?P<off>[+-]9999|[+-]99:99|[+-]99)| ?(?P<zone>A+(?:[/_-]A+)*))?(?: ?[(\[](?P<note>[^)\]]*)[)\]])?"
_CLOCK = r"(?P<h>99?):(?P<mi>99)(?::(?P<s>99))?(?:[.,]9+)?"
_WEEKDAY = r"(?:A+\.?,? +)?"
_SHAPES = [
    ("epoch", re.compile(r"(?P<n>9{9,11})(?:\.9+)?")),
    ("epoch_ms", re.compile(r"(?P<n>9{12,14})")),
    ("epoch_us", re.compile(r"(?P<n>9{15,17})")),
    ("ymd", re.compile(rf"(?P<y>9999)[-/.](?P<m>99?)[-/.](?P<d>99?)[ A]{_CLOCK}{_TAIL}")),
    ("ymd", re.compile(rf"(?P<y>9999)(?P<m>99)(?P<d>99)[ A]?(?P<h>99)(?P<mi>99)(?P<s>99)?(?:[.,]9+)?{_TAIL}")),
    ("named", re.compile(rf"{_WEEKDAY}(?P<d>99?)\.?[ -](?P<mon>A+)\.?[ -](?P<y>9999|99),? {_CLOCK}{_TAIL}")),
    ("named", re.compile(rf"A+,? (?P<mon>A+) +(?P<d>99?) {_CLOCK} (?:(?P<zone>A+) )?(?P<y>9999)")),
    ("dmy", re.compile(rf"(?P<d>99?)\.(?P<m>99?)\.(?P<y>9999|99),? {_CLOCK}{_TAIL}")),
    ("slash", re.compile(rf"(?P<a>99?)/(?P<b>99?)/(?P<y>9999|99),? {_CLOCK}(?: ?(?P<half>AA)(?= |$))?{_TAIL}")),
]


@functools.lru_cache(maxsize=4096)
def compile_mask(mask: str) -> tuple[tuple[str, dict[str, tuple[int, int]]], ...]:
    """Readings of a mask: (kind, group -> column span).  Compiled once per worker."""
    found = []
    for kind, shape in _SHAPES:
        m = shape.fullmatch(mask)
        if m:
            found.append((kind, {k: m.span(k) for k, v in m.groupdict().items() if v is not None}))
    return tuple(found)


def _codes(mask: str, texts: np.ndarray) -> np.ndarray:
    return np.array(texts, dtype=f"U{len(mask)}").view(np.uint32).reshape(len(texts), len(mask))


def _number(codes: np.ndarray, span: tuple[int, int]) -> np.ndarray:
    value = np.zeros(len(codes), dtype=np.int64)
    for i in range(*span):
        value = value * 10 + (codes[:, i].astype(np.int64) - 48)
    return value


def _words(texts: np.ndarray, span: tuple[int, int]) -> list[str]:
    return [t[span[0] : span[1]] for t in texts]


def _days(y: np.ndarray, m: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Days since 1970 of civil dates, and which of them exist."""
    ok = (y >= 1) & (m >= 1) & (m <= 12) & (d >= 1)
    y, m, d = np.where(ok, y, 2000), np.where(ok, m, 1), np.where(ok, d, 1)
    months = (y - 1970) * 12 + (m - 1)
    start = months.astype("datetime64[M]").astype("datetime64[D]").astype(np.int64)
    after = (months + 1).astype("datetime64[M]").astype("datetime64[D]").astype(np.int64)
    return start + d - 1, ok & (start + d - 1 < after)


def local_mask(mask: str, texts: np.ndarray, day_first: np.ndarray) -> tuple[np.ndarray, np.ndarray, str, dict[str, tuple[int, int]]]:
    """(seconds since 1970 as the written clock counts them, readable, kind, spans) of texts that share a mask.

    No zone is looked at.  A bare number has no clock but that of 1970, UTC.
    """
    n = len(texts)
    readings = compile_mask(mask)
    if not readings:
        return np.zeros(n, dtype=np.int64), np.zeros(n, dtype=bool), "", {}
    kind, at = readings[0]
    codes = _codes(mask, texts)
    if kind.startswith("epoch"):
        return _number(codes, at["n"]) // {"epoch": 1, "epoch_ms": 1000, "epoch_us": 1_000_000}[kind], np.ones(n, dtype=bool), kind, at
    y = _number(codes, at["y"])
    if at["y"][1] - at["y"][0] == 2:
        y = y + 2000
    if kind == "slash":
        a, b = _number(codes, at["a"]), _number(codes, at["b"])
        m, d = np.where(day_first, b, a), np.where(day_first, a, b)
    else:
        d = _number(codes, at["d"])
        if kind == "named":
            m = np.array([MONTHS.get(w[:3].lower(), 0) for w in _words(texts, at["mon"])], dtype=np.int64)
        else:
            m = _number(codes, at["m"])
    h, mi = _number(codes, at["h"]), _number(codes, at["mi"])
    s = _number(codes, at["s"]) if "s" in at else np.zeros(n, dtype=np.int64)
    good = (mi < 60) & (s <= 60)
    if "half" in at:
        half = np.array([w.upper() for w in _words(texts, at["half"])])
        good &= np.isin(half, ["AM", "PM"]) & (h >= 1) & (h <= 12)
        h = h % 12 + np.where(half == "PM", 12, 0)
    good &= (h < 24) | ((h == 24) & (mi == 0) & (s == 0))
    days, exists = _days(y, m, d)
    good &= exists
    local = days * 86400 + h * 3600 + mi * 60 + s
    return local, good, kind, at


def convert_mask(
    mask: str, texts: np.ndarray, home: np.ndarray, day_first: np.ndarray, version: str
) -> tuple[np.ndarray, np.ndarray]:
    """(UTC seconds, readable) of texts that share a mask."""
    n = len(texts)
    local, good, kind, at = local_mask(mask, texts, day_first)
    if not kind or kind.startswith("epoch"):
        return local, good
    seconds = np.zeros(n, dtype=np.int64)
    if "off" in at:
        codes = _codes(mask, texts)
        lo, hi = at["off"]
        sign = np.where(codes[:, lo] == ord("-"), -1, 1)
        hours = _number(codes, (lo + 1, lo + 3))
        minutes = _number(codes, (hi - 2, hi)) if hi - lo > 3 else np.zeros(n, dtype=np.int64)
        good &= (minutes < 60) & (hours < 24)
        return local - sign * (hours * 3600 + minutes * 60), good
    named = at.get("zone") or at.get("note")
    zones = _words(texts, named) if named else [""] * n
    unsettled = np.ones(n, dtype=bool)
    for word in set(zones):
        if not word or word.lower() in NO_ZONES:
            continue
        rows = np.fromiter((z == word for z in zones), bool, n)
        if word.upper() in ABBREVIATIONS:
            seconds[rows] = local[rows] - 60 * ABBREVIATIONS[word.upper()]
            unsettled &= ~rows
        elif (table := zone_table(word, version)) is not None:
            seconds[rows] = table.to_utc(local[rows])
            unsettled &= ~rows
        elif "zone" in at:
            good &= ~rows  # an unknown zone leaves the instant open
    for name in set(home[unsettled]):
        rows = unsettled & (home == name)
        table = zone_table(name, version) if name else None
        if table is None:
            good &= ~rows
        else:
            seconds[rows] = table.to_utc(local[rows])
    return seconds, good


def masks(values: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """``keep``, mask, n, known: how often each shape occurs and whether a parser reads it.

    Shapes without a parser give no instants; this says which and how many.
    Nulls are left out.
    """
    shape = F.regexp_replace(F.regexp_replace(F.col(text), "[0-9]", "9"), r"\p{L}", "A")
    counted = values.where(F.col(text).isNotNull()).groupBy(*keep, F.trim(shape).alias("mask")).agg(F.count(F.lit(1)).alias("n"))
    known = F.pandas_udf(lambda m: pd.Series([bool(compile_mask(x)) for x in m], dtype=bool), "boolean")
    return counted.withColumn("known", known("mask"))


def to_instants(values: DataFrame, text: str, home_zone: str, day_first: str, keep: list[str]) -> DataFrame:
    """``keep`` plus ``utc_s`` for every readable value of ``text``.

    Null, blank, unreadable and impossible values, and local times whose home
    zone is null or unknown, give no row.  Repeated rows stay.
    """
    spark = values.sparkSession
    version = zone_version()
    source = values.select(*keep, F.trim(F.col(text)).alias("__text"), F.col(home_zone).alias("__home"), F.col(day_first).alias("__first"))
    source = source.where(F.length("__text") > 0)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if zone_version() != version:
            raise RuntimeError(f"zone database {zone_version()} on this worker, {version} on the driver")
        for batch in batches:
            texts = batch["__text"].str.strip().to_numpy(dtype=object)
            home = batch["__home"].fillna("").to_numpy(dtype=object)
            first = batch["__first"].map(lambda v: v is None or v != v or bool(v)).to_numpy(dtype=bool)
            masks = pd.Series([mask_of(t) for t in texts], dtype=object)
            seconds, good = np.zeros(len(texts), dtype=np.int64), np.zeros(len(texts), dtype=bool)
            for mask, rows in masks.groupby(masks).indices.items():
                seconds[rows], good[rows] = convert_mask(mask, texts[rows], home[rows], first[rows], version)
            out = batch[keep][good].reset_index(drop=True)
            out["utc_s"] = seconds[good]
            yield out

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields if f.name in keep)
    return source.mapInPandas(run, f"{schema}, utc_s long")


@F.pandas_udf(T.LongType())
def _wall_seconds(text: pd.Series, day_first: pd.Series) -> pd.Series:
    texts = text.fillna("").str.strip().to_numpy(dtype=object)
    first = day_first.map(lambda v: v is None or v != v or bool(v)).to_numpy(dtype=bool)
    masks = pd.Series([mask_of(t) for t in texts], dtype=object)
    seconds, good = np.zeros(len(texts), dtype=np.int64), np.zeros(len(texts), dtype=bool)
    for mask, rows in masks.groupby(masks).indices.items():
        seconds[rows], good[rows], *_ = local_mask(mask, texts[rows], first[rows])
    return pd.Series(seconds, dtype="Int64").mask(~good)


def wall_clock(text: Column, day_first: Column) -> Column:
    """Written wall clock (timestamp_ntz, whole seconds) of a text in any form that ``to_instants`` reads.

    Offset, zone and home zone change nothing, so an unknown zone leaves the clock
    readable; a bare number shows UTC.  ``day_first`` null counts as true.  Null,
    blank, unreadable and impossible values give null.
    """
    seconds = _wall_seconds(text, day_first)
    days = F.floor(seconds / 86400).cast("int")
    return F.lit("1970-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(days, F.lit(0), F.lit(0), F.pmod(seconds, F.lit(86400)).cast("decimal(18,6)"))


def mail_instants(mail_headers: DataFrame, scanned_message: DataFrame, account: DataFrame) -> DataFrame:
    """fld, hdr_id, utc_s of the readable ``date_`` and ``received`` values."""
    zones = account.select("name", "home_zone", "day_first")
    stacked = mail_headers.select(F.lit("date").alias("fld"), "hdr_id", F.col("account").alias("name"), F.col("date_").alias("raw")).unionByName(
        scanned_message.select(F.lit("received").alias("fld"), "hdr_id", F.col("account").alias("name"), F.col("received").alias("raw"))
    )
    stacked = stacked.where(F.col("raw").isNotNull())
    return to_instants(stacked.join(zones, "name", "left"), "raw", "home_zone", "day_first", ["fld", "hdr_id"])
