"""Identity of mails and collision-free names."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_NUMBERED = re.compile(r"(.*)-([1-9][0-9]*)", re.DOTALL)


def identity(message_id: Column, from_: Column, subject: Column, stamp: Column, content: Column) -> Column:
    """Struct of the first line (message id, else sender, subject and time) and the content hash line."""
    first = F.coalesce(F.nullif(F.trim(message_id), F.lit("")), F.concat_ws("|", F.coalesce(from_, F.lit("")), F.coalesce(subject, F.lit("")), F.coalesce(stamp, F.lit(""))))
    return F.struct(first.alias("primary"), F.concat(F.lit("sha256:"), F.sha2(content, 256)).alias("sha256"))


def same_mail(stored: Column, current: Column) -> Column:
    """Whether two manifests name one mail: by hash if both have one, else by any other common line."""
    lines = lambda c: F.filter(F.transform(F.split(c, "\n"), F.trim), lambda x: F.length(x) > 0)
    hashed = lambda c: F.filter(lines(c), lambda x: F.startswith(x, F.lit("sha256:")))
    plain = lambda c: F.filter(lines(c), lambda x: ~F.startswith(x, F.lit("sha256:")))
    both = (F.size(hashed(stored)) > 0) & (F.size(hashed(current)) > 0)
    answer = F.when(both, F.arrays_overlap(hashed(stored), hashed(current))).otherwise(F.arrays_overlap(plain(stored), plain(current)))
    return F.coalesce(F.when(stored.isNotNull() & current.isNotNull(), answer), F.lit(False))


def unique_names(mails: DataFrame, base: str, ident: str, order: list[str]) -> DataFrame:
    """``mails`` plus ``name`` and ``skip``: base, base-2, base-3 ... by first appearance of each identity.

    The same identity shares its name and all but its first row are skipped.
    Distinct identities are numbered after a map-side aggregate; a base with very
    many of them is numbered with range-partitioned offsets instead of one window.
    """
    first = mails.groupBy(base, ident).agg(F.min(F.struct(*order)).alias("__first"))
    numbered = number_within(first, base, ["__first"], "__k")
    name = F.when(F.col("__k") == 1, F.col(base)).otherwise(F.concat(F.col(base), F.lit("-"), F.col("__k").cast("string")))
    joined = mails.join(numbered.withColumn("name", name), [base, ident], "left")
    return joined.withColumn("skip", F.struct(*order) > F.col("__first")).drop("__first", "__k")


def number_within(df: DataFrame, group: str, order: list[str], out: str) -> DataFrame:
    """Row numbers within groups that stay parallel when one group holds most rows.

    Rows are range-partitioned by (group, order), numbered within a partition,
    and shifted by the counts of the earlier partitions of the same group.
    """
    ranged = df.repartitionByRange(F.col(group), *order).withColumn("__p", F.spark_partition_id())
    counts = ranged.groupBy(group, "__p").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(group).orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("__o", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    local = Window.partitionBy(group, "__p").orderBy(*order)
    numbered = ranged.withColumn("__r", F.row_number().over(local))
    return numbered.join(offsets, [group, "__p"]).withColumn(out, F.col("__r") + F.col("__o")).drop("__p", "__r", "__o")


def unique_names_probe(mails: DataFrame, collision: str, base: str, ident: str, order: list[str]) -> DataFrame:
    """Exact probing where bases can meet each other's numbered names (``x-2`` as a base of its own).

    ``collision`` groups every base with all names it can reach.  A group stays
    in one task, which reads it as a stream and keeps its names; use unique_names
    where bases can't meet.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, str] = {}
        free: dict[str, int] = {}  # no number below is free
        own: dict[tuple[str, str], int] = {}  # least number an identity holds of a base
        group = object()
        for part in batches:
            names, skips = [], []
            for g, b, i in zip(part[collision], part[base], part[ident], strict=True):
                if g != group:
                    group, held, free, own = g, {}, {}, {}
                name = b
                if held.get(b, i) != i:
                    k, mine = free.get(b, 2), own.get((b, i))
                    while (mine is None or k < mine) and f"{b}-{k}" in held:
                        k += 1
                    if mine is None or k < mine:
                        free[b] = k
                    else:
                        k = mine
                    name = f"{b}-{k}"
                skips.append(name in held)
                if name not in held:
                    held[name] = i
                    m = name and _NUMBERED.fullmatch(name)
                    if m and int(m[2]) > 1:
                        own[m[1], i] = min(own.get((m[1], i), int(m[2])), int(m[2]))
                names.append(name)
            yield part.assign(name=names, skip=skips)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in mails.schema.fields)
    return mails.repartition(F.col(collision)).sortWithinPartitions(collision, *order).mapInPandas(run, f"{schema}, name string, skip boolean")


def content_dedup(files: DataFrame, keys: list[str], content: str, order: str) -> DataFrame:
    """First row of every (keys, length, hash of content); the content itself isn't shuffled."""
    lean = files.select(*keys, order, F.octet_length(content).alias("length"), F.sha2(F.col(content).cast("binary"), 256).alias("sha256"))
    return lean.groupBy(*keys, "length", "sha256").agg(F.min(order).alias(order), F.count(F.lit(1)).alias("copies"))
