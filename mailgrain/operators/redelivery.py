"""Messages delivered more than once: a persistent identifier index, probed batch by batch.

Identifiers become 128-bit hashes.  The index is a folder of immutable runs.  A
run holds, by hash prefix, sorted identifier arrays with the smallest and the
largest ``hdr_id`` seen of each.  What is ingested is reduced locally (per
identifier and batch, map-side) and routed by prefix; batch by batch in order of
``batch_no`` it is probed by binary search against the runs, and what is novel or
changes an entry becomes the next run.  Runs are merged once there are more than
``RUNS_BEFORE_MERGE``.  Every prefix is one bounded group whatever the copies: a
message with a third of all rows is one entry per batch by the time it reaches its
prefix, and merging splits prefixes that have grown beyond ``KEYS_PER_PREFIX``.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mailgrain.runtime import materialise, scratch_path

KEYS_PER_PREFIX = 100_000
RUNS_BEFORE_MERGE = 4
LEAST_PREFIXES = 16
#: Identifiers of a prefix that are probed at once: batches with fewer go together, whole and in order.
PROBED_AT_ONCE = 4_096
RUN_SCHEMA = "prefix int, hi array<bigint>, lo array<bigint>, first_id array<bigint>, last_id array<bigint>"
_COLUMNS = ("hi", "lo", "first_id", "last_id")
_NAME = re.compile(r"(run|merged)-(\d{6})-p(\d+)")


def normal_identifier(message_id: Column) -> Column:
    """Identifier without brackets and outer white space, lower case after the last "@"; null if blank."""
    inner = F.regexp_replace(message_id, r"(?U)^[\s<]+|[\s>]+$", "")
    cut = F.length(inner) - F.length(F.substring_index(inner, "@", -1))
    lowered = F.concat(F.substr(inner, F.lit(1), cut), F.lower(F.substring_index(inner, "@", -1)))
    return F.when(F.length(inner) == 0, F.lit(None)).when(F.instr(inner, "@") > 0, lowered).otherwise(inner)


def _parts(*columns: Column) -> Column:
    """One string that tells its parts, their order and their nulls apart."""
    return F.concat(*[F.coalesce(F.concat(F.length(c).cast("string"), F.lit(":"), c), F.lit("-;")) for c in columns])


def keyed_deliveries(delivered: DataFrame, mail_headers: DataFrame) -> DataFrame:
    """hdr_id, batch_no and the two hash halves of each delivered row's message.

    The message is account, identifier and subject; without an identifier
    (null, blank or no header row) it is account, folder, uidvalidity and uid.
    """
    d = delivered.select("hdr_id", "batch_no", "account", "folder", F.col("uidvalidity").cast("string").alias("gen"), F.col("uid").cast("string").alias("uid"))
    h = mail_headers.select("hdr_id", normal_identifier(F.col("message_id")).alias("ident"), "subject")
    both = d.join(h, "hdr_id", "left")
    by_id = F.concat(F.lit("m"), _parts(F.col("account"), F.col("ident"), F.col("subject")))
    by_place = F.concat(F.lit("p"), _parts(F.col("account"), F.col("folder"), F.col("gen"), F.col("uid")))
    key = F.when(F.col("ident").isNotNull(), by_id).otherwise(by_place)
    return both.select(
        "hdr_id", F.coalesce("batch_no", F.lit(0)).alias("batch_no"), F.xxhash64(F.lit(17), key).alias("hi"), F.xxhash64(F.lit(71), key).alias("lo")
    )


class Runs:
    """Sorted identifier arrays of one prefix: persisted ones, which only note what changes, and new ones."""

    def __init__(self, persisted=(), max_runs: int = RUNS_BEFORE_MERGE):
        self.persisted = [tuple(np.array(x, dtype=np.int64) for x in run) for run in persisted]
        self.changed = [np.zeros(len(run[0]), dtype=bool) for run in self.persisted]
        self.new: list[tuple[np.ndarray, ...]] = []
        self.max_runs = max_runs

    @staticmethod
    def find(run, hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
        """Positions of identifiers in a run by binary search, -1 where absent."""
        r_hi, r_lo = run[0], run[1]
        at = np.searchsorted(r_hi, hi, side="left")
        inside = np.minimum(at, len(r_hi) - 1)
        found = np.where((r_hi[inside] == hi) & (r_lo[inside] == lo), inside, -1)
        # equal first halves with different second halves: walk the tie
        for k in np.flatnonzero((found < 0) & (r_hi[inside] == hi)):
            p = inside[k]
            while p < len(r_hi) and r_hi[p] == hi[k]:
                if r_lo[p] == lo[k]:
                    found[k] = p
                    break
                p += 1
        return found

    def ingest(self, hi: np.ndarray, lo: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Add one batch of distinct identifiers; True for the novel ones."""
        novel = np.ones(len(hi), dtype=bool)
        for k, run in enumerate(self.persisted + self.new):
            if not len(run[0]):
                continue
            at = self.find(run, hi, lo)
            hit = at >= 0
            if k < len(self.persisted):
                self.changed[k][at[hit]] |= (first[hit] < run[2][at[hit]]) | (last[hit] > run[3][at[hit]])
            np.minimum.at(run[2], at[hit], first[hit])
            np.maximum.at(run[3], at[hit], last[hit])
            novel &= ~hit
        if novel.any():
            order = np.lexsort((lo[novel], hi[novel]))
            self.new.append(tuple(x[novel][order].copy() for x in (hi, lo, first, last)))
        if len(self.new) > self.max_runs:
            self.new = [joined_run(self.new)]
        return novel

    def delta(self) -> tuple[np.ndarray, ...]:
        """One run of what is new and what has changed."""
        return joined_run(self.new + [tuple(x[c] for x in run) for run, c in zip(self.persisted, self.changed, strict=True)])


def joined_run(runs: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    """One sorted run; an identifier in several runs keeps its smallest and largest id."""
    runs = [r for r in runs if len(r[0])]
    if not runs:
        return tuple(np.empty(0, dtype=np.int64) for _ in _COLUMNS)
    joined = [np.concatenate(x) for x in zip(*runs, strict=True)]
    order = np.lexsort((joined[1], joined[0]))
    hi, lo, first, last = (x[order] for x in joined)
    begins = np.flatnonzero(np.concatenate([[True], (np.diff(hi) != 0) | (np.diff(lo) != 0)]))
    return hi[begins], lo[begins], np.minimum.reduceat(first, begins), np.maximum.reduceat(last, begins)


def probes(batch_no: np.ndarray) -> list[tuple[int, int]]:
    """Stretches of whole batches (rows in order of ``batch_no``) with PROBED_AT_ONCE rows or one batch each."""
    ends = [*(np.flatnonzero(np.diff(batch_no)) + 1).tolist(), len(batch_no)] if len(batch_no) else []
    out, begin = [], 0
    for end in ends:
        if end - begin >= PROBED_AT_ONCE or end == len(batch_no):
            out.append((begin, end))
            begin = end
    return out


def prefix_count(rows: int) -> int:
    """Power of two giving about KEYS_PER_PREFIX identifiers a prefix at most."""
    return max(LEAST_PREFIXES, 1 << math.ceil(math.log2(max(rows, 1) / KEYS_PER_PREFIX + 1)))


class IdentifierIndex:
    """Index of identifiers in a folder that all executors share.

    ``run-N-pP`` is what the N-th ingestion added over P prefixes, ``merged-N-pP``
    all up to the N-th.  Folders without a success mark are left over from a
    failed write and are not read, so an ingestion counts wholly or not at all.
    """

    def __init__(self, spark: SparkSession, path: str, max_runs: int = RUNS_BEFORE_MERGE):
        self.spark, self.path, self.max_runs = spark, path.rstrip("/"), max_runs

    def _folders(self) -> list[tuple[int, str, int]]:
        """(number, name, prefixes) of all complete folders, merged ones after runs of the same number."""
        jvm = self.spark._jvm
        root = jvm.org.apache.hadoop.fs.Path(self.path)
        fs = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(root):
            return []
        out = []
        for status in fs.listStatus(root):
            m = _NAME.fullmatch(status.getPath().getName())
            if m and fs.exists(jvm.org.apache.hadoop.fs.Path(status.getPath(), "_SUCCESS")):
                out.append((int(m[2]), m[1] == "merged", m[0], int(m[3])))
        return [(n, name, prefixes) for n, _, name, prefixes in sorted(out)]

    def current(self) -> list[tuple[int, str, int]]:
        """The folders that make up the index: the last merged one and the runs after it."""
        folders = self._folders()
        last = max((k for k, (_, name, _) in enumerate(folders) if name.startswith("merged")), default=0)
        return folders[last:]

    def _read(self, names: list[str]) -> DataFrame:
        return self.spark.read.schema(RUN_SCHEMA).parquet(*[f"{self.path}/{n}" for n in names])

    def ingest(self, keyed: DataFrame, rows: int | None = None) -> None:
        """Take all batches of ``keyed`` (hdr_id, batch_no, hi, lo) into the index, in order of ``batch_no``.

        What was ingested before changes nothing, so a batch may come again.
        ``rows`` is the number of rows, where it is known.
        """
        folders = self.current()
        number = folders[-1][0] + 1 if folders else 1
        prefixes = folders[-1][2] if folders else prefix_count(keyed.count() if rows is None else rows)
        local = keyed.groupBy("hi", "lo", "batch_no").agg(F.min("hdr_id").alias("first_id"), F.max("hdr_id").alias("last_id"))
        local = local.select(F.pmod("hi", F.lit(prefixes)).cast("int").alias("prefix"), "batch_no", *_COLUMNS)

        def rows_of(prefix: int, runs: Runs, batch: pd.DataFrame) -> pd.DataFrame:
            order = batch.sort_values("batch_no", kind="stable")
            columns = [order[c].to_numpy(dtype=np.int64) for c in _COLUMNS]
            for begin, end in probes(order["batch_no"].to_numpy()):
                runs.ingest(*joined_run([tuple(c[begin:end] for c in columns)]))
            delta = runs.delta()
            return pd.DataFrame([(prefix, *[x.tolist() for x in delta])] if len(delta[0]) else [], columns=["prefix", *_COLUMNS])

        if folders:

            def extend(key: tuple, old: pd.DataFrame, batch: pd.DataFrame) -> pd.DataFrame:
                return rows_of(int(key[0]), Runs(zip(*[old[c] for c in _COLUMNS], strict=True)), batch)

            old = self._read([name for _, name, _ in folders])
            added = old.groupBy("prefix").cogroup(local.groupBy("prefix")).applyInPandas(extend, RUN_SCHEMA)
        else:
            added = local.groupBy("prefix").applyInPandas(lambda key, batch: rows_of(int(key[0]), Runs(), batch), RUN_SCHEMA)
        added.write.mode("overwrite").parquet(f"{self.path}/run-{number:06d}-p{prefixes}")
        if len(folders) + 1 > self.max_runs:
            self.merge()

    def merge(self) -> None:
        """Write one merged folder of all runs, with more prefixes where they hold too many identifiers."""
        folders = self.current()
        if len(folders) < 2:
            return
        number, prefixes = folders[-1][0], folders[-1][2]
        source = self._read([name for _, name, _ in folders])
        entries = source.agg(F.sum(F.size("hi"))).first()[0] or 0
        wide = max(prefixes, prefix_count(entries))

        def join(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
            run = joined_run([tuple(np.array(x, dtype=np.int64) for x in r) for r in zip(*[part[c] for c in _COLUMNS], strict=True)])
            of = np.mod(run[0], wide)
            return pd.DataFrame([(int(p), *[x[of == p].tolist() for x in run]) for p in np.unique(of)], columns=["prefix", *_COLUMNS])

        merged = source.groupBy("prefix").applyInPandas(join, RUN_SCHEMA)
        merged.write.mode("overwrite").parquet(f"{self.path}/merged-{number:06d}-p{wide}")

    def vacuum(self) -> None:
        """Delete what the current folders replace; call it when no reader is left."""
        keep = {name for _, name, _ in self.current()}
        jvm = self.spark._jvm
        root = jvm.org.apache.hadoop.fs.Path(self.path)
        fs = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
        for status in fs.listStatus(root) if fs.exists(root) else ():
            if _NAME.fullmatch(status.getPath().getName()) and status.getPath().getName() not in keep:
                fs.delete(status.getPath(), True)

    def entries(self) -> DataFrame:
        """hi, lo, first_id, last_id: one row per identifier."""
        names = [name for _, name, _ in self.current()]
        if not names:
            return self.spark.createDataFrame([], "hi long, lo long, first_id long, last_id long")
        rows = self._read(names).select(F.explode(F.arrays_zip(*_COLUMNS)).alias("e")).select(*[F.col(f"e.{c}") for c in _COLUMNS])
        return rows if len(names) == 1 else rows.groupBy("hi", "lo").agg(F.min("first_id").alias("first_id"), F.max("last_id").alias("last_id"))


def open_index(spark: SparkSession, path: str, max_runs: int = RUNS_BEFORE_MERGE) -> IdentifierIndex:
    """The index in a folder, empty if there is none yet."""
    return IdentifierIndex(spark, path, max_runs)


def repeats(delivered: DataFrame, mail_headers: DataFrame, index_path: str | None = None) -> DataFrame:
    """hdr_id of every delivered row whose message has a row with a smaller hdr_id, in this or an earlier ingestion.

    Rows with a null hdr_id can't be told apart and are left out.  The rows go
    batch by batch into the index at ``index_path`` (a scratch folder if None);
    its entries with several ids are joined back to them.  A message with very
    many rows makes a skewed partition of that join, which is split at run time.
    """
    spark = delivered.sparkSession
    keyed = materialise(keyed_deliveries(delivered, mail_headers).where(F.col("hdr_id").isNotNull()), "deliveries")
    index = open_index(spark, index_path or scratch_path(spark, "identifier-index"))
    index.ingest(keyed)
    several = index.entries().where("last_id > first_id").select("hi", "lo", "first_id")
    return keyed.join(several, ["hi", "lo"]).where("hdr_id > first_id").select("hdr_id")


def kept(delivered: DataFrame, mail_headers: DataFrame, index_path: str | None = None) -> DataFrame:
    """The delivered rows that remain: one per message."""
    return delivered.join(repeats(delivered, mail_headers, index_path), "hdr_id", "left_anti")
