"""Session-level helpers shared by all operators."""

from __future__ import annotations

import atexit
import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One parquet table of a data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share.

    ``spark.checkpoint.dir`` of the session is used where it is set.  Only a
    session whose executors are this process (tests, a laptop) gets a local folder
    without it: on a cluster each machine would write to its own disk.
    """
    known = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if known:
        return known.rstrip("/")
    master = spark.sparkContext.master
    if not re.fullmatch(r"local(\[[^\]]*\])?", master):
        raise RuntimeError(f"spark.checkpoint.dir isn't set and {master} has no folder that all executors share")
    local = os.path.join(tempfile.gettempdir(), "mailgrain-shared")
    os.makedirs(local, exist_ok=True)
    return "file://" + local


_SCRATCH: list[tuple[SparkSession, str]] = []


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder; it is deleted when the driver ends, or by ``clean_scratch``."""
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    if not _SCRATCH:
        atexit.register(clean_scratch)
    _SCRATCH.append((spark, path))
    return path


def clean_scratch() -> None:
    """Delete the intermediate tables of this driver.  Results that still read them can't be used afterwards."""
    while _SCRATCH:
        spark, path = _SCRATCH.pop()
        try:
            target = spark._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
        except Exception:  # noqa: BLE001, S112 - the session may be gone; the folder's owner clears it then
            continue


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage with files that survive the loss of an executor, so a
    stage that several later stages read is computed once.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, *keys) -> DataFrame:
    """Spread rows evenly over all task slots before a costly Python stage.

    Small inputs arrive as one or two file splits.  Large ones already have
    more splits than slots, then no shuffle is added.
    """
    spark = df.sparkSession
    slots = max(spark.sparkContext.defaultParallelism, 1)
    splits = input_splits(df)
    if splits >= 2 * slots:
        return df
    return df.repartition(2 * slots, *keys)


def input_splits(df: DataFrame) -> int:
    """How many file splits the scans below ``df`` give, from the sizes of their files; what comes after them doesn't count."""
    spark = df.sparkSession
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    size = sum(int(str(leaves.apply(k).stats().sizeInBytes())) for k in range(leaves.size()))
    limit = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(
        spark.conf.get("spark.sql.files.maxPartitionBytes", "134217728")
    )
    return size // max(limit, 1)
