"""Delivered state: first write wins per (account, folder, uidvalidity, uid)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEY = ["account", "folder", "uidvalidity", "uid"]
COLUMNS = [*KEY, "filename", "profile"]


def migrate(state: DataFrame) -> DataFrame:
    """Older state with missing nullable columns added."""
    for name in ("filename", "profile"):
        if name not in state.columns:
            state = state.withColumn(name, F.lit(None).cast("string"))
    return state.select(*COLUMNS)


def insert_or_ignore(state: DataFrame, new: DataFrame, order: Column) -> DataFrame:
    """State plus the new keys; of several new rows with one key the first by ``order`` wins.

    Keys are never null; the first row is found with a map-side aggregate, so
    repeated keys don't gather in one task.
    """
    first = new.groupBy(*KEY).agg(F.min_by(F.struct("filename", "profile"), order).alias("f")).select(*KEY, "f.filename", "f.profile")
    return migrate(state).unionByName(first.join(state.select(*KEY), KEY, "left_anti"))


def delivered_uids(state: DataFrame, account: str, folder: str, uidvalidity: int) -> DataFrame:
    """uid of the delivered messages of one folder generation."""
    return state.where((F.col("account") == account) & (F.col("folder") == folder) & (F.col("uidvalidity") == uidvalidity)).select("uid")


def not_delivered(messages: DataFrame, state: DataFrame) -> DataFrame:
    """Messages without state."""
    return messages.join(state.select(*KEY), KEY, "left_anti")


def already_delivered(messages: DataFrame, state: DataFrame) -> DataFrame:
    """Messages with state."""
    return messages.join(state.select(*KEY), KEY, "left_semi")


def clear(state: DataFrame, profile: str | None = None) -> tuple[DataFrame, Column]:
    """(what is kept, condition of what goes).  A targeted clear keeps rows without a profile."""
    gone = F.lit(True) if profile is None else F.coalesce(F.col("profile") == profile, F.lit(False))
    return state.where(~gone), gone


def untracked(state: DataFrame) -> DataFrame:
    """Count of legacy rows without a profile."""
    return state.agg(F.count_if(F.col("profile").isNull()).alias("untracked"))
