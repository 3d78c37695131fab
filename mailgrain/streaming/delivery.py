"""Delivery as a stream: the same state as a batch run, kept incrementally.

Which keys have been seen is kept in the stream's own state store, so a batch
costs what it brings and not what was delivered before it.  Every batch writes
under its own batch id; one that runs again after a failure replaces its own
files and delivers nothing twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from mailgrain.operators.state import KEY
from mailgrain.plans import fetch
from mailgrain.plans import rules as R
from mailgrain.runtime import scratch_path


def first_deliveries(messages: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """First arrival of every key that ``known`` (a table of the state) doesn't hold.

    State never expires, as delivered mail is never forgotten.
    """
    fresh = messages if known is None else messages.join(known.select(*KEY), KEY, "left_anti")
    return fresh.dropDuplicates(KEY)


def deliver(messages: DataFrame, state_path: str, checkpoint: str, known: DataFrame | None = None) -> StreamingQuery:
    """Append the first deliveries of a stream to ``state_path``, batch by batch."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{state_path}/batch_id={batch_id}")

    return first_deliveries(messages, known).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def delivered_by_stream(messages: DataFrame) -> DataFrame:
    """State after all available input, read back from the shared folder."""
    spark = messages.sparkSession
    state, checkpoint = scratch_path(spark, "stream-state"), scratch_path(spark, "stream-checkpoint")
    deliver(messages, state, checkpoint).awaitTermination()
    return spark.read.schema(messages.schema).parquet(f"{state}/batch_id=*")


def fetch_stream(messages: DataFrame, rules: list[R.Rule], folders: DataFrame, path: str, checkpoint: str, strict: bool = True) -> StreamingQuery:
    """Match a mailbox stream against rules, first match wins.

    Below ``path``: ``delivered`` holds matched messages with their ordinal,
    ``unmatched`` the others, which aren't delivered and may match other rules in
    a later run (see ``matched_later``), ``actions`` the server actions that
    follow, each with the batch that asked for it.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        hits = fetch.matched(batch, rules, folders, strict).persist()
        at = f"batch_id={batch_id}"
        hits.where("ordinal is not null").write.mode("overwrite").parquet(f"{path}/delivered/{at}")
        hits.where("ordinal is null").drop("ordinal").write.mode("overwrite").parquet(f"{path}/unmatched/{at}")
        due = hits.join(F.broadcast(fetch.rules_frame(spark, rules)), "ordinal").where("has_action").select(*KEY, "profile", "label", "move_to", "deletes")  # one row per rule
        due.write.mode("overwrite").parquet(f"{path}/actions/{at}")
        hits.unpersist()

    return first_deliveries(messages).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def matched_later(spark: SparkSession, path: str, rules: list[R.Rule], folders: DataFrame, strict: bool = True) -> DataFrame:
    """Messages that no rule took when they came, with their ordinal under the rules of now (null: still none)."""
    return fetch.matched(spark.read.parquet(f"{path}/unmatched/batch_id=*").drop("batch_id"), rules, folders, strict)


def open_actions(spark: SparkSession, path: str, done: DataFrame | None = None) -> DataFrame:
    """Actions asked for and not reported done (state key): failed ones come again in every run until they succeed."""
    asked = spark.read.parquet(f"{path}/actions/batch_id=*").drop("batch_id")
    return asked if done is None else asked.join(done.select(*KEY).distinct(), KEY, "left_anti")
