"""Run reports and batching as small relations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from mailgrain.operators.audit import smallest
from mailgrain.operators.naming import number_within

BATCH_FILES, SHOWN_PATHS = 100, 10


def totals(report: DataFrame) -> DataFrame:
    """profile, delivered of a fetch report, with the total under a null profile."""
    return report.rollup("profile").agg(F.sum("delivered").alias("delivered"))


def summary_text(report: DataFrame, counters: DataFrame) -> DataFrame:
    """One text: total, profiles by name, and every counter that isn't zero.

    ``counters``: one row with failed, post_fetch_failed, already_archived, post_fetch_skipped.
    """
    lines = report.where("delivered > 0").agg(
        F.coalesce(F.sum("delivered"), F.lit(0)).alias("total"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("profile", "delivered"))), lambda r: F.concat(F.lit("  "), r["profile"], F.lit(": "), r["delivered"].cast("string"))), "\n").alias("names"),
    )
    shown = lambda c, text: F.when(F.col(c) > 0, F.concat(F.col(c).cast("string"), F.lit(f" {text}")))
    both = lines.withColumn("__k", F.lit(1)).join(counters.withColumn("__k", F.lit(1)), "__k")
    return both.select(
        F.concat_ws(
            "\n", F.concat(F.col("total").cast("string"), F.lit(" delivered")), F.nullif("names", F.lit("")), shown("already_archived", "already archived"),
            shown("failed", "failed"), shown("post_fetch_failed", "actions failed"), shown("post_fetch_skipped", "actions skipped"),
        ).alias("summary")
    )


def non_compliant(results: DataFrame) -> DataFrame:
    """group, n, shown: failing paths of each group, the first ten by name and how many more."""
    failing = results.where(~F.col("compliant")).select("group", "path").distinct()
    counts = failing.groupBy("group").agg(F.count(F.lit(1)).alias("n"))
    more = F.when(F.col("n") > SHOWN_PATHS, F.concat(F.lit(" … and "), (F.col("n") - SHOWN_PATHS).cast("string"), F.lit(" more")))
    return counts.join(smallest(failing, "group", "path", SHOWN_PATHS), "group").select("group", "n", F.concat_ws("", F.array_join("names", ", "), more).alias("shown"))


def batches(paths: DataFrame, group: str, path: str, size: int = BATCH_FILES) -> DataFrame:
    """Distinct paths with a batch number: at most ``size`` in one, in order, parallel within a group."""
    numbered = number_within(paths.select(group, path).distinct(), group, [path], "__n")
    return numbered.withColumn("batch", F.floor((F.col("__n") - 1) / size)).drop("__n")


def mail_complete(outcomes: Column) -> Column:
    """Whether all attachments of a mail were converted; none counts as complete."""
    return F.coalesce(F.forall(outcomes, lambda o: o["ok"]), F.lit(True))


def outcome_counts(results: DataFrame) -> DataFrame:
    """outcome, n sorted by outcome."""
    return results.groupBy("outcome").agg(F.count(F.lit(1)).alias("n")).orderBy("outcome")


def mail_only_failures(results: DataFrame) -> DataFrame:
    """n: failing paths that are body-only files, which points to the renderer rather than to an attachment."""
    return results.agg(F.count_if(~F.col("compliant") & F.endswith("path", F.lit("_mailonly.pdf"))).alias("n"))


def damaged(results: DataFrame) -> DataFrame:
    """n: attachments that were damaged or locked."""
    return results.agg(F.count_if(F.col("reason").isin("CORRUPT", "ENCRYPTED")).alias("n"))


def mails_of_run(plans: DataFrame) -> DataFrame:
    """mails: how many mails all plans of a run hold (profile, mails)."""
    return plans.agg(F.coalesce(F.sum("mails"), F.lit(0)).alias("mails"))


def restore_exit_code(outcomes: DataFrame) -> DataFrame:
    """1 if any upload failed, else 0."""
    return outcomes.agg(F.coalesce(F.max((F.col("outcome") == "FAILED").cast("int")), F.lit(0)).alias("exit_code"))


def observed(df: DataFrame, name: str) -> tuple[DataFrame, Observation]:
    """``df`` that counts its rows while they pass, and the observation that tells the count."""
    seen = Observation(name)
    return df.observe(seen, F.count(F.lit(1)).alias("rows")), seen
