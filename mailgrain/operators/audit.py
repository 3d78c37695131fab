"""Archive audit: findings about folders, duplicates and mails that were never rendered."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STAGING = ".staging-"
SHOWN_NAMES = 5


def _finding(kind: str, severity: str, detail):
    return [F.lit(kind).alias("kind"), F.lit(severity).alias("severity"), F.col("profile"), detail.alias("detail")]


def duplicates(folders: DataFrame) -> DataFrame:
    """Identities that several rendered folders share."""
    named = folders.where(~F.startswith("name", F.lit(STAGING)) & F.col("identity").isNotNull())
    grouped = named.groupBy("profile", "identity").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.array_sort(F.collect_list("name")), ", ").alias("names"))
    return grouped.where("n > 1").select(*_finding("duplicate", "WARN", F.col("names")))


def folder_findings(folders: DataFrame) -> DataFrame:
    """Leftover staging folders, missing manifests and missing PDFs."""
    staging = F.startswith("name", F.lit(STAGING))
    kind = F.when(staging, F.array(F.lit("staging"))).otherwise(
        F.filter(F.array(F.when(~F.col("has_manifest"), F.lit("no-manifest")), F.when(~F.col("has_pdf"), F.lit("incomplete"))), lambda k: k.isNotNull())
    )
    flat = folders.select("profile", "name", F.explode(kind).alias("kind"))
    return flat.select("kind", F.when(F.col("kind") == "incomplete", "FAIL").otherwise("WARN").alias("severity"), "profile", F.col("name").alias("detail"))


def unrendered(files: DataFrame, folders: DataFrame) -> DataFrame:
    """One finding per profile: mails without a folder of their name whose id and hash no manifest holds."""
    known = folders.where(F.col("identity").isNotNull()).select("profile", F.explode(F.split("identity", "\n")).alias("line")).distinct()
    left = files.join(folders.select("profile", F.col("name").alias("stem")), ["profile", "stem"], "left_anti")
    left = left.join(known.withColumnRenamed("line", "message_id"), ["profile", "message_id"], "left_anti")
    left = left.join(known.withColumnRenamed("line", "sha256"), ["profile", "sha256"], "left_anti")
    # the five smallest names by a bounded aggregate, not by gathering all of them
    grouped = left.groupBy("profile").agg(F.count(F.lit(1)).alias("n"))
    ranked = smallest(left, "profile", "stem", SHOWN_NAMES)
    detail = F.concat(F.col("n").cast("string"), F.lit(": "), F.array_join("names", ", "), F.when(F.col("n") > SHOWN_NAMES, F.lit(", …")).otherwise(F.lit("")))
    return grouped.join(ranked, "profile").select(*_finding("unrendered", "WARN", detail))


def smallest(df: DataFrame, group: str, value: str, k: int) -> DataFrame:
    """group, names: the k smallest values of each group; tasks keep k rows each before the shuffle."""
    from pyspark.sql import Window

    w = Window.partitionBy(group).orderBy(value)
    top = df.select(group, value).withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= k)
    return top.groupBy(group).agg(F.array_sort(F.collect_list(value)).alias("names"))


def findings(files: DataFrame, folders: DataFrame, profiles: DataFrame) -> DataFrame:
    """All findings of all profiles; a profile without mails has "no-archive" only, one without pdf none."""
    have = files.select("profile").distinct()
    empty = profiles.join(have, "profile", "left_anti").select(*_finding("no-archive", "WARN", F.lit("")))
    rendered = profiles.where("pdf").join(have, "profile", "left_semi").select("profile")
    inside = folders.join(rendered, "profile", "left_semi")
    return (
        empty.unionByName(duplicates(inside)).unionByName(folder_findings(inside)).unionByName(unrendered(files.join(rendered, "profile", "left_semi"), inside))
    )


def summary(found: DataFrame) -> DataFrame:
    """profile, kind, severity, n, detail: warnings collapsed (a lone one keeps its detail), failures never."""
    warnings = found.where("severity <> 'FAIL'").groupBy("profile", "kind", "severity").agg(F.count(F.lit(1)).alias("n"), F.min("detail").alias("detail"))
    collapsed = warnings.withColumn("detail", F.when(F.col("n") == 1, F.col("detail")))
    failures = found.where("severity = 'FAIL'").select("profile", "kind", "severity", F.lit(1).cast("long").alias("n"), "detail")
    return collapsed.unionByName(failures)


def exit_code(found: DataFrame) -> DataFrame:
    """1 if anything failed, else 0."""
    return found.agg(F.coalesce(F.max(F.when(F.col("severity") == "FAIL", 1).otherwise(0)), F.lit(0)).alias("exit_code"))


def restore_plan(archive: DataFrame, mailbox: DataFrame) -> DataFrame:
    """Archived mails with outcome: already there by (message_id, subject), or to be uploaded.

    A mail without id is never found in the mailbox.
    """
    there = mailbox.select("message_id", "subject").where("message_id is not null").distinct().withColumn("__there", F.lit(True))
    joined = archive.join(there, ["message_id", "subject"], "left")
    return joined.withColumn("outcome", F.when(F.col("__there"), "SKIPPED").otherwise("RESTORED")).drop("__there")
