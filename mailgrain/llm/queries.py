"""Queries of the llm operators and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from mailgrain.llm import confusables, leakage, mixing, mojibake, pii, truncation
from mailgrain.runtime import materialise, table


def p2_found(spark, sf_dir):
    """Subjects and file names that look ordinary and are written with other characters."""
    found = mojibake.deviating_headers(table(spark, sf_dir, "mail_headers"), table(spark, sf_dir, "attachment_part"))
    return found.select("fld", "row_id")


def p2_normal(spark, sf_dir):
    """Every subject and file name in its consistent form."""
    texts = confusables.header_texts(table(spark, sf_dir, "mail_headers"), table(spark, sf_dir, "attachment_part"))
    return confusables.normalise(texts, "text", ["fld", "row_id"]).selectExpr("fld", "row_id", "normal", "array_join(kinds, ',') as kinds")


def p2_stable(spark, sf_dir):
    """Texts by field, and how many a second pass would change: none."""
    texts = confusables.header_texts(table(spark, sf_dir, "mail_headers"), table(spark, sf_dir, "attachment_part")).where("text is not null")
    once = confusables.normalise(texts, "text", ["fld", "row_id"]).select("fld", "row_id", F.col("normal").alias("once"))
    twice = confusables.normalise(once, "once", ["fld", "row_id"])
    return twice.groupBy("fld").agg(F.count(F.lit(1)).alias("texts"), F.count_if(F.col("text") != F.col("normal")).alias("changed_again"))


def p3_found(spark, sf_dir):
    """Subjects, senders and file names decoded with a wrong encoding."""
    found = mojibake.garbled_headers(table(spark, sf_dir, "mail_headers"), table(spark, sf_dir, "attachment_part"))
    return found.where("garbled").select("fld", "row_id")


def p3_restored(spark, sf_dir):
    """Garbled values with their original text."""
    found = mojibake.garbled_headers(table(spark, sf_dir, "mail_headers"), table(spark, sf_dir, "attachment_part"))
    return found.where("garbled").drop("garbled")


def p3_accuracy(spark, sf_dir):
    """Share of clean values that come back after each kind of misreading."""
    texts = confusables.header_texts(table(spark, sf_dir, "mail_headers"), table(spark, sf_dir, "attachment_part"), sender=True)
    return mojibake.restoration_accuracy(texts, "text")


KEY = "demonstration key"


def p4_found(spark, sf_dir):
    """Distinct personal values of every body that surrogates replace."""
    found = pii.replacements(table(spark, sf_dir, "parsed_mail"), table(spark, sf_dir, "mail_headers"), KEY)
    return found.where("surrogate is not null").select("mail_id", "body", "kind", "pii_value")


def p4_collisions(spark, sf_dir):
    """Stand-ins of several values and values with several stand-ins, by kind: none."""
    found = pii.replacements(table(spark, sf_dir, "parsed_mail"), table(spark, sf_dir, "mail_headers"), KEY)
    kinds = spark.createDataFrame([(k,) for k in pii.KINDS], "kind string")
    bad = pii.collisions(found).groupBy("kind").agg(F.count_if(F.col("entities") > 1).alias("shared"), F.count_if(F.col("stand_ins") > 1).alias("split"))
    return kinds.join(bad, "kind", "left").na.fill(0, ["shared", "split"])


def p4_redacted(spark, sf_dir):
    """Bodies with numbered placeholders."""
    return pii.redacted(table(spark, sf_dir, "parsed_mail"), table(spark, sf_dir, "mail_headers"))


def p4_surrogates(spark, sf_dir):
    """Bodies with keyed surrogates."""
    return pii.redacted(table(spark, sf_dir, "parsed_mail"), table(spark, sf_dir, "mail_headers"), key=KEY, mode="surrogate")


def p7_found(spark, sf_dir):
    """Documents holding thirteen or more consecutive words of an evaluation item."""
    found = leakage.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))
    return found.where("kind = 'verbatim'").select("doc_id", "item_id")


def p7_report(spark, sf_dir):
    """All leaks with their measures, paraphrases included."""
    return leakage.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p8_mix(spark, sf_dir):
    """Documents of the mix with their copies."""
    return mixing.mixed(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))


def p8_report(spark, sf_dir):
    """Target and reached share of every source."""
    return mixing.mix_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))


def p8_kept(spark, sf_dir):
    """Whether every source meets its target share to within two documents and no document is used too often."""
    targets = table(spark, sf_dir, "mix_targets")
    used = mixing.mixed(table(spark, sf_dir, "documents"), targets)
    sums = used.groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("t"), F.max("copies").alias("most"), F.max("tokens").alias("longest"))
    sums = materialise(sums, "mix-check")
    total = sums.agg(F.sum("t")).first()[0]
    both = targets.join(sums, "source", "left")
    misses = F.abs(F.col("t") - F.col("target_share") * F.lit(float(total)))
    # each of the others may miss its own target by two documents, which moves the total
    longest = sums.agg(F.max("longest")).first()[0]
    slack = 2 * F.col("longest") + F.col("target_share") * F.lit(2.0 * longest) * F.lit(both.count())
    return both.select("source", (misses <= slack).alias("share_kept"), (F.col("most") <= F.col("max_repeats")).alias("caps_kept"))


def p9_found(spark, sf_dir):
    """Documents that are cut off."""
    return truncation.truncated(table(spark, sf_dir, "documents")).where("cut").select("doc_id")


def p9_report(spark, sf_dir):
    """Share of cut texts by source."""
    return truncation.truncation_report(table(spark, sf_dir, "documents"))


def p9_limits(spark, sf_dir):
    """Length hazards of every source and which lengths are significant."""
    ends = truncation.endings(table(spark, sf_dir, "documents"))
    return truncation.length_limits(ends).selectExpr("source", "measure", "length", "n", "round(hazard, 9) as hazard", "round(around, 9) as around", "`limit`")


QUERIES = {
    "p2_found": p2_found,
    "p2_normal": p2_normal,
    "p2_stable": p2_stable,
    "p3_found": p3_found,
    "p3_restored": p3_restored,
    "p3_accuracy": p3_accuracy,
    "p4_found": p4_found,
    "p4_collisions": p4_collisions,
    "p4_redacted": p4_redacted,
    "p4_surrogates": p4_surrogates,
    "p7_found": p7_found,
    "p7_report": p7_report,
    "p8_mix": p8_mix,
    "p8_report": p8_report,
    "p8_kept": p8_kept,
    "p9_found": p9_found,
    "p9_report": p9_report,
    "p9_limits": p9_limits,
}
SQL = {
    "p2_stable": """
select 'subject' as fld, count(subject) as texts, 0::bigint as changed_again from mail_headers
union all select 'filename', count(filename), 0 from attachment_part""",
    "p8_kept": "select source, true as share_kept, true as caps_kept from mix_targets",
    "p4_collisions": "select kind, 0::bigint as shared, 0::bigint as split from (values ('email'), ('phone'), ('id_number'), ('address'), ('name')) t(kind)",
    "p7_found": r"""
with d as (select doc_id, regexp_extract_all(lower(nfc_normalize(text)), '[\p{L}\p{N}]+') as w from documents where text is not null),
i as (select item_id, regexp_extract_all(lower(nfc_normalize(regexp_extract(trim(text, chr(10) || chr(13) || ' '), '^(?s)(.*?)(\n\s*\n|$)', 1))), '[\p{L}\p{N}]+') as w from eval_items where text is not null),
dg as (select doc_id, array_to_string(w[k:k + 12], ' ') as g from d, lateral (select unnest(generate_series(1, len(w) - 12)) as k)),
ig as (select distinct item_id, array_to_string(w[k:k + 12], ' ') as g from i, lateral (select unnest(generate_series(1, len(w) - 12)) as k))
select distinct doc_id, item_id from dg join ig using (g)""",
    "p9_limits": r"""
with t as (select distinct source, text from documents where length(trim(text, ' ')) > 0),
x as (select source, 'chars' as measure, length(text) as length from t union all select source, 'bytes', octet_length(encode(text)) from t),
h as (select source, measure, length, count(*) as n from x group by all),
r as (select *,
    sum(n) over (partition by source, measure order by length desc) as reached,
    sum(n) over (partition by source, measure order by length range between 10 preceding and 10 following) - n as near,
    count(*) over (partition by source, measure) as tests from h),
z as (select *, n / reached as hazard, (near + 1.0) / (greatest(reached, 1) * 20 + 1.0) as around from r),
p as (select *, case when n <= reached * around then 1.0 else
    list_sum([exp(k * ln(reached * around) - reached * around - lgamma(k + 1)) for k in generate_series(n::bigint, n::bigint + 199)]) end as p_value from z),
k as (select *, row_number() over (partition by source, measure order by p_value, length) as rank from p),
b as (select *, max(case when p_value <= 0.01 * rank / tests then rank else 0 end) over (partition by source, measure) as last from k)
select source, measure, length, n, round(hazard, 9) as hazard, round(around, 9) as around, rank <= last and n >= 3 and hazard > 2 * around as "limit" from b""",
}
