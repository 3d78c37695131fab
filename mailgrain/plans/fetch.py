"""The fetch plan: scan, match, anti-join, planned deliveries, actions and report as lazy DataFrames."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailgrain.functions.mime import read_mails
from mailgrain.functions.text import base_name, decode_words, email_address, email_addresses, move_target
from mailgrain.operators import state as st
from mailgrain.plans import rules as R


def address_columns(strict: bool = True) -> dict[str, Column]:
    """Lower-case candidate addresses by header field; ``strict`` uses the RFC 5322 reader."""
    read = (lambda c: email_addresses(F.col(c))) if strict else (lambda c: F.regexp_extract_all(F.col(c), F.lit(r"([\w.+-]+@[\w.-]+)"), F.lit(1)))
    return {m: F.transform(read(c), F.lower) for m, c in (("from", "from_"), ("to", "to_"), ("cc", "cc"), ("bcc", "bcc"))}


def with_addresses(messages: DataFrame, rules: list[R.Rule], strict: bool = True) -> DataFrame:
    """Messages with one array column per address field that some rule reads."""
    used = {m for r in rules if r.domains or r.addresses for m in r.mode}
    columns = address_columns(strict)
    return messages.withColumns({f"__addr_{m}": columns[m] for m in sorted(used)}) if used else messages


def predicates(rules: list[R.Rule]) -> list[tuple[int, Column]]:
    """Header predicate of every rule over a mailbox with addresses."""
    addresses = {m: F.col(f"__addr_{m}") for m in R.ADDRESS_FIELDS}
    return [(i, R.header_predicate(r, addresses, F.col("subject"), F.col("date_wall"), F.col("received_wall"), F.col("size"))) for i, r in enumerate(rules)]


def matched(messages: DataFrame, rules: list[R.Rule], folders: DataFrame, strict: bool = True, names: DataFrame | None = None) -> DataFrame:
    """Messages plus ``ordinal`` of the first rule on their folder that matches (null: none).

    ``folders``: account, folder, ordinal (see folder_map).  It has a few rows per
    account, so its arrays of ordinals join as one small table.  ``names``:
    hdr_id, name of attachments.  It is read only for messages that a rule with
    an attachment filter could still win; a message without known attachments
    matches no such rule.
    """
    scope = folders.groupBy("account", "folder").agg(F.collect_set("ordinal").alias("__scope"))
    wide = with_addresses(messages, rules, strict).join(scope, ["account", "folder"], "left")
    tests = [(i, p & F.coalesce(F.array_contains("__scope", i), F.lit(False))) for i, p in predicates(rules)]
    filtered = [i for i, r in enumerate(rules) if r.attachments]
    plain = R.first_match([t for t in tests if t[0] not in filtered]) if len(filtered) < len(rules) else F.lit(None).cast("int")
    out = wide.withColumn("ordinal", plain)
    if filtered and names is not None:
        before = F.coalesce("ordinal", F.lit(len(rules)))
        open_for = F.filter(F.array(*[F.when(p & (before > i), F.lit(i)) for i, p in tests if i in filtered]), lambda i: i.isNotNull())
        out = out.withColumn("__open", open_for)
        asked = out.where(F.size("__open") > 0).select("hdr_id", F.explode("__open").alias("__o"))
        wins = F.lit(False)
        for i in filtered:
            wins = wins | ((F.col("__o") == i) & R.attachment_predicate(rules[i].attachments, F.array("name")))
        won = asked.join(names.select("hdr_id", "name"), "hdr_id").where(wins).groupBy("hdr_id").agg(F.min("__o").alias("__won"))
        out = out.join(won, "hdr_id", "left").withColumn("ordinal", F.coalesce("__won", "ordinal"))
    return out.drop(*[c for c in out.columns if c.startswith("__")])


def rule_table(spark, rules: list[R.Rule]) -> DataFrame:
    """One row per rule with what it matches, for ``matched_by_table``.

    Address ends and addresses in lower case, address fields, subject patterns as
    Java expressions, day and size bounds.  Rules that look at attachments or use
    conditional patterns can't be told by a row.
    """
    rows = []
    for i, r in enumerate(rules):
        subjects = [] if r.subject is None else [R.java_pattern(r.subject)] if isinstance(r.subject, str) else [R.glob_regex(g) for g in r.subject]
        if r.attachments:
            raise R.ConfigError(f"{r.name}: attachment rules need the expression plan")
        ends = [e for d in r.domains for e in ("@" + d.lower().lstrip("@"), "." + d.lower().lstrip("@"))]
        rows.append((i, ends, [a.lower() for a in r.addresses], list(r.mode), subjects, r.since, r.until, r.larger, r.smaller))
    return spark.createDataFrame(
        rows, "ordinal int, __ends array<string>, __addresses array<string>, __mode array<string>, __subjects array<string>, __since date, __until date, __larger long, __smaller long"
    )


def matched_by_table(messages: DataFrame, rules: list[R.Rule], folders: DataFrame, strict: bool = True) -> DataFrame:
    """As ``matched``, planned as a join of the messages with the rules of their folder.

    Every rule is a row that is compared value by value, so the plan doesn't grow
    with the number of rules.  The rules of a folder come from files that people
    write and are broadcast.
    """
    of_folder = folders.join(rule_table(messages.sparkSession, rules), "ordinal").select("account", "folder", "ordinal", *[f"__{c}" for c in ("ends", "addresses", "mode", "subjects", "since", "until", "larger", "smaller")])
    columns = address_columns(strict)
    wide = messages.select("hdr_id", "account", "folder", "subject", F.coalesce("date_wall", "received_wall").cast("date").alias("__day"), "size", F.create_map(*[x for m, c in columns.items() for x in (F.lit(m), c)]).alias("__by_field"))
    both = wide.join(F.broadcast(of_folder), ["account", "folder"])
    found = F.flatten(F.transform("__mode", lambda m: F.col("__by_field")[m]))
    asks = (F.size("__ends") > 0) | (F.size("__addresses") > 0)
    by_address = F.exists(found, lambda a: F.exists("__ends", lambda e: F.endswith(a, e)) | F.array_contains(F.col("__addresses"), a))
    by_subject = (F.size("__subjects") == 0) | F.exists("__subjects", lambda r: F.regexp_like(F.col("subject"), r))
    within = (
        F.coalesce(F.col("__day") >= F.col("__since"), F.lit(True)) & F.coalesce(F.col("__day") <= F.col("__until"), F.lit(True))
        & F.coalesce(F.col("size") > F.col("__larger"), F.lit(True)) & F.coalesce(F.col("size") < F.col("__smaller"), F.lit(True))
    )
    hits = both.where(within & by_subject & (~asks | by_address))
    first = hits.groupBy("hdr_id").agg(F.min("ordinal").alias("ordinal"))
    return messages.join(first, "hdr_id", "left")


def file_base(rules: list[R.Rule]) -> Column:
    """File name of a matched message by the naming options of its rule."""
    wall, profile, subject = F.coalesce("date_wall", "received_wall"), F.col("profile"), F.col("subject")
    plain = base_name(wall, profile, subject)
    own = [(i, {k: r.options[o] for k, o in (("pattern", "filename_pattern"), ("date_format", "date_format")) if o in r.options}) for i, r in enumerate(rules)]
    return F.coalesce(*[F.when(F.col("ordinal") == i, base_name(wall, profile, subject, **o)) for i, o in own if o], plain)


def with_bodies(messages: DataFrame, bodies: DataFrame) -> DataFrame:
    """Messages with ``raw`` from ``bodies`` (state key, raw), joined after all filters; null where there is no body."""
    return messages.join(bodies.select(*st.KEY, "raw"), st.KEY, "left")


def attachment_names(messages: DataFrame) -> DataFrame:
    """hdr_id, name of every attachment of messages with ``raw``, for rules that look at them."""
    return read_mails(messages, "raw", ["hdr_id"]).select("hdr_id", F.explode("m.attachments.filename").alias("name"))


def rules_frame(spark, rules: list[R.Rule]) -> DataFrame:
    """ordinal, profile, label, move_to, deletes, has_action, action."""
    rows = [
        (i, r.name, r.label, r.move_to, r.delete, r.has_action, " and ".join(x for x in (f"label {r.label}" if r.label else None, f"move to {r.move_to}" if r.move_to else None, "delete" if r.delete else None) if x))
        for i, r in enumerate(rules)
    ]
    return spark.createDataFrame(rows, "ordinal int, profile string, label string, move_to string, deletes boolean, has_action boolean, action string")


def scan_filter(messages: DataFrame, rules: list[R.Rule]) -> DataFrame:
    """Messages within the loosest bounds of all rules; the filter reaches the scan.

    Unknown sizes and days stay, as every rule lets them pass.
    """
    bounds = R.weakest_bounds(rules)
    if bounds["since"] is not None:
        latest = F.greatest("date_wall", "received_wall").cast("date")
        messages = messages.where(F.coalesce(latest >= F.lit(bounds["since"]), F.lit(True)))
    if bounds["larger"] is not None:
        messages = messages.where(F.coalesce(F.col("size") > bounds["larger"], F.lit(True)))
    if bounds["smaller"] is not None:
        messages = messages.where(F.coalesce(F.col("size") < bounds["smaller"], F.lit(True)))
    return messages


@dataclass
class FetchPlan:
    """Named results of one fetch; nothing runs until one is used."""

    matched: DataFrame
    new: DataFrame
    planned: DataFrame
    actions: DataFrame
    report: DataFrame
    counters: DataFrame


def plan(
    messages: DataFrame, state: DataFrame, rules: list[R.Rule], folders: DataFrame, archive: DataFrame | None = None, server_actions: bool = True, strict: bool = True,
    namespaces: DataFrame | None = None, names: DataFrame | None = None, failed: DataFrame | None = None, failed_accounts: DataFrame | None = None, failed_actions: DataFrame | None = None,
) -> FetchPlan:
    """Plan a fetch over all accounts and folders.

    ``archive``: account, filename of files that exist; actions apply only to
    messages whose file does (all, if it is None).  ``namespaces`` (account,
    prefix, delimiter): folders that rules move mail into aren't read unless a
    rule of the account names them.  ``names``: hdr_id, name of attachments, for
    rules that look at them.  ``failed`` (state key), ``failed_accounts``
    (account), ``failed_actions`` (state key): what couldn't be read or done.  A
    failed message is neither delivered nor acted upon and stays for the next
    run, a failed account takes nothing else with it, and both are counted.
    """
    spark = messages.sparkSession
    table = rules_frame(spark, rules)
    if namespaces is not None:
        folders = without_move_targets(folders, move_targets(rules, namespaces), rules)
    if failed_accounts is not None:
        messages = messages.join(F.broadcast(failed_accounts.select("account").distinct()), "account", "left_anti")  # one row per account
    hits = matched(scan_filter(messages, rules), rules, folders, strict, names).where("ordinal is not null").join(F.broadcast(table), "ordinal")  # one row per rule
    name = F.concat(file_base(rules), F.lit(".eml"))
    known = state.select(*st.KEY, F.col("filename").alias("__recorded"), F.lit(True).alias("__done"))
    both = hits.join(known, st.KEY, "left").withColumn("already", F.coalesce("__done", F.lit(False)))
    both = both.withColumn("filename", F.coalesce("__recorded", name)).drop("__recorded", "__done")
    flagged = both.withColumn("failed", F.lit(False)) if failed is None else both.join(failed.select(*st.KEY).distinct().withColumn("__f", F.lit(True)), st.KEY, "left").withColumn("failed", F.coalesce("__f", F.lit(False))).drop("__f")
    both = flagged.where("not failed").drop("failed")
    new = both.where("not already")
    planned = new.select("profile", "account", "folder", "uid", "subject", F.coalesce(F.nullif("action", F.lit("")), F.lit("none")).alias("action"))
    candidates = both.where("has_action") if server_actions else both.where("false")
    if archive is not None:
        candidates = candidates.join(archive.select("account", "filename").distinct().withColumn("__there", F.lit(True)), ["account", "filename"], "left").withColumn("__file", F.coalesce("__there", F.lit(False)))
    else:
        candidates = candidates.withColumn("__file", F.lit(True))
    steps = F.filter(
        F.array(
            F.when(F.col("label").isNotNull(), F.struct(F.lit("label").alias("step"), F.col("label").alias("argument"))),
            F.when(F.col("move_to").isNotNull(), F.struct(F.lit("move").alias("step"), F.col("move_to").alias("argument"))),
            F.when(F.col("deletes"), F.struct(F.lit("delete").alias("step"), F.lit("").alias("argument"))),
        ),
        lambda x: x.isNotNull(),
    )
    due = candidates.where("__file").select(*st.KEY, "profile", "already", F.posexplode(steps).alias("step_no", "s"))
    actions = due.select(*st.KEY, "profile", (F.col("step_no") + 1).alias("step_no"), "s.step", "s.argument", "already")
    report = both.groupBy("profile").agg(F.count_if(~F.col("already")).alias("delivered"), F.count_if("already").alias("already_archived"))
    undone = failed_actions.select(*st.KEY).distinct().join(candidates.where("__file").select(*st.KEY), st.KEY, "left_semi") if failed_actions is not None else state.select(*st.KEY).where("false")
    counts = [
        flagged.agg(F.count_if("failed").alias("failed"), F.count_if(~F.col("failed") & F.col("already")).alias("already_archived")),
        candidates.agg(F.count_if(~F.col("__file")).alias("post_fetch_skipped")),
        undone.agg(F.count(F.lit(1)).alias("post_fetch_failed")),
    ]
    counters = counts[0].withColumn("__k", F.lit(1))
    for c in counts[1:]:
        counters = counters.join(c.withColumn("__k", F.lit(1)), "__k")  # one row each
    return FetchPlan(hits, new, planned, actions, report, counters.select("failed", "post_fetch_failed", "already_archived", "post_fetch_skipped"))


def move_targets(rules: list[R.Rule], namespaces: DataFrame) -> DataFrame:
    """account, folder of every resolved move destination (namespaces: account, prefix, delimiter)."""
    spark = namespaces.sparkSession
    wanted = spark.createDataFrame([(r.account, r.move_to) for r in rules if r.move_to], "only_account string, destination string")
    joined = namespaces.join(wanted, F.col("only_account").isNull() | (F.lower("account") == F.lower("only_account")))
    return joined.select("account", move_target(F.col("destination"), F.col("prefix"), F.col("delimiter")).alias("folder")).distinct()


def without_move_targets(folders: DataFrame, targets: DataFrame, rules: list[R.Rule]) -> DataFrame:
    """Folder scopes without move targets that no rule of the account lists by name."""
    named = targets.sparkSession.createDataFrame([(r.account, f) for r in rules for f in r.folders or ()], "only_account string, listed string")
    listed = (F.col("folder") == F.col("listed")) & (F.col("only_account").isNull() | (F.lower("account") == F.lower("only_account")))
    return folders.join(targets.join(F.broadcast(named), listed, "left_anti"), ["account", "folder"], "left_anti")


def namespace_of(namespaces: DataFrame, folders: DataFrame) -> DataFrame:
    """account, prefix, delimiter: the server's namespace, else the inbox where its folders lie under it.

    ``namespaces``: account, prefix (null: not told).  ``folders``: account, folder, delimiter.
    """
    d = F.coalesce(F.nullif("delimiter", F.lit("")), F.lit("/"))
    seen = folders.groupBy("account").agg(F.max(d).alias("delimiter"), F.bool_or(F.startswith("folder", F.concat(F.lit("INBOX"), d))).alias("under"))
    told = namespaces.select("account", F.col("prefix").alias("told"))
    guess = F.when(F.col("under"), F.concat(F.lit("INBOX"), "delimiter")).otherwise("")
    return seen.join(told, "account", "left").select("account", F.coalesce("told", guess).alias("prefix"), "delimiter")


def envelope_address(parts: Column) -> Column:
    """Header text of an array of (mailbox, host) structs."""
    return F.array_join(F.transform(parts, lambda p: F.concat_ws("@", p["mailbox"], p["host"])), ", ")


def headers_of_envelope(e: Column) -> Column:
    """Struct of header texts from a server's envelope (addresses as arrays of mailbox and host)."""
    fields = [envelope_address(e[f]).alias(c) for f, c in (("from", "from_"), ("to", "to_"), ("cc", "cc"), ("bcc", "bcc"))]
    return F.struct(*fields, decode_words(F.coalesce(e["subject"], F.lit(""))).alias("subject"), e["date"].alias("date_"), F.nullif(F.trim(e["message_id"]), F.lit("")).alias("message_id"))


def sender(message: Column) -> Column:
    """Address of a sender header."""
    return F.lower(email_address(message))
