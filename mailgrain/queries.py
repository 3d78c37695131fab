"""Queries of the core operators and the SQL that checks them.

The mailbox is scanned_message with its mail_headers; state is the delivery log;
archive folders and files are derived from deliveries and attachments.
"""

from __future__ import annotations

import dataclasses
import datetime as dt

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mailgrain.functions import attachments as A
from mailgrain.functions import markup as H
from mailgrain.functions import mime as M
from mailgrain.functions import text as X
from mailgrain.operators import audit, instants, naming, packed_fields, redelivery, reports
from mailgrain.operators import state as st
from mailgrain.plans import fetch, render
from mailgrain.plans import rules as R
from mailgrain.runtime import materialise, spread, table
from mailgrain.sources import config, mailbox, sinks
from mailgrain.streaming import delivery

QUERIES: dict = {}
SQL: dict[str, str] = {}

RULES = [
    R.Rule("invoices", subject=("*rechnung*", "*invoice*", "*facture*"), folders=("INBOX/Invoices",), larger=5 * 1024, move_to="Archive/Invoices"),
    R.Rule("nordlicht", domains=("@nordlicht.example", "nordlicht-group.example"), mode=("from",), recursive=True, since=dt.date(2020, 1, 1)),
    R.Rule("lists", subject=r"^(Re: )?\[list-\d+\]", folders=("Lists", "INBOX"), label="list"),
    R.Rule("team", domains=("test",), mode=("to",), until=dt.date(2022, 12, 31), smaller=2 * 1024**2, label="team", move_to="Team/2022"),
    R.Rule("catchall", folders=("Archive",), delete=True),
]

MBOX = r"""
mbox as (
  select s.account, s.folder, s.uidvalidity, s.uid, s.hdr_id, s.rfc822_size as size,
    coalesce(h.from_, '') as from_, coalesce(h.to_, '') as to_, coalesce(h.subject, '') as subject,
    nullif(trim(h.message_id, ' '), '') as message_id
  from scanned_message s join mail_headers h on s.hdr_id = h.hdr_id
)"""
FROM_ADDRESSES = r"regexp_extract_all(lower(from_), '[\w.+-]+@[\w.-]+')"
TO_ADDRESSES = r"regexp_extract_all(lower(to_), '[\w.+-]+@[\w.-]+')"
NORDLICHT = f"len(list_filter({FROM_ADDRESSES}, lambda a: a like '%@nordlicht.example' or a like '%.nordlicht.example' or a like '%@nordlicht-group.example' or a like '%.nordlicht-group.example')) > 0"
TEST_TO = f"len(list_filter({TO_ADDRESSES}, lambda a: a like '%@test' or a like '%.test')) > 0"
GLOBS = "(lower(subject) like '%rechnung%' or lower(subject) like '%invoice%' or lower(subject) like '%facture%')"
HITS = f"""
hits as (
  select mbox.*, case
    when folder = 'INBOX/Invoices' and {GLOBS} and coalesce(size > 5120, true) then 0
    when (folder = 'INBOX' or folder like 'INBOX/%') and {NORDLICHT} then 1
    when folder in ('Lists', 'INBOX') and regexp_matches(subject, '^(Re: )?\\[list-\\p{{Nd}}+\\]') then 2
    when folder = 'INBOX' and {TEST_TO} and coalesce(size < 2097152, true) then 3
    when folder = 'Archive' then 4 end as ordinal
  from mbox
)""".replace("\\\\", "\\")
RULE_NAMES = "['invoices', 'nordlicht', 'lists', 'team', 'catchall']"
STATE = """
state as (
  select account, folder, uidvalidity, uid, arg_min(coalesce(filename, '?'), hdr_id) as filename, arg_min(coalesce(profile, '?'), hdr_id) as profile
  from delivered group by all
)"""


def query(sql: str | None = None):
    """Register a query with its SQL."""

    def add(function):
        QUERIES[function.__name__] = function
        if sql is not None:
            SQL[function.__name__] = sql
        return function

    return add


#: The rules without day bounds.  Days are written in forms that SQL can't read, so SQL checks everything else by these.
DATELESS = [dataclasses.replace(r, since=None, until=None) for r in RULES]


def mbox(spark: SparkSession, d: str) -> DataFrame:
    return mailbox.mailbox(table(spark, d, "scanned_message"), table(spark, d, "mail_headers"), table(spark, d, "account"))


def folder_list(spark: SparkSession, d: str) -> DataFrame:
    listed = table(spark, d, "scanned_message").select("account", "folder").distinct().withColumn("delimiter", F.lit("/"))
    flags = F.when((F.col("folder") == "Trash") & (F.length("account") % 2 == 0), F.array(F.lit("\\Trash"))).otherwise(F.array().cast("array<string>"))
    return listed.withColumn("flags", flags)


def scopes(spark: SparkSession, d: str) -> DataFrame:
    folders = materialise(folder_list(spark, d), "folders")  # a few rows per account, read five times
    return R.folder_map(spark, RULES, folders, mailbox.trash_folders(folders))


def state_of(spark: SparkSession, d: str) -> DataFrame:
    log = table(spark, d, "delivered").select(*st.KEY, F.coalesce("filename", F.lit("?")).alias("filename"), F.coalesce("profile", F.lit("?")).alias("profile"), "hdr_id")
    empty = log.select(*st.COLUMNS).where("false")
    return st.insert_or_ignore(empty, log, F.col("hdr_id"))


def fetch_plan(spark: SparkSession, d: str, with_archive: bool = False, rules: list[R.Rule] = RULES) -> fetch.FetchPlan:
    state = state_of(spark, d)
    archive = state.where("filename <> '?' and uid % 3 <> 0").select("account", "filename") if with_archive else None
    # a message of unknown size stands for one that couldn't be read
    failed = table(spark, d, "scanned_message").where("rfc822_size is null").select(*st.KEY)
    return fetch.plan(mbox(spark, d), state, rules, scopes(spark, d), archive, strict=False, failed=failed)


@query()
def p1_found(spark, d):
    """Recipients of every field that packs two or more."""
    return packed_fields.recipients(table(spark, d, "mail_headers"), 2).select("hdr_id", "fld", "pos", "addr")


@query(r"""
with h as (
  select hdr_id, subject, regexp_replace(message_id, '^[\s<]+|[\s>]+$', '', 'g') as inner_id from mail_headers
), k as (
  select d.*, h.subject,
    case when inner_id is null or inner_id = '' then null
      when instr(inner_id, '@') = 0 then inner_id
      else concat(regexp_replace(inner_id, '@[^@]*$', ''), '@', lower(regexp_extract(inner_id, '@([^@]*)$', 1))) end as ident
  from delivered d left join h on d.hdr_id = h.hdr_id
), r as (
  select hdr_id,
    case when ident is not null then min(hdr_id) over (partition by account, ident, subject)
      else min(hdr_id) over (partition by account, folder, uidvalidity, uid, ident is null) end as first_id
  from k
)
select hdr_id from r where hdr_id > first_id""")
def p5_found(spark, d):
    """Delivered rows that repeat a message."""
    return redelivery.repeats(table(spark, d, "delivered"), table(spark, d, "mail_headers"))


@query()
def p6_found(spark, d):
    """Readable instants as UTC seconds."""
    return instants.mail_instants(table(spark, d, "mail_headers"), table(spark, d, "scanned_message"), table(spark, d, "account"))


@query(r"""
with t as (select 'date' as fld, date_ as t from mail_headers union all select 'received', received from scanned_message)
select fld, trim(regexp_replace(regexp_replace(t, '[0-9]', '9', 'g'), '\p{L}', 'A', 'g'), ' ') as mask, count(*) as n from t where t is not null group by all""")
def p6_masks(spark, d):
    """Shapes of all time values with their counts."""
    h, s = table(spark, d, "mail_headers"), table(spark, d, "scanned_message")
    both = h.select(F.lit("date").alias("fld"), F.col("date_").alias("t")).unionByName(s.select(F.lit("received").alias("fld"), F.col("received").alias("t")))
    return instants.masks(both, "t", ["fld"]).drop("known")


@query()
def p6_unread(spark, d):
    """Shapes that no parser reads, with their counts."""
    h, s = table(spark, d, "mail_headers"), table(spark, d, "scanned_message")
    both = h.select(F.lit("date").alias("fld"), F.col("date_").alias("t")).unionByName(s.select(F.lit("received").alias("fld"), F.col("received").alias("t")))
    return instants.masks(both, "t", ["fld"]).where("not known").drop("known")


@query()
def fetch_report(spark, d):
    """Deliveries per rule: first match, anti-join with the state, grouped counts."""
    return fetch_plan(spark, d).report


@query(f"""with {MBOX}, {HITS}, keys as (select distinct account, folder, uidvalidity, uid, 1 as known from delivered)
select {RULE_NAMES}[ordinal + 1] as profile, cast(count(*) filter (where known is null) as bigint) as delivered,
  cast(count(*) filter (where known is not null) as bigint) as already_archived
from hits left join keys using (account, folder, uidvalidity, uid) where ordinal is not null and size is not null group by 1""")
def fetch_report_dateless(spark, d):
    """``fetch_report`` by the rules without days."""
    return fetch_plan(spark, d, rules=DATELESS).report


@query()
def first_match(spark, d):
    """First rule of every message, as one compiled expression."""
    return fetch.matched(mbox(spark, d), RULES, scopes(spark, d), strict=False).select("hdr_id", "ordinal")


@query(f"with {MBOX}, {HITS} select hdr_id, cast(ordinal as integer) as ordinal from hits")
def first_match_dateless(spark, d):
    """``first_match`` by the rules without days."""
    return fetch.matched(mbox(spark, d), DATELESS, scopes(spark, d), strict=False).select("hdr_id", "ordinal")


@query()
def first_match_table(spark, d):
    """First rule of every message, as a join with the rule table."""
    return fetch.matched_by_table(mbox(spark, d), RULES, scopes(spark, d), strict=False).select("hdr_id", "ordinal")


@query(SQL["first_match_dateless"])
def first_match_table_dateless(spark, d):
    """``first_match_table`` by the rules without days."""
    return fetch.matched_by_table(mbox(spark, d), DATELESS, scopes(spark, d), strict=False).select("hdr_id", "ordinal")


@query()
def first_match_strict(spark, d):
    """First rule with addresses by the strict header reader."""
    return fetch.matched(mbox(spark, d), RULES, scopes(spark, d)).select("hdr_id", "ordinal")


@query("select account, folder, uidvalidity, uid, hdr_id from scanned_message order by account, folder, uid")
def scan_sorted(spark, d):
    """Scan in order of uid within folders."""
    return table(spark, d, "scanned_message").select(*st.KEY, "hdr_id").orderBy("account", "folder", "uid")


@query("select hdr_id, rfc822_size as size from scanned_message where rfc822_size > 5120 or rfc822_size is null")
def scan_weakest_bound(spark, d):
    """Scan under the loosest size bound of two rules."""
    two = [R.Rule("a", larger=5120), R.Rule("b", larger=1024**2)]
    s = table(spark, d, "scanned_message").select("hdr_id", F.col("rfc822_size").alias("size"))
    return fetch.scan_filter(s, two)


@query(f"with {MBOX} select hdr_id from mbox where {NORDLICHT}")
def match_domain(spark, d):
    """Sender in a domain or below it."""
    m = fetch.with_addresses(mbox(spark, d), [RULES[1]], strict=False)
    return m.where(R.address_predicate(RULES[1], F.col("__addr_from"))).select("hdr_id")


@query(f"with {MBOX} select hdr_id from mbox where list_contains({TO_ADDRESSES}, 'nordqvist@quarzo-group.test')")
def match_address_mode(spark, d):
    """Exact address in the To field only."""
    rule = R.Rule("x", addresses=("Nordqvist@quarzo-group.test",), mode=("to",))
    m = fetch.with_addresses(mbox(spark, d), [rule], strict=False)
    return m.where(R.address_predicate(rule, F.col("__addr_to"))).select("hdr_id")


@query(f"with {MBOX} select hdr_id from mbox where regexp_matches(subject, '^(Re: )?\\[list-\\p{{Nd}}+\\]')")
def match_subject_regex(spark, d):
    """Subject by unanchored, case-sensitive expression."""
    return mbox(spark, d).where(R.subject_predicate(RULES[2].subject, F.col("subject"))).select("hdr_id")


@query(f"with {MBOX} select hdr_id from mbox where {GLOBS}")
def match_subject_glob(spark, d):
    """Subject by any case-blind glob."""
    return mbox(spark, d).where(R.subject_predicate(RULES[0].subject, F.col("subject"))).select("hdr_id")


@query()
def match_date_window(spark, d):
    """Inclusive day window; undated messages pass."""
    rule = R.Rule("x", since=dt.date(2020, 6, 1), until=dt.date(2021, 5, 31))
    return mbox(spark, d).where(_alone(rule)).select("hdr_id")


@query(f"with {MBOX} select hdr_id from mbox where coalesce(size > 10000 and size < 500000, true)")
def match_size_window(spark, d):
    """Strict size window; unknown sizes pass."""
    return mbox(spark, d).where(_alone(R.Rule("x", larger=10_000, smaller=500_000))).select("hdr_id")


def _alone(rule: R.Rule):
    return R.header_predicate(rule, {}, F.col("subject"), F.col("date_wall"), F.col("received_wall"), F.col("size"))


@query(r"""
select hdr_id from attachment_part group by hdr_id
having count(*) filter (where lower(regexp_extract(filename, '^(?:.*/)?[^/]+\.([^./]+)$', 1)) in ('pdf', 'csv')) > 0""")
def match_attachment_suffix(spark, d):
    """Mails with an attachment of a wanted suffix."""
    names = table(spark, d, "attachment_part").groupBy("hdr_id").agg(F.collect_list("filename").alias("names"))
    return names.where(R.attachment_predicate((".PDF", "csv"), F.col("names"))).select("hdr_id")


@query(r"""
with f as (select distinct account, folder from scanned_message), a as (select distinct account from f)
select account, 'INBOX/Invoices' as folder, 0 as ordinal from a
union select account, 'INBOX', 1 from a union select account, folder, 1 from f where folder like 'INBOX/%'
union select account, 'Lists', 2 from a union select account, 'INBOX', 2 from a union select account, 'INBOX', 3 from a union select account, 'Archive', 4 from a""")
def folder_expand(spark, d):
    """Folders each rule reads, recursive ones expanded."""
    return scopes(spark, d)


@query("select distinct account, folder from scanned_message where folder = 'Trash'")
def trash_folders(spark, d):
    """Trash by flag, else by name."""
    return mailbox.trash_folders(folder_list(spark, d))


@query(r"""
with a as (select distinct account from scanned_message)
select account, case when length(account) % 2 = 0 then 'INBOX.' || x else x end as folder
from a, (values ('Archive/Invoices'), ('Team/2022')) v(t), lateral (select case when length(account) % 2 = 0 then replace(t, '/', '.') else t end as x)""")
def move_targets(spark, d):
    """Server names of the move destinations."""
    ns = folder_list(spark, d).select("account").distinct()
    dotted = F.length("account") % 2 == 0
    ns = ns.select("account", F.when(dotted, "INBOX.").otherwise("").alias("prefix"), F.when(dotted, ".").otherwise("").alias("delimiter"))
    return fetch.move_targets(RULES, ns)


@query(r"""
with f as (select distinct account, folder from scanned_message)
select account, folder from f where folder <> 'INBOX/Projects'""")
def move_target_exclusion(spark, d):
    """Folders without move targets nobody lists."""
    rules = [R.Rule("x", move_to="INBOX/Projects"), R.Rule("y", move_to="Lists", folders=("Lists",))]
    folders = folder_list(spark, d).select("account", "folder")
    ns = folders.select("account").distinct().select("account", F.lit("").alias("prefix"), F.lit("/").alias("delimiter"))
    return fetch.without_move_targets(folders, fetch.move_targets(rules, ns), rules)


@query("select s.hdr_id from scanned_message s anti join delivered d using (account, folder, uidvalidity, uid)")
def delivered_anti(spark, d):
    """Messages not delivered yet."""
    return st.not_delivered(table(spark, d, "scanned_message"), table(spark, d, "delivered")).select("hdr_id")


@query("select cast(count(*) as bigint) as already_archived from scanned_message s semi join delivered d using (account, folder, uidvalidity, uid)")
def already_archived_count(spark, d):
    """Count of messages delivered before."""
    return st.already_delivered(table(spark, d, "scanned_message"), table(spark, d, "delivered")).agg(F.count(F.lit(1)).alias("already_archived"))


@query()
def retry_actions(spark, d):
    """Server actions due on delivered mail whose archive file exists."""
    return fetch_plan(spark, d, with_archive=True).actions.where("already").drop("already")


@query(f"""with {MBOX}, {HITS}, {STATE}
select hits.account, hits.folder, hits.uidvalidity, hits.uid, {RULE_NAMES}[ordinal + 1] as profile, cast(row_number() over (partition by hits.hdr_id order by k) as integer) as step_no, step, argument
from hits join state on hits.account = state.account and hits.folder = state.folder and hits.uidvalidity = state.uidvalidity and hits.uid = state.uid
  join (select distinct account, filename from state where filename <> '?' and uid % 3 <> 0) a on a.account = hits.account and a.filename = state.filename
  join (values (0, 1, 'move', 'Archive/Invoices'), (2, 1, 'label', 'list'), (3, 1, 'label', 'team'), (3, 2, 'move', 'Team/2022'), (4, 1, 'delete', '')) v(o, k, step, argument) on v.o = ordinal where size is not null""")
def retry_actions_dateless(spark, d):
    """``retry_actions`` by the rules without days."""
    return fetch_plan(spark, d, with_archive=True, rules=DATELESS).actions.where("already").drop("already")


@query()
def post_fetch_steps(spark, d):
    """Ordered server actions of every matched message."""
    return fetch_plan(spark, d).actions.drop("already")


@query(f"""with {MBOX}, {HITS}
select account, folder, uidvalidity, uid, {RULE_NAMES}[ordinal + 1] as profile, cast(k as integer) as step_no, step, argument
from hits join (values (0, 1, 'move', 'Archive/Invoices'), (2, 1, 'label', 'list'), (3, 1, 'label', 'team'), (3, 2, 'move', 'Team/2022'), (4, 1, 'delete', '')) v(o, k, step, argument) on v.o = ordinal where size is not null""")
def post_fetch_steps_dateless(spark, d):
    """``post_fetch_steps`` by the rules without days."""
    return fetch_plan(spark, d, rules=DATELESS).actions.drop("already")


@query()
def planned_delivery(spark, d):
    """Dry run: what would be delivered, and the action to follow."""
    return fetch_plan(spark, d).planned


@query(f"""with {MBOX}, {HITS}
select {RULE_NAMES}[ordinal + 1] as profile, account, folder, uid, subject,
  ['move to Archive/Invoices', 'none', 'label list', 'label team and move to Team/2022', 'delete'][ordinal + 1] as action
from hits anti join delivered using (account, folder, uidvalidity, uid) where ordinal is not null and size is not null""")
def planned_delivery_dateless(spark, d):
    """``planned_delivery`` by the rules without days."""
    return fetch_plan(spark, d, rules=DATELESS).planned


@query(f"with {STATE} select * from state")
def state_insert_or_ignore(spark, d):
    """State of the delivery log, first write wins."""
    return state_of(spark, d)


@query(f"with {STATE} select * from state where profile is distinct from 'orders_00'")
def state_clear_profile(spark, d):
    """State after a targeted clear."""
    kept, _ = st.clear(state_of(spark, d), "orders_00")
    return kept


@query("select cast(count(*) filter (where profile is null) as bigint) as untracked from delivered")
def state_untracked(spark, d):
    """Legacy rows without a profile."""
    return st.untracked(st.migrate(table(spark, d, "delivered")))


#: What counts as a blank in names, as a character class.
BLANKS = r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
SAFE = rf"trim(regexp_replace(regexp_replace({{x}}, '[/\\:*?\"<>|]', '_', 'g'), '[{BLANKS.replace(chr(123), chr(123) * 2).replace(chr(125), chr(125) * 2)}_]+', '_', 'g'), '_')"


@query()
def base_name(spark, d):
    """File names of all messages."""
    name = X.base_name(F.coalesce("date_wall", "received_wall"), F.lit("demo"), F.col("subject"))
    return mbox(spark, d).select("hdr_id", name.alias("base_name"))


@query(f"""with {MBOX}, b as (select hdr_id, {SAFE.format(x="nfc_normalize(concat('demo_', subject))")} as safe from mbox),
n as (select hdr_id, unnest(generate_series(40, 200)) as n, safe from b where strlen(safe) > 200),
f as (select hdr_id, max(n) as n from n where strlen(left(safe, cast(n as integer))) <= 200 group by hdr_id)
select hdr_id, case when safe = '' then 'email' else rtrim(case when f.n is null then safe else left(safe, cast(f.n as integer)) end, ' ') end as base_name from b left join f using (hdr_id)""")
def base_name_dateless(spark, d):
    """``base_name`` of profile and subject."""
    name = X.base_name(F.lit(None).cast("timestamp_ntz"), F.lit("demo"), F.col("subject"), "{profile}_{subject}")
    return mbox(spark, d).select("hdr_id", name.alias("base_name"))


@query(f"select part_id, {SAFE.format(x='nfc_normalize(filename)')} as safe from attachment_part")
def sanitize_nfc(spark, d):
    """Safe file names; null stays null."""
    return table(spark, d, "attachment_part").select("part_id", X.sanitize(F.col("filename")).alias("safe"))


@query(r"""
with t as (select doc_id, text from documents where text is not null),
c as (select doc_id, text, unnest(generate_series(190, 200)) as n from t where strlen(text) > 200),
p as (select doc_id, max(n) as n from (select doc_id, n, left(text, cast(n as integer)) as x from (select doc_id, text, unnest(generate_series(50, 200)) as n from t where strlen(text) > 200)) where strlen(x) <= 200 group by doc_id)
select t.doc_id, rtrim(case when strlen(text) <= 200 then text else left(text, cast(p.n as integer)) end, ' ') as cut from t left join p using (doc_id)""")
def truncate_bytes(spark, d):
    """Texts capped at 200 bytes on a character."""
    return table(spark, d, "documents").where("text is not null").select("doc_id", X.truncate_bytes(F.col("text")).alias("cut"))


@query(r"""
with v(t, n) as (values ('512', 512), ('5 MB', 5242880), ('1.5kb', 1536), ('2G', 2147483648), (' 7 b ', 7), ('', null), ('MB', null), ('-5', null), ('five', null))
select t, cast(n as bigint) as size from v""")
def parse_size(spark, d):
    """Size literals of the rule language."""
    rows = [("512",), ("5 MB",), ("1.5kb",), ("2G",), (" 7 b ",), ("",), ("MB",), ("-5",), ("five",)]
    return spark.createDataFrame(rows, "t string").select("t", X.parse_size(F.col("t")).alias("size"))


@query(r"""
select hdr_id, case when rfc822_size is null then null when rfc822_size < 1024 then concat(rfc822_size, ' B')
  when rfc822_size < 1048576 then concat(printf('%.1f', rfc822_size / 1024.0), ' KB')
  when rfc822_size < 1073741824 then concat(printf('%.1f', rfc822_size / 1048576.0), ' MB')
  else concat(printf('%.1f', rfc822_size / 1073741824.0), ' GB') end as size
from scanned_message""")
def format_size(spark, d):
    """Human sizes."""
    return table(spark, d, "scanned_message").select("hdr_id", X.format_size(F.col("rfc822_size")).alias("size"))


@query()
def format_date_human(spark, d):
    """Human dates."""
    return mbox(spark, d).select("hdr_id", X.format_date_human(F.col("date_wall")).alias("shown"))


@query(rf"""
with p as (select filename as t, regexp_extract(regexp_replace(replace(filename, chr(92), '/'), '(?:/+\.)*/*$', ''), '([^/]*)$', 1) as last from attachment_part),
c as (select t, regexp_replace(regexp_replace(last, '[\x00-\x1f\x7f]', '', 'g'), '^[{BLANKS}]+|[{BLANKS}]+$', '', 'g') as clean from p)
select t, case when clean is null or clean in ('', '.', '..') then 'attachment' else clean end as safe from c""")
def safe_attachment_name(spark, d):
    """Attachment names without paths."""
    return table(spark, d, "attachment_part").select(F.col("filename").alias("t"), X.safe_attachment_name(F.col("filename")).alias("safe"))


SNIFF = """case when starts_with(h, '255044462D') then 'application/pdf' when starts_with(h, '89504E470D0A1A0A') then 'image/png' when starts_with(h, 'FFD8FF') then 'image/jpeg'
  when h[:12] in ('474946383761', '474946383961') then 'image/gif' when h[:8] in ('49492A00', '4D4D002A') then 'image/tiff'
  when h[:8] = '52494646' and h[17:24] = '57454250' then 'image/webp' end"""
KINDS = f"""
parts as (select *, hex(content) as h, lower(regexp_extract(filename, '^(?:.*/)?[^/]+\\.([^./]+)$', 1)) as suffix from attachment_part),
kinds as (select *, coalesce({SNIFF}, lower(content_type)) as mime from parts),
sorted as (select *, case when mime = 'application/pdf' then 'PDF' when mime in ('image/jpeg', 'image/jpg', 'image/png', 'image/gif', 'image/tiff', 'image/webp', 'image/heic', 'image/heif', 'image/avif') then 'IMAGE'
  when coalesce(mime in ('text/plain', 'text/markdown', 'text/x-markdown'), false) or coalesce(suffix in ('txt', 'md', 'markdown', 'text'), false) then 'TEXT' else 'OPAQUE' end as kind from kinds)"""


@query(f"with {KINDS} select part_id, mime, kind from sorted")
def sniff_classify(spark, d):
    """Types by content and kinds of attachments."""
    c = [F.col("content"), F.col("content_type"), F.col("filename")]
    return table(spark, d, "attachment_part").select("part_id", A.effective_mime(*c[:2]).alias("mime"), A.classify(*c).alias("kind"))


@query("select doc_id, text as decoded from documents")
def decode_text(spark, d):
    """Bytes to text: UTF-8, else Latin-1."""
    return table(spark, d, "documents").select("doc_id", X.decode_bytes(F.encode("text", "UTF-8")).alias("decoded"))


def raw_mail(spark: SparkSession, d: str) -> DataFrame:
    """RFC 822 bytes of documents: encoded subject, text body and one attachment."""
    b64 = lambda c: F.regexp_replace(F.base64(F.encode(c, "UTF-8")), r"[\r\n]", "")
    subject = F.concat(F.lit("Nachricht é "), F.col("doc_id").cast("string"))
    lines = [
        F.lit("From: Sender <sender@example.org>"), F.concat(F.lit("To: r"), F.col("doc_id").cast("string"), F.lit("@example.org")),
        F.concat(F.lit("Subject: =?utf-8?B?"), b64(subject), F.lit("?=")), F.lit("Date: Tue, 02 Jan 2024 10:20:30 +0100"),
        F.concat(F.lit("Message-ID: <"), F.col("doc_id").cast("string"), F.lit("@example.org>")), F.lit("MIME-Version: 1.0"),
        F.lit('Content-Type: multipart/mixed; boundary="edge"'), F.lit(""), F.lit("--edge"), F.lit("Content-Type: text/plain; charset=utf-8"),
        F.lit("Content-Transfer-Encoding: base64"), F.lit(""), b64(F.col("text")), F.lit("--edge"), F.lit('Content-Type: application/octet-stream; name="data.bin"'),
        F.lit('Content-Disposition: attachment; filename="data.bin"'), F.lit("Content-Transfer-Encoding: base64"), F.lit(""), b64(F.col("source")), F.lit("--edge--"), F.lit(""),
    ]
    return table(spark, d, "documents").where("text is not null and source is not null").select("doc_id", F.encode(F.concat_ws("\r\n", *lines), "UTF-8").alias("raw"))


def parsed(spark: SparkSession, d: str) -> DataFrame:
    return M.read_mails(spread(raw_mail(spark, d)), "raw", ["doc_id"])


@query("""
select doc_id, concat('Nachricht é ', doc_id) as subject, concat('r', doc_id, '@example.org') as recipient, concat('<', doc_id, '@example.org>') as message_id,
  '2024-01-02 10:20:30' as wall, 60 as offset_min from documents where text is not null and source is not null""")
def mime_headers_roundtrip(spark, d):
    """Headers of synthesised mails equal what they were made of."""
    return parsed(spark, d).select("doc_id", "m.subject", F.col("m.to").alias("recipient"), "m.message_id", F.date_format("m.wall", "yyyy-MM-dd HH:mm:ss").alias("wall"), "m.offset_min")


@query("select doc_id, text as body from documents where text is not null and source is not null")
def mime_body_roundtrip(spark, d):
    """Bodies of synthesised mails."""
    return parsed(spark, d).select("doc_id", F.col("m.text_body").alias("body"))


@query("select doc_id, 1 as part_no, 'data.bin' as filename, source as content from documents where text is not null and source is not null")
def mime_parts(spark, d):
    """Attachments of synthesised mails, exploded."""
    p = parsed(spark, d).select("doc_id", F.posexplode("m.attachments").alias("k", "a"))
    return p.select("doc_id", (F.col("k") + 1).alias("part_no"), "a.filename", F.decode("a.content", "UTF-8").alias("content"))


#: Shapes of mails by turn: (type of the whole, [(type, headers, what it holds)]); T is the document's text, S its source.
ATTACHED = 'Content-Disposition: attachment; filename="{}"'
SHAPES = [
    ("multipart/mixed", [("multipart/related", "", [("multipart/alternative", "", [("text/plain", "", "T"), ("text/html", "", "<p>S</p>")]), ("image/png", "Content-ID: <logo>", "S")]), ("application/pdf", ATTACHED.format("doc.pdf"), "S")]),
    ("multipart/alternative", [("text/plain", "", "T"), ("text/html", "", "<p>S</p>"), ("text/calendar", "", "BEGIN:VCALENDAR"), ("text/x-amp-html", "", "S")]),
    ("multipart/alternative", [("text/plain", "", "T"), ("text/calendar", ATTACHED.format("invite.ics"), "S")]),
    ("multipart/mixed", [("text/html", "", "<p>S</p>"), ("message/rfc822", ATTACHED.format("fwd.eml"), "Subject: inner\r\nContent-Type: image/png\r\nContent-ID: <in>\r\n\r\nS")]),
    ("multipart/mixed", [("text/plain", "", "T"), ("multipart/mixed", ATTACHED.format("nested.eml"), [("text/plain", "", "S")])]),
    ("text/plain", ATTACHED.format("only.txt")),
    ("text/plain", ""),
    ("multipart/mixed", None),
]


def shaped_mail(k: int, text, source):
    """RFC 822 text of the k-th shape as a column; plain bodies are base64."""

    def part(kind, headers, holds, depth):
        head = [F.lit(f"Content-Type: {kind}" + (f'; boundary="b{depth}"' if isinstance(holds, list) else "; charset=utf-8" if kind.startswith("text/") else ""))]
        head += [F.lit(headers)] if headers else []
        if not isinstance(holds, list):
            if holds == "T":
                return [*head, F.lit("Content-Transfer-Encoding: base64"), F.lit(""), text]
            before, _, after = holds.partition("S")
            return [*head, F.lit(""), F.concat(F.lit(before), source, F.lit(after)) if "S" in holds and "VCAL" not in holds else F.lit(holds)]
        lines = [*head, F.lit("")]
        for n, p in enumerate(holds, 1):
            lines += [F.lit(f"--b{depth}"), *part(*p, depth * 10 + n)]
        return [*lines, F.lit(f"--b{depth}--"), F.lit("")]

    kind, holds = SHAPES[k]
    if holds is None:  # cut off inside its only part
        lines = [F.lit('Content-Type: multipart/mixed; boundary="b1"'), F.lit(""), F.lit("--b1"), F.lit("Content-Type: text/plain"), F.lit(""), source]
    else:
        lines = part(kind, "", holds, 1) if isinstance(holds, list) else part(kind, holds, "T", 1)
    return F.concat_ws("\r\n", F.lit("From: a@example.org"), F.lit("MIME-Version: 1.0"), *lines)


@query("""
select doc_id,
  case doc_id % 8 when 3 then null when 5 then null when 7 then source else text end as text_body,
  case when doc_id % 8 in (0, 1, 3) then concat('<p>', source, '</p>') end as html_body,
  case doc_id % 8 when 0 then 'doc.pdf' when 2 then 'invite.ics' when 3 then 'fwd.eml' when 4 then 'nested.eml' when 5 then 'only.txt' else '' end as attachments,
  case doc_id % 8 when 0 then 'logo' else '' end as inline
from documents where text is not null and source is not null""")
def mime_structure(spark, d):
    """Shown bodies, attachments and inline parts of mails of eight structures."""
    b64 = F.regexp_replace(F.base64(F.encode("text", "UTF-8")), r"[\r\n]", "")
    docs = table(spark, d, "documents").where("text is not null and source is not null")
    raw = F.coalesce(*[F.when(F.pmod("doc_id", F.lit(8)) == k, shaped_mail(k, b64, F.col("source"))) for k in range(8)])
    m = M.read_mails(spread(docs.select("doc_id", F.encode(raw, "UTF-8").alias("raw"))), "raw", ["doc_id"])
    names = lambda parts, field: F.array_join(F.transform(parts, lambda p: p[field]), ",")
    return m.select("doc_id", "m.text_body", "m.html_body", names(F.col("m.attachments"), "filename").alias("attachments"), names(F.col("m.inline_parts"), "content_id").alias("inline"))


@query("select hdr_id, coalesce(nullif(trim(message_id, ' '), ''), concat_ws('|', coalesce(from_, ''), coalesce(subject, ''), coalesce(date_, ''))) as first_line, concat('sha256:', sha256(coalesce(subject, ''))) as hash_line from mail_headers")
def identity_hash(spark, d):
    """Identity lines of mails."""
    h = table(spark, d, "mail_headers")
    i = naming.identity(F.col("message_id"), F.col("from_"), F.col("subject"), F.col("date_"), F.coalesce("subject", F.lit("")).cast("binary"))
    return h.select("hdr_id", i.alias("i")).select("hdr_id", F.col("i.primary").alias("first_line"), F.col("i.sha256").alias("hash_line"))


@query("""
select n, same from (values (1, true), (2, false), (3, true), (4, false), (5, false)) v(n, same)""")
def same_mail(spark, d):
    """Pairs of manifests."""
    rows = [(1, "a\nsha256:1", "b\nsha256:1"), (2, "a\nsha256:1", "a\nsha256:2"), (3, "a", "a\nsha256:2"), (4, None, "a"), (5, "x", "y\nsha256:1")]
    pairs = spark.createDataFrame(rows, "n int, stored string, current string")
    return pairs.select("n", naming.same_mail(F.col("stored"), F.col("current")).alias("same"))


@query("select source, min(doc_id) as doc_id, cast(count(*) as bigint) as copies from documents where text is not null and source is not null group by source, text")
def content_dedup(spark, d):
    """Distinct contents of every source."""
    docs = table(spark, d, "documents").where("text is not null and source is not null")
    return naming.content_dedup(docs, ["source"], "text", "doc_id").select("source", "doc_id", "copies")


@query("""
with f as (select source, md5(text) as ident, min(doc_id) as first_id from documents where text is not null and source is not null group by 1, 2),
k as (select *, row_number() over (partition by source order by first_id) as n from f)
select d.doc_id, case when n = 1 then k.source else concat(k.source, '-', n) end as name, d.doc_id > first_id as skip
from documents d join k on d.source = k.source and md5(d.text) = k.ident""")
def unique_names(spark, d):
    """Collision-free names by source, in order of doc_id."""
    docs = table(spark, d, "documents").where("text is not null and source is not null").select("doc_id", "source", F.md5(F.col("text").cast("binary")).alias("ident"))
    return naming.unique_names(docs, "source", "ident", ["doc_id"]).select("doc_id", "name", "skip")


@query()
def unique_names_cross(spark, d):
    """Exact names of attachments by content, in order of part_id, where a name may meet a numbered one."""
    ident = F.coalesce(F.sha2("content", 256), F.lit("-"))
    parts = table(spark, d, "attachment_part").select(F.col("part_id").alias("n"), X.safe_attachment_name(F.col("filename")).alias("base"), ident.alias("ident"))
    parts = parts.withColumn("grp", F.regexp_replace("base", r"(-\d+)+\z", ""))
    return naming.unique_names_probe(parts, "grp", "base", "ident", ["n"]).select("n", "name", "skip")


@query(r"""select mail_id, not regexp_matches(html_body, '(?i)<(a|b|i|img|table|tr|td|ul|li|h1|strong|em|u)[ >]') and not regexp_matches(html_body, '(?i)\b(background|border)\b') and trim(html_body) <> '' as trivial from parsed_mail where html_body is not null""")
def html_trivial(spark, d):
    """Pages that show nothing beyond their text."""
    return spread(table(spark, d, "parsed_mail").where("html_body is not null").select("mail_id", "html_body")).select("mail_id", H.html_is_trivial("html_body").alias("trivial"))


@query()
def html_to_text(spark, d):
    """Plain text of pages."""
    return spread(table(spark, d, "parsed_mail").where("html_body is not null").select("mail_id", "html_body")).select("mail_id", H.html_to_text("html_body").alias("text"))


def audited_pages(spark: SparkSession, d: str) -> DataFrame:
    page = F.concat(
        F.lit('<img src="https://t'), (F.col("mail_id") % 5).cast("string"), F.lit('.track.example/p.gif"><img src="cid:none"><div style="background:url(//cdn.example/b.png)" onclick="x()">'),
        F.coalesce("html_body", F.lit("")), F.lit("</div><script>1</script>"),
    )
    no_parts = F.array().cast("array<struct<content_id:string,content_location:string,content_type:string,content:binary>>")
    pages = spread(table(spark, d, "parsed_mail").select("mail_id", page.alias("page")))
    return pages.select("mail_id", H.page_cleaner()("page", no_parts).alias("c"))


@query(r"""
select mail_id, concat('https://t', mail_id % 5, '.track.example/p.gif,//cdn.example/b.png') as blocked, concat_ws(',', 'cid:none', nullif(regexp_extract(html_body, '<img src="(cid:[^"]*)"', 1), '')) as unresolved, false as active from parsed_mail""")
def html_clean_audit(spark, d):
    """References that cleaning blocks or can't resolve."""
    c = audited_pages(spark, d)
    return c.select(
        "mail_id", F.array_join("c.blocked_remote", ",").alias("blocked"), F.array_join("c.unresolved_cids", ",").alias("unresolved"),
        F.col("c.html").rlike("(?i)<script|onclick").alias("active"),
    )


@query("""
select host, cast(count(*) as bigint) as n from (
  select concat('t', mail_id % 5, '.track.example') as host from parsed_mail union all select 'cdn.example' from parsed_mail) group by host""")
def tracker_domains(spark, d):
    """Hosts of blocked references."""
    urls = audited_pages(spark, d).select(F.explode("c.blocked_remote").alias("url"))
    return urls.groupBy(F.parse_url(F.regexp_replace("url", "^//", "http://"), F.lit("HOST")).alias("host")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""with {KINDS}
select part_id, kind, cast(octet_length(content) as bigint) as size,
  case when coalesce(octet_length(content), 0) = 0 then 'EMPTY' when octet_length(content) > 30 then 'TOO_LARGE' when kind = 'OPAQUE' then 'UNSUPPORTED_TYPE' end as reason from sorted""")
def conversion_outcome(spark, d):
    """Attachments that are not converted, and why (cap of 30 bytes)."""
    return render.attachment_plan(table(spark, d, "attachment_part"), F.lit(30)).select("part_id", "kind", "size", "reason")


@query(r"""
with m as (
  select mail_id, 1 + mail_id % 2 as pages, html_body is not null and html_body <> '' and (regexp_matches(html_body, '(?i)<(a|b|i|img|table|tr|td|ul|li|h1|strong|em|u)[ >]') or regexp_matches(html_body, '(?i)\b(background|border)\b')) as visual,
    (coalesce(text_body, '') <> '' or html_body is not null) as has_text from parsed_mail
), p as (
  select mail_id, list_filter([case when visual and pages > 1 then 'faithful' end, case when visual and pages > 1 then 'section' end, case when visual then 'reflowed' end,
    case when visual and has_text then 'section' end, case when has_text then 'text' end, case when not visual and not has_text then 'header' end], lambda x: x is not null) as l from m
)
select mail_id, cast(k as integer) as page_no, l[k] as part from p, lateral (select unnest(generate_series(1, len(l))) as k)""")
def page_plan(spark, d):
    """Ordered body pages of every mail, given page counts."""
    mails = table(spark, d, "parsed_mail").withColumn("html_pages", (1 + F.col("mail_id") % 2).cast("int"))
    return render.body_plan(spread(mails)).select("mail_id", "page_no", "part")


def page_count(kind: str, mime: str, content: bytes) -> int:
    """A stand-in for converters: one page for texts, up to three for others; a leading zero byte is damage."""
    if content[:1] == b"\0":
        raise ValueError("damaged")
    return 1 if kind == "TEXT" else len(content) % 3 + 1


OUTCOMES = """
outcomes as (select *, case when coalesce(octet_length(content), 0) = 0 then 'EMPTY' when octet_length(content) > 30 then 'TOO_LARGE' when kind = 'OPAQUE' then 'UNSUPPORTED_TYPE'
  when starts_with(h, '00') then 'CORRUPT' end as reason from sorted)"""


@query(f"""with {KINDS}, {OUTCOMES}
select part_id, reason is null as ok, cast(case when reason is not null then 0 when kind = 'TEXT' then 1 else octet_length(content) % 3 + 1 end as integer) as pages, reason from outcomes""")
def converted_parts(spark, d):
    """Outcomes of all attachments with a stand-in converter (cap of 30 bytes)."""
    return render.converted(spread(table(spark, d, "attachment_part")), F.lit(30), page_count)


@query(f"""with {KINDS}, {OUTCOMES}, p as (select hdr_id, part_no, part_id, unnest(case when reason is null then ['separator', 'pages'] else ['info'] end) as page from outcomes)
select hdr_id, part_no as "index", cast(page = 'pages' as integer) as step, page, part_id from p""")
def attachment_pages(spark, d):
    """Separator, pages or information page of every attachment."""
    parts = table(spark, d, "attachment_part")
    return render.attachment_pages(parts, render.converted(spread(parts), F.lit(30), page_count)).drop("markup")


@query("""
with f as (select source, md5(text) as ident, min(doc_id) as first_id from documents where text is not null and source is not null group by 1, 2),
k as (select *, row_number() over (partition by source order by first_id) as n from f)
select d.doc_id as position, d.source as folder, case when n = 1 then 'mail' else concat('mail-', n) end as name, d.doc_id > first_id as skip
from documents d join k on d.source = k.source and md5(d.text) = k.ident""")
def deliver_plan(spark, d):
    """File of every message in its folder, same bytes once."""
    docs = table(spark, d, "documents").where("text is not null and source is not null")
    mails = docs.select(F.col("doc_id").alias("position"), F.col("source").alias("folder"), F.lit("mail").alias("base"), F.encode("text", "UTF-8").alias("content"))
    return sinks.delivery_names(mails).select("position", "folder", "name", "skip")


def render_mails(spark: SparkSession, d: str) -> DataFrame:
    """Parsed mails with the first plain letter of their subject as subject, undated, in folders by account."""
    letter = F.regexp_extract(F.coalesce("subject", F.lit("")), "([A-Za-z])", 1)
    h = table(spark, d, "mail_headers").select(F.col("hdr_id").alias("mail_id"), F.col("account").alias("folder"), F.col("account").alias("profile"), letter.alias("subject"), "message_id", "from_")
    content = F.encode(F.concat(F.coalesce("text_body", F.lit("")), F.coalesce("html_body", F.lit(""))), "UTF-8")
    m = table(spark, d, "parsed_mail").select("mail_id", "text_body", "html_body", content.alias("content"), F.lit(1).alias("html_pages"))
    return m.join(h, "mail_id").withColumn("stamp", F.lit(None).cast("timestamp_ntz"))


RENDERED = r"""
m as (select mail_id, account as folder, case when regexp_extract(coalesce(subject, ''), '([A-Za-z])', 1) = '' then account else concat(account, '_', regexp_extract(subject, '([A-Za-z])', 1)) end as base,
  concat(coalesce(text_body, ''), coalesce(html_body, '')) as content from parsed_mail join mail_headers on mail_id = hdr_id),
i as (select folder, base, content, min(mail_id) as first_id from m group by 1, 2, 3),
n as (select *, row_number() over (partition by folder, base order by first_id) as k from i),
named as (select m.mail_id, m.folder, case when k = 1 then m.base else concat(m.base, '-', k) end as name, m.mail_id > first_id as skip from m join n using (folder, base, content))"""


@query(f"with {RENDERED} select * from named")
def render_names(spark, d):
    """Folder name of every mail and whether it is rendered already."""
    parts = table(spark, d, "attachment_part")
    outcomes = render.converted(parts, F.lit(30), page_count)
    return render.render_plan(render_mails(spark, d), parts, outcomes).mails.select("mail_id", "folder", "name", "skip")


@query(f"""with {RENDERED}, f as (select mail_id, folder, name, unnest(case when mail_id in (select hdr_id from attachment_part) then ['.pdf', '_mailonly.pdf'] else ['.pdf'] end) as suffix from named where not skip)
select mail_id, folder, name, concat(name, suffix) as file, suffix = '.pdf' and mail_id in (select hdr_id from attachment_part) as with_attachments from f""")
def render_files(spark, d):
    """Files of every mail that a render run writes."""
    parts = table(spark, d, "attachment_part")
    outcomes = render.converted(parts, F.lit(30), page_count)
    return render.render_plan(render_mails(spark, d), parts, outcomes).files


@query("""
select account, uid, step, array_to_string(case step when 'label' then ['STORE'] when 'move' then ['CREATE', 'SUBSCRIBE'] || case when length(account) % 2 = 0 then ['MOVE'] when length(account) % 3 = 0 then ['COPY', 'STORE \\Deleted', 'UID EXPUNGE'] else ['COPY', 'STORE \\Deleted'] end
    else case when length(account) % 3 = 0 then ['STORE \\Deleted', 'UID EXPUNGE'] else ['STORE \\Deleted'] end end, ',') as commands,
  case when length(account) % 3 > 0 and (step = 'delete' or (step = 'move' and length(account) % 2 > 0)) then 'no UIDPLUS: left marked as deleted' end as error
from (select account, uid, ['label', 'move', 'delete'][1 + uid % 3] as step from scanned_message)""")
def server_outcomes(spark, d):
    """What servers of different capabilities are told for one step per message."""
    s = table(spark, d, "scanned_message")
    steps = s.select("account", "uid", F.element_at(F.array(F.lit("label"), F.lit("move"), F.lit("delete")), (1 + F.col("uid") % 3).cast("int")).alias("step"))
    can = F.concat(F.when(F.length("account") % 2 == 0, F.array(F.lit("MOVE"))).otherwise(F.array().cast("array<string>")), F.when(F.length("account") % 3 == 0, F.array(F.lit("UIDPLUS"))).otherwise(F.array().cast("array<string>")))
    told = sinks.server_outcomes(steps, s.select("account").distinct().withColumn("capabilities", can))
    return told.select("account", "uid", "step", F.array_join("commands", ",").alias("commands"), "error")


def rendered(spark: SparkSession, d: str) -> DataFrame:
    """Render results derived from deliveries."""
    x = table(spark, d, "delivered")
    return x.select("hdr_id", (F.col("uid") % 4 > 0).alias("written"), (F.col("uid") % 4 == 0).alias("skipped"), (F.col("uid") % 7 > 0).alias("complete"), (F.col("uid") % 11 > 0).alias("html_rendered"))


@query("""
select cast(count(*) filter (where uid % 4 > 0) as bigint) as written, cast(count(*) filter (where uid % 4 = 0) as bigint) as skipped,
  cast(count(*) filter (where uid % 4 > 0 and uid % 7 = 0) as bigint) as incomplete, cast(count(*) filter (where uid % 4 > 0 and uid % 11 = 0) as bigint) as html_fallback from delivered""")
def run_report(spark, d):
    """Counts of a render run."""
    return render.run_report(rendered(spark, d))


def archive_folders(spark: SparkSession, d: str) -> DataFrame:
    """Rendered folders of deliveries with a file name."""
    x = table(spark, d, "delivered").where("filename is not null and profile is not null").join(table(spark, d, "mail_headers").select("hdr_id", "message_id"), "hdr_id")
    staging = F.col("uid") % 50 == 0
    name = F.concat(F.when(staging, audit.STAGING).otherwise(""), F.regexp_replace("filename", r"\.eml$", ""))
    ident = F.when(F.col("uid") % 13 > 0, F.concat(F.coalesce("message_id", F.lit("-")), F.lit("\nsha256:"), F.sha2(F.coalesce("message_id", F.lit("-")), 256)))
    return x.select("profile", name.alias("name"), ident.isNotNull().alias("has_manifest"), ident.alias("identity"), (F.col("uid") % 17 > 0).alias("has_pdf")).where((F.col("hdr_id") % 5 > 0) | staging)


FOLDERS = r"""
folders as (
  select profile, concat(case when uid % 50 = 0 then '.staging-' else '' end, regexp_replace(filename, '\.eml$', '')) as name, uid % 13 > 0 as has_manifest,
    case when uid % 13 > 0 then concat(coalesce(message_id, '-'), chr(10), 'sha256:', sha256(coalesce(message_id, '-'))) end as identity, uid % 17 > 0 as has_pdf
  from delivered join (select hdr_id, message_id from mail_headers) h using (hdr_id) where filename is not null and profile is not null and (hdr_id % 5 > 0 or uid % 50 = 0)
), files as (
  select profile, regexp_replace(filename, '\.eml$', '') as stem, message_id, concat('sha256:', sha256(coalesce(message_id, '-'))) as hash
  from delivered join (select hdr_id, message_id from mail_headers) h using (hdr_id) where filename is not null and profile is not null
)"""
FINDINGS = """
dup as (select 'duplicate' as kind, 'WARN' as severity, profile, string_agg(name, ', ' order by name) as detail from folders where not starts_with(name, '.staging-') and identity is not null group by profile, identity having count(*) > 1),
fold as (
  select 'staging' as kind, 'WARN' as severity, profile, name as detail from folders where starts_with(name, '.staging-')
  union all select 'no-manifest', 'WARN', profile, name from folders where not starts_with(name, '.staging-') and not has_manifest
  union all select 'incomplete', 'FAIL', profile, name from folders where not starts_with(name, '.staging-') and not has_pdf
), lines as (select distinct profile, unnest(string_split(identity, chr(10))) as line from folders where identity is not null),
rest as (
  select f.profile, stem from files f where not exists (select 1 from folders x where x.profile = f.profile and x.name = f.stem)
    and not exists (select 1 from lines l where l.profile = f.profile and l.line = f.message_id) and not exists (select 1 from lines l where l.profile = f.profile and l.line = f.hash)
), unr as (
  select 'unrendered' as kind, 'WARN' as severity, profile,
    concat(count(*), ': ', array_to_string(list_sort(list(stem))[1:5], ', '), case when count(*) > 5 then ', …' else '' end) as detail from rest group by profile
), found as (select * from dup union all select * from fold union all select * from unr)"""


def archive_files(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "delivered").where("filename is not null and profile is not null").join(table(spark, d, "mail_headers").select("hdr_id", "message_id"), "hdr_id")
    return x.select("profile", F.regexp_replace("filename", r"\.eml$", "").alias("stem"), "message_id", F.concat(F.lit("sha256:"), F.sha2(F.coalesce("message_id", F.lit("-")), 256)).alias("sha256"))


@query(f"with {FOLDERS}, {FINDINGS} select * from dup")
def verify_duplicates(spark, d):
    """Mails rendered more than once."""
    return audit.duplicates(archive_folders(spark, d))


@query(f"with {FOLDERS}, {FINDINGS} select * from fold")
def verify_folder_findings(spark, d):
    """Staging leftovers, missing manifests, missing PDFs."""
    return audit.folder_findings(archive_folders(spark, d))


@query(f"with {FOLDERS}, {FINDINGS} select * from unr")
def verify_unrendered(spark, d):
    """Mails never rendered, by profile."""
    return audit.unrendered(archive_files(spark, d), archive_folders(spark, d))


@query(f"""with {FOLDERS}, {FINDINGS}
select profile, kind, severity, cast(count(*) as bigint) as n, case when count(*) = 1 then min(detail) end as detail from found where severity <> 'FAIL' group by all
union all select profile, kind, severity, cast(1 as bigint), detail from found where severity = 'FAIL'""")
def verify_summary(spark, d):
    """Findings, warnings collapsed."""
    profiles = table(spark, d, "delivered").where("profile is not null and filename is not null").select("profile").distinct().withColumn("pdf", F.lit(True))
    # read by four findings each
    files, folders = materialise(archive_files(spark, d), "archive-files"), materialise(archive_folders(spark, d), "archive-folders")
    return audit.summary(audit.findings(files, folders, profiles))


@query(f"""with {FOLDERS} select case when count(*) filter (where not starts_with(name, '.staging-') and not has_pdf) > 0 then 1 else 0 end as exit_code from folders""")
def verify_exit_code(spark, d):
    """1 if any finding is a failure."""
    return audit.exit_code(audit.folder_findings(archive_folders(spark, d)))


@query("""
with box as (select distinct message_id, subject from mail_headers where hdr_id % 2 = 0 and message_id is not null and subject is not null)
select h.hdr_id, case when b.message_id is not null then 'SKIPPED' else 'RESTORED' end as outcome from mail_headers h left join box b on h.message_id = b.message_id and h.subject = b.subject""")
def restore_plan(spark, d):
    """Archived mails already in the mailbox, and those to upload."""
    h = table(spark, d, "mail_headers")
    return audit.restore_plan(h.select("hdr_id", "message_id", "subject"), h.where("hdr_id % 2 = 0")).select("hdr_id", "outcome")


@query("select cast(min(hdr_id) as bigint) as position, concat('/in/', folder, '.eml') as path from scanned_message group by folder")
def collect_distinct(spark, d):
    """Distinct paths, first mention kept."""
    s = table(spark, d, "scanned_message").select(F.col("hdr_id").alias("position"), F.concat(F.lit("/in/"), "folder", F.lit(".eml")).alias("path"))
    return mailbox.collect_paths(s).select("position", "path")


@query("""
select cast((doc_id - doc_id % 4) // 4 as bigint) as batch, cast(row_number() over (partition by (doc_id - doc_id % 4) // 4 order by doc_id) - 1 as integer) as position, concat('/pdf/', doc_id) as path, doc_id % 3 > 0 as compliant from documents""")
def validation_json(spark, d):
    """Validator reports paired with their paths by position."""
    docs = table(spark, d, "documents").select("doc_id", F.floor((F.col("doc_id") - F.col("doc_id") % 4) / 4).alias("batch"))
    verdict = F.when(F.col("doc_id") % 3 > 0, '{"validationResult": [{"compliant": true}]}').otherwise('{"other": 1}')
    job = F.array_sort(F.collect_list(F.struct("doc_id", verdict.alias("j"))))
    reports = docs.groupBy("batch").agg(job.alias("jobs")).select(
        "batch", F.transform("jobs", lambda x: F.concat(F.lit("/pdf/"), x["doc_id"].cast("string"))).alias("paths"),
        F.concat(F.lit('{"report": {"jobs": ['), F.array_join(F.transform("jobs", lambda x: x["j"]), ","), F.lit("]}}")).alias("json"),
    )
    return render.validation_results(reports, "paths", "json")


@query("select lower(name) as name, host, port, concat('user@', host) as user, ssl from account")
def accounts_pivot(spark, d):
    """Accounts of key/value settings."""
    a = table(spark, d, "account")
    pair = lambda f, v: F.struct(F.concat(F.lit("IMAP_"), F.upper("name"), F.lit(f"_{f}")).alias("key"), v.cast("string").alias("value"))
    rows = a.select(F.explode(F.array(pair("HOST", F.col("host")), pair("PORT", F.col("port")), pair("SSL", F.col("ssl")), pair("USER", F.concat(F.lit("user@"), "host")))).alias("p"))
    return config.pivot_accounts(rows.select("p.key", "p.value"))


@query("select p.ordinal, p.name, a.host from profile p join account a on lower(p.account) = lower(a.name)")
def profile_accounts(spark, d):
    """Profiles with their accounts, names case-blind."""
    p, a = table(spark, d, "profile"), table(spark, d, "account")
    return p.join(a, F.lower(p["account"]) == F.lower(a["name"])).select(p["ordinal"], p["name"], a["host"])


@query("select account, folder, uidvalidity, uid, cast(count(*) as bigint) as n from (select distinct account, folder, uidvalidity, uid from scanned_message) group by all")
def delivery_stream(spark, d):
    """Delivered keys after streaming all available messages."""
    source = table(spark, d, "scanned_message").select(*st.KEY)
    stream = spark.readStream.schema(table(spark, d, "scanned_message").schema).parquet(_folder_of(d, "scanned_message"))
    state = delivery.delivered_by_stream(stream.select(*st.KEY))
    return state.select(*source.columns).groupBy(*st.KEY).agg(F.count(F.lit(1)).alias("n"))


def _folder_of(d: str, name: str) -> str:
    """A pattern that a file stream takes for one table, single file or folder."""
    return f"{d}/{name}.parque[t]"


@query("select account, cast(grouping(account) as integer) as total, cast(count(*) as bigint) as n from scanned_message group by rollup (account)")
def delivered_rollup(spark, d):
    """Counts per account and in total."""
    return table(spark, d, "scanned_message").rollup("account").agg(F.grouping("account").cast("int").alias("total"), F.count(F.lit(1)).alias("n"))


@query("select account, folder, uid, rfc822_size as size from scanned_message where account = 'tarnwell_private' and rfc822_size > 100000")
def snapshot_pushdown(spark, d):
    """Snapshot source with pushed equality and size filters."""
    mailbox.register(spark)
    s = spark.read.format("mail_snapshot").load(f"{d}/scanned_message.parquet")
    return s.where("account = 'tarnwell_private' and size > 100000").select("account", "folder", "uid", "size")


@query(r"select hdr_id, lower(coalesce(nullif(trim(regexp_extract(from_, '<([^>]+)>', 1), ' '), ''), trim(from_, ' '))) as addr from mail_headers")
def sender_address(spark, d):
    """Bare sender addresses."""
    return table(spark, d, "mail_headers").select("hdr_id", fetch.sender(F.col("from_")).alias("addr"))


@query("""
select case when has_flag then 'x' end as a, profile, cast(count(*) as bigint) as n, array_to_string(list_sort(list(filename))[1:10], ', ') as first_names
from (select false as has_flag, coalesce(profile, '?') as profile, filename from delivered where filename is not null) group by all""")
def report_names(spark, d):
    """First ten file names of every profile."""
    x = table(spark, d, "delivered").where("filename is not null").withColumn("profile", F.coalesce("profile", F.lit("?")))
    counts = x.groupBy("profile").agg(F.count(F.lit(1)).alias("n"))
    names = audit.smallest(x, "profile", "filename", 10)
    return counts.join(names, "profile").select(F.lit(None).cast("string").alias("a"), "profile", "n", F.array_join("names", ", ").alias("first_names"))


@query("select part_id, concat('data:', content_type, ';base64,', to_base64(content)) as uri from attachment_part")
def data_uris(spark, d):
    """Attachments as data URIs."""
    return table(spark, d, "attachment_part").select("part_id", X.data_uri(F.col("content"), F.col("content_type")).alias("uri"))


@query(rf"""with {MBOX}, pdf as (select distinct hdr_id from attachment_part where lower(regexp_extract(filename, '^(?:.*/)?[^/]+\.([^./]+)$', 1)) = 'pdf')
select mbox.hdr_id, cast(case when {GLOBS} and pdf.hdr_id is not null then 0 when coalesce(size > 100000, true) then 1 when pdf.hdr_id is not null then 2 end as integer) as ordinal
from mbox left join pdf on mbox.hdr_id = pdf.hdr_id""")
def first_match_attachments(spark, d):
    """First match where rules look at attachments, bodies read late."""
    rules = [R.Rule("bills", subject=RULES[0].subject, attachments=(".PDF",)), R.Rule("large", larger=100_000), R.Rule("pdf", attachments=("pdf",))]
    box = mbox(spark, d)
    scope = folder_list(spark, d).select("account", "folder", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("ordinal"))
    names = table(spark, d, "attachment_part").select("hdr_id", F.col("filename").alias("name"))
    return fetch.matched(box, rules, scope, strict=False, names=names).select("hdr_id", "ordinal")


@query()
def fetch_summary(spark, d):
    """Text of a fetch report; zero counters are left out."""
    p = fetch_plan(spark, d, with_archive=True)
    return reports.summary_text(p.report, p.counters)


@query(f"""with {MBOX}, {HITS}, {STATE}, m as (
  select {RULE_NAMES}[ordinal + 1] as profile, size, ordinal, state.filename, state.uid is not null as known, a.filename is not null as there
  from hits left join state on hits.account = state.account and hits.folder = state.folder and hits.uidvalidity = state.uidvalidity and hits.uid = state.uid
    left join (select distinct account, filename from state where filename <> '?' and uid % 3 <> 0) a on a.account = hits.account and a.filename = state.filename
  where ordinal is not null
), r as (select profile, count(*) filter (where size is not null and not known) as n from m group by 1),
c as (select count(*) filter (where size is null) as failed, count(*) filter (where size is not null and known) as already,
  count(*) filter (where size is not null and ordinal <> 1 and known and not there) as skipped from m),
n as (select count(*) as skipped from m where size is not null and ordinal <> 1 and not known)
select concat_ws(chr(10), concat((select sum(n) from r), ' delivered'), (select string_agg(concat('  ', profile, ': ', n), chr(10) order by profile) from r where n > 0),
  concat(already, ' already archived'), concat(failed, ' failed'), concat(c.skipped + n.skipped, ' actions skipped')) as summary from c, n""")
def fetch_summary_dateless(spark, d):
    """``fetch_summary`` by the rules without days."""
    p = fetch_plan(spark, d, with_archive=True, rules=DATELESS)
    return reports.summary_text(p.report, p.counters)


@query("""
with f as (select distinct source as "group", concat('/pdf/', doc_id % 200) as path from documents where doc_id % 3 = 0 and source is not null),
c as (select "group", count(*) as n, array_to_string(list_sort(list(path))[1:10], ', ') as names from f group by 1)
select "group", cast(n as bigint) as n, concat(names, case when n > 10 then concat(' … and ', n - 10, ' more') else '' end) as shown from c""")
def non_compliant(spark, d):
    """Failing paths of every group, ten shown."""
    docs = table(spark, d, "documents").where("source is not null")
    results = docs.select(F.col("source").alias("group"), F.concat(F.lit("/pdf/"), (F.col("doc_id") % 200).cast("string")).alias("path"), (F.col("doc_id") % 3 != 0).alias("compliant"))
    return reports.non_compliant(results)


@query("""select source, doc_id, cast((row_number() over (partition by source order by doc_id) - 1) // 100 as bigint) as batch from (select distinct source, doc_id from documents)""")
def validation_batches(spark, d):
    """Files in batches of a hundred."""
    return reports.batches(table(spark, d, "documents"), "source", "doc_id")


@query("""
with a as (select distinct account from scanned_message)
select account, case when length(account) % 3 = 0 then 'mail.' else 'INBOX/' end as prefix, '/' as delimiter from a""")
def namespaces(spark, d):
    """Prefix of every account's folders."""
    folders = folder_list(spark, d)
    told = folders.select("account").distinct().select("account", F.when(F.length("account") % 3 == 0, "mail.").alias("prefix"))
    return fetch.namespace_of(told, folders)
