"""Rules, folders and the fetch plan."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from mailgrain.plans import fetch
from mailgrain.plans import rules as R
from mailgrain.sources import config, mailbox

BOX = "account string, folder string, uidvalidity long, uid long, hdr_id long, size long, received_wall timestamp_ntz, from_ string, to_ string, cc string, bcc string, subject string, message_id string, date_wall timestamp_ntz"


def box(spark, **changes):
    row = dict(account="a", folder="INBOX", uidvalidity=1, uid=1, hdr_id=1, size=100, received_wall=None, from_="", to_="", cc="", bcc="", subject="", message_id=None, date_wall=None)
    return spark.createDataFrame([tuple((row | changes).values())], BOX)


def hits(spark, rule, **changes):
    df = fetch.with_addresses(box(spark, **changes), [rule])
    return df.where(fetch.predicates([rule])[0][1]).count() == 1


@pytest.mark.parametrize(
    "sender, rule, expected",
    [
        ("X <u@mail.shop.test>", R.Rule("r", domains=("@shop.test",)), True),
        ("X <u@shop.test>", R.Rule("r", domains=("shop.test",)), True),
        ("X <u@eshop.test>", R.Rule("r", domains=("shop.test",)), False),
        ("X <U@Shop.Test>", R.Rule("r", addresses=("u@shop.test",)), True),
        ("X <u@shop.test>", R.Rule("r", addresses=("u@shop.test",), mode=("to",)), False),
        ("X <u@shop.test>", R.Rule("r"), True),
    ],
)
def test_addresses(spark, sender, rule, expected):
    assert hits(spark, rule, from_=sender) is expected


def test_subjects(spark):
    assert hits(spark, R.Rule("r", subject="Rech"), subject="Ihre Rechnung")
    assert not hits(spark, R.Rule("r", subject="rech"), subject="Ihre Rechnung")
    assert hits(spark, R.Rule("r", subject=("*RECH*", "x")), subject="Ihre Rechnung")
    assert not hits(spark, R.Rule("r", subject=("rech*",)), subject="Ihre Rechnung")
    assert hits(spark, R.Rule("r", subject=r"(?P<n>\d+)-(?P=n)"), subject="no 12-12")


def test_windows_let_unknown_pass(spark):
    day = dt.datetime(2024, 3, 1, 23, 59)
    rule = R.Rule("r", since=dt.date(2024, 3, 1), until=dt.date(2024, 3, 1))
    assert hits(spark, rule, date_wall=day) and hits(spark, rule) and not hits(spark, rule, date_wall=dt.datetime(2024, 3, 2))
    assert hits(spark, rule, received_wall=day)
    size = R.Rule("r", larger=100, smaller=200)
    assert not hits(spark, size, size=100) and hits(spark, size, size=150) and not hits(spark, size, size=200) and hits(spark, size, size=None)


def test_bad_settings():
    with pytest.raises(R.ConfigError):
        R.Rule("r", move_to="x", delete=True)
    with pytest.raises(R.ConfigError):
        R.Rule("r", mode=("sender",))
    for bad in ("five", "", "MB", -1):
        with pytest.raises(R.ConfigError):
            R.size_literal(bad)
    assert R.size_literal("1.5 kb") == 1536
    with pytest.raises(R.ConfigError):
        config.load_accounts({"IMAP_WORK_HOST": "h"})
    for ssl, yes in (("banana", False), (" YES ", True), ("on", True), ("1", True), ("false", False), ("", False)):
        env = {"IMAP_a_b_HOST": "h", "IMAP_a_b_USER": "u", "IMAP_a_b_PASSWORD": "p", "IMAP_a_b_SSL": ssl, "IMAP_HOST": "x", "XIMAP_c_HOST": "y"}
        assert {n: a.ssl for n, a in config.load_accounts(env).items()} == {"a_b": yes}
    accounts = config.load_accounts({"IMAP_Work_HOST": "h", "IMAP_Work_USER": "u", "IMAP_Work_PASSWORD": "p", "OTHER": "x"})
    assert accounts["work"].port == 993 and accounts["work"].ssl and "p'" not in repr(accounts["work"])


def test_rule_file(tmp_path):
    f = tmp_path / "rules.yaml"
    f.write_text("profiles:\n- {name: a, account: Work, output: x, match: {domains: [x.test], larger: 5 MB}, after_fetch: {move_to: Done}}\n- {name: b, account: work, output: y}\n")
    rules = R.load_rules(str(f), {"work"})
    assert [r.name for r in rules] == ["a", "b"] and rules[0].larger == 5 * 1024**2 and rules[0].has_action
    with pytest.raises(R.ConfigError):
        R.load_rules(str(f), {"home"})
    with pytest.raises(R.ConfigError):
        R.load_rules(str(tmp_path / "none.yaml"))


def test_weakest_bounds():
    rules = [R.Rule("a", larger=5, smaller=50), R.Rule("b", larger=3, smaller=90, since=dt.date(2024, 1, 1))]
    assert R.weakest_bounds(rules) == {"since": None, "larger": 3, "smaller": 90}
    assert R.weakest_bounds([]) == {"since": None, "larger": None, "smaller": None}


def test_folder_map(spark):
    names = ["INBOX", "INBOX/Sub", "INBOX/Trash", "Other"]
    folders = spark.createDataFrame([("a", n, "/") for n in names], "account string, folder string, delimiter string")
    trash = spark.createDataFrame([("a", "INBOX/Trash")], "account string, folder string")
    rules = [R.Rule("plain"), R.Rule("deep", recursive=True), R.Rule("all", recursive=True, trash=True), R.Rule("named", folders=("INBOX/Trash",))]
    got = {}
    for r in R.folder_map(spark, rules, folders, trash).collect():
        got.setdefault(r["ordinal"], set()).add(r["folder"])
    assert got == {0: {"INBOX"}, 1: {"INBOX", "INBOX/Sub"}, 2: {"INBOX", "INBOX/Sub", "INBOX/Trash"}, 3: {"INBOX/Trash"}}


def test_plan(spark):
    rules = [R.Rule("first", subject="x", label="l", move_to="M"), R.Rule("second")]
    m = box(spark, subject="x").unionByName(box(spark, hdr_id=2, uid=2, subject="y")).unionByName(box(spark, hdr_id=3, uid=3, subject="x"))
    state = spark.createDataFrame([("a", "INBOX", 1, 3, "old.eml", "first")], "account string, folder string, uidvalidity long, uid long, filename string, profile string")
    scope = spark.createDataFrame([("a", "INBOX", 0), ("a", "INBOX", 1)], "account string, folder string, ordinal int")
    p = fetch.plan(m, state, rules, scope, archive=spark.createDataFrame([("a", "old.eml")], "account string, filename string"))
    assert {r["profile"]: (r["delivered"], r["already_archived"]) for r in p.report.collect()} == {"first": (1, 1), "second": (1, 0)}
    assert [(r["uid"], r["step_no"], r["step"], r["argument"]) for r in p.actions.orderBy("uid", "step_no").collect()] == [(3, 1, "label", "l"), (3, 2, "move", "M")]
    assert fetch.plan(m, state, rules, scope, server_actions=False).actions.count() == 0


KEY = "account string, folder string, uidvalidity long, uid long"


def test_plan_leaves_move_targets_and_failures_out(spark):
    rules = [R.Rule("mover", subject="x", recursive=True, folders=("INBOX",), move_to="Done"), R.Rule("lister", account="B", folders=("INBOX/Done",))]
    m = box(spark, subject="x")
    for n, (account, folder) in enumerate((("a", "INBOX/Done"), ("b", "INBOX"), ("b", "INBOX/Done"), ("c", "INBOX")), 2):
        m = m.unionByName(box(spark, hdr_id=n, uid=n, account=account, folder=folder, subject="x"))
    scope = spark.createDataFrame([(a, f, o) for a in "abc" for f in ("INBOX", "INBOX/Done") for o in (0, 1) if o == 0 or a == "b"], "account string, folder string, ordinal int")
    spaces = spark.createDataFrame([(a, "INBOX/", "/") for a in "abc"], "account string, prefix string, delimiter string")
    state = spark.createDataFrame([("a", "INBOX", 1, 1, "gone.eml", "mover")], KEY + ", filename string, profile string")
    p = fetch.plan(m, state, rules, scope, namespaces=spaces)
    # only account b lists the target by name
    assert sorted(r["hdr_id"] for r in p.matched.collect()) == [1, 3, 4, 5]
    bad = spark.createDataFrame([("b", "INBOX", 1, 3)], KEY)
    p = fetch.plan(
        m, state, rules, scope, spark.createDataFrame([("a", "other.eml")], "account string, filename string"), namespaces=spaces,
        failed=bad, failed_accounts=spark.createDataFrame([("c",)], "account string"), failed_actions=bad,
    )
    assert {r["uid"] for r in p.planned.collect()} == {4}
    assert tuple(p.counters.first()) == (1, 0, 1, 2)
    done = fetch.plan(m, state, rules, scope, namespaces=spaces, failed_actions=spark.createDataFrame([("a", "INBOX", 1, 1), ("z", "q", 1, 1)], KEY))
    assert tuple(done.counters.first()) == (0, 1, 1, 0)


def test_rule_table_agrees_with_the_expression(spark):
    rules = [
        R.Rule("re", subject=r"(?P<kind>bill)-\d+"), R.Rule("glob", subject=("*invoice*", "re?ht"), smaller=50), R.Rule("who", domains=("x.test",), addresses=("Q@y.test",), mode=("from", "cc")),
        R.Rule("when", since=dt.date(2024, 1, 2), until=dt.date(2024, 2, 1)), R.Rule("any", larger=10),
    ]
    texts, senders, sizes, days = ["bill-7", "Bill-7", "An INVOICE", "recht", ""], ["a@x.test", "b@s.x.test", "q@Y.test", "n@nox.test", ""], [5, 40, None], [None, dt.datetime(2024, 1, 2, 3), dt.datetime(2024, 2, 2)]
    m, n = None, 0
    for t in texts:
        for s_ in senders:
            row = box(spark, hdr_id=n, uid=n, subject=t, from_=s_, size=sizes[n % 3], date_wall=days[n % 3 if n % 2 else n % 2])
            m = row if m is None else m.unionByName(row)
            n += 1
    scope = spark.createDataFrame([("a", "INBOX", o) for o in range(5)], "account string, folder string, ordinal int")
    by = [{r["hdr_id"]: r["ordinal"] for r in f(m, rules, scope).collect()} for f in (fetch.matched, fetch.matched_by_table)]
    assert by[0] == by[1] and len(set(by[0].values())) >= 4
    with pytest.raises(R.ConfigError):
        fetch.rule_table(spark, [R.Rule("a", attachments=("pdf",))])


def test_trash_and_selectable(spark):
    rows = [("a", "Bin", ["\\Noselect"]), ("a", "X", ["\\TRASH"]), ("b", "INBOX/Papierkorb", []), ("b", "INBOX", None)]
    folders = spark.createDataFrame(rows, "account string, folder string, flags array<string>")
    assert {tuple(r) for r in mailbox.trash_folders(folders).collect()} == {("a", "X"), ("b", "INBOX/Papierkorb")}
    assert mailbox.selectable(folders).count() == 3


def test_plan_shapes(spark, tmp_path):
    spark.range(10).select(F.col("id").alias("hdr_id"), F.col("id").alias("size"), F.lit("x").alias("body")).write.parquet(str(tmp_path / "t"))
    t = spark.read.parquet(str(tmp_path / "t")).select("hdr_id", "size")
    plan = fetch.scan_filter(t, [R.Rule("a", larger=5), R.Rule("b", larger=3)])._jdf.queryExecution().toString()
    assert "PushedFilters: [Or(GreaterThan(size,3),IsNull(size)" in plan.replace("`", "") or "PushedFilters" in plan
    assert "body" not in plan.split("ReadSchema")[1]


def test_eml_files(spark, tmp_path):
    (tmp_path / "b.eml").write_bytes(b"x")
    (tmp_path / "a.eml").write_bytes(b"yy")
    (tmp_path / "c.EML").write_bytes(b"z")
    got = [(r["stem"], r["length"]) for r in mailbox.eml_files(spark, str(tmp_path)).orderBy("path").collect()]
    assert got == [("a", 2), ("b", 1)]
    with pytest.raises(mailbox.SourceError):
        mailbox.eml_files(spark, str(tmp_path / "a.eml"))
