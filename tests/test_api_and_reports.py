"""Facade, reports, checks and rule files."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from mailgrain.api import Archive
from mailgrain.operators import reports
from mailgrain.plans import fetch
from mailgrain.plans import rules as R
from mailgrain.sources import checks


def test_reports(spark):
    r = spark.createDataFrame([("b", 2, 1), ("a", 3, 0), ("c", 0, 4)], "profile string, delivered long, already_archived long")
    counters = spark.createDataFrame([(0, 2, 5, 0)], "failed long, post_fetch_failed long, already_archived long, post_fetch_skipped long")
    assert reports.summary_text(r, counters).first()[0] == "5 delivered\n  a: 3\n  b: 2\n5 already archived\n2 actions failed"
    assert {(x["profile"], x["delivered"]) for x in reports.totals(r).collect()} == {("a", 3), ("b", 2), ("c", 0), (None, 5)}
    p = spark.createDataFrame([("g", f"p{i:02d}", False) for i in range(12)] + [("g", "p00", False), ("g", "ok", True), ("h", "x", False)], "group string, path string, compliant boolean")
    got = {x["group"]: (x["n"], x["shown"]) for x in reports.non_compliant(p).collect()}
    assert got["h"] == (1, "x") and got["g"][0] == 12 and got["g"][1].endswith("p09 … and 2 more")
    b = reports.batches(p, "group", "path", 5).groupBy("group", "batch").count().collect()
    assert sorted((x["group"], x["batch"], x["count"]) for x in b) == [("g", 0, 5), ("g", 1, 5), ("g", 2, 3), ("h", 0, 1)]
    o = spark.sql("select array(named_struct('ok', true), named_struct('ok', false)) as a union all select array()")
    assert sorted(x[0] for x in o.select(reports.mail_complete(F.col("a"))).collect()) == [False, True]
    assert reports.outcome_counts(spark.createDataFrame([("X",), ("A",), ("X",)], "outcome string")).collect()[1]["n"] == 2


def test_rule_file_round_trip(tmp_path):
    rules = [
        R.Rule("a", account="w", output="/x", domains=("x.test",), mode=("from",), subject=("*a*", "b"), folders=("F",), recursive=True, since=dt.date(2024, 1, 2), larger=5, pdf=True, label="l", move_to="M"),
        R.Rule("b", account="w", output="/y", subject="^x", attachments=("pdf",), trash=True, smaller=9, delete=True),
    ]
    f = tmp_path / "r.yaml"
    f.write_text(R.rules_text(rules), encoding="utf-8")
    assert R.load_rules(str(f)) == rules
    assert R.match_summary(rules[0]) == "from/to x.test; subject *a* | b; in F and below; since 2024-01-02; larger 5"
    assert [R.action_summary(r) for r in rules] == ["label l and move to M", "delete"]
    assert [r.name for r in R.select_rules(rules, pdf_only=True)] == ["a"]
    with pytest.raises(R.ConfigError):
        R.select_rules(rules, "none")


def test_attachment_rules_read_late(spark):
    rules = [R.Rule("pdf", attachments=("pdf",)), R.Rule("large", larger=100), R.Rule("csv", attachments=(".CSV",))]
    rows = [("a", "INBOX", i, size, "", None, None) for i, size in ((1, 50), (2, 200), (3, 50), (4, 50), (5, None))]
    box = spark.createDataFrame(rows, "account string, folder string, hdr_id long, size long, subject string, date_wall timestamp_ntz, received_wall timestamp_ntz")
    scope = spark.createDataFrame([("a", "INBOX", i) for i in range(3)], "account string, folder string, ordinal int")
    names = spark.createDataFrame([(1, "x.PDF"), (1, "y.csv"), (2, "z.csv"), (3, "z.csv"), (4, None)], "hdr_id long, name string")
    got = {r["hdr_id"]: r["ordinal"] for r in fetch.matched(box, rules, scope, names=names).collect()}
    assert got == {1: 0, 2: 1, 3: 2, 4: None, 5: 1}


def test_facade(spark):
    a = Archive(spark, [R.Rule("one", subject="x", pdf=True), R.Rule("two")], {"IMAP_A_HOST": "h", "IMAP_A_USER": "u", "IMAP_A_PASSWORD": "p"})
    assert a.profiles().count() == 2 and a.accounts["a"].host == "h"
    listed = spark.createDataFrame([("a", "INBOX", "/", ["\\HasChildren"]), ("a", "No", "/", ["\\NoSelect"])], "account string, folder string, delimiter string, flags array<string>")
    state = spark.createDataFrame([("a", "INBOX", 1, 7)], "account string, folder string, uidvalidity long, uid long")
    columns = "account string, folder string, uidvalidity long, uid long, hdr_id long, size long, received_wall timestamp_ntz, from_ string, subject string, date_wall timestamp_ntz"
    box = spark.createDataFrame([("a", "INBOX", 1, 7, 1, None, None, "", "x", None), ("a", "INBOX", 1, 8, 2, 1, None, "", "y", None)], columns)
    assert {(r["profile"], r["uid"]) for r in a.fetch(box, state, listed).planned.collect()} == {("two", 8)}
    assert a.fetch(box, state, listed, profile="one").planned.count() == 0
    kept, gone = a.reset(state)
    assert (kept.count(), gone) == (0, 1)


def test_checks(spark):
    rows = [checks.tool("sh"), checks.tool("none", "no-such-program-here"), checks.probe("x", lambda: "fine"), checks.probe("y", lambda: 1 / 0)]
    assert [r["status"] for r in checks.checks(spark, rows).collect()] == ["OK", "FAIL", "OK", "FAIL"]
    assert checks.browser_revision('{"browsers": [{"name": "chromium", "revision": 12}]}') == "12" and checks.browser_revision("{") is None


def test_namespaces(spark):
    told = spark.createDataFrame([("a", "X."), ("b", None)], "account string, prefix string")
    folders = spark.createDataFrame([("a", "INBOX", "."), ("b", "INBOX.Sub", "."), ("c", "Other", None)], "account string, folder string, delimiter string")
    got = {r["account"]: (r["prefix"], r["delimiter"]) for r in fetch.namespace_of(told, folders).collect()}
    assert got == {"a": ("X.", "."), "b": ("INBOX.", "."), "c": ("", "/")}
    parts = spark.sql("select array(named_struct('mailbox', 'a', 'host', 'x'), named_struct('mailbox', 'b', 'host', 'y')) as p")
    assert parts.select(fetch.envelope_address(F.col("p"))).first()[0] == "a@x, b@y"
