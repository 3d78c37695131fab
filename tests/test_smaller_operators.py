"""Operators of a few lines: sources, settings, headers, layout, reports, checks."""

import datetime as dt

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from mailgrain import api, errors
from mailgrain.functions import markup as H
from mailgrain.functions import mime as M
from mailgrain.functions import text as X
from mailgrain.operators import reports
from mailgrain.plans import fetch, render
from mailgrain.plans import rules as R
from mailgrain.sources import checks, mailbox


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


def test_errors_are_of_one_family():
    kinds = [v for v in vars(errors).values() if isinstance(v, type) and issubclass(v, Exception)]
    assert len(kinds) == 12 and all(issubclass(k, errors.MailError) for k in kinds)
    assert R.ConfigError is errors.ConfigError and mailbox.SourceError is errors.SourceError


def test_mail_source(spark, tmp_path):
    (tmp_path / "b.eml").write_bytes(b"Subject: two\r\n\r\nx")
    (tmp_path / "a.eml").write_bytes(b"Subject: one\r\n\r\nx")
    got = mailbox.parsed_mails(mailbox.EmlFolder(str(tmp_path)), spark).select("source_id", "m.subject", "m.ok")
    assert [(r[0][-5:], r[1], r[2]) for r in got.orderBy("source_id").collect()] == [("a.eml", "one", True), ("b.eml", "two", True)]


def test_delimiters_and_received(spark):
    f = spark.createDataFrame([("a", 1, "."), ("a", 2, "/"), ("a", 3, ""), ("b", 1, None), ("c", 1, "")], "account string, position int, delimiter string")
    assert dict(rows(mailbox.delimiters(f))) == {"a": "/", "b": "/", "c": "/"}
    d = spark.createDataFrame([(dt.datetime(2024, 1, 2), dt.datetime(2023, 5, 6)), (dt.datetime(2024, 1, 2), None)], "modified timestamp, wall timestamp_ntz")
    assert [r["received"].year for r in mailbox.received_time(d, "wall", True).orderBy(F.desc("wall")).collect()] == [2023, 2024]
    assert {r["received"].year for r in mailbox.received_time(d, "wall").collect()} == {2024}


def test_profiles_need_their_accounts(spark):
    p = spark.createDataFrame([("x", "Work"), ("y", "home")], "name string, account string")
    a = spark.createDataFrame([("work", "h1"), ("HOME", "h2")], "name string, host string")
    assert {(r["name"], r["account_of"]["host"]) for r in R.with_accounts(p, a).collect()} == {("x", "h1"), ("y", "h2")}
    with pytest.raises(R.ConfigError, match="x"):
        R.with_accounts(p, a.where("name = 'HOME'"))


def test_folders_in_order(spark):
    rules = [R.Rule("listed", folders=("Z", "A", "M")), R.Rule("deep", recursive=True)]
    scope = spark.createDataFrame([("a", f, 0) for f in "AMZ"] + [("a", f, 1) for f in ("INBOX/b", "INBOX", "INBOX/a")], "account string, folder string, ordinal int")
    assert {r["ordinal"]: r["folders"] for r in R.folder_order(scope, rules).collect()} == {0: ["Z", "A", "M"], 1: ["INBOX", "INBOX/a", "INBOX/b"]}


def test_rule_output_is_expanded(tmp_path, monkeypatch):
    monkeypatch.setenv("HOME", "/home/me")
    f = tmp_path / "r.yaml"
    f.write_text("profiles:\n- {name: a, output: ~/mail}\n")
    assert R.load_rules(str(f))[0].output == "/home/me/mail"


def test_sizes_that_must_hold(spark):
    df = spark.createDataFrame([("5 MB",), (None,)], "t string")
    assert {r[0] for r in df.select(X.required_size(F.col("t"))).collect()} == {5 * 1024**2, None}
    with pytest.raises(PySparkException, match="not a size"):
        spark.createDataFrame([("five",)], "t string").select(X.required_size(F.col("t"))).collect()


def test_header_readers(spark):
    raws = [b"A: b\r\nMessage-ID:\r\n <x@y>\r\n\r\nMessage-ID: <no@body>", b"message-id: <low@y>\nB: c", b"A: b\n\nMessage-ID: <no@body>", b"", None, b"X: \xe9\nMessage-ID: <l@y>\n\n"]
    df = spark.createDataFrame(list(enumerate(raws)), "i int, raw binary")
    assert [r[1] for r in rows(df.select("i", X.header_message_id(F.col("raw"))), "i")] == ["<x@y>", "<low@y>", None, None, None, "<l@y>"]
    big = spark.createDataFrame([(b"A: " + b"x" * 70_000 + b"\r\nMessage-ID: <late@y>\r\n\r\n",)], "raw binary")
    assert big.select(X.header_message_id(F.col("raw"))).first()[0] is None
    heads = [b"=?utf-8?B?w6k=?=", b"\xe9t\xe9", "é".encode(), None, b""]
    assert [r[1] for r in rows(spark.createDataFrame(list(enumerate(heads)), "i int, raw binary").select("i", X.decode_header_bytes("raw")), "i")] == ["é", "été", "é", None, ""]


def test_envelope(spark):
    person = "array<struct<mailbox: string, host: string>>"
    schema = ", ".join(f"{f}: {person}" for f in ("`from`", "`to`", "cc", "bcc"))
    df = spark.createDataFrame([(([("a", "x"), ("b", "y")], [("c", "z")], [], None, "=?utf-8?B?w6k=?=", "d", " <i> "),)], f"e struct<{schema}, subject: string, date: string, message_id: string>")
    h = df.select(fetch.headers_of_envelope(F.col("e")).alias("h")).first()["h"]
    assert (h["from_"], h["to_"], h["cc"], h["subject"], h["message_id"]) == ("a@x, b@y", "c@z", "", "é", "<i>")


def test_bodies_come_late(spark):
    key = "account string, folder string, uidvalidity long, uid long"
    m = spark.createDataFrame([("a", "f", 1, 1, 7), ("a", "f", 1, 2, 8)], key + ", hdr_id long")
    raw = b'Content-Type: multipart/mixed; boundary="e"\r\n\r\n--e\r\nContent-Type: application/pdf\r\nContent-Disposition: attachment; filename="n.pdf"\r\n\r\nx\r\n--e--'
    both = fetch.with_bodies(m, spark.createDataFrame([("a", "f", 1, 1, raw)], key + ", raw binary"))
    assert both.count() == 2 and rows(fetch.attachment_names(both)) == [(7, "n.pdf")]


def test_naming_options_of_rules(spark):
    rules = [R.Rule("own", options={"filename_pattern": "{subject}-{date}", "date_format": "YYYY"}), R.Rule("plain")]
    df = spark.createDataFrame([(0, "own", "s", dt.datetime(2024, 1, 2)), (1, "plain", "s", dt.datetime(2024, 1, 2))], "ordinal int, profile string, subject string, date_wall timestamp_ntz").withColumn("received_wall", F.lit(None).cast("timestamp_ntz"))
    assert rows(df.select("ordinal", fetch.file_base(rules)), "ordinal") == [(0, "s-2024"), (1, "2024-01-02_00-00-00_plain_s")]


def test_layout(spark):
    one = spark.range(1)
    box = F.array(F.struct(F.lit(0.0).alias("x0"), F.lit(0.0).alias("y0"), F.lit(10.0).alias("x1"), F.lit(5.0).alias("y1")))
    moved = one.select(render.carry_links(box, render.place(F.lit(10.0), F.lit(10.0), F.lit(20.0), F.lit(40.0))).alias("l")).first()["l"][0]
    assert tuple(moved) == (0.0, 10.0, 20.0, 20.0)
    assert render.REFLOWED.width_px == 624 and render.FAITHFUL.may_turn and not render.REFLOWED.may_turn


def test_references_meet_parts(spark):
    refs = spark.createDataFrame([(1, "cid:a%40b"), (1, "./pic.png"), (1, "cid:none"), (2, "cid:a@b")], "mail_id int, url string")
    parts = spark.createDataFrame([(1, 10, "<a@b>", None), (1, 11, "a@b", ""), (1, 12, None, "pic.png")], "mail_id int, part_id int, content_id string, content_location string")
    assert {(m, u): p for m, u, p in rows(render.resolved_references(refs, parts).select("mail_id", "url", "part_id"))} == {(1, "cid:a%40b"): 10, (1, "./pic.png"): 12, (1, "cid:none"): None, (2, "cid:a@b"): None}


def test_tools_behind_protocols(spark):
    class Pictures:
        def pages(self, mime, content):
            return b"P" + content

    class Documents:
        def normalise(self, content):
            if content == b"locked":
                raise errors.EncryptedError("locked")
            if content == b"bad":
                raise errors.DamagedError("bad")
            return content

        def join(self, documents):
            return b"".join(documents)

        def count(self, content):
            return len(content)

        def archive(self, content):
            return b"A" + content

    parts = [(1, "a.png", "image/png", b"xx"), (2, "a.pdf", "application/pdf", b"locked"), (3, "a.pdf", "application/pdf", b"bad"), (4, "a.txt", "text/plain", b"\xe9"), (5, "a.pdf", "application/pdf", b"fine")]
    df = spark.createDataFrame(parts, "part_id long, filename string, content_type string, content binary")
    convert = render.converter(Pictures(), Documents(), lambda text: text.encode())
    got = {r["part_id"]: (r["pages"], r["reason"]) for r in render.converted(df, F.lit(100), convert, jobs=1).collect()}
    assert got == {1: (3, None), 2: (0, "ENCRYPTED"), 3: (0, "CORRUPT"), 4: (2, None), 5: (4, None)}
    assert render.joined(Documents(), [b"1", b"2"]) == b"A12"
    with pytest.raises(errors.MergeError):
        render.joined(Documents(), [])


def test_namespaced_tags():
    assert H.local_tag("svg:Image") == "image" and H.local_tag("{http://x}use") == "use" and H.local_tag("p") == "p"
    cleaner = H.Cleaner([], False)
    root = H.tree('<svg:image href="//x.test/a.png"></svg:image><x:script>1</x:script>')
    cleaner.clean(root)
    assert cleaner.blocked == ["//x.test/a.png"] and "script" not in H.serialise(root)


def test_parts_to_resolve(spark):
    raw = b'Content-Type: multipart/mixed; boundary="e"\r\n\r\n--e\r\nContent-Type: image/png\r\nContent-ID: <i>\r\n\r\nx\r\n--e\r\nContent-Type: application/pdf\r\nContent-Disposition: attachment; filename="n.pdf"\r\n\r\nx\r\n--e--'
    m = M.read_mails(spark.createDataFrame([(1, raw)], "i int, raw binary"), "raw", ["i"])
    assert m.select(F.size(M.resolvable_parts(F.col("m")))).first()[0] == 2


def test_report_rows(spark):
    r = spark.createDataFrame([("a_mailonly.pdf", False), ("b_mailonly.pdf", True), ("c.pdf", False)], "path string, compliant boolean")
    assert reports.mail_only_failures(r).first()[0] == 1
    o = spark.createDataFrame([("CORRUPT",), ("ENCRYPTED",), ("EMPTY",), (None,)], "reason string")
    assert reports.damaged(o).first()[0] == 2 and reports.mails_of_run(spark.createDataFrame([("p", 3), ("q", 4)], "profile string, mails int")).first()[0] == 7
    out = spark.createDataFrame([("RESTORED",), ("FAILED",)], "outcome string")
    assert reports.restore_exit_code(out).first()[0] == 1 and reports.restore_exit_code(out.limit(0)).first()[0] == 0
    df, seen = reports.observed(spark.range(7), "passed")
    df.write.format("noop").mode("overwrite").save()
    assert seen.get["rows"] == 7


def test_since_bound_reaches_the_scan(spark):
    m = spark.createDataFrame([(1, dt.datetime(2020, 1, 1), None), (2, dt.datetime(2020, 1, 1), dt.datetime(2024, 1, 1)), (3, None, None)], "hdr_id int, date_wall timestamp_ntz, received_wall timestamp_ntz").withColumn("size", F.lit(1))
    two = [R.Rule("a", since=dt.date(2023, 1, 1)), R.Rule("b", since=dt.date(2022, 1, 1))]
    assert [r[0] for r in rows(fetch.scan_filter(m, two).select("hdr_id"), "hdr_id")] == [2, 3]


def test_checks(spark, tmp_path):
    with pytest.raises(errors.ToolMissing, match="nothing-here"):
        checks.tools({"sh": ("sh",), "nothing-here": ("no-such-program",)})
    assert checks.tools({"sh": ("sh",), "x": ("no",)}, {"x": "/bin/sh"})["x"] == "/bin/sh"
    f = tmp_path / "r.yaml"
    f.write_text("profiles:\n- {name: a}\n")
    env = {"IMAP_W_HOST": "h", "IMAP_W_USER": "u", "IMAP_W_PASSWORD": "p"}
    plain = checks.standard(str(f), [str(tmp_path), "/no/such"], str(tmp_path), {"sh": ("sh",)}, env)
    got = {r["name"]: r["status"] for r in checks.checks(spark, plain).collect()}
    assert got["rules"] == got["accounts"] == got["state"] == got[f"output {tmp_path}"] == "OK" and got["output /no/such"] == "FAIL" and len(plain) == 8
    assert checks.standard(str(f), [], "/none", {}, env, login=lambda a: 1 / 0)[-1][:2] == ("login w", "FAIL")


def test_facade_rewrites_rule_files(spark, tmp_path):
    f = tmp_path / "r.yaml"
    f.write_text("profiles:\n- {name: a, account: w}\n")
    archive = api.Archive.from_file(spark, str(f))
    assert archive.add_profile(str(f), R.Rule("b", account="w", domains=("x.test",))) == f"{f}.bak"
    assert [r.name for r in R.load_rules(str(f))] == ["a", "b"]
    with pytest.raises(R.ConfigError):
        archive.add_profile(str(f), R.Rule("b"))
