"""State, naming, audit, reports, sources and streaming."""

import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from mailgrain.operators import audit, naming
from mailgrain.operators import state as st
from mailgrain.plans import render
from mailgrain.plans import rules as R
from mailgrain.sources import config, mailbox, sinks
from mailgrain.streaming import delivery

STATE = "account string, folder string, uidvalidity long, uid long, filename string, profile string"


def test_state(spark):
    old = spark.createDataFrame([("a", "f", 1, 1)], "account string, folder string, uidvalidity long, uid long")
    new = spark.createDataFrame([("a", "f", 1, 1, "late", "p", 1), ("a", "f", 1, 2, "x", None, 3), ("a", "f", 1, 2, "y", "p", 2), ("a", "f", 2, 1, "z", "q", 4)], STATE + ", n int")
    s = st.insert_or_ignore(old, new, F.col("n"))
    assert sorted((r["uidvalidity"], r["uid"], r["filename"]) for r in s.collect()) == [(1, 1, None), (1, 2, "y"), (2, 1, "z")]
    assert st.insert_or_ignore(s, new, F.col("n")).count() == 3  # again: nothing new
    kept, gone = st.clear(s, "p")
    assert sorted(str(r["profile"]) for r in kept.collect()) == ["None", "q"] and s.where(gone).count() == 1
    assert st.clear(s)[0].count() == 0 and st.untracked(s).first()[0] == 1
    assert st.delivered_uids(s, "a", "f", 1).count() == 2


def test_names(spark):
    rows = [(1, "x", "i"), (2, "x", "j"), (3, "x", "i"), (4, "y", "k"), (5, "x", "l"), (6, "x", "j")]
    got = naming.unique_names(spark.createDataFrame(rows, "n int, base string, ident string"), "base", "ident", ["n"])
    assert [(r["n"], r["name"], r["skip"]) for r in got.orderBy("n").collect()] == [(1, "x", False), (2, "x-2", False), (3, "x", True), (4, "y", False), (5, "x-3", False), (6, "x-2", True)]


def test_findings(spark):
    folders = spark.createDataFrame(
        [("p", "a", True, "i\nsha256:1", True), ("p", "b", True, "i\nsha256:1", False), ("p", ".staging-c", False, None, False), ("p", "d", False, None, True)],
        "profile string, name string, has_manifest boolean, identity string, has_pdf boolean",
    )
    files = spark.createDataFrame([("p", s, m, h) for s, m, h in [("a", "i", "x"), ("a-2", "i", "x"), ("z", None, "sha256:1"), ("n1", "q", "y")] + [(f"n{k}", None, None) for k in range(2, 9)]], "profile string, stem string, message_id string, sha256 string")
    profiles = spark.createDataFrame([("p", True), ("none", True), ("off", False)], "profile string, pdf boolean")
    found = audit.findings(files, folders, profiles)
    got = sorted((r["kind"], r["severity"], r["profile"], r["detail"]) for r in found.collect())
    assert got == [
        ("duplicate", "WARN", "p", "a, b"), ("incomplete", "FAIL", "p", "b"), ("no-archive", "WARN", "none", ""), ("no-archive", "WARN", "off", ""), ("no-manifest", "WARN", "p", "d"),
        ("staging", "WARN", "p", ".staging-c"), ("unrendered", "WARN", "p", "8: n1, n2, n3, n4, n5, …"),
    ]
    assert audit.exit_code(found).first()[0] == 1 and audit.exit_code(found.where("severity = 'WARN'")).first()[0] == 0
    assert audit.summary(found).where("kind = 'staging'").first()["detail"] == ".staging-c"


def test_restore(spark):
    a = spark.createDataFrame([(1, "m", "s"), (2, "m", "t"), (3, None, "s")], "i int, message_id string, subject string")
    b = spark.createDataFrame([("m", "s"), ("m", "s"), (None, "s")], "message_id string, subject string")
    assert [r["outcome"] for r in audit.restore_plan(a, b).orderBy("i").collect()] == ["SKIPPED", "RESTORED", "RESTORED"]


def test_pages_and_reports(spark):
    mails = spark.createDataFrame([(1, "t", "<b>x</b>", 2), (2, None, "<p>x</p>", 1), (3, None, None, None), (4, "t", "<b>x</b>", None)], "mail_id int, text_body string, html_body string, html_pages int")
    got = {}
    for r in render.body_plan(mails).orderBy("mail_id", "page_no").collect():
        got.setdefault(r["mail_id"], []).append(r["part"])
    assert got == {1: ["faithful", "section", "reflowed", "section", "text"], 2: ["text"], 3: ["header"], 4: ["text"]}
    reports = spark.createDataFrame([(1, ["a", "b"], '{"report":{"jobs":[{"validationResult":{"compliant":true}},{}]}}'), (2, ["a"], "{}"), (3, ["a"], None)], "batch int, paths array<string>, json string")
    assert [(r["path"], r["compliant"]) for r in render.validation_results(reports, "paths", "json").where("batch = 1").orderBy("position").collect()] == [("a", True), ("b", False)]
    # what can't be paired is checked file by file, or has no verdict
    assert [(r["batch"], r["path"], r["compliant"]) for r in render.validation_results(reports, "paths", "json").where("batch > 1").orderBy("batch").collect()] == [(2, "a", None), (3, "a", None)]
    assert {r["compliant"] for r in render.validation_results(reports, "paths", "json", lambda p: 1 / 0 if p == "b" else True).where("batch > 1").collect()} == {True}
    fit = spark.range(1).select(render.fit(F.lit(5000.0)).alias("f"), render.place(F.lit(10.0), F.lit(10.0), F.lit(20.0), F.lit(40.0)).alias("p")).first()
    assert fit["f"]["landscape"] and fit["f"]["scale"] < 0.85 and tuple(fit["p"]) == (2.0, 0.0, 10.0)


def test_accounts(spark):
    rows = [("IMAP_A_HOST", "h"), ("IMAP_A_USER", "u"), ("IMAP_A_SSL", "False"), ("IMAP_B_C_HOST", "k"), ("OTHER", "x")]
    got = {r["name"]: tuple(r)[1:] for r in config.pivot_accounts(spark.createDataFrame(rows, "key string, value string")).collect()}
    assert got == {"a": ("h", 993, "u", False), "b_c": ("k", 993, None, True)}


def test_stream_equals_batch_and_survives_a_rerun(spark, tmp_path):
    schema = "account string, folder string, uidvalidity long, uid long"
    inbox = tmp_path / "in"
    first = spark.createDataFrame([("a", "f", 1, i % 40) for i in range(100)], schema)
    first.repartition(3).write.parquet(str(inbox))
    read = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(inbox))
    state, check = str(tmp_path / "state"), str(tmp_path / "check")
    delivery.deliver(read(), state, check).awaitTermination()
    spark.createDataFrame([("a", "f", 1, 3), ("a", "f", 2, 3)], schema).write.mode("append").parquet(str(inbox))
    delivery.deliver(read(), state, check).awaitTermination()
    got = [tuple(r) for r in spark.read.schema(schema).parquet(f"{state}/batch_id=*").collect()]
    assert len(got) == len(set(got)) == 41
    assert delivery.first_deliveries(spark.read.parquet(str(inbox))).count() == 41


def test_stream_with_rules(spark, tmp_path):
    """First match per message, unmatched ones for later rules, actions until they are done."""
    schema = "account string, folder string, uidvalidity long, uid long, hdr_id long, size long, received_wall timestamp_ntz, from_ string, to_ string, cc string, bcc string, subject string, message_id string, date_wall timestamp_ntz"
    rows = [("a", "INBOX", 1, i, i, 10, None, "", "", "", "", "bill" if i % 2 else "other", None, None) for i in range(20)]
    inbox, out = str(tmp_path / "in"), str(tmp_path / "out")
    spark.createDataFrame(rows, schema).repartition(2).write.parquet(inbox)
    folders = spark.createDataFrame([("a", "INBOX", 0)], "account string, folder string, ordinal int")
    rules = [R.Rule("bills", subject="bill", label="b")]
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(inbox)
    delivery.fetch_stream(stream, rules, folders, out, str(tmp_path / "check")).awaitTermination()
    spark.createDataFrame(rows[:4], schema).write.mode("append").parquet(inbox)
    delivery.fetch_stream(stream, rules, folders, out, str(tmp_path / "check")).awaitTermination()
    assert sorted(r["uid"] for r in spark.read.parquet(f"{out}/delivered/batch_id=*").collect()) == list(range(1, 20, 2))
    assert delivery.matched_later(spark, out, rules, folders).where("ordinal is not null").count() == 0
    later = delivery.matched_later(spark, out, [R.Rule("any")], folders)
    assert sorted(r["uid"] for r in later.where("ordinal = 0").collect()) == list(range(0, 20, 2))
    done = spark.createDataFrame([("a", "INBOX", 1, 1)], "account string, folder string, uidvalidity long, uid long")
    assert delivery.open_actions(spark, out).count() == 10 and sorted(r["uid"] for r in delivery.open_actions(spark, out, done).collect()) == list(range(3, 20, 2))


def test_snapshot_source(spark, tmp_path):
    rows = [("a", "f", 1, i, i, i * 10) for i in range(20)] + [("b", "f", 1, 1, 99, 500)]
    spark.createDataFrame(rows, "account string, folder string, uidvalidity long, uid long, hdr_id long, rfc822_size long").write.parquet(str(tmp_path / "s"))
    mailbox.register(spark)
    s = spark.read.format("mail_snapshot").load(str(tmp_path / "s"))
    assert s.where("account = 'a' and size > 150").count() == 4


def test_core_stands_without_the_subpackage():
    root = Path(__file__).resolve().parents[1]
    code = "import sys; sys.modules['mailgrain.llm'] = None; import __spark_entry__ as e; assert 'p1_found' in e.queries() and 'p2_found' not in e.queries(); assert set(e.oracle_sql()) <= set(e.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=root, check=True)
    for p in (root / "mailgrain").rglob("*.py"):
        if "llm" not in p.parts:
            assert "mailgrain.llm" not in p.read_text()


def test_write_once(tmp_path):
    d = str(tmp_path / "new")
    assert sinks.write_once(d, "m.eml", b"one") == ("m.eml", True) and sinks.write_once(d, "m.eml", b"one") == ("m.eml", False)
    assert sinks.write_once(d, "m.eml", b"two") == ("m-2.eml", True) and sinks.write_once(d, "m.eml", b"two") == ("m-2.eml", False)
    assert sorted(p.name for p in (tmp_path / "new").iterdir()) == ["m-2.eml", "m.eml"] and (tmp_path / "new" / "m.eml").stat().st_mode & 0o777 == 0o400
    assert sinks.free_name(d, "m.eml") == "m-3.eml" and sinks.free_name(d, ".hidden") == ".hidden" and sinks.numbered(".hidden", 2) == ".hidden-2"


def test_delivery(spark, tmp_path):
    rows = [(1, "p", "x", b"a"), (2, "p", "x", b"b"), (3, "p", "x", b"a"), (4, "q", "x", b"c"), (5, "p", "y", b"new"), (6, "p", "x-2", b"d"), (7, "q", "z", None)]
    mails = spark.createDataFrame(rows, "position int, folder string, base string, content binary")
    there = spark.createDataFrame([("p", "y", b"old"), ("p", "y-2", b"new"), ("q", "x", b"c")], "folder string, name string, content binary")
    planned = sinks.delivery_names(mails, there)
    got = {r["position"]: (r["name"], r["skip"]) for r in planned.collect()}
    assert got == {1: ("x", False), 2: ("x-2", False), 3: ("x", True), 4: ("x", True), 5: ("y-2", True), 6: ("x-2-2", False), 7: ("z", False)}
    for turn in range(2):  # a second run writes nothing
        done = {(r["folder"], r["name"]): (r["written"], r["error"]) for r in sinks.deliver(planned, str(tmp_path)).collect()}
        assert done["p", "x.eml"][0] in (turn == 0, False) and done["q", "z.eml"] == (False, "ValueError: no content")
    assert {p.name: p.read_bytes() for p in (tmp_path / "p").iterdir()} == {"x.eml": b"a", "x-2.eml": b"b", "x-2-2.eml": b"d"}
    assert sinks.delivery_names(mails.limit(0), there).count() == 0


def test_mail_folders(spark, tmp_path):
    root = str(tmp_path)
    (tmp_path / ".staging-left").mkdir()
    (tmp_path / ".staging-file").write_text("x")
    assert sinks.sweep_staging(root) == [".staging-file", ".staging-left"] and sinks.sweep_staging(str(tmp_path / "none")) == []
    rows = [("m1", "id1\nsha256:1", [("m1.pdf", b"P"), ("../evil.txt", b"E"), ("m1.pdf", b"Q")]), ("m2", "id2", [])]
    df = spark.createDataFrame(rows, "name string, identity string, files array<struct<name: string, content: binary>>")
    assert sorted(tuple(r) for r in sinks.store(df, root).collect()) == [("m1", True, None), ("m2", True, None)]
    assert sorted(tuple(r) for r in sinks.store(df, root).collect()) == [("m1", False, None), ("m2", False, None)]
    assert {p.name: p.read_bytes() for p in (tmp_path / "m1").iterdir() if p.name != sinks.MANIFEST} == {"m1.pdf": b"P", "m1-2.pdf": b"Q", "evil.txt": b"E"}
    assert {r["name"]: r["identity"] for r in sinks.manifests(spark, root).collect()} == {"m1": "id1\nsha256:1", "m2": "id2"}
    other = spark.createDataFrame([("m1", "someone else", [])], df.schema)
    assert sinks.store(other, root).first()["error"].startswith("OSError") or sinks.store(other, root).first()["error"]
    (tmp_path / "in.eml").write_bytes(b"raw")
    assert sinks.move_into_folder(f"{root}/in.eml", f"{root}/m2") == f"{root}/m2/m2.eml" and sinks.move_into_folder(f"{root}/in.eml", f"{root}/m2") is None


def test_settings_files(tmp_path):
    f = tmp_path / "rules.yaml"
    assert sinks.rewrite_settings(str(f), "a") is None
    assert [sinks.rewrite_settings(str(f), t) for t in "bc"] == [f"{f}.bak", f"{f}.bak.1"] and f.read_text() == "c" and (tmp_path / "rules.yaml.bak.1").read_text() == "b"


def test_server_outcomes(spark):
    steps = [("full", "move"), ("plus", "move"), ("none", "move"), ("none", "delete"), ("plus", "delete"), ("none", "label"), ("none", "upload"), ("unknown", "delete")]
    a = spark.createDataFrame(steps, "account string, step string")
    c = spark.createDataFrame([("full", ["move", "uidplus"]), ("plus", ["UIDPLUS"]), ("none", [])], "account string, capabilities array<string>")
    got = {(r["account"], r["step"]): (r["commands"], r["error"] is None) for r in sinks.server_outcomes(a, c).collect()}
    assert got["full", "move"] == (["CREATE", "SUBSCRIBE", "MOVE"], True) and got["plus", "move"][0][2:] == ["COPY", "STORE \\Deleted", "UID EXPUNGE"]
    assert got["none", "move"] == (["CREATE", "SUBSCRIBE", "COPY", "STORE \\Deleted"], False) and got["none", "delete"][1] is False and got["unknown", "delete"][1] is False
    assert got["none", "label"] == (["STORE"], True) and got["none", "upload"][0][-1] == "APPEND"


def test_pages_markup(spark):
    one = spark.range(1)
    text = lambda c: one.select(c).first()[0]
    info = text(render.info_markup(F.lit(2), F.lit("a<b>.zip"), F.lit("application/zip"), F.lit(2048), F.lit("zu groß")))
    assert "a&lt;b&gt;.zip" in info and "zu groß" in info and "2.0 KB" in info and "default-src 'none'" in info
    sep = [text(render.separator_markup(F.lit(1), F.lit("x"), F.lit(n), F.lit(5))) for n in (1, 2)]
    assert "1 Seite &middot;" in sep[0] and "2 Seiten &middot;" in sep[1]
    heads = {"from_": F.lit("A <a@x>"), "bcc": F.lit("z@x"), "cc": F.lit(""), "subject": F.lit(None).cast("string")}
    assert text(render.header_markup(heads)) == '<div class="header"><div class="row"><b>Von:</b> A &lt;a@x&gt;</div></div>'
    assert "BCC" in text(render.header_markup(heads, show_bcc=True)) and "<script>" not in text(render.text_markup(heads, F.lit("<script>")))
    assert "Anhang" in text(render.text_attachment_markup(F.lit("n"), F.lit("t"))) and "T&amp;" in text(render.section_markup(F.lit("T&")))


def test_converter_outcomes(spark):
    def convert(kind, mime, content):
        raise {b"t": TimeoutError, b"e": PermissionError, b"c": ValueError, b"x": RuntimeError}[content] if content != b"ok" else StopIteration

    rows = [(n, "a.txt", "text/plain", c) for n, c in enumerate([b"t", b"e", b"c", b"x", b"", None, b"long" * 9])] + [(9, "a.bin", "application/x", b"x")]
    parts = spark.createDataFrame(rows, "part_id long, filename string, content_type string, content binary")
    got = {r["part_id"]: r["reason"] for r in render.converted(parts, F.lit(20), convert).collect()}
    assert got == {0: "TIMEOUT", 1: "ENCRYPTED", 2: "CORRUPT", 3: "TRANSCODE_FAILED", 4: "EMPTY", 5: "EMPTY", 6: "TOO_LARGE", 9: "UNSUPPORTED_TYPE"}


def test_render_and_adhoc_plans(spark):
    mail = lambda i, folder, subject, content, mid="m": (i, folder, "p", subject, None, mid, "f", content, "text", None, None)
    schema = "mail_id long, folder string, profile string, subject string, stamp timestamp_ntz, message_id string, from_ string, content binary, text_body string, html_body string, html_pages int"
    mails = spark.createDataFrame([mail(1, "d", "s", b"1"), mail(2, "d", "s", b"2"), mail(3, "d", "s", b"1"), mail(4, "d", "t", b"4", "known"), mail(5, "e", "s", b"9"), mail(6, "d", "u", b"6")], schema)
    parts = spark.createDataFrame([(10, 2, 1, "a.txt", "text/plain", b"x"), (11, 2, 2, "b.bin", "application/x", b"y"), (12, 3, 1, "c", "text/plain", b"z")], "part_id long, hdr_id long, part_no int, filename string, content_type string, content binary")
    outcomes = render.converted(parts, F.lit(100), lambda kind, mime, content: 3)
    old = spark.createDataFrame([("d", "p_t", "known"), ("d", "p_u", "q\nsha256:0")], "folder string, name string, identity string")
    plan = render.render_plan(mails, parts, outcomes, old)
    assert {r["mail_id"]: (r["name"], r["skip"]) for r in plan.mails.collect()} == {1: ("p_s", False), 2: ("p_s-2", False), 3: ("p_s", True), 4: ("p_t", True), 5: ("p_s", False), 6: ("p_u-2", False)}
    pages = [(r["index"], r["page"]) for r in plan.pages.where("mail_id = 2").orderBy("index", "step").collect()]
    assert pages == [(0, "text"), (1, "separator"), (1, "pages"), (2, "info")] and plan.pages.where("mail_id in (3, 4)").count() == 0
    assert sorted((r["mail_id"], r["file"], r["with_attachments"]) for r in plan.files.collect()) == [(1, "p_s.pdf", False), (2, "p_s-2.pdf", True), (2, "p_s-2_mailonly.pdf", False), (5, "p_s.pdf", False), (6, "p_u-2.pdf", False)]
    files = mails.drop("folder", "profile", "stamp").withColumn("path", F.concat(F.lit("/in/"), F.when(F.col("mail_id") == 5, "b/").otherwise("a/"), "mail_id", F.lit(".eml"))).withColumn("wall", F.lit(None).cast("timestamp_ntz")).withColumn("modified", F.lit("2024-01-02 03:04:05").cast("timestamp"))
    adhoc = {r["mail_id"]: (r["folder"], r["name"], r["skip"]) for r in render.adhoc_plan(files, "adhoc", parts, outcomes).mails.collect()}
    assert adhoc[1] == ("/in/a", "2024-01-02_03-04-05_adhoc_s", False) and adhoc[2][1].endswith("_s-2") and adhoc[3][2] and adhoc[5] == ("/in/b", "2024-01-02_03-04-05_adhoc_s", False)


def test_collect_files(spark, tmp_path):
    for n in ("b.eml", "a.eml", "c.txt"):
        (tmp_path / n).write_text("x")
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "d.eml").write_text("x")
    got = [r["path"].rsplit("/", 1)[1] for r in mailbox.collect_files(spark, [f"{tmp_path}/b.eml", str(tmp_path), f"{tmp_path}/a.eml"]).orderBy("position").collect()]
    assert got == ["b.eml", "a.eml"]
    for bad in ("none", "c.txt"):
        with pytest.raises(mailbox.SourceError):
            mailbox.collect_files(spark, [f"{tmp_path}/{bad}"])
