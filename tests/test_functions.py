"""Scalar functions, MIME and markup."""

import datetime as dt
from email.message import EmailMessage

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from mailgrain.functions import attachments as A
from mailgrain.functions import markup as H
from mailgrain.functions import mime as M
from mailgrain.functions import text as X
from mailgrain.operators import naming


def column(spark, values, expr, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[1] for r in sorted(df.select("i", expr(F.col("v"))).collect())]


def test_sanitize(spark):
    cases = {"a/b\\c:d": "a_b_c_d", "  x \t y ": "x_y", "é": "é", "__": "", 'q"*?<>|r': "q_r", "a b": "a_b", "": ""}
    assert column(spark, list(cases), X.sanitize) == list(cases.values())
    assert column(spark, [None], X.sanitize) == [None]


def test_truncate_bytes(spark):
    values = ["x" * 250, "ä" * 150, "é" * 100, "x" * 199 + "ä", "a" * 199 + " b", None, ""]
    got = column(spark, values, X.truncate_bytes)
    for v, g in zip(values, got):
        if v is not None:
            assert len(g.encode()) <= 200 and v.startswith(g)
    assert got[2] == "é" * 100 and got[3] == "x" * 199 and got[4] == "a" * 199 and got[5] is None


def test_names_and_dates(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 3, 5, 7, 8, 9), "p", "Hi: there"), (None, "p", "")], "w timestamp_ntz, p string, s string")
    assert [r[0] for r in df.select(X.base_name(F.col("w"), F.col("p"), F.col("s"))).collect()] == ["2024-03-05_07-08-09_p_Hi_there", "p"]
    assert df.select(X.base_name(F.col("w"), F.lit(""), F.lit(""), "{subject}")).first()[0] == "email"
    assert [r[0] for r in df.select(X.format_date_human(F.col("w"))).collect()] == ["05.03.2024 07:08", ""]
    assert df.select(X.format_date(F.col("w"), "mm YYYY hammer")).first()[0] == "08 2024 ha08er"


def test_sizes(spark):
    assert column(spark, ["512", "5 MB", "1.5k", "x", "", None, "-1"], X.parse_size) == [512, 5 * 1024**2, 1536, None, None, None, None]
    assert column(spark, [0, 1023, 1280, 1024**2, None], X.format_size, "long") == ["0 B", "1023 B", "1.2 KB", "1.0 MB", None]


def test_addresses_and_targets(spark):
    got = column(spark, ['"A, B" <a@x.test>, b@x.test', "foo <a@b> <c@d>", "", None], X.email_addresses)
    assert got[0] == ["a@x.test", "b@x.test"] and got[2] == [] and got[3] == []
    assert column(spark, ["N <a@x>", " a@x ", None], X.email_address) == ["a@x", "a@x", None]
    df = spark.createDataFrame([("A/B", "INBOX.", "."), ("INBOX.A", "INBOX.", "."), ("/A//B/", "", ""), ("A.B", "", ".")], "d string, p string, s string")
    assert [r[0] for r in df.select(X.move_target(F.col("d"), F.col("p"), F.col("s"))).collect()] == ["INBOX.A.B", "INBOX.A", "A/B", "A.B"]
    assert column(spark, ["=?utf-8?B?w6k=?=", "plain", None], X.decode_words) == ["é", "plain", None]


def test_kinds(spark):
    rows = [(b"%PDF-1.7", "x/y", "a"), (b"RIFF1234WEBPx", None, "a"), (b"0000ftypheic", None, None), (b"II*\0", None, None), (b"hello", "text/plain", None), (b"hello", "x/y", "a.MD"), (b"", None, None), (None, None, "b.zip")]
    df = spark.createDataFrame(rows, "c binary, t string, n string")
    got = [tuple(r) for r in df.select(A.effective_mime(F.col("c"), F.col("t")), A.classify(F.col("c"), F.col("t"), F.col("n"))).collect()]
    assert got == [("application/pdf", "PDF"), ("image/webp", "IMAGE"), ("image/heic", "IMAGE"), ("image/tiff", "IMAGE"), ("text/plain", "TEXT"), ("x/y", "TEXT"), (None, "OPAQUE"), (None, "OPAQUE")]


def mail(**headers):
    m = EmailMessage()
    for k, v in headers.items():
        m[k.replace("_", "-")] = v
    return m


def test_mime(spark):
    m = mail(From="Ä <a@x.test>", To="b@x.test", Subject="Grüße", Date="Tue, 02 Jan 2024 10:20:30 +0100", Message_ID="<1@x>")
    m.set_content("plain")
    m.add_alternative("<p>page</p>", subtype="html")
    m.get_payload()[1].add_related(b"PNG", "image", "png", cid="<pic>")
    m.add_attachment(b"%PDF", maintype="application", subtype="pdf", filename="é.pdf")
    m.add_attachment(b"x;y", maintype="text", subtype="csv")
    bad = b"Subject: x\r\nDate: never\r\nContent-Type: text/plain; charset=nope\r\n\r\n\xff"
    df = spark.createDataFrame([(0, m.as_bytes()), (1, bad), (2, None), (3, b"")], "i int, raw binary")
    rows = {r["i"]: r["m"] for r in df.select("i", M.parse_mail("raw").alias("m")).collect()}
    got = rows[0]
    assert got["subject"] == "Grüße" and got["offset_min"] == 60 and got["wall"] == dt.datetime(2024, 1, 2, 10, 20, 30)
    assert got["text_body"].strip() == "plain" and got["html_body"].strip() == "<p>page</p>"
    assert [a["filename"] for a in got["attachments"]] == ["é.pdf", "attachment-03.csv"]
    assert [(p["content_id"], bytes(p["content"])) for p in got["inline_parts"]] == [("pic", b"PNG")]
    assert rows[1]["ok"] and rows[1]["wall"] is None and rows[1]["text_body"] is not None
    assert not rows[2]["ok"] and rows[3]["ok"]


def test_sql_functions(spark):
    M.register(spark)
    spark.sql("select 1 as k, cast('Content-Type: application/pdf; name=a.pdf\r\n\r\nx' as binary) as raw").createOrReplaceTempView("mails")
    assert [tuple(r) for r in spark.sql("select part_no, filename from mails, lateral mail_parts(raw)").collect()] == [(1, "a.pdf")]
    refs = spark.sql("select kind, url from html_refs('<img src=\"http://t/x\"><img src=\"cid:y\">') order by kind").collect()
    assert [tuple(r) for r in refs] == [("blocked", "http://t/x"), ("unresolved", "cid:y")]


@pytest.mark.parametrize(
    "page, text",
    [
        ("", ""), (" ", ""), ("<p>a</p><p>b</p>", "a\nb"), ("a<br>b", "a\nb"), ("<ul><li>x<li>y</ul>", "• x\n• y"), ("<style>p{}</style><script>1</script>z", "z"),
        ("<p>a &amp; b&nbsp;c", "a & b\xa0c"), ("<div>a</div><hr><hr><hr><div>b</div>", "a\n\nb"), ("<title>T</title>x<!-- c -->", "Tx"),
    ],
)
def test_page_text(page, text):
    assert H.page_text(page) == text


def test_trivial():
    assert all(H.is_trivial(p) for p in ("<p>x</p>", "x<br>y", "<div><span style='color:red'>x</span></div>"))
    assert not any(H.is_trivial(p) for p in ("", "<b>x</b>", "<p style='border-collapse:x'>", "<style>a{background-color:x}</style>y", "<a>x</a>", "<table></table>"))


def test_cleaner():
    parts = [{"content_id": "<pic>", "content_location": None, "content_type": "image/gif", "content": b"G"}, {"content_id": None, "content_location": "./l.png", "content_type": "image/png", "content": b"P"}]
    page = (
        '<base href="x"><img src="cid:pic"><img src="l.png"><img srcset="http://t/a 1x, cid:pic 2x"><link rel="stylesheet" href="https://c/x.css"><a href="http://keep">k</a>'
        "<style>@import 'http://i/x'; p{background:url(cid:gone)}</style><svg><image href='//r/z'/></svg><meta http-equiv=refresh content=0><p onclick=x>t</p><iframe></iframe>"
    )
    html, unresolved, blocked, kept, ok = H.clean_page(page, parts, False)
    assert ok and unresolved == ["cid:gone"] and sorted(blocked) == ["//r/z", "http://i/x", "http://t/a", "https://c/x.css"] and kept == []
    assert "data:image/gif;base64,Rw==" in html and "data:image/png;base64,UA==" in html and "http://keep" in html
    assert not any(x in html for x in ("onclick", "iframe", "<base", "refresh", "https://c"))
    assert H.clean_page('<img src="http://t/a">', [], True)[3] == ["http://t/a"]


def test_page_edits():
    assert H.with_header("<!-- <body> --><BODY a=b>x</body>", [("Von", "a<b"), ("CC", "")]) == "<!-- <body> --><BODY a=b><div><div><b>Von:</b> a&lt;b</div></div>x</body>"
    assert H.harden("<header>x</header>", False).startswith("<meta")


@settings(max_examples=100, deadline=None)
@given(st.text(max_size=200))
def test_markup_never_fails(text):
    H.page_text(text), H.is_trivial(text), H.clean_page(text, [], False)


def test_numbers_stay_parallel(spark):
    df = spark.createDataFrame([(0 if i % 3 else i, i) for i in range(3000)], "g int, v int")
    got = sorted(tuple(r) for r in naming.number_within(df, "g", ["v"], "k").collect())
    by = {(g, v): k for g, v, k in got}
    for g in {g for g, _ in by}:
        assert [k for _, k in sorted((v, k) for (x, v), k in by.items() if x == g)] == list(range(1, sum(x == g for x, _ in by) + 1))


def raw_mail(kind, parts, subtype="mixed"):
    """Bytes of a mail of nested (type line, headers, body or parts)."""
    def one(content, headers, body, depth):
        if not isinstance(body, list):
            return f"Content-Type: {content}\r\n{headers}\r\n{body}"
        edge = f"b{depth}"
        inner = "".join(f"--{edge}\r\n{one(*p, depth * 10 + k)}\r\n" for k, p in enumerate(body, 1))
        return f'Content-Type: {content}; boundary="{edge}"\r\n{headers}\r\n{inner}--{edge}--\r\n'

    return f"From: a@x.test\r\nSubject: {kind}\r\nMIME-Version: 1.0\r\n{one(subtype, '', parts, 1)}".encode()


ATTACHED = 'Content-Disposition: attachment; filename="{}"\r\n'


@pytest.mark.parametrize(
    "raw, text, html, attachments, inline",
    [
        # mixed > related > alternative, inline image and a document
        (raw_mail("nested", [("multipart/related", "", [("multipart/alternative", "", [("text/plain", "", "hi"), ("text/html", "", "<p>x</p>")]), ("image/png", "Content-ID: <logo>\r\nContent-Disposition: inline\r\n", "p")]), ("application/pdf", ATTACHED.format("doc.pdf"), "d")], "multipart/mixed"), "hi", "<p>x</p>", ["doc.pdf"], ["logo"]),
        # other forms of the shown text
        (raw_mail("invite", [("text/plain", "", "plain"), ("text/html", "", "<p>h</p>"), ("text/calendar; method=REQUEST", "", "BEGIN:VCALENDAR"), ("text/x-amp-html", "", "<html>")], "multipart/alternative"), "plain", "<p>h</p>", [], []),
        (raw_mail("invite", [("text/plain", "", "plain"), ("text/calendar", ATTACHED.format("invite.ics"), "BEGIN:VCALENDAR")], "multipart/alternative"), "plain", None, ["invite.ics"], []),
        # a container and a message attached as a whole
        (raw_mail("fwd", [("text/plain", "", "see"), ("multipart/mixed", ATTACHED.format("nested.eml"), [("text/plain", "", "nested body")])], "multipart/mixed"), "see", None, ["nested.eml"], []),
        (raw_mail("fwd", [("text/plain", "", "see"), ("message/rfc822", ATTACHED.format("fwd.eml"), "Subject: in\r\nContent-Type: image/png\r\nContent-ID: <i>\r\n\r\nx")], "multipart/mixed"), "see", None, ["fwd.eml"], []),
        # the only part is attached, or isn't a text
        (b"Subject: t\r\nContent-Type: text/plain\r\nContent-Disposition: attachment; filename=a.txt\r\n\r\nbody", None, None, ["a.txt"], []),
        (b"Subject: t\r\nContent-Type: application/zip\r\n\r\nbody", None, None, ["attachment-01.zip"], []),
        (b"Subject: t\r\n\r\nbody", "body", None, [], []),
        # broken: no closing edge, no parts
        (b'Content-Type: multipart/mixed; boundary="e"\r\n\r\n--e\r\nContent-Type: text/plain\r\n\r\ncut', "cut", None, [], []),
        (b"", "", None, [], []),
    ],
)
def test_mail_structures(raw, text, html, attachments, inline):
    m = M.read_mail(raw)
    assert m["ok"] and (m["text_body"] or "").strip() == (text or "") and (m["html_body"] or "").strip() == (html or "")
    assert [a["filename"] for a in m["attachments"]] == attachments and [a["content_id"] for a in m["inline_parts"]] == inline


def test_attached_text_keeps_its_bytes():
    raw = b'Content-Type: multipart/mixed; boundary="B"\r\n\r\n--B\r\nContent-Type: text/csv; charset="windows-1252"\r\nContent-Disposition: attachment; filename="d.csv"\r\nContent-Transfer-Encoding: base64\r\n\r\ngOkNCg==\r\n--B--\r\n'
    assert M.read_mail(raw)["attachments"][0]["content"] == b"\x80\xe9\r\n"


@pytest.mark.parametrize(
    "style, targets",
    [
        ("a{background:url(//x.test/a.png)}", ["//x.test/a.png"]),
        ('@import "//x.test/s.css"; b{}', ["//x.test/s.css"]),
        ("@import url('//x.test/s.css');", ["//x.test/s.css"]),
        ("url( '//x.test/a(1).png' ) url(//x.test/b)", ["//x.test/a(1).png", "//x.test/b"]),
        (r'url("//x.test/a\"b.png")', ['//x.test/a"b.png']),
        ("/* url(//x.test/no) */ content: 'url(//x.test/no)'; url(//x.test/yes)", ["//x.test/yes"]),
        ("curl(//x.test/no) my@import 'x'", []),
        ("a: 'open\nurl(//x.test/c)", ["//x.test/c"]),
        ("url(//x.test/open", ["//x.test/open"]),
        ("url() url('')", []),
        ("", []),
    ],
)
def test_style_references(style, targets):
    assert [t for *_, t in H.style_references(style)] == targets
    cleaner = H.Cleaner([], False)
    assert "x.test/yes" not in cleaner.css(style) and cleaner.blocked == [t for t in targets if t.startswith("//")]


@pytest.mark.parametrize("style, yes", [("background:red", True), ("color:red; BORDER-left : 1px", True), ("p{border:0}", True), ("color:red", False), ("/* border:1 */color:x", False), ("x-border:1", False), ("transition: border", False)])
def test_box_styles(style, yes):
    assert H.draws_boxes(style) is yes


def test_sizes_agree(spark):
    texts = ["512", "5 MB", "1.5kb", "2G", " 7 b ", "", "MB", "-5", "five", "5 5MB", "1.", ".5", "1.5.2", "3GBB", "\t8\nK", "٣", "1e3", "10TB", "7 B B"]
    assert column(spark, texts, X.parse_size) == [X.size_bytes(t) for t in texts]
    assert [X.size_bytes(t) for t in texts[:5]] == [512, 5 * 1024**2, 1536, 2 * 1024**3, 7] and not any(X.size_bytes(t) for t in texts[5:14])


def test_functions_in_sql_text(spark):
    M.register(spark)
    wall = "timestamp_ntz'2024-01-02 03:04:05'"
    cases = {
        "sanitize_name('a/b  c')": "a_b_c", "cap_bytes('abc ')": "abc", "email_address('N <a@x>')": "a@x", f"base_name({wall}, 'p', 'Hi: x')": "2024-01-02_03-04-05_p_Hi_x", "base_name(null, '', '?')": "email",
        f"format_date_human({wall})": "02.01.2024 03:04", "parse_size('5 MB')": 5 * 1024**2, "format_size(2048L)": "2.0 KB", "safe_attachment_name('../x.pdf')": "x.pdf", "file_suffix('a.PDF')": "pdf",
        "bare_id('<x>')": "x", "move_target('A/B', 'INBOX.', '.')": "INBOX.A.B", "data_uri(cast('x' as binary), 'text/plain')": "data:text/plain;base64,eA==", "decode_bytes(X'E9')": "é", "is_remote_url('//x')": True,
        "is_allowed_url('data:x')": True, "escape_html('<a>')": "&lt;a&gt;", "sniff_mime(cast('%PDF-' as binary))": "application/pdf", "classify_attachment(cast('x' as binary), 'text/plain', 'a')": "TEXT",
        "has_style_reference('URL(x)')": True, "nfc('e\u0301')": "é", "parse_mail(cast('Subject: s' as binary)).subject": "s", "html_is_trivial('<p>x')": True,
    }
    got = spark.sql("select " + ", ".join(f"{q} as c{n}" for n, q in enumerate(cases))).first()
    assert dict(zip(cases, got, strict=True)) == cases
    df = spark.createDataFrame([(dt.datetime(2024, 1, 2), "p", s_) for s_ in ("a", "{date}", "ü" * 150, "", None)], "w timestamp_ntz, k string, t string")
    assert df.select(F.expr("base_name(w, k, t)").alias("x"), X.base_name(F.col("w"), F.col("k"), F.col("t")).alias("y")).where("x <> y or x is null").count() == 0
