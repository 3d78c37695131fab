"""Queries over the whole mailbox, by brute force where SQL can't follow."""

import datetime as dt
import random
import re
import unicodedata
from pathlib import PurePosixPath

import pytest

from mailgrain import queries as Q

ACCOUNT = "name string, host string, port int, ssl boolean, home_zone string, day_first boolean"
SCANNED = "account string, folder string, uidvalidity long, uid long, hdr_id long, received string, rfc822_size long"
HEADERS = "hdr_id long, account string, from_ string, to_ string, cc string, bcc string, subject string, date_ string, message_id string"

#: (account, date_, received, wall clock shown by date_, by received)
TIMES = [
    ("eu", "2021-03-01 10:20:30", None, (2021, 3, 1, 10, 20, 30), None),
    ("eu", "Fri, 10 Apr 2020 23:07:37 -0400 (local time)", None, (2020, 4, 10, 23, 7, 37), None),
    ("eu", "Wed, 10 Jul 2019 07:38:18 MEZ", "x", (2019, 7, 10, 7, 38, 18), None),
    ("eu", "2024-12-31T23:25:12Z", None, (2024, 12, 31, 23, 25, 12), None),
    ("eu", " 17. Juli 2019, 14:43 Uhr ", None, (2019, 7, 17, 14, 43, 0), None),
    ("eu", "07/06/2019 04:49 PM", None, (2019, 6, 7, 16, 49, 0), None),
    ("us", "07/06/2019 04:49 PM", None, (2019, 7, 6, 16, 49, 0), None),
    ("gone", "07/06/2019 04:49", None, (2019, 6, 7, 4, 49, 0), None),
    ("gone", "2020-11-18 04:09:30 Nowhere/Place", None, (2020, 11, 18, 4, 9, 30), None),
    ("us", "1562137872.539", "1562438912445", (2019, 7, 3, 7, 11, 12), (2019, 7, 6, 18, 48, 32)),
    ("us", "-", "Sat, 21-Oct-23 15:41:58 +0200", None, (2023, 10, 21, 15, 41, 58)),
    ("eu", "Mon, 00 Jan 0000 00:00:00", "", None, None),
    ("eu", "2023-13-45T25:61:00Z", None, None, None),
    ("eu", None, None, None, None),
]
SUBJECTS = ["Grüße", "Grüße", "a b c　d\x85e", "ä" * 120, "x" * 170 + "€" * 20, "�" * 90, "/\\:*?", "", None, "plain", "日本" * 60, "tail" + "🙂" * 50, "a\tb\x1c_c", "{profile}"]


def brute_name(wall, subject):
    date = "" if wall is None else dt.datetime(*wall).strftime("%Y-%m-%d_%H-%M-%S")
    text = unicodedata.normalize("NFC", "{date}_demo_{subject}".replace("{date}", date).replace("{subject}", subject or ""))
    safe = re.sub(r"[\s_]+", "_", re.sub(r'[/\\:*?"<>|]', "_", text)).strip("_")
    raw = safe.encode()
    return (safe if len(raw) <= 200 else raw[:200].decode(errors="ignore").rstrip()) or "email"


@pytest.fixture(scope="module")
def box(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("box"))
    write = lambda name, rows, schema: spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{d}/{name}.parquet")
    write("account", [("eu", "h", 1, True, "Europe/Berlin", True), ("us", "h", 1, True, "America/New_York", False)], ACCOUNT)
    write("scanned_message", [(a, "INBOX", 1, i, i, r, None if i % 3 == 0 else 200_000 * (i % 2)) for i, (a, _, r, _, _) in enumerate(TIMES)], SCANNED)
    write("mail_headers", [(i, a, "u@nordlicht.example", "", "", "", SUBJECTS[i], t, None) for i, (a, t, _, _, _) in enumerate(TIMES)], HEADERS)
    return d


def test_every_readable_form_dates_a_message(spark, box):
    got = {r["hdr_id"]: (r["date_wall"], r["received_wall"]) for r in Q.mbox(spark, box).collect()}
    assert got == {i: (w and dt.datetime(*w), r and dt.datetime(*r)) for i, (_, _, _, w, r) in enumerate(TIMES)}


def test_date_rules_hold_for_every_form(spark, box):
    day = [(w or r) and dt.date(*(w or r)[:3]) for *_, w, r in TIMES]
    inside = {i for i, x in enumerate(day) if x is None or dt.date(2020, 6, 1) <= x <= dt.date(2021, 5, 31)}
    assert {r["hdr_id"] for r in Q.match_date_window(spark, box).collect()} == inside
    nordlicht = {i: 1 if x is None or x >= dt.date(2020, 1, 1) else None for i, x in enumerate(day)}
    for query in (Q.first_match, Q.first_match_table, Q.first_match_strict):
        assert {r["hdr_id"]: r["ordinal"] for r in query(spark, box).collect()} == nordlicht
    shown = {r["hdr_id"]: r["shown"] for r in Q.format_date_human(spark, box).collect()}
    assert shown == {i: dt.datetime(*w).strftime("%d.%m.%Y %H:%M") if w else "" for i, (*_, w, _) in enumerate(TIMES)}


def test_fetch_by_days(spark, box):
    """Report, plan, actions and summary of the dated rules; sizes are unknown for every third message, which counts as failed."""
    delivered = [("eu", "INBOX", 1, i, f"f{i}.eml", "nordlicht", i) for i in (1, 4, 9)]
    schema = "account string, folder string, uidvalidity long, uid long, filename string, profile string, hdr_id long"
    rows = [(TIMES[i][0], *r[1:]) for i, r in zip((1, 4, 9), delivered)]
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("overwrite").parquet(f"{box}/delivered.parquet")
    day = [(w or r) and dt.date(*(w or r)[:3]) for *_, w, r in TIMES]
    hit = [i for i, x in enumerate(day) if x is None or x >= dt.date(2020, 1, 1)]
    failed, read = [i for i in hit if i % 3 == 0], [i for i in hit if i % 3]
    new, old = [i for i in read if i not in (1, 4, 9)], [i for i in read if i in (1, 4, 9)]
    assert old and new and failed
    assert [tuple(r) for r in Q.fetch_report(spark, box).collect()] == [("nordlicht", len(new), len(old))]
    assert sorted((r["uid"], r["action"]) for r in Q.planned_delivery(spark, box).collect()) == [(i, "none") for i in new]
    assert Q.post_fetch_steps(spark, box).count() == Q.retry_actions(spark, box).count() == 0  # the rule has no action
    summary = Q.fetch_summary(spark, box).first()["summary"]
    assert summary == f"{len(new)} delivered\n  nordlicht: {len(new)}\n{len(old)} already archived\n{len(failed)} failed"


def test_every_subject_names_a_file(spark, box):
    got = {r["hdr_id"]: r["base_name"] for r in Q.base_name(spark, box).collect()}
    assert got == {i: brute_name(w or r, SUBJECTS[i]) for i, (*_, w, r) in enumerate(TIMES)}


def test_every_filename_is_made_safe(spark, tmp_path):
    blanks = "".join(map(chr, [*range(0x09, 0x0E), *range(0x1C, 0x20), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
    names = [None, "", "plain.pdf", "ü.pdf", *[f"a{c}b{c}" for c in blanks], f"x{blanks}y", "a᠎b", "a\x80b\x9fc", "a​b", 'q?"<>|.txt']
    spark.createDataFrame(list(enumerate(names)), "part_id long, filename string").coalesce(1).write.parquet(str(tmp_path / "attachment_part.parquet"))
    brute = {i: n and re.sub(r"[\s_]+", "_", re.sub(r'[/\\:*?"<>|]', "_", unicodedata.normalize("NFC", n))).strip("_") for i, n in enumerate(names)}
    assert {r["part_id"]: r["safe"] for r in Q.sanitize_nfc(spark, str(tmp_path)).collect()} == brute


def test_unknown_sizes_meet_the_size_rule(spark, box):
    spark.createDataFrame([(3, "x.pdf"), (4, "y.PDF"), (8, "z.txt")], "hdr_id long, filename string").coalesce(1).write.mode("overwrite").parquet(f"{box}/attachment_part.parquet")
    got = {r["hdr_id"]: r["ordinal"] for r in Q.first_match_attachments(spark, box).collect()}
    assert got == {i: 1 if i % 3 == 0 or i % 2 else 2 if i == 4 else None for i in range(len(TIMES))}


def brute_attachment(name):
    last = PurePosixPath((name or "").replace("\\", "/")).name
    clean = re.sub(r"[\x00-\x1f\x7f]", "", last).strip()
    return "attachment" if clean in ("", ".", "..") else clean


def test_every_attachment_name_is_made_safe(spark, tmp_path):
    names = [None, "", "  ", ".", "..", "../../etc/passwd", "a\\b.txt", "dir/", "dir/.", "dir/.//./", "a/..", "/", "//.", "dir/\n", "x\n", "a\x00b", "\xa0", "  ok.pdf　", "ok.pdf", "a./b.", "\x85x"]
    spark.createDataFrame([(n,) for n in names], "filename string").coalesce(1).write.parquet(str(tmp_path / "attachment_part.parquet"))
    assert {r["t"]: r["safe"] for r in Q.safe_attachment_name(spark, str(tmp_path)).collect()} == {n: brute_attachment(n) for n in names}


def brute_unique(rows):
    held, out = {}, set()
    for n, base, ident in sorted(rows):
        k, name = 1, base
        while held.get(name, ident) != ident:
            k += 1
            name = f"{base}-{k}"
        out.add((n, name, name in held))
        held[name] = ident
    return out


def test_numbered_names_never_meet(spark, tmp_path):
    pick = random.Random(3)
    rows = [(n, pick.choice(["x", "x", "x-2", "x-3", "x-2-2", "x-02", "y", "y-4", "x-1"]), bytes([pick.randrange(12)])) for n in range(150)]
    rows += [(n, "z", n.to_bytes(4)) for n in range(150, 20_150)]  # a base with most rows
    spark.createDataFrame(rows, "part_id long, filename string, content binary").coalesce(1).write.parquet(str(tmp_path / "attachment_part.parquet"))
    got = {tuple(r) for r in Q.unique_names_cross(spark, str(tmp_path)).collect()}
    assert {r for r in got if r[0] < 150} == brute_unique(rows[:150])
    assert {r for r in got if r[0] >= 150} == {(n, "z" if n == 150 else f"z-{n - 149}", False) for n in range(150, 20_150)}
