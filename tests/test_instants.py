"""Timestamps against the standard library."""

import datetime as dt
import zoneinfo

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from mailgrain.operators import instants as I

VERSION = I.zone_version()


def read(text, home="Europe/Berlin", day_first=True):
    t = text.strip()
    s, ok = I.convert_mask(I.mask_of(t), np.array([t], dtype=object), np.array([home], dtype=object), np.array([day_first]), VERSION)
    return int(s[0]) if ok[0] else None


def at(*parts):
    return int(dt.datetime(*parts, tzinfo=dt.timezone.utc).timestamp())


@pytest.mark.parametrize(
    "text, expected",
    [
        ("Fri, 10 Apr 2020 23:07:37 -0400 (local time)", at(2020, 4, 11, 3, 7, 37)),
        ("16 Apr 2020 10:55 +0200", at(2020, 4, 16, 8, 55)),
        ("Fri, 19 Mar 2021 06:13:52 -0000", at(2021, 3, 19, 6, 13, 52)),
        ("Mon, 19 May 2025 00:37:50 CEST", at(2025, 5, 18, 22, 37, 50)),
        ("Wed, 10 Jul 2019 07:38:18 MEZ", at(2019, 7, 10, 6, 38, 18)),
        ("Sat, 21-Oct-23 15:41:58 +0200", at(2023, 10, 21, 13, 41, 58)),
        (" 7-Jul-2019 10:31:47 +0000", at(2019, 7, 7, 10, 31, 47)),
        ("Sun Aug  9 07:23:43 2020", at(2020, 8, 9, 5, 23, 43)),
        ("2024-12-31t06:25:12Z", at(2024, 12, 31, 6, 25, 12)),
        ("2023-12-26T17:01:38.312918Z", at(2023, 12, 26, 17, 1, 38)),
        ("2019-07-24 11:57:13,471", at(2019, 7, 24, 9, 57, 13)),
        ("2019-07-29 16:37:25+01", at(2019, 7, 29, 15, 37, 25)),
        ("2022-04-03T19:08:26-04:00[America/New_York]", at(2022, 4, 3, 23, 8, 26)),
        ("2020-11-18 04:09:30 America/New_York", at(2020, 11, 18, 9, 9, 30)),
        ("20190703T111238Z", at(2019, 7, 3, 11, 12, 38)),
        ("17. Juli 2019, 14:43 Uhr", at(2019, 7, 17, 12, 43)),
        ("1. März 2020, 01:30 Uhr", at(2020, 3, 1, 0, 30)),
        ("03.07.2019 12:17", at(2019, 7, 3, 10, 17)),
        ("03/07/2019 07:15", at(2019, 7, 3, 5, 15)),
        ("1562137872.539", 1562137872),
        ("1562438912445", 1562438912),
        ("1563669701793719", 1563669701),
        ("27. Oktober 2024, 02:56 Uhr", at(2024, 10, 27, 0, 56)),  # twice: the first
        ("31.03.2024 02:45", at(2024, 3, 31, 1, 45)),  # skipped: offset before
        ("2023-13-45T25:61:00Z", None),
        ("Mon, 00 Jan 0000 00:00:00", None),
        ("Thu, 32 Feb 2024 10:00:00 +0100", None),
        ("2023-02-29 10:00:00", None),
        ("2020-11-18 04:09:30 Nowhere/Place", None),
        ("yesterday", None),
        ("-", None),
    ],
)
def test_forms(text, expected):
    assert read(text) == expected


def test_slash_dates_follow_the_account():
    assert read("07/06/2019 04:49 PM", "UTC", False) == at(2019, 7, 6, 16, 49)
    assert read("07/06/2019 12:05 AM", "UTC", True) == at(2019, 6, 7, 0, 5)


@settings(max_examples=200, deadline=None)
@given(st.datetimes(dt.datetime(1975, 1, 1), dt.datetime(2090, 1, 1)), st.sampled_from(["Europe/Berlin", "America/New_York", "Australia/Sydney", "Asia/Kolkata", "UTC"]))
def test_local_times_as_fold_zero(wall, zone):
    wall = wall.replace(microsecond=0)
    assert read(wall.strftime("%Y-%m-%d %H:%M:%S"), zone) == int(wall.replace(tzinfo=zoneinfo.ZoneInfo(zone)).timestamp())


def test_rows(spark):
    h = spark.createDataFrame(
        [(1, "a", "2020-01-01 00:00:00", 5), (2, "a", None, 5), (3, None, "2020-01-01 00:00:00", 5), (4, None, "2020-01-01T00:00:00Z", 5), (5, "b", "", 5), (1, "a", "2020-01-01 00:00:00", 5)],
        "hdr_id long, account string, date_ string, utc_s long",
    )
    s = spark.createDataFrame([(1, "b", "0")], "hdr_id long, account string, received string")
    a = spark.createDataFrame([("a", "Asia/Tokyo", None), ("b", None, True)], "name string, home_zone string, day_first boolean")
    out = sorted(tuple(r) for r in I.mail_instants(h, s, a).collect())
    tokyo = at(2019, 12, 31, 15)
    assert out == [("date", 1, tokyo), ("date", 1, tokyo), ("date", 4, at(2020, 1, 1))]
    assert I.mail_instants(h.limit(0), s.limit(0), a).count() == 0


def test_masks_tell_what_is_not_read(spark):
    rows = [("2024-01-02 03:04:05",), (" 2023-11-12 13:14:15",), ("5 Jan 2024",), ("2024-W10-2T10:00",), (None,), ("",), ("Ж 9",)]
    got = {r["mask"]: (r["n"], r["known"]) for r in I.masks(spark.createDataFrame(rows, "t string"), "t", []).collect()}
    assert got == {"9999-99-99 99:99:99": (2, True), "9 AAA 9999": (1, False), "9999-A99-9A99:99": (1, False), "": (1, False), "A 9": (1, False)}
