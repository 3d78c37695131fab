"""The identifier index against brute force."""

import random

import numpy as np

from mailgrain.operators import redelivery as D

DELIVERED = "hdr_id long, batch_no int, account string, folder string, uidvalidity long, uid long, subject string"
HEADERS = "hdr_id long, message_id string, subject string, account string"


def brute(delivered, headers):
    by = {h[0]: h for h in headers}
    groups = {}
    for d in delivered:
        ident = (by.get(d[0]) or (None, None, None, None))[1]
        ident = ident.strip().strip("<>").strip() if ident else ""
        if ident:
            left, at, host = ident.rpartition("@")
            key = ("m", d[2], left + at + host.lower() if at else ident, by[d[0]][2])
        else:
            key = ("p", d[2], d[3], d[4], d[5])
        groups.setdefault(key, []).append(d[0])
    return sorted(i for g in groups.values() for i in g if i > min(g))


def frames(spark, delivered, headers):
    return spark.createDataFrame(delivered, DELIVERED), spark.createDataFrame(headers, HEADERS)


def test_repeats_match_brute_force(spark):
    rng = random.Random(3)
    headers, delivered = [], []
    for i in range(600):
        n = 7 if rng.random() < 0.35 else rng.randrange(200)  # one message holds a third
        form = rng.choice(["<id{}@Host.Test>", " id{}@host.test\r\n", "id{}@HOST.test", "<id{}@host.test> "])
        ident = None if rng.random() < 0.05 else " " if rng.random() < 0.05 else form.format(n)
        headers.append((i, ident, f"s{n % 3}" if n != 9 else None, "a"))
        delivered.append((i, rng.choice([None, 1, 2, 9]), rng.choice(["a", "b"]) if n != 7 else "a", rng.choice(["f", None]), 1, rng.randrange(50), "x"))
    got = D.repeats(*frames(spark, delivered, headers))
    assert got.columns == ["hdr_id"]
    assert sorted(r[0] for r in got.collect()) == brute(delivered, headers)
    kept = D.kept(*frames(spark, delivered, headers)).count()
    assert kept == len(delivered) - len(brute(delivered, headers))


def test_late_smaller_row_wins(spark):
    delivered = [(5, 1, "a", "f", 1, 1, None), (2, 8, "a", "g", 1, 2, None)]
    headers = [(5, "<x@y>", "s", "a"), (2, "x@Y", "s", "a")]
    assert [r[0] for r in D.repeats(*frames(spark, delivered, headers)).collect()] == [5]


def test_empty_tables(spark):
    assert D.repeats(*frames(spark, [], [])).count() == 0


def test_runs_search_and_merge():
    rng = np.random.default_rng(1)
    runs, seen = D.Runs(max_runs=2), {}
    for n in range(9):
        keys = rng.choice(500, 60, replace=False)
        hi, lo, ids = keys // 3, keys % 3, rng.integers(0, 10_000, 60)
        novel = runs.ingest(hi, lo, ids.copy(), ids.copy())
        assert [bool(n) for n in novel] == [k not in seen for k in keys]
        for k, f in zip(keys, ids):
            low, high = seen.get(k, (f, f))
            seen[k] = min(low, f), max(high, f)
        assert len(runs.new) <= 2
        if n == 4:  # what there is becomes the persisted part
            runs = D.Runs([runs.delta()], max_runs=2)
    hi, lo, first, last = D.joined_run(runs.persisted + runs.new)
    assert {h * 3 + o: (f, z) for h, o, f, z in zip(hi, lo, first, last)} == seen
    changed = {h * 3 + o for h, o, *_ in zip(*runs.delta())}
    assert changed < set(seen) and len(D.joined_run([])[0]) == 0


def test_index_grows_by_batches(spark, tmp_path):
    rows = [(i, i % 4, i % 10, i % 10) for i in range(40)]
    keyed = spark.createDataFrame(rows, "hdr_id long, batch_no int, hi long, lo long")
    as_set = lambda index: sorted(tuple(r) for r in index.entries().collect())
    whole = D.open_index(spark, f"file://{tmp_path}/whole")
    assert as_set(whole) == []
    whole.ingest(keyed)
    steps = D.open_index(spark, f"file://{tmp_path}/steps", max_runs=2)
    for k in range(4):
        D.open_index(spark, f"file://{tmp_path}/steps", max_runs=2).ingest(keyed.where(f"batch_no = {k}"))
    assert as_set(whole) == as_set(steps) == [(k, k, k, 30 + k) for k in range(10)]
    names = [name for _, name, _ in steps.current()]
    assert names[0].startswith("merged-") and len(names) <= 2
    # what was ingested adds nothing when it comes again
    steps.ingest(keyed)
    assert as_set(whole) == as_set(steps)
    assert spark.read.schema(D.RUN_SCHEMA).parquet(f"{tmp_path}/steps/{steps._folders()[-1][1]}").count() == 0 or steps.current()[-1][1].startswith("merged")
    # a folder without success mark isn't part of the index
    (tmp_path / "steps" / "run-000099-p16").mkdir()
    assert as_set(whole) == as_set(steps)
    steps.merge()
    steps.vacuum()
    assert as_set(whole) == as_set(steps) and len(steps._folders()) == 1


def test_probes_are_whole_batches(monkeypatch):
    monkeypatch.setattr(D, "PROBED_AT_ONCE", 3)
    assert D.probes(np.array([1, 1, 2, 2, 2, 2, 3, 5, 5])) == [(0, 6), (6, 9)] and D.probes(np.array([], dtype=int)) == []
    assert D.probes(np.array([1])) == [(0, 1)]


def test_merging_splits_full_prefixes(spark, tmp_path, monkeypatch):
    index = D.open_index(spark, f"file://{tmp_path}/i")
    index.ingest(spark.createDataFrame([(i, 1, i, 0) for i in range(100)], "hdr_id long, batch_no int, hi long, lo long"))
    monkeypatch.setattr(D, "KEYS_PER_PREFIX", 5)
    index.ingest(spark.createDataFrame([(i, 2, i, 0) for i in range(100, 300)], "hdr_id long, batch_no int, hi long, lo long"))
    index.merge()
    assert index.current()[-1][2] == 64
    assert [tuple(r) for r in index.entries().orderBy("hi").collect()] == [(i, 0, i, i) for i in range(300)]
    index.ingest(spark.createDataFrame([(1000, 3, 7, 0)], "hdr_id long, batch_no int, hi long, lo long"))
    assert tuple(index.entries().where("hi = 7").first()) == (7, 0, 7, 1000)


def test_later_batches_against_a_written_index(spark, tmp_path):
    delivered = [(1, 1, "a", "f", 1, 1, None), (2, 1, "a", "g", 1, 2, None), (3, 2, "a", "f", 1, 3, None), (4, 2, "a", "f", 1, 4, None)]
    headers = [(1, "<x@y>", "s", "a"), (2, "<z@y>", "s", "a"), (3, "x@Y", "s", "a"), (4, "<new@y>", "s", "a")]
    d, h = frames(spark, delivered, headers)
    path = f"file://{tmp_path}/index"
    assert D.repeats(d.where("batch_no = 1"), h, path).count() == 0
    assert [r[0] for r in D.repeats(d.where("batch_no = 2"), h, path).collect()] == [3]
    assert [r[0] for r in D.repeats(d, h, path).collect()] == [3]
