"""Leakage, mixing and truncation."""

import random

import numpy as np
import pytest

from mailgrain.llm import leakage as L
from mailgrain.llm import mixing as X
from mailgrain.llm import truncation as T

RNG = random.Random(5)
WORDS = ["".join(RNG.choice("abcdefghij") for _ in range(5)) for _ in range(400)]


def sentence(n, rng):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def test_leaks_against_brute_force(spark):
    rng = random.Random(7)
    items = [(i, sentence(40, rng) + ("\n\nlegal footer " + sentence(20, rng) if i % 3 == 0 else "")) for i in range(20)] + [(90, None), (91, "too short"), (92, "")]
    docs, truth = [], set()
    for d in range(300):
        text = sentence(60, rng)
        if d % 4 == 0:
            i, n = rng.randrange(20), rng.choice([12, 13, 14, 30])
            w = L.item_words(items[i][1])
            s = rng.randrange(len(w) - n)
            text += "\n> *" + " ".join(x.upper() if rng.random() < 0.2 else x for x in w[s : s + n]).replace(" ", " \n> ", 2) + "*, " + sentence(9, rng)
            if n >= 13:
                truth.add((d, i))
        docs.append((d, text))
    docs += [(900, None), (901, ""), (902, sentence(30_000, rng)), (0, docs[0][1])]
    found = L.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), rank=64)
    got = [(r["doc_id"], r["item_id"]) for r in found.where("kind = 'verbatim'").collect()]
    assert set(got) == truth and len(got) == len(truth) + ((0, next(i for d, i in truth if d == 0)) in got if any(d == 0 for d, _ in truth) else 0)


def test_blocks_of_items_agree(spark):
    """The verbatim pairs don't depend on how items are cut into blocks."""
    rng = random.Random(8)
    items = [(i, sentence(30, rng)) for i in range(12)]
    docs = [(d, sentence(30, rng) + " " + (items[d % 12][1] if d % 3 == 0 else "") + " " + sentence(10, rng)) for d in range(90)]
    frames = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    pairs = [sorted((r["doc_id"], r["item_id"]) for r in L.leaks(*frames, rank=32, item_block=n).where("kind = 'verbatim'").collect()) for n in (100, 5)]
    assert pairs[0] == pairs[1] == [(d, d % 12) for d in range(0, 90, 3)]


def test_paraphrases(spark):
    """Items retold with other common words and another order, no run of thirteen kept: at least nine in ten are found, and nothing else."""
    rng = random.Random(21)
    common, rare = WORDS[:60], WORDS[60:]
    text = lambda n: " ".join(rng.choice(common if rng.random() < 0.6 else rare) for _ in range(n))
    items = [(i, text(60)) for i in range(40)]

    def retold(item):
        out = []
        w = item.split()
        for at in range(0, len(w), 8):
            part = w[at : at + 8]
            k = next((k for k, x in enumerate(part) if x in common), 0)
            part[k] = rng.choice(common)
            if rng.random() < 0.4 and len(part) > 3:
                part[-1], part[-2] = part[-2], part[-1]
            out += part
        return " ".join(out)

    docs, truth = [], set()
    for d in range(240):
        i = d % 40
        body = retold(items[i][1]) if d % 2 else text(60)
        docs.append((d, f"{text(40)} {body} {text(20)}"))
        w, ids = L.words(docs[-1][1]), L.item_words(items[i][1])
        if d % 2 and not {tuple(w[k : k + 13]) for k in range(len(w) - 12)} & {tuple(ids[k : k + 13]) for k in range(len(ids) - 12)}:
            truth.add((d, i))
    found = L.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    got = {(r["doc_id"], r["item_id"]) for r in found if r["kind"] == "paraphrase"}
    print("paraphrases:", len(truth), "found:", len(got & truth), "others:", len(got - truth))
    assert len(truth) > 60 and len(got & truth) >= 0.9 * len(truth) and len(got - truth) <= 0.02 * len(truth)
    assert all(r["run"] == 0 for r in found if r["kind"] == "paraphrase")


def test_leaks_of_empty_tables(spark):
    docs, items = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    assert L.leaks(docs, items).count() == 0
    assert L.leaks(docs, spark.createDataFrame([(1, sentence(30, RNG))], "item_id long, text string")).count() == 0


def test_windows_cover_every_run():
    for n in range(13, 90):
        for width, step in ((L.DOC_WINDOW, L.DOC_STEP), (L.ITEM_WINDOW, L.ITEM_STEP)):
            spans = L.windows(n, width, step)
            assert all(any(a <= s and s + 13 <= b for a, b in spans) for s in range(n - 12))


def test_sequences():
    rng = random.Random(2)
    for _ in range(50):
        a, b = [rng.randrange(5) for _ in range(20)], [rng.randrange(5) for _ in range(15)]
        table = np.zeros((21, 16), int)
        runs = np.zeros((21, 16), int)
        for i in range(20):
            for j in range(15):
                table[i + 1, j + 1] = table[i, j] + 1 if a[i] == b[j] else max(table[i, j + 1], table[i + 1, j])
                runs[i + 1, j + 1] = runs[i, j] + 1 if a[i] == b[j] else 0
        assert L.common_subsequence(a, b) == table[-1, -1]
    for _ in range(200):
        a, b = [rng.randrange(2) for _ in range(60)], [rng.randrange(2) for _ in range(50)]
        longest = max(n for n in range(51) if any(a[i : i + n] == b[j : j + n] for i in range(61 - n) for j in range(51 - n)))
        assert L.longest_run(a, b, L.word_runs(a), L.word_runs(b)) == (longest if longest >= L.RUN else 0)


def test_flight_keeps_both_sums():
    rng = np.random.default_rng(4)
    for n in (0, 1, 2, 5, 500):
        tokens, chance = rng.integers(1, 900, n), np.full(n, 0.37)
        p = X.fly(tokens, chance, rng)
        assert abs(p.sum() - chance.sum()) < 1e-6 and abs((p * tokens).sum() - (chance * tokens).sum()) < 1e-3
        assert ((p > 0) & (p < 1)).sum() <= 2
        assert set(np.unique(X.land(tokens, p, rng))) <= {0.0, 1.0}


def test_flight_is_unbiased():
    tokens, chance = np.arange(1, 13), np.full(12, 0.25)
    mean = np.mean([X.land(tokens, X.fly(tokens, chance, r), r) for r in (np.random.default_rng(s) for s in range(3000))], axis=0)
    assert np.abs(mean - 0.25).max() < 0.04


def test_mix(spark, monkeypatch):
    monkeypatch.setattr(X, "BLOCK_UNITS", 50)
    rng = random.Random(1)
    docs = [(i, "big" if i % 3 else "small" if i % 2 else "tiny", sentence(rng.randrange(1, 40), rng)) for i in range(900)] + [(1000, None, "x"), (1001, "big", None), (1002, "big", ""), (1003, "none", "x y")]
    targets = [("big", 0.5, 1), ("small", 0.3, 3), ("tiny", 0.2, 2), ("absent", 0.0, 1)]
    t = spark.createDataFrame(targets, "source string, target_share double, max_repeats int")
    report = {r["source"]: r for r in X.mix_report(spark.createDataFrame(docs, "doc_id long, source string, text string"), t).collect()}
    for source, share, cap in targets[:3]:
        assert abs(report[source]["share"] - share) < 0.02 and report[source]["most_copies"] <= cap
    assert report["absent"]["tokens"] == 0
    empty = spark.createDataFrame([], "doc_id long, source string, text string")
    assert X.mixed(empty, t).count() == 0


def test_truncation(spark):
    rng = random.Random(9)
    subjects, verbs = ["The team", "Our office", "Somebody", "A courier"], ["moved", "printed", "signed", "lost"]
    line = lambda: f"{rng.choice(subjects)} {rng.choice(verbs)} the {rng.choice(WORDS)} of {rng.choice(WORDS)} number {rng.randrange(99)}."
    closings = ["Kind regards", "Best wishes", "PS: see you", "- first item", "let me think...", "https://x.example/d/7"]
    docs, truth = [], set()
    for i in range(900):
        text = " ".join(line() for _ in range(rng.randrange(3, 9)))
        kind = i % 9
        if kind < 4:
            text += "\n\n" + rng.choice(closings)
        elif kind == 4:
            cut = text[:120] if len(text) > 120 else text
            if len(text) > 120 and cut.rstrip()[-1] != ".":
                text = cut
                truth.add(i)
        elif kind == 5:
            text = text[:-9] + rng.choice(["…", " [...]", "�", "=C3"])
            truth.add(i)
        docs.append((i, "fixed" if kind == 4 else "free" if kind != 8 else None, text))
    docs += [(2000, "free", None), (2001, "free", " "), (2002, "free", "x y. " * 50_000)]
    df = spark.createDataFrame(docs, "doc_id long, source string, text string").selectExpr("*", "0 as chars")
    got = {r["doc_id"]: r for r in T.truncated(df).collect()}
    assert {i for i, r in got.items() if r["cut"]} == truth
    assert any(got[i]["at_limit"] for i in truth if i % 9 == 4)
    report = {r["source"]: r for r in T.truncation_report(df).collect()}
    assert report["fixed"]["cut"] == len([i for i in truth if i % 9 == 4]) and None in report
    assert T.truncated(df.limit(0)).count() == 0


def test_hazards_decide(spark):
    """Endings nobody knows are cut at a significant length and complete elsewhere."""
    rng = random.Random(4)
    odd = lambda n: "".join(rng.choice("qwxzjkv") for _ in range(n))
    docs = []
    for i in range(600):
        text = " ".join(f"The {rng.choice(WORDS)} is on page {rng.randrange(99)}." for _ in range(rng.randrange(2, 6)))
        if i % 3 == 0:
            docs.append((i, "capped", text + "\n" + odd(200 - len(text) - 1)))
        elif i % 3 == 1:
            docs.append((i, "capped", text))
        else:
            docs.append((i, "open", text + "\n" + odd(rng.randrange(5, 90))))
    df = spark.createDataFrame(docs, "doc_id long, source string, text string")
    got = {r["doc_id"]: r for r in T.truncated(df).collect()}
    assert {r["reason"] for i, r in got.items() if i % 3 == 0} == {"limit"}
    assert {r["reason"] for i, r in got.items() if i % 3} == {None}
    limits = {(r["source"], r["measure"], r["length"]) for r in T.length_limits(T.endings(df)).where("limit").collect()}
    assert {("capped", "chars", 200), ("capped", "bytes", 200)} <= limits and "open" not in {source for source, _, _ in limits}


def test_evidence_of_transfer():
    known = T.Evidence({"\nBest wishes": 0.9, "- item": 0.8}, {"We moved": (50, 49, 0), "\nBest": (40, 0, 0), "\nAnna": (9, 0, 9)}, {"questionnaire": 30, "the": 90})
    assert known.reason("We moved the", False, False) == "transfer"
    assert known.reason("x questio", False, False) == "transfer"
    assert known.reason("\nBest", False, False) == "transfer"
    assert known.reason("any text=C3", False, False) == "transfer"
    assert known.reason("\nBest wishes", False, False) is None and known.reason("\nBest wishes", False, True) is None
    assert known.reason("\nAnna", False, False) is None and known.reason("\nAnna", False, True) == "limit"
    assert known.reason("We moved the table.", True, True) is None


def test_upper_tail():
    assert T.upper_tail(0, 10, 0.1) == 1.0
    assert T.upper_tail(3, 1000, 0.001) == pytest.approx(0.0803, abs=1e-3)
    assert 0 < T.upper_tail(60, 1000, 0.001) < 1e-60


def test_token_counts(spark):
    docs = spark.createDataFrame([(1, "s", "hello world"), (2, "s", ""), (3, "s", "<|endoftext|>")], "doc_id long, source string, text string")
    sizes = {r["doc_id"]: r["tokens"] for r in X.token_sizes(docs).collect()}
    assert sizes[1] == 2 and sizes[2] == 0 and sizes[3] > 1
