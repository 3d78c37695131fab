"""Consistent forms and garbled text."""

import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from mailgrain.llm import confusables as C
from mailgrain.llm import mojibake as M


@pytest.mark.parametrize(
    "text, normal, kinds",
    [
        ("Ｋｉｔｃｈｅｎ－２", "Kitchen-2", {"width", "hyphen"}),
        ("Cloture été", "Cloture été", {"accent"}),
        ("Be​st­", "Best", {"invisible"}),
        ("a b c", "a b c", {"blank"}),
        ("list‑9", "list-9", {"hyphen"}),
        ("Κіtсhen", "Kitchen", {"script"}),
        ("oﬃce K", "office K", {"width"}),
        ("Встреча “x” – … ½ € 🎉", "Встреча “x” – … ½ € 🎉", set()),
        ("👩‍💻", "👩‍💻", set()),
        ("", "", set()),
    ],
)
def test_forms(text, normal, kinds):
    assert C.transduce(text) == (normal, frozenset(kinds))


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=40))
def test_normal_form_is_stable(text):
    once = C.normal_form(text)
    assert C.normal_form(once) == once


def test_lookalikes_are_stable_and_agree():
    """In a word with Latin letters a look-alike gives what the letter itself gives, and twice changes nothing."""
    for key, out in C.lookalike_map().items():
        once = C.normal_form(f"x{key}y")
        assert once == C.normal_form(f"x{out}y") == C.normal_form(once) == f"x{out}y"
        assert C.normal_form(key) == key


def test_normalise_rows(spark):
    rows = [(1, None, "k"), (2, "Ａ", "k"), (2, "Ａ", "k"), (3, "x" * 200_000 + " ", None)]
    out = C.normalise(spark.createDataFrame(rows, "id long, v string, kinds string"), "v", ["id"])
    got = sorted((r["id"], (r["normal"] or "")[-1:], tuple(r["kinds"])) for r in out.collect())
    assert got == [(1, "", ()), (2, "A", ("width",)), (2, "A", ("width",)), (3, " ", ("blank",))]
    assert C.normalise(spark.createDataFrame([], "id long, v string"), "v", ["id"]).count() == 0


CLEAN = ["Größere Prüfung für die Küche", "Übersicht der Rückfrage fällig", "Réunion décalée à vendredi", "Счёт на оплату", "SÃO PÁGINAS", "Â margem do relatório", "IRMÃ E IRMÃO", "garantía revisión"]


def wrong(text, write, read):
    return text.encode(write).decode(read)


def test_restore(spark):
    garbled = [
        ("Größere Prüfung", wrong("Größere Prüfung", "utf-8", "cp1252")), ("für die Küche", wrong("für die Küche", "utf-8", "mac_roman")),
        ("Rückfrage fällig", wrong(wrong("Rückfrage fällig", "utf-8", "cp1252"), "utf-8", "cp1252")), ("Счёт на оплату", wrong("Счёт на оплату", "cp1251", "cp1252")),
        ("Réunion décalée", wrong("Réunion décalée", "cp1252", "cp437")),
    ]
    rows = [(i, t) for i, t in enumerate(CLEAN * 60)] + [(10_000 + i, g) for i, (_, g) in enumerate(garbled)] + [(20_000, None), (20_001, ""), (20_002, "Pr�fung"), (20_003, "a" * 300_000)]
    out = {r["id"]: r for r in M.restored(spark.createDataFrame(rows, "id long, v string"), "v", ["id"]).collect()}
    assert not [i for i in range(len(CLEAN) * 60) if out[i]["garbled"]]
    for i, (original, _) in enumerate(garbled):
        assert out[10_000 + i]["garbled"] and out[10_000 + i]["original"] == original
    assert 20_000 not in out and not out[20_001]["garbled"] and not out[20_003]["garbled"]
    assert out[20_002]["garbled"] and out[20_002]["operations"] == "lost"
    assert M.restored(spark.createDataFrame([], "id long, v string"), "v", ["id"]).count() == 0


def small_model(*more):
    pairs = {}
    for t in " ".join([*CLEAN, *more]).split(" "):
        for a, b in zip("\x02" + t.lower(), t.lower() + "\x03"):
            pairs[a + b] = pairs.get(a + b, 0) + 1
    return M.Plausibility(pairs)


def exhaustive(token, model, depth=2):
    """Cheapest text within ``depth`` encode and decode steps, all of them tried."""
    best, level = (model.cost(token), token), {token: (0.0, 0)}
    for _ in range(depth):
        after = {}
        for text, (price, others) in level.items():
            for read in M.READ_AS:
                data = M.encode(text, read)
                for to in M.WRITTEN_IN if data is not None and read else ():
                    new = None if to == read else M.decode(data, to)
                    if new:
                        k = others + (to != "utf-8")
                        cost = price + (M.UTF8_BITS if to == "utf-8" else M.STEP_BITS * k)
                        after[new] = min(after.get(new, (cost, k)), (cost, k))
                        best = min(best, (model.cost(new) + cost, new))
        level = after
    return best


@pytest.mark.parametrize("text", ["Küche", "fällig", "Réunion", "décalée"])
@pytest.mark.parametrize("steps", [(("utf-8", "cp1252"),), (("cp1252", "cp437"),), (("utf-8", "cp1252"), ("utf-8", "mac_roman")), (("utf-8", "cp437"), ("utf-8", "cp1252"))])
def test_search_is_the_cheapest(text, steps):
    model = small_model()
    bad = M.garble(text, steps)
    got, path, gain = M.search(bad, model)
    cost, _ = exhaustive(bad, model)
    assert model.cost(bad) - gain <= cost + 1e-9 and got == text


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="abcüéÃ©¼Â¤ñ", min_size=1, max_size=6))
def test_bound_is_below_all_reached(token):
    model = small_model()
    cost, _ = exhaustive(token, model, 1)
    assert model.bound(token) <= cost + 1e-9


def test_lost_no_break_space():
    restorer = M.Restorer(small_model("à la carte à jour", "à demain"))
    assert restorer.restore(wrong("IRMÃ à margem", "utf-8", "cp1252").replace("\u00a0", " "))[1].replace("\u00a0", " ").endswith("à margem")


def test_accuracy(spark):
    rows = [(t,) for t in CLEAN * 20] + [(None,), ("",), ("plain",)]
    got = {r["misreading"]: r for r in M.restoration_accuracy(spark.createDataFrame(rows, "v string"), "v").collect()}
    assert set(got) <= set(M.MISREADINGS) and got["utf-8 as cp1252"]["restored"] >= 0.9 * got["utf-8 as cp1252"]["words"]


def test_model_is_bounded():
    assert len({M.sign_of(chr(c)) for c in range(0x110000) if not 0xD800 <= c < 0xE000}) <= 3072 + 256 + 17


def test_codecs_round_trip():
    for name in M.READ_AS:
        for b in range(256):
            c = next(k for k, v in M._byte_of(name).items() if v == b)
            assert M.encode(c, name) == bytes([b])
    assert M.encode("Ж", "cp1252") is None


def test_deviating_leaves_garbled_out(spark):
    h = spark.createDataFrame([(i, t, "A B <a@b.test>") for i, t in enumerate(CLEAN * 60)] + [(9001, wrong("garantía revisión", "utf-8", "cp1252"), None), (9002, "a b", None)], "hdr_id long, subject string, from_ string")
    a = spark.createDataFrame([(1, unicodedata.normalize("NFD", "Réunion.pdf")), (2, None)], "part_id long, filename string")
    assert {(r["fld"], r["row_id"]) for r in M.deviating_headers(h, a).collect()} == {("subject", 9002), ("filename", 1)}
