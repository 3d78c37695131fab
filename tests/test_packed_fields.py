"""Recipients out of packed fields."""

import math
import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from mailgrain.operators import packed_fields as P

TYPES, DIALECTS = P.code_lengths({}, P.TYPES), P.code_lengths({}, P.DIALECTS)


def cheapest(parses, types=TYPES, dialects=DIALECTS):
    """The parse with the shortest code, as the column expression chooses it."""
    order = list(P.DIALECTS)
    ways = []
    for k, (kinds, literal, _, named) in enumerate(parses):
        bits = sum(types[t] * n for t, n in kinds) + P.LITERAL_BITS * literal
        own = {d: (1 + math.log2(len(P.DIALECTS[d][0]))) * (sum(n for _, n in kinds) - 1) + dialects[d] for d in named}
        ways += [(round(bits + round(b, 9), 9), order.index(d), k) for d, b in own.items()]
    cost, at, k = min(ways)
    return order[at], parses[k]


def addresses(text):
    return cheapest(P.parses(text))[1][2]


@pytest.mark.parametrize(
    "text, expected",
    [
        ("a@x.test, B C <b@x.test>", ["a@x.test", "b@x.test"]),
        ("A@X.test;b@x.test;;c@x.test", ["a@x.test", "b@x.test", "c@x.test"]),
        ("a@x.test | b@x.test", ["a@x.test", "b@x.test"]),
        ("a@x.test/b@x.test / <c@x.test>", ["a@x.test", "b@x.test", "c@x.test"]),
        ("a@x.test\tb@x.test\n", ["a@x.test", "b@x.test"]),
        ("a@x.test,\r\n b@x.test", ["a@x.test", "b@x.test"]),
        ("a@x.test  <b@x.test> c@x.test", ["a@x.test", "b@x.test", "c@x.test"]),
        ("Last, First <a@x.test>, b@x.test", ["a@x.test", "b@x.test"]),
        ('"Last, First" <a@x.test>; "P | Q; r" <b@x.test>', ["a@x.test", "b@x.test"]),
        ("'a@x.test' <a@x.test>, 'b@x.test'", ["a@x.test", "b@x.test"]),
        ('"q,x y"@x.test, mailto:b@x.test', ['"q,x y"@x.test', "b@x.test"]),
        ("a@x.test (Last, First), N (Hall 6; North, wing) <b@x.test>", ["a@x.test", "b@x.test"]),
        ('"Desk, late": A B <a@x.test>, b@x.test;', ["a@x.test", "b@x.test"]),
        ("undisclosed-recipients:;", []),
        ('"a@x.test" <a@x.test>', ["a@x.test"]),
        ("a@x.test, a@x.test", ["a@x.test", "a@x.test"]),
        ('5" disk <a@x.test>, 3" disk <b@x.test>', ["a@x.test", "b@x.test"]),
        ('"Anna <a@x.test>" <a@x.test>, b@x.test', ["a@x.test", "b@x.test"]),
        ('12" rack; a@x.test; b@x.test', ["a@x.test", "b@x.test"]),
        ("", []),
        (" , ;", []),
    ],
)
def test_dialects(text, expected):
    assert addresses(text) == expected


def test_plain_values_read_as_by_full_scoring():
    """The shortcut for fields of one plain value changes neither type nor address, under any code lengths."""
    rng = random.Random(3)
    names, hosts = ["A", "Anna B", "x.y", "Ö. Z-9", '"B, A"', '"q; r | s"', ""], ["x.test", "a-b.c.test", "LOCAL"]
    hit = 0
    for _ in range(3000):
        local = "".join(rng.choice("abcXY0.+_-") for _ in range(rng.randrange(1, 8)))
        address = f"{local}@{rng.choice(hosts)}"
        text = rng.choice([address, f"<{address}>", f"{rng.choice(names)} <{address}>", f"mailto:{address}", f" {address}", f"{rng.choice(names)}  <{address}>"])
        plain = P.plain_value(text)
        if plain is None:
            continue
        hit += 1
        types = P.code_lengths({t: rng.randrange(1000) for t in P.TYPES}, P.TYPES)
        dialects = P.code_lengths({d: rng.randrange(1000) for d in P.DIALECTS}, P.DIALECTS)
        for lengths in ((TYPES, DIALECTS), (types, dialects)):
            kinds, _, found, _ = cheapest(P.all_parses(text), *lengths)[1]
            assert found == [plain[1]] and (kinds == ((plain[0], 1),) or lengths[0] is types)
    assert hit > 1500


@settings(max_examples=3000, deadline=None)
@given(st.text(alphabet="mmaaeswwwdDcoqA,,;|/ \t\nB", max_size=14), st.sampled_from(sorted(P.SEPARATORS.values())))
def test_stretches_parse_as_tokens(shape, separators):
    shape = re.sub(r"[ \t\nB]{2,}", " ", shape)  # white space is one token
    assert P.parse(shape, separators) == P.parse_by_token(shape, separators)
    if " " in separators and not P._blank_splits(separators.strip(" ")).search(shape):
        assert P.parse(shape, separators) == P.parse(shape, separators.strip(" ") or "\x00")


def test_choice_as_by_brute_force(spark):
    """Counting and choice by expressions equal counting and choice in Python."""
    fields = ["a@x.test, b@x.test", "a@x.test;b@x.test, c@x.test", '"L, F" <a@x.test> | b@x.test', "L, F <a@x.test>, b@x.test", 'x" <a@x.test>, 3" <b@x.test>', "a@x.test", "g: a@x.test, b@x.test;", "a@x.test b@x.test", '"a\x1d\x1cb\x1e"@x.test, c@x.test, "\x1f,\x1c1"@x.test']
    df = spark.createDataFrame([(k, t) for k, t in enumerate(fields * 3)], "id long, v string")
    parsed = P.parsed_fields(df, "v", ["id"])
    types, dialects = P.learn_codes(parsed)
    seen, used = {}, {}
    for t in fields * 3:
        d, (kinds, *_) = cheapest(P.parses(t))
        for kind, n in kinds:
            seen[kind] = seen.get(kind, 0) + n
        if sum(n for _, n in kinds) > 1:
            used[d] = used.get(d, 0) + 1
    assert types == P.code_lengths(seen, P.TYPES) and dialects == P.code_lengths(used, P.DIALECTS)
    got = {(r["id"], r["pos"]): (r["addr"], r["dialect"]) for r in P.split_packed(df, "v", ["id"]).collect()}
    want = {}
    for k, t in enumerate(fields * 3):
        d, (_, _, found, _) = cheapest(P.parses(t), types, dialects)
        want |= {(k, n): (a, d) for n, a in enumerate(found, 1)}
    assert got == want


def test_rows_positions_nulls_and_repeats(spark):
    rows = [
        (1, "a@x.test, b@x.test", None, "", "extra"), (1, "a@x.test, b@x.test", None, "", "extra"), (2, None, "one@x.test", " ", None), (3, ", ".join(f"u{i}@x.test" for i in range(3000)), None, None, None),
    ]
    df = spark.createDataFrame(rows, "hdr_id long, to_ string, cc string, bcc string, addr string")
    got = P.recipients(df, 2)
    assert got.columns == ["hdr_id", "fld", "pos", "addr", "dialect"]
    out = [tuple(r) for r in got.select("hdr_id", "fld", "pos", "addr").collect()]
    assert sorted(x for x in out if x[0] == 1) == [(1, "to", 1, "a@x.test")] * 2 + [(1, "to", 2, "b@x.test")] * 2
    assert not [x for x in out if x[0] == 2]
    assert [x[2] for x in sorted(x for x in out if x[0] == 3)] == list(range(1, 3001))
    assert P.recipients(df, 1).where("hdr_id = 2").count() == 1


def test_empty_table(spark):
    df = spark.createDataFrame([], "hdr_id long, to_ string, cc string, bcc string")
    assert P.recipients(df).count() == 0
