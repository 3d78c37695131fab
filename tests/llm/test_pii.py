"""Personal values and their replacements."""

import itertools
import re
import unicodedata

import pytest
from hypothesis import given
from hypothesis import strategies as st

from mailgrain.llm import pii as P
from mailgrain.llm.surrogates import Surrogates, ending_of

NAMES = P.Names({"kaspin": 9, "arvid": 9, "vesna": 9, "zoë": 4}, {"eberhaus": 9, "mösslang": 9, "tannmoor": 9})


def found(text, page=False):
    return [(f.kind, f.value) for f in P.find((P.visible_html if page else P.visible_text)(text).text, NAMES)]


@pytest.mark.parametrize(
    "text, expected",
    [
        ("write to a.b+c@x.test.", [("email", "a.b+c@x.test")]),
        ("a [dot] b [at] x-y [dot] test", [("email", "a [dot] b [at] x-y [dot] test")]),
        ("u(at)x.test or u AT x.test", [("email", "u(at)x.test"), ("email", "u AT x.test")]),
        ("Message-ID: <1.2.x@mx.test> https://u@h.test/x", []),
        ("at +49 30 23125 656 after", [("phone", "+49 30 23125 656")]),
        ("(ext. via (415)\n555-0130) for", [("phone", "(415) 555-0130")]),
        ("030 / 23125-171, 01.99.00.84.47, 020 7946 0147", [("phone", "030 / 23125-171"), ("phone", "01.99.00.84.47"), ("phone", "020 7946 0147")]),
        ("Tel. +33 1 99 00 25 23\n135 Harrow Lane, Kelbury 06680", [("phone", "+33 1 99 00 25 23"), ("address", "135 Harrow Lane, Kelbury 06680")]),
        ("Article no. 0737 18742, Order 4500-121-10011, tracking 74307371743072, 192.0.2.7, 17.03.2024", []),
        ("number 666-88-8489 and", [("id_number", "666-88-8489")]),
        ("ID QQ 55 79 91 C", [("id_number", "QQ 55 79 91 C")]),
        ("passport no. is 00731149500, please", [("id_number", "00731149500")]),
        ("Steuer-ID 0 36 05 34 984 390 54 fehlt", [("id_number", "0 36 05 34 984 390 54")]),
        ("Ausweisnummer: C0F12M161", [("id_number", "C0F12M161")]),
        ("Küferstr. 182, D-06700 Neuwieden.", [("address", "Küferstr. 182, D-06700 Neuwieden")]),
        ("an Lindenhang 72 b\n03130 Bad Kronsee im Hof", [("address", "Lindenhang 72 b 03130 Bad Kronsee")]),
        ("to Flat 3, 173B Lanternmere St., Kelbury 07170, ID", [("address", "Flat 3, 173B Lanternmere St., Kelbury 07170")]),
        ("Ask Kaspin\n> Eberhaus now", [("name", "Kaspin Eberhaus")]),
        ("Eberhaus, Arvid; A. Eberhaus; Arvid T. Eberhaus; Vesna E. said", [("name", "Eberhaus, Arvid"), ("name", "A. Eberhaus"), ("name", "Arvid T. Eberhaus"), ("name", "Vesna E.")]),
        ("VESNA MÖSSLANG met Mr Unknownby", [("name", "VESNA MÖSSLANG"), ("name", "Unknownby")]),
        ("Hallo Zoë,\nTannmoor AG und Eberhaus & Partner", [("name", "Zoë")]),
        ("Hallo zusammen,\nHi all,\nDear colleagues,", []),
        ("", []),
    ],
)
def test_text(text, expected):
    assert found(text) == expected


def test_html():
    page = '<style>p{x:y}</style><p title="Kaspin Eberhaus">Kas<b>pin</b> M&ouml;&szlig;lang</p><td>a&#64;x.test</td><td>0</td><!-- Arvid -->+49&nbsp;30&nbsp;23125656<br>Ar&shy;vid'
    assert found(page, True) == [("name", "Kaspin Mößlang"), ("email", "a@x.test"), ("phone", "+49 30 23125656"), ("name", "Arvid")]


def test_replacement_keeps_markup():
    page = "<p>Kas<b>pin</b> Eberhaus &amp; co</p>"
    seen = P.visible_html(page)
    new = P.replaced(page, seen, P.find(seen.text, NAMES), lambda f: "[X]")
    assert new == "<p>[X]<b></b> &amp; co</p>" or new == "<p>[X]<b></b>" + " &amp; co</p>"


def test_surrogates_are_keyed_distinct_and_coreferent():
    one, two = Surrogates(b"k"), Surrogates(b"other")
    values = [("phone", f"+49 30 231256{i:02d}") for i in range(100)] + [("id_number", f"666-{i:02d}-1448") for i in range(100)]
    assert len({one.replace(*v) for v in values}) == len(values)
    assert [one.replace(*v) for v in values] != [two.replace(*v) for v in values]
    given, family = one.replace("name", "Kaspin Eberhaus").split()
    assert one.replace("name", "Eberhaus, Kaspin") == f"{family}, {given}" and one.replace("name", "KASPIN") == given.upper()
    assert one.replace("name", "K. Eberhaus") == f"{given[0]}. {family}" and one.replace("email", "kaspin.eberhaus@x.test").startswith(f"{given}.{family}@".lower())
    assert one.replace("phone", "+49 30 23125656").startswith("+49 ")
    digits = [re.sub(r"\D", "", one.replace("phone", p))[-8:] for p in ("+49 30 1234567", "0049 30 1234567", "030 1234567", "+49 (0)30 1234567")]
    assert len({d.lstrip("0") for d in digits}) == 1
    assert re.fullmatch(r"[A-Z][a-zß]+straße \d, \d{5} [A-Z][a-z]+", one.replace("address", "Hauptstraße 5, 10115 Berlin"))
    assert one.replace("email", "a.b@x.co.uk").endswith(".co.uk")
    assert not any("LATIN" in unicodedata.name(c, "") for c in one.replace("name", "Мария Иванова"))


def test_words_are_permuted():
    """No two words share a stand-in, gender endings and first letters go together."""
    s = Surrogates(b"k")
    words = ["".join(p) for n in (1, 2, 3, 4, 5) for p in itertools.product("abelrs", repeat=n)]
    new = [s.word(w) for w in words]
    assert len(set(new)) == len(words) and [len(w) for w in new] == [len(w) for w in words]
    assert all(ending_of(a) == ending_of(b) for a, b in zip(words, new, strict=True))
    assert all(len({b[0] for a, b in zip(words, new, strict=True) if a[0] == c}) == 1 for c in "abelrs")
    numbers = [f"{k:04d}" for k in range(10_000)]
    assert len({s.number(n, "phone") for n in numbers}) == 10_000


@given(st.text(min_size=1, max_size=12))
def test_any_name_keeps_its_form(text):
    new = Surrogates(b"k").replace("name", text)
    assert len(unicodedata.normalize("NFC", text)) >= 1 and isinstance(new, str)


def test_entities_of_a_mail():
    values = [("name", v) for v in ("John Smith", "J. Smith", "Smith, John", "Smith", "John", "Anna Roe", "A. Roe", "Roe")]
    finds = [P.Found(k, n, n + 1, v) for n, (k, v) in enumerate(values + [("phone", "+49 30 1234567"), ("phone", "0049 30 1234567"), ("email", "A@x.test"), ("email", "a (at) x (dot) test")])]
    keys = P.entity_keys(finds)
    assert len({keys[f] for f in finds[:5]}) == 1 and len({keys[f] for f in finds[5:8]}) == 1
    assert keys[finds[8]] == keys[finds[9]] and keys[finds[10]] == keys[finds[11]]


#: Forms that the tables don't hold: (text, kind, value).
OTHER_FORMS = [
    ("Send it to 10 Downing Street, London SW1A 2AA please", "address", "10 Downing Street, London SW1A 2AA"),
    ("at 221B Baker Street, London NW1 6XE now", "address", "221B Baker Street, London NW1 6XE"),
    ("au 12 rue de la Paix, 75002 Paris avant", "address", "12 rue de la Paix, 75002 Paris"),
    ("5 bis avenue des Ternes, 75017 Paris", "address", "5 bis avenue des Ternes, 75017 Paris"),
    ("en Calle de Alcalá 45, 28014 Madrid hoy", "address", "Calle de Alcalá 45, 28014 Madrid"),
    ("Hauptstraße 5, 10115 Berlin", "address", "Hauptstraße 5, 10115 Berlin"),
    ("1600 Amphitheatre Way, Mountain View, CA 94043", "address", "1600 Amphitheatre Way, Mountain View, CA 94043"),
    ("Call Priya Raghunathan tomorrow", "name", "Priya Raghunathan"),
    ("Please contact Tomasz Wiśniewski about it", "name", "Tomasz Wiśniewski"),
    ("Kind regards,\nIngrid Bergström", "name", "Ingrid Bergström"),
    ("Rufen Sie Yasemin Öztürk an", "name", "Yasemin Öztürk"),
    ("Dear Mr. Okonkwo, thanks", "name", "Okonkwo"),
    ("Frau Dr. Schlegelmilch kommt", "name", "Schlegelmilch"),
    ("Hello Beatriz,\nsee below", "name", "Beatriz"),
    ("ring 020 7946 0958 now", "phone", "020 7946 0958"),
    ("tel: (212) 555-0187", "phone", "(212) 555-0187"),
    ("mobile +33 6 12 34 56 78", "phone", "+33 6 12 34 56 78"),
    ("Fon 0221/1234567", "phone", "0221/1234567"),
    ("call 0800-1234567", "phone", "0800-1234567"),
    ("ask jane_doe@mail.example.org", "email", "jane_doe@mail.example.org"),
    ("jane.doe AT example DOT org", "email", "jane.doe AT example DOT org"),
    ("o'brien+x@sub.example.ie", "email", "o'brien+x@sub.example.ie"),
    ("SSN 078-05-1120", "id_number", "078-05-1120"),
    ("NI number QQ 12 34 56 C", "id_number", "QQ 12 34 56 C"),
    ("DNI 12345678Z", "id_number", "12345678Z"),
    ("passport number: L01X00T47", "id_number", "L01X00T47"),
]


def test_recall_on_other_forms():
    hits: dict[str, list[bool]] = {}
    for text, kind, value in OTHER_FORMS:
        hits.setdefault(kind, []).append((kind, value) in [(f.kind, f.value) for f in P.find(P.visible_text(text).text, P.Names())])
    shares = {kind: sum(h) / len(h) for kind, h in hits.items()}
    print("recall by kind:", shares)
    assert sum(sum(h) for h in hits.values()) >= 0.9 * len(OTHER_FORMS) and min(shares.values()) >= 0.6, shares


def test_forms_that_are_none():
    for text in ("IBAN DE89 3704 0044 0532 0130 00 bitte", "Contact Nordlicht Logistik today", "Ask Customer Service", "the North Office"):
        assert P.find(P.visible_text(text).text, P.Names(common=frozenset({"customer", "service"}))) == []


def test_frames(spark):
    heads = spark.createDataFrame([(f"Kaspin Eberhaus <k{i}@x.test>",) for i in range(5)] + [(None,)], "from_ string")
    mails = [(1, "Hallo Kaspin,\nKaspin", None), (2, None, None), (3, "", "<p>Kaspin Eberhaus</p>"), (3, "", "<p>Kaspin Eberhaus</p>"), (4, "x " * 100_000, None)]
    df = spark.createDataFrame(mails, "mail_id long, text_body string, html_body string").selectExpr("*", "'c' as kind")
    got = sorted(tuple(r) for r in P.replacements(df, heads, "k").select("mail_id", "body", "kind", "pii_value").collect())
    assert got == [(1, "text", "name", "Kaspin")] + [(3, "html", "name", "Kaspin Eberhaus")] * 2
    red = {r["mail_id"]: r for r in P.redacted(df, heads).collect()}
    assert red[1]["text_body"] == "Hallo [NAME_1],\n[NAME_1]" and red[1]["html_body"] is None and red[3]["html_body"] == "<p>[NAME_1]</p>"
    assert P.replacements(df.limit(0), heads.limit(0), "k").count() == 0
    # name parts beyond the broadcast are joined to their mails
    joined = P.replacements(df, heads, "k", lexicon_size=0).select("mail_id", "body", "kind", "pii_value").collect()
    assert sorted(tuple(r) for r in joined) == got and P.collisions(P.replacements(df, heads, "k")).count() == 0
