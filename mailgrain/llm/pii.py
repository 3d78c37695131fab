"""Personal information inside free text: detection and keyed surrogate generation.

A body is first read as a reader sees it (markup dropped, references resolved,
quote marks removed) with a map back to the source.  Entities are found by form
and by what stands before them; person names by a lexicon of given and family
names counted over the sender fields of the whole archive, by titles and
greetings, and, where no sender bears the name, by a score of what surrounds it.
Every entity then gets a stand-in: a typed placeholder with one number for each
entity of a mail, or a keyed surrogate (see ``surrogates``).
"""

from __future__ import annotations

import bisect
import html
import re
import unicodedata
from collections import ChainMap
from collections.abc import Iterator, Mapping
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailgrain.llm.surrogates import Surrogates, canonical
from mailgrain.runtime import materialise, spread

KINDS = ("email", "phone", "id_number", "address", "name")
#: Stands between blocks of text that no entity may span; not white space for patterns.
BREAK = "\ue000"
#: Name parts that are broadcast (the others are joined to the mails that hold them), and the least number of senders that bear one.
LEXICON_SIZE, LEXICON_LEAST = 200_000, 2
#: Share of all words of the bodies from which a word is too common for a name; bounds their number to 1 / rate.
COMMON_RATE = 1e-4
#: Points from which two capitalised words are a name no sender bears.
NAME_POINTS = 4

_TAGS = re.compile(
    r"<!--.*?-->|<(?P<skip>style|script|title|template)\b[^>]*>.*?</(?P=skip)\s*>|<(?P<tag>/?[a-zA-Z][\w:-]*)[^>]*>|<![^>]*>"
    r"|&(?:#\d+|#[xX][0-9a-fA-F]+|[A-Za-z]\w*);?",
    re.DOTALL,
)
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data dfn em font i ins kbd mark q s samp small span strong sub sup time tt u var wbr".split())
_UNSEEN = re.compile("[\u00ad\u200b-\u200d\u2060\ufeff]")
_QUOTE = re.compile(r"^(?:[ \t]*>)+[ \t]?", re.MULTILINE)


class Visible:
    """Text as a reader sees it, with the source span of every visible stretch."""

    def __init__(self) -> None:
        self.parts: list[str] = []
        self.starts: list[int] = []
        self.spans: list[tuple[int, int]] = []
        self.length = 0

    def add(self, text: str, start: int, end: int) -> None:
        if text:
            self.parts.append(text)
            self.starts.append(self.length)
            self.spans.append((start, end))
            self.length += len(text)

    @property
    def text(self) -> str:
        return "".join(self.parts)

    def source(self, begin: int, end: int) -> list[tuple[int, int]]:
        """Source spans of the visible stretch, in order."""
        out = []
        k = bisect.bisect_right(self.starts, begin) - 1
        while k < len(self.parts) and self.starts[k] < end:
            low, high = self.spans[k]
            size = len(self.parts[k])
            if high - low == size:
                a, b = max(begin, self.starts[k]), min(end, self.starts[k] + size)
                out.append((low + a - self.starts[k], low + b - self.starts[k]))
            elif high > low:
                out.append((low, high))
            k += 1
        return out


def _plain_run(seen: Visible, text: str, base: int) -> None:
    at = 0
    for m in _UNSEEN.finditer(text):
        seen.add(text[at : m.start()], base + at, base + m.start())
        at = m.end()
    seen.add(text[at:], base + at, base + len(text))


def visible_text(body: str) -> Visible:
    """Plain body without quote marks; blank lines become breaks."""
    seen = Visible()
    at = 0
    for m in re.finditer(r"(?:^(?:[ \t]*>)+[ \t]?)|(?:(?<=\n)[ \t>]*\r?\n)", body, re.MULTILINE):
        _plain_run(seen, body[at : m.start()], at)
        if "\n" in m.group():
            seen.add(BREAK, m.start(), m.start())
        at = m.end()
    _plain_run(seen, body[at:], at)
    return seen


def visible_html(body: str) -> Visible:
    """HTML body without markup, style sheets, comments and attributes; blocks are kept apart."""
    seen = Visible()
    at = 0
    for m in _TAGS.finditer(body):
        _plain_run(seen, body[at : m.start()], at)
        at = m.end()
        if body[m.start()] == "&":
            char = html.unescape(m.group())
            if not _UNSEEN.fullmatch(char):
                seen.add(char, m.start(), m.end())
        elif m.group("tag"):
            tag = m.group("tag").lower().lstrip("/")
            if tag == "br":
                seen.add("\n", m.start(), m.start())
            elif tag not in _INLINE:
                seen.add(BREAK, m.start(), m.start())
    _plain_run(seen, body[at:], at)
    return seen


@dataclass(frozen=True)
class Found:
    """An entity in visible text."""

    kind: str
    begin: int
    end: int
    value: str


@dataclass
class Names:
    """Lexicon of case-folded given and family names with their counts, and the common words of the bodies."""

    given: Mapping[str, int] = field(default_factory=dict)
    family: Mapping[str, int] = field(default_factory=dict)
    common: frozenset[str] = frozenset()


_AT = r"(?:@|\s?[\[({]\s?(?:at|AT)\s?[\])}]\s?|\sAT\s|\sat\s(?=[A-Za-z][\w-]*\s?[\[({]?\s?dot\b))"
_DOT = r"(?:\.|\s?[\[({]\s?(?:dot|DOT)\s?[\])}]\s?|\s(?:DOT|dot)\s)"
_EMAIL = re.compile(rf"(?<![\w.+-])(?:mailto:)?(?P<v>\"[^\"\n]+\"{_AT}[\w-]+(?:{_DOT}[\w-]+)*{_DOT}[A-Za-z]{{2,}}|[\w+-]+(?:{_DOT}[\w+-]+)*{_AT}[\w-]+(?:{_DOT}[\w-]+)*{_DOT}[A-Za-z]{{2,}})(?![\w-])")
_LINK = re.compile(r"\b(?:https?|ftp|cid|mid)://?[^\s<>\"\ue000]+|\bwww\.[^\s<>\"\ue000]+")
_MESSAGE_ID = re.compile(r"(?:Message-ID|Message-Id|In-Reply-To|References|Nachrichten-ID)\s*:?\s*(?:<[^<>\s]+>\s*)+", re.IGNORECASE)

_ID_FORMS = [
    re.compile(r"(?<![\w-])[A-Z]{2}\s?\d{2}\s?\d{2}\s?\d{2}\s?[A-D](?![\w-])"),  # British insurance
    re.compile(r"(?<![\w-])\d{3}([- ]|\s)\d{2}\1\d{4}(?![\w-])"),  # US social security
    re.compile(r"(?<![\w-])\d{3}[-\s]\d{2}[-\s]\d{4}(?![\w-])"),
    re.compile(r"(?<![\w.-])\d{8}-?[A-HJ-NP-TV-Z](?![\w-])"),  # Spanish identity number
    re.compile(r"(?<![\w-])\d{2}\s?\d{6}\s?[A-Z]\s?\d{3}(?![\w-])"),  # German pension insurance
    re.compile(r"(?<![\w-])\d{2}\s\d{3}\s\d{3}\s\d{3}(?![\w-])"),  # German tax
    re.compile(r"(?<![\w-])\d\s\d{2}\s\d{2}\s(?:\d{2}|2[AB])\s\d{3}\s\d{3}(?:\s\d{2})?(?![\w-])"),  # French insurance
    re.compile(r"(?<![\w-])[CFGHJKLMNPRTVWXYZ](?=\d*[CFGHJKLMNPRTVWXYZ])[0-9CFGHJKLMNPRTVWXYZ]{8}(?![\w-])"),  # German card
]
_ID_LABEL = re.compile(
    r"(?:passport|ausweis|pass|identity|identit[äy]\w*|steuer|tax|social security|sozialversicherung|versicherung|rentenversicherung|insurance|national)"
    r"[\w .\-/]{0,22}?(?:no\.?|nr\.?|number|nummer|id)?\s*(?:is|lautet|ist|:|=|#)?\s*(?P<v>(?=[A-Z0-9 ]*\d[A-Z0-9 ]*\d)[A-Z0-9](?:[A-Z0-9]|[ \u00a0\n-](?=[A-Z0-9]*\d)){5,18}[A-Z0-9])(?![\w-])"
    r"|(?:,\s*(?:ID|Nr\.|No\.)\s+)(?P<w>(?=[A-Z0-9 ]*\d[A-Z0-9 ]*\d)[A-Z0-9](?:[A-Z0-9]|[ \u00a0\n-](?=[A-Z0-9]*\d)){5,18}[A-Z0-9])(?![\w-])",
)
_ELEVEN = re.compile(r"(?<![\w.+/-])00\d{9}(?![\w-])")

_IBAN = re.compile(r"(?<![\w-])[A-Z]{2}\d{2}(?:\s?[A-Z0-9]{4}){2,7}(?:\s?[A-Z0-9]{1,3})?(?![\w-])")
_NOT_PHONE = re.compile(
    r"(?:article|artikel\w*|order|auftrag|invoice|rechnung|tracking|sendungsnummer|parcel|code|version|ticket|vorgang|page|seite|relay|server|id=|ref\.?)[^\d\n\ue000]{0,14}$",
    re.IGNORECASE,
)
_PHONE_LABEL = re.compile(r"(?:\b(?:tel|telefon|phone|fon|mobil|mobile|cell|fax|call|t|m|p)\b\.?\s?:?\s?)$", re.IGNORECASE)


def _phones(sep: str) -> re.Pattern:
    s = rf"[{sep}]"
    return re.compile(
        r"(?<![\w.+/=-])(?:"
        rf"\+\d{{1,3}}(?:{s}?\(0\))?(?:{s}{{0,3}}\(?\d+\)?){{1,6}}"
        rf"|00[1-9]\d{s}(?:\(0\){s}?)?\d+(?:{s}{{1,3}}\d+){{0,5}}|00[1-9]\d{{9,12}}"
        rf"|\(0?\d{{2,5}}\)(?:{s}{{1,3}}\d+){{1,4}}"
        rf"|0\d{{2,4}}{s}?/{s}?\d+(?:{s}\d+){{0,3}}"
        rf"|0\d(?:[.{sep}]\d{{2}}){{4}}"
        rf"|0\d{{2,4}}{s}\d{{3,4}}{s}\d{{3,4}}|0\d{{4}}{s}\d{{6}}|0\d{{2,4}}-\d{{4,8}}(?:-\d+)?"
        rf"|\d{{3}}[.{sep}]\d{{3}}[.{sep}]\d{{4}}"
        r")(?![\w-]|\.\d)"
    )


_PHONE, _PHONE_WRAPPED = _phones(r" \u00a0/-"), _phones(r"\s/-")
_PHONE_START = re.compile(r"(?<![\w.+/=-])[+(0-9]")

_STREET_DE = r"[A-ZÄÖÜ][\w’'-]*(?:straße|strasse|str\.|weg|platz|gasse|hang|grund|allee|ring|ufer|damm|steig|markt|wall|chaussee|pfad|stieg|winkel|hof)"
_TOWN = r"(?:(?:Bad|Klein|Groß|Gross|Alt|Neu|Sankt|St\.|Ober|Unter|Little|Great|Upper|Lower|Port|North|South|East|West|New|Old|Market)\s)?[A-ZÄÖÜ][\w’'-]+(?:\s(?:am|an\sder|ob\sder|bei|upon|on\sthe)\s[A-ZÄÖÜ][\w’'-]+)?"
_UNIT = r"(?:Flat|Apt\.?|Apartment|Unit|Suite|Room)"
_STREET_EN = r"(?:Street|St\.?|Road|Rd\.?|Lane|Ln\.?|Avenue|Ave\.?|Drive|Dr\.?|Court|Ct\.?|Way|Place|Square|Close|Terrace|Boulevard|Blvd\.?)"
_STREET_FR = r"(?:[Rr]ue|[Aa]venue|[Bb]oulevard|[Pp]lace|[Cc]hemin|[Aa]llée|[Ii]mpasse|[Qq]uai|[Cc]ours|[Rr]oute)"
_STREET_ES = r"(?:Calle|C/|Avenida|Avda\.|Plaza|Paseo|Camino)"
_ADDRESS = [
    re.compile(rf"(?<![\w-]){_STREET_DE}\s\d+(?:\s?[a-zA-Z](?![\w]))?(?:\s?,\s?|\sin\s|\s)(?:D-)?\d{{5}}\s{_TOWN}"),
    re.compile(rf"(?<![\w-])(?:{_UNIT}\s\w+,?\s)?\d+[A-Za-z]?\s(?:[A-Z][\w’'-]*\s){{1,4}}?{_STREET_EN},?\s{_TOWN},?\s[A-Z]{{1,2}}\d[A-Z\d]?\s?\d[A-Z]{{2}}(?!\w)"),
    re.compile(rf"(?<![\w-])\d+(?:\s?(?:bis|ter))?,?\s{_STREET_FR}\s(?:d[eu]s?\s(?:l[ae]s?\s|l[’'])?|d[’'])?(?:[A-ZÀ-Ý][\w’'-]*\s?){{1,4}}?,?\s\d{{5}}\s{_TOWN}"),
    re.compile(rf"(?<![\w-]){_STREET_ES}\s(?:de\s(?:la|los|las|el)\s|del?\s)?(?:[A-ZÀ-Ý][\w’'-]*,?\s){{1,4}}?\d+,?\s\d{{5}}\s{_TOWN}"),
    re.compile(
        rf"(?<![\w-])(?:{_UNIT}\s\w+,?\s)?\d+[A-Za-z]?\s(?:[A-Z][\w’'-]*\s){{1,4}}?{_STREET_EN},?\s{_TOWN},?\s(?:[A-Z]{{2}}\s)?\d{{5}}(?!\d)"
    ),
]

_TOKEN = re.compile(r"[^\W\d_]+(?:[-’'][^\W\d_]+)*")
_TITLE = re.compile(r"(?:\b(?:Herrn?|Frau|Mrs?|Ms|Miss|Dr|Prof|Mme|M|Sr|Sra|Señora?|Madame|Monsieur)\b\.?\s(?:(?:Dr|Prof)\.\s)?)$")
_GREETING = re.compile(r"(?:^|[\n\ue000]|[.!?]\s)\s*(?:Hallo|Hi|Hello|Dear|Lieber?|Liebe/r|Moin|Hey)\s$")
_COMPANY = re.compile(r"\s?(?:&|und|and)\s(?:Partner|Söhne|Sons|Co)|\s(?:[A-ZÄÖÜ][\w-]+\s)?(?:GmbH|AG|KG|eG|SE|Ltd|LLC|Inc|SA|S\.L\.|S\.A\.|SARL|Services|Bakery|Druck|Logistik|Group|Holding)\b")
#: What stands before somebody's name and nothing else: verbs of contact, signatures, contact lines.
_CUE = re.compile(
    r"(?:\b(?:[Cc]all|[Pp]hone|[Cc]ontact|[Aa]sk|[Mm]eet|[Mm]et|[Tt]ell|[Tt]hank|[Rr]emind|[Ii]nform|[Ss](?:peak|poke) (?:to|with)|[Ss]igned(?: by)?:?|[Aa]ttn\.?:?"
    r"|[Rr]ufen Sie|[Ff]ragen Sie|[Kk]ontaktieren Sie|[Mm]elden Sie sich bei|Ansprechpartner(?:in)?(?: ist|:)?|gez\."
    r"|[Cc]ontactez|[Dd]emandez|[Aa]ppelez|[Ll]lame a|[Pp]regunte (?:a|por)) "
    r"|(?:[Rr]egards|[Ww]ishes|[Gg]rüße|[Gg]rüßen|[Cc]ordialement|[Aa]tentamente|[Ss]aludos),?\s*[\n\ue000]\s*)$"
)
#: Last words of the cues, tried before the pattern is.
_CUE_WORDS = frozenset("call phone contact ask meet met tell thank remind inform to with signed by attn sie bei ansprechpartner ansprechpartnerin ist gez contactez demandez appelez a por regards wishes grüße grüßen cordialement atentamente saludos".split())
_GREETING_WORDS = frozenset("hallo hi hello dear lieber liebe liebe/r moin hey".split())
_TITLES = frozenset("herr herrn frau mr mrs ms miss dr prof mme m sr sra señor señora madame monsieur".split())
_NOT_NAMES = frozenset("all everyone colleagues team zusammen kollegen kolleginnen sir madam damen herren there friends ladies gentlemen both folks".split())


def _squeeze(text: str) -> str:
    return re.sub(r"\s+", " ", text).strip()


def _shown(token: str) -> bool:
    return token[0].isupper() and (token[1:] == token[1:].lower() or token.isupper() or "-" in token or "’" in token or "'" in token)


def name_points(text: str, first: re.Match, second: re.Match, names: Names) -> int:
    """How much speaks for two neighbouring capitalised words being a person nobody knows as a sender."""
    if len(second.group()) < 2 or first.group().lower() in _TITLES or _CUE.search(text, max(0, first.start() - 40), first.start()) is None:
        return 0
    points = 2
    for word in (first.group(), second.group()):
        points += -3 if word.casefold() in names.common else 1
    if first.group().isupper() != second.group().isupper():
        points -= 1
    if _COMPANY.match(text, first.end()) or _COMPANY.match(text, second.end()) or text[second.end() : second.end() + 1] in ("@", "/", "_"):
        points -= 4
    return points


def valid_iban(text: str) -> bool:
    """Whether the check digits of an account number hold."""
    plain = re.sub(r"\s", "", text)
    return int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1


class _Words:
    """What a lexicon says about a word, remembered: (shown as a name, given name, family name, lower case)."""

    def __init__(self, names: Names):
        self.names = names
        self.known: dict[str, tuple[bool, bool, bool]] = {}

    def __call__(self, word: str) -> tuple[bool, bool, bool]:
        got = self.known.get(word)
        if got is None:
            low, shown, long = word.casefold(), _shown(word), len(word) > 1
            in_given, in_family = self.names.given.get(low, 0), self.names.family.get(low, 0)
            got = shown, shown and long and in_given > in_family, shown and long and in_family > 0
            if len(self.known) > 200_000:
                self.known.clear()
            self.known[word] = got
        return got


_STEP = {gap: re.compile(gap) for gap in (r"\s", r"\s?", r",\s", r" ")}


def find_names(text: str, names: Names, taken: list[tuple[int, int]], about: _Words | None = None) -> Iterator[Found]:
    """Person names by lexicon, initials and titles, longest form first."""
    about = about or _Words(names)
    tokens = [m for m in _TOKEN.finditer(text) if text[m.start()].isupper()]
    words = [m.group() for m in tokens]
    starts = {m.start(): k for k, m in enumerate(tokens)}
    blocked = sorted(taken)
    low = [b for b, _ in blocked]

    def free(k: int) -> bool:
        at = tokens[k].start()
        j = bisect.bisect_right(low, at) - 1
        return j < 0 or blocked[j][1] <= at

    def given(k: int) -> bool:
        return about(words[k])[1]

    def family(k: int) -> bool:
        return about(words[k])[2] and free(k)

    def initial(k: int) -> bool:
        m = tokens[k]
        return len(words[k]) == 1 and text[m.end() : m.end() + 1] == "." and text[m.start() - 1 : m.start()] != "." and free(k)

    def after(end: int, gap: str) -> int | None:
        m = _STEP[gap].match(text, end)
        return starts.get(m.end()) if m else None

    k = 0
    while k < len(tokens):
        m, word = tokens[k], words[k]
        last, end = None, None
        if free(k):
            shown, g, f = about(word)
            i = initial(k)
            long = len(word) > 1
            if g:
                n = after(m.end(), r"\s")
                if n is not None and initial(n):
                    p = after(tokens[n].end() + 1, r"\s")
                    if p is not None and family(p):
                        last, end = p, tokens[p].end()
                    else:
                        last, end = n, tokens[n].end() + 1
                elif n is not None and family(n):
                    last, end = n, tokens[n].end()
                elif n is not None and text[m.end()] == " " and free(n) and about(words[n])[0] and len(words[n]) > 2:
                    if not given(n) and not _COMPANY.match(text, tokens[n].end()):
                        last, end = n, tokens[n].end()  # a family name no sender bears
            if end is None and f:
                n = after(m.end(), r",\s")
                if n is not None and given(n):
                    last, end = n, tokens[n].end()
                    p = after(tokens[n].end(), r"\s")
                    if p is not None and initial(p):
                        last, end = p, tokens[p].end() + 1
                elif n is not None and initial(n):
                    last, end = n, tokens[n].end() + 1
            if end is None and i:
                n = after(m.end() + 1, r"\s?")
                if n is not None and initial(n):
                    n = after(tokens[n].end() + 1, r"\s?")
                if n is not None and family(n):
                    last, end = n, tokens[n].end()
            before = ""
            if end is None and shown and long:
                front = text[max(0, m.start() - 20) : m.start()].split()
                before = front[-1].strip(".,:\ue000").lower() if front else ""
            if before in _TITLES and _TITLE.search(text, max(0, m.start() - 24), m.start()):
                last, end = k, m.end()
            if end is None and (g or f):
                last, end = k, m.end()
            if end is None and len(word) > 2 and before in _GREETING_WORDS and word.lower() not in _NOT_NAMES:
                if re.match(r"\s?[,!]?\s?(?:[\n\ue000]|$)|,", text[m.end() : m.end() + 3]) and _GREETING.search(text, max(0, m.start() - 16), m.start()):
                    last, end = k, m.end()
            if end is not None and last == k and _COMPANY.match(text, end):
                end = None
            if end is None and before in _CUE_WORDS:
                n = after(m.end(), r" ")
                if n is not None and about(words[n])[0] and free(n) and name_points(text, m, tokens[n], names) >= NAME_POINTS:
                    last, end = n, tokens[n].end()
        if end is None:
            k += 1
            continue
        yield Found("name", m.start(), end, _squeeze(text[m.start() : end]))
        k = last + 1


def find_phones(text: str, free) -> Iterator[Found]:
    """Phone numbers; a number that is too short before a line break is read across it."""
    at = 0
    while (m := _PHONE_START.search(text, at)) is not None:
        best = _PHONE.match(text, m.start())
        digits = len(re.sub(r"\D", "", best.group())) if best else 0
        if best is None or digits < (11 if best.group()[0] == "+" or best.group().startswith("00") else 10):
            wide = _PHONE_WRAPPED.match(text, m.start())
            if wide and digits < len(re.sub(r"\D", "", wide.group())) <= 14:
                best = wide
        before = text[max(0, m.start() - 30) : m.start()]
        if best is not None:
            digits = len(re.sub(r"\D", "", best.group()))
            end = m.start() + len(best.group().rstrip("() /.-"))
            if 8 <= digits <= 15 and free(m.start(), end) and not _NOT_PHONE.search(before):
                yield Found("phone", m.start(), end, _squeeze(text[m.start() : end]))
                at = end
                continue
        elif _PHONE_LABEL.search(before):
            own = re.compile(r"\d[\d \u00a0/.-]{5,16}\d(?![\w-])").match(text, m.start())
            if own and free(m.start(), own.end()):
                yield Found("phone", m.start(), own.end(), _squeeze(own.group()))
                at = own.end()
                continue
        at = m.start() + 1
        while at < len(text) and text[at].isdigit():
            at += 1


#: What a text must hold for the forms of addresses, of numbers and of accounts to be tried at all.
_MAY_ADDRESS = re.compile(r"\d{5}(?!\d)|\d[A-Z]{2}(?!\w)")
_MAY_ID = re.compile(r"(?<![\w-])(?=[A-Z\d])(?:" + "|".join(re.sub(r"^\(\?<![^)]*\)", "", p.pattern).replace(r"([- ]|\s)", r"[-\s]").replace(r"\1", r"[-\s]") for p in _ID_FORMS) + ")")
_MAY_IBAN = re.compile(r"[A-Z]{2}\d\d")


def find(text: str, names: Names, about: _Words | None = None) -> list[Found]:
    """All entities of visible text, without overlaps, in order."""
    taken: list[tuple[int, int]] = []
    out: list[Found] = []

    def free(a: int, b: int) -> bool:
        return all(b <= x or a >= y for x, y in taken)

    def take(kind: str, a: int, b: int, keep: bool = True) -> None:
        if free(a, b):
            taken.append((a, b))
            if keep:
                out.append(Found(kind, a, b, _squeeze(text[a:b])))

    if "<" in text:
        for m in _MESSAGE_ID.finditer(text):
            take("", *m.span(), keep=False)
    if ":/" in text or "www." in text or "cid:" in text or "mid:" in text:
        for m in _LINK.finditer(text):
            take("", *m.span(), keep=False)
    if _MAY_IBAN.search(text):
        for m in _IBAN.finditer(text):
            if valid_iban(m.group()):
                take("", *m.span(), keep=False)
    if "@" in text or re.search(r"\b(?:at|AT)\b", text):
        for m in _EMAIL.finditer(text):
            take("email", *m.span("v"))
    for pattern in _ADDRESS if _MAY_ADDRESS.search(text) else ():
        for m in pattern.finditer(text):
            take("address", *m.span())
    for pattern in _ID_FORMS if _MAY_ID.search(text) else ():
        for m in pattern.finditer(text):
            if not _NOT_PHONE.search(text[max(0, m.start() - 30) : m.start()]):
                take("id_number", *m.span())
    for m in _ID_LABEL.finditer(text):
        take("id_number", *(m.span("v") if m.group("v") else m.span("w")))
    for m in _ELEVEN.finditer(text):
        if not _NOT_PHONE.search(text[max(0, m.start() - 30) : m.start()]):
            take("id_number", *m.span())
    for f in find_phones(text, free):
        taken.append((f.begin, f.end))
        out.append(f)
    out.extend(find_names(text, names, taken, about))
    return sorted(out, key=lambda f: f.begin)


def _mixed(part: str) -> bool:
    """Whether a name part mixes scripts, as garbled ones do."""
    return len({unicodedata.name(c, "?").split()[0] for c in part if c.isalpha()}) > 1


def name_parts(mail_headers: DataFrame) -> DataFrame:
    """role, part, n: name parts of all senders written "Given Family <address>" that LEXICON_LEAST of them bear."""
    pattern = r"^\s*\"?(\p{Lu}[\p{L}'’-]+) (\p{Lu}[\p{L}'’-]+)\"?\s*<"
    part = lambda role, k: F.struct(F.lit(role).alias("role"), F.lower(F.regexp_extract("from_", pattern, k)).alias("part"))
    parts = mail_headers.where(F.col("from_").rlike(pattern)).select(F.explode(F.array(part("g", 1), part("f", 2))).alias("x"))
    return parts.groupBy("x.role", "x.part").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= LEXICON_LEAST)


def common_words(parsed_mail: DataFrame) -> frozenset[str]:
    """Case-folded words that make up COMMON_RATE of all words of the bodies; at most 1 / COMMON_RATE."""
    plain = F.concat_ws(" ", "text_body", F.regexp_replace("html_body", r"<[^>]*>", " "))
    words = parsed_mail.select(F.explode(F.split(F.lower(plain), r"[^\p{L}]+")).alias("w")).where(F.length("w") > 1).groupBy("w").agg(F.count(F.lit(1)).alias("n"))
    words = materialise(words, "body-words")
    total = words.agg(F.sum("n")).first()[0] or 0
    return frozenset(r["w"].casefold() for r in words.where(F.col("n") >= COMMON_RATE * total).select("w").collect())


def _lexicon(rows) -> tuple[dict[str, int], dict[str, int]]:
    out: tuple[dict[str, int], dict[str, int]] = {}, {}
    for r in rows:
        if not _mixed(r["part"]):
            out[r["role"] == "f"][r["part"].casefold()] = r["n"]
    return out


def learn_names(parsed_mail: DataFrame, mail_headers: DataFrame, lexicon_size: int = LEXICON_SIZE) -> tuple[Names, DataFrame | None]:
    """(lexicon to broadcast, name parts beyond ``lexicon_size`` or None).

    The more frequent parts are broadcast, up to ``lexicon_size`` of them; the
    others stay a table, which ``_bodies`` joins to the mails that hold them, so
    none is lost.
    """
    counted = materialise(name_parts(mail_headers), "name-parts")
    levels = counted.groupBy("n").agg(F.count(F.lit(1)).alias("parts")).orderBy(F.desc("n")).collect()
    least, held = None, 0
    for level in levels:
        held += level["parts"]
        if held > lexicon_size:
            break
        least = level["n"]
    top = counted.where(F.col("n") >= least).collect() if least is not None else []
    rare = None if held <= lexicon_size else counted.where(F.col("n") < least) if least is not None else counted
    return Names(*_lexicon(top), common_words(parsed_mail)), rare


def replaced(body: str, seen: Visible, found: list[Found], text_of) -> str:
    """The body with every entity's visible letters replaced, markup in between kept."""
    edits: list[tuple[int, int, str]] = []
    for f in found:
        spans = seen.source(f.begin, f.end)
        for n, (a, b) in enumerate(spans):
            edits.append((a, b, text_of(f) if n == 0 else ""))
    out, at = [], 0
    for a, b, new in sorted(edits):
        out += [body[at:a], new]
        at = max(at, b)
    out.append(body[at:])
    return "".join(out)


def entity_keys(found: list[Found]) -> dict[Found, tuple]:
    """Key of the entity each find stands for, within one mail.

    Spellings of one address, number or mail address share a key.  A person is
    known by given and family name; the initialled, reversed or shortened form
    goes to the only person of the mail it fits, else it is an entity of its own.
    """
    out: dict[Found, tuple] = {}
    persons: dict[tuple[str, str], tuple] = {}
    names = [f for f in found if f.kind == "name"]
    parsed = {f: person_of(f.value) for f in names}
    for f in names:
        given, family = parsed[f]
        if given and family and len(given) > 1:
            out[f] = persons.setdefault((given, family), ("name", given, family))
    for f in names:
        given, family = parsed[f]
        if f not in out and family and given:
            fits = [k for k in persons if k[1] == family and k[0].startswith(given)]
            out[f] = persons[fits[0]] if len(fits) == 1 else persons.setdefault((given, family), ("name", given, family))
    for f in names:
        if f not in out:
            single = parsed[f][1]
            fits = {v for k, v in persons.items() if single in k}
            out[f] = fits.pop() if len(fits) == 1 else ("name", single)
    for f in found:
        out.setdefault(f, (f.kind, canonical(f.kind, f.value)))
    return out


def person_of(value: str) -> tuple[str, str]:
    """(given name or initial, family name) in lower case; a single name counts as family name."""
    if "," in value:
        family, _, given = value.partition(",")
        words = [*given.split(), family.strip()]
    else:
        words = re.sub(r"\.(?=\w)", ". ", value).split()
    words = [w.casefold() for w in words]
    if len(words) == 1:
        return "", words[0]
    return words[0].rstrip("."), words[-1].rstrip(".")


def _bodies(parsed_mail: DataFrame, rare: DataFrame | None) -> DataFrame:
    """mail_id, text_body, html_body, rare: bodies with the name parts of the rare table that they hold."""
    source = spread(parsed_mail.select("mail_id", "text_body", "html_body").where("text_body is not null or html_body is not null"))
    rare_type = "array<struct<role: string, part: string, n: bigint>>"
    if rare is None:
        return source.withColumn("rare", F.lit(None).cast(rare_type))
    source = source.withColumn("__row", F.monotonically_increasing_id())
    source = materialise(source, "bodies")

    def tokens(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for row, text, page in zip(batch["__row"], batch["text_body"], batch["html_body"], strict=True):
                held = {t.lower() for v, read in ((text, visible_text), (page, visible_html)) if v for t in _TOKEN.findall(read(v).text) if t[0].isupper()}
                out += [(row, t) for t in held]
            yield pd.DataFrame(out, columns=["__row", "part"])

    held = source.select("__row", "text_body", "html_body").mapInPandas(tokens, "__row long, part string")
    known = held.join(rare, "part").groupBy("__row").agg(F.collect_list(F.struct("role", "part", "n")).alias("rare"))
    return source.join(known, "__row", "left").select("mail_id", "text_body", "html_body", "rare")


class Detector:
    """Finds entities of mails with the broadcast lexicon and the rare names that come with a row."""

    def __init__(self, names: Names):
        self.names, self.about = names, _Words(names)

    def mail(self, text: str | None, page: str | None, rare) -> list[tuple[str, str | None, Visible | None, list[Found]]]:
        """(body, source, visible text, finds) of both bodies."""
        names, about = self.names, self.about
        if rare is not None and len(rare):
            given, family = _lexicon(rare)
            names = Names(ChainMap(given, names.given), ChainMap(family, names.family), names.common)
            about = _Words(names)
        out = []
        for body, value, read in (("text", text, visible_text), ("html", page, visible_html)):
            seen = read(value) if value else None
            out.append((body, value, seen, find(seen.text, names, about) if seen else []))
        return out


def replacements(parsed_mail: DataFrame, mail_headers: DataFrame, key: str, lexicon_size: int = LEXICON_SIZE) -> DataFrame:
    """mail_id, body, kind, pii_value, entity, surrogate: one row per distinct value in each body.

    ``surrogate`` is what stands for the value under ``key``, ``entity`` what its
    spellings have in common.  Null and empty bodies give no row; repeated mails
    give repeated rows; other columns aren't read.
    """
    names, rare = learn_names(parsed_mail, mail_headers, lexicon_size)
    shared = parsed_mail.sparkSession.sparkContext.broadcast(names)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        detector, surrogates = Detector(shared.value), Surrogates(key.encode())
        for batch in batches:
            out = []
            for mail, text, page, extra in zip(batch["mail_id"], batch["text_body"], batch["html_body"], batch["rare"], strict=True):
                for body, _, _, found in detector.mail(text, page, extra):
                    for kind, value in dict.fromkeys((f.kind, f.value) for f in found):
                        out.append((mail, body, kind, value, canonical(kind, value), surrogates.replace(kind, value)))
            yield pd.DataFrame(out, columns=["mail_id", "body", "kind", "pii_value", "entity", "surrogate"])

    id_type = parsed_mail.schema["mail_id"].dataType.simpleString()
    return _bodies(parsed_mail, rare).mapInPandas(run, f"mail_id {id_type}, body string, kind string, pii_value string, entity string, surrogate string")


def collisions(replaced_values: DataFrame) -> DataFrame:
    """kind, stand_in, entities, stand_ins: stand-ins of several entities, and entities with several stand-ins.

    Both checks run over all values of ``replacements``; distinctness and
    coreference hold if no row comes out.
    """
    of = lambda kind, value: F.when(kind == "phone", F.regexp_replace(value, r"\D", "")).when(kind == "id_number", F.upper(F.regexp_replace(value, r"[\W_]", ""))).otherwise(F.lower(value))
    v = replaced_values.select("kind", F.lower("pii_value").alias("value"), "entity", F.lower("surrogate").alias("stand_in")).distinct()
    shared = v.groupBy("kind", "stand_in").agg(F.count_distinct(of(F.col("kind"), F.col("value"))).alias("entities")).where("entities > 1")
    split = v.groupBy("kind", "value").agg(F.count_distinct("stand_in").alias("stand_ins")).where("stand_ins > 1")
    return shared.select("kind", "stand_in", "entities", F.lit(1).cast("long").alias("stand_ins")).unionByName(
        split.select("kind", F.col("value").alias("stand_in"), F.lit(1).cast("long").alias("entities"), "stand_ins")
    )


def redacted(parsed_mail: DataFrame, mail_headers: DataFrame, key: str = "", mode: str = "placeholder", lexicon_size: int = LEXICON_SIZE) -> DataFrame:
    """mail_id, text_body, html_body, entities with every entity replaced.

    ``mode`` is "placeholder" (``[NAME_1]``, one number for each entity of the
    mail, by first appearance) or "surrogate" (keyed by ``key``).  Null bodies
    stay null.
    """
    if mode not in ("placeholder", "surrogate"):
        raise ValueError(mode)
    names, rare = learn_names(parsed_mail, mail_headers, lexicon_size)
    shared = parsed_mail.sparkSession.sparkContext.broadcast(names)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        detector = Detector(shared.value)
        surrogates = Surrogates(key.encode()) if mode == "surrogate" else None
        for batch in batches:
            rows = []
            for mail, text, page, extra in zip(batch["mail_id"], batch["text_body"], batch["html_body"], batch["rare"], strict=True):
                bodies = detector.mail(text, page, extra)
                keys = {} if surrogates is not None else entity_keys([f for *_, found in bodies for f in found])
                numbers: dict[tuple, int] = {}
                per_kind: dict[str, int] = {}

                def stand_in(f: Found) -> str:
                    if surrogates is not None:
                        return surrogates.replace(f.kind, f.value)
                    if keys[f] not in numbers:
                        numbers[keys[f]] = per_kind[f.kind] = per_kind.get(f.kind, 0) + 1
                    return f"[{f.kind.upper()}_{numbers[keys[f]]}]"

                new = [replaced(value, seen, found, stand_in) if seen else value for _, value, seen, found in bodies]
                rows.append((mail, *new, sum(len(found) for *_, found in bodies)))
            yield pd.DataFrame(rows, columns=["mail_id", "text_body", "html_body", "entities"])

    id_type = parsed_mail.schema["mail_id"].dataType.simpleString()
    return _bodies(parsed_mail, rare).mapInPandas(run, f"mail_id {id_type}, text_body string, html_body string, entities int")
