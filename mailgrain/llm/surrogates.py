"""Keyed, type-consistent stand-ins that stay distinct by construction.

Every replacement is a permutation: letters stay in their class (script, vowel
or consonant, frequent or rare, case), digits stay digits, separators stay.  A
permutation never gives two values one stand-in, whatever the values are and in
whatever batch they come, so nothing has to be remembered or looked up.

A word's first letter is permuted on its own.  "J. Smith" and "John Smith" thus
keep a common initial, in any mail.  Endings that tell a name's gender are kept,
and the word is permuted again until it shows the same ending and no other, which
is a permutation of the words with that ending.  Phone numbers are permuted
without country code and trunk zero, so both ways to write a number agree.
"""

from __future__ import annotations

import functools
import hashlib
import re
import unicodedata

# Letters that replace each other, in lower case.
CLASSES = (
    "aeiou", "bdfghklmnprstvw", "cjqxyz", "äöüàáâãåèéêëìíîïòóôõùúûýæøœ", "çñšžčćđłńśźżřťď",
    "аеёиоуыэюя", "бвгджзйклмнпрстфхцчшщ", "αεηιουω", "βγδζθκλμνξπρστφχψ",
)
#: Scripts without case, as ranges of code points that replace each other.
RANGES = ((0x05D0, 0x05E9), (0x0627, 0x063A), (0x0641, 0x064A), (0x0915, 0x0939), (0x0E01, 0x0E2E), (0x3041, 0x3093), (0x30A1, 0x30F3), (0x4E00, 0x9FFF), (0xAC00, 0xD7A3))
# Endings that tell the gender of given names in the languages of the mails.
FEMALE = "a ia ina ine elle ette ie rid hild gard trud lind is".split()
MALE = "o us ert bert rich fried mar win olf ian ias as er en".split()
ENDINGS = tuple(sorted({*FEMALE, *MALE}, key=lambda e: (-len(e), e)))
# Country codes of one and two digits; all others have three.
ONE_DIGIT, TWO_DIGITS = "1 7".split(), "20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split()
# Words of addresses that say what follows, and endings of German street names.
ADDRESS_WORDS = frozenset(
    "flat apt apartment unit suite room street st road rd lane ln avenue ave drive dr court ct way place square close terrace boulevard blvd "
    "rue chemin allée impasse quai cours route calle avenida plaza paseo via viale piazza bis ter in am an der im ob see de du des la le les l d del los las "
    "bad klein groß gross alt neu sankt ober unter little great upper lower port north south east west new old market bei upon on the".split()
)
STREET_ENDINGS = tuple("straße strasse str weg platz gasse hang grund allee ring ufer damm steig markt wall chaussee pfad stieg winkel hof".split())

_WORD = re.compile(r"[^\W\d_]+")
_RUN = re.compile(r"\d+")
_PREFIX = re.compile(r"\+|00(?=[1-9])")


@functools.lru_cache(maxsize=1 << 14)
def _place(c: str) -> tuple[int, int, int]:
    """(class, position, size) of a letter or digit; size 1 where it has no companions."""
    for k, members in enumerate(CLASSES):
        if (at := members.find(c)) >= 0:
            return k, at, len(members)
    if c.isdigit() and c.isascii():
        return 100, ord(c) - 48, 10
    for k, (low, high) in enumerate(RANGES):
        if low <= ord(c) <= high:
            return 200 + k, ord(c) - low, high - low + 1
    return 300, 0, 1


def _letter(kind: int, at: int, old: str) -> str:
    if kind == 300:
        return old
    if kind == 100:
        return chr(48 + at)
    return chr(RANGES[kind - 200][0] + at) if kind >= 200 else CLASSES[kind][at]


def ending_of(word: str) -> str:
    """The longest ending of a lower-case word that tells a gender and leaves three letters, or ''."""
    return next((e for e in ENDINGS if word.endswith(e) and len(word) >= len(e) + 3), "")


class Surrogates:
    """Stand-ins under one key; equal keys give equal stand-ins everywhere."""

    def __init__(self, key: bytes):
        self.key = hashlib.blake2b(key, digest_size=32).digest()
        self.word = functools.lru_cache(maxsize=1 << 16)(self._word)
        self.replace = functools.lru_cache(maxsize=1 << 16)(self._replace)

    def _mac(self, tweak: str, value: int) -> int:
        return int.from_bytes(hashlib.blake2b(f"{tweak}\0{value}".encode(), key=self.key, digest_size=16).digest(), "big")

    def permute(self, digits: list[int], radices: list[int], tweak: str) -> list[int]:
        """Permutation of the digit lists with these radices.

        A single free digit is rotated and so always changes.  More are split into
        two halves that are shifted by keyed functions of each other in turn.
        """
        free = [k for k, r in enumerate(radices) if r > 1]
        tweak = f"{tweak}:{radices}"
        out = list(digits)
        if len(free) == 1:
            k = free[0]
            out[k] = (digits[k] + 1 + self._mac(tweak, 0) % (radices[k] - 1)) % radices[k]
            return out
        halves = [free[: len(free) // 2], free[len(free) // 2 :]]
        sizes, values = [1, 1], [0, 0]
        for h in (0, 1):
            for k in halves[h]:
                sizes[h] *= radices[k]
                values[h] = values[h] * radices[k] + digits[k]
        for turn in range(4 if free else 0):
            h = turn % 2
            values[h] = (values[h] + self._mac(f"{tweak}:{turn}", values[1 - h])) % sizes[h]
        for h in (0, 1):
            for k in reversed(halves[h]):
                values[h], out[k] = divmod(values[h], radices[k])
        return out

    def _word(self, word: str) -> str:
        word = unicodedata.normalize("NFC", word)
        low = "".join(c.lower() if len(c.lower()) == 1 and c.lower().upper() == c else c for c in word)
        ending = ending_of(low)
        places = [_place(c) for c in low]
        kinds, sizes = [p[0] for p in places], [p[2] for p in places]
        if len(ending) == len(low):
            return word
        first = self.permute(places[:1] and [places[0][1]], sizes[:1], f"initial:{kinds[0]}")[0]
        head, inner = _letter(kinds[0], first, low[0]), slice(1, len(low) - len(ending))
        rest = [p[1] for p in places[inner]]
        while True:  # until the word shows the same ending and no other, which it does at its own place at the latest
            rest = self.permute(rest, sizes[inner], f"word:{kinds}:{ending}:{first}")
            new = head + "".join(map(_letter, kinds[inner], rest, low[inner])) + ending
            if ending_of(new) == ending:
                return "".join(n.upper() if c.isupper() else n for c, n in zip(word, new, strict=True))

    def number(self, value: str, tweak: str) -> str:
        """Text with its digits permuted as one number; leading zeros stay, a first digit stays other than zero."""
        digits = [c for c in value if c.isdigit() and c.isascii()]
        zeros = next((k for k, c in enumerate(digits) if c != "0"), len(digits))
        radices = [1] * zeros + [9] * (len(digits) > zeros) + [10] * (len(digits) - zeros - 1)
        shift = [1 if r == 9 else 0 for r in radices]
        new = self.permute([int(c) - s if r > 1 else 0 for c, s, r in zip(digits, shift, radices, strict=True)], radices, tweak)
        turned = iter([str(n + s) if r > 1 else "0" for n, s, r in zip(new, shift, radices, strict=True)])
        return "".join(next(turned) if c.isdigit() and c.isascii() else c for c in value)

    def words(self, text: str) -> str:
        """Text with every run of letters replaced."""
        return _WORD.sub(lambda m: self.word(m.group()), text)

    def email(self, value: str) -> str:
        """Local part and host names word by word, as in names; top domain and spelled-out signs stay."""
        low = value.lower()
        at = max(low.rfind("@"), *(low.rfind(s) for s in (" at ", "(at)", "[at]", "{at}", "( at )", "[ at ]", "{ at }")))
        dot = max(low.rfind("."), *(low.rfind(s) for s in (" dot ", "(dot)", "[dot]", "{dot}", "( dot )", "[ dot ]", "{ dot }")))
        keep = {m.start() for m in re.finditer(r"(?<![^\W_])(?:at|dot)(?![^\W_])", low) if m.start() >= at or m.group() == "dot"} if "@" not in low or "dot" in low else set()
        second = re.search(r"(?<![^\W_])(?:co|com|ac|org|gov|net)(?=\.[a-z]{2}$)", low)
        if second:
            keep.add(second.start())
        one = lambda m: m.group() if m.start() in keep or m.start() >= dot > at else self.word(m.group())
        return _RUN.sub(lambda m: self.number(m.group(), "email"), _WORD.sub(one, value))

    def phone(self, value: str) -> str:
        """Country code and trunk zero stay, the subscriber's digits are permuted."""
        m = _PREFIX.match(value)
        head = 0
        if m:
            digits = [(k, c) for k, c in enumerate(value) if k >= m.end() and c.isdigit()]
            code = "".join(c for _, c in digits[:2])
            n = 1 if code[:1] in ONE_DIGIT else 2 if code in TWO_DIGITS else 3
            head = digits[min(n, len(digits)) - 1][0] + 1 if digits else m.end()
        trunk = re.match(r"\s?\(0\)|[\s(]*0(?!\d*\))" if head else r"\(?0", value[head:])
        head += trunk.end() if trunk else 0
        return value[:head] + self.number(value[head:], "phone")

    def address(self, value: str) -> str:
        """Numbers run by run, names word by word; words that name a kind of street, unit or place stay."""

        def one(m: re.Match) -> str:
            word = m.group()
            low = word.lower()
            after = value[m.end() : m.end() + 1]
            if low in ADDRESS_WORDS or (len(word) <= 2 and word.isupper() and after == " "):
                return word
            end = next((e for e in STREET_ENDINGS if low.endswith(e) and len(low) > len(e) + 1), "")
            if not end:
                return self.word(word)
            stem = self.word(word[: len(word) - len(end)])
            # a stem that itself ends like a street would read as another split
            while any((stem + word[len(word) - len(end) :]).lower().endswith(e) for e in STREET_ENDINGS if len(e) > len(end)):
                stem = self.word(stem)
            return stem + word[len(word) - len(end) :]

        return _RUN.sub(lambda m: self.number(m.group(), "address"), _WORD.sub(one, value))

    def identity(self, value: str) -> str:
        """Letters and digits permuted together, each in its place."""
        chars = [c for c in value if c.isalnum()]
        places = [_place(c.lower()) for c in chars]
        new = self.permute([p[1] for p in places], [p[2] for p in places], f"id:{[p[0] for p in places]}")
        turned = iter([n.upper() if c.isupper() else n for c, n in zip(chars, (_letter(p[0], n, c.lower()) for p, n, c in zip(places, new, chars, strict=True)), strict=True)])
        return "".join(next(turned) if c.isalnum() else c for c in value)

    def _replace(self, kind: str, value: str) -> str:
        """Stand-in of a value of one of the five kinds."""
        return {"email": self.email, "phone": self.phone, "id_number": self.identity, "address": self.address, "name": self.words}[kind](value)


def canonical(kind: str, value: str) -> str:
    """What all spellings of one entity have in common, as far as the value itself tells."""
    if kind == "email":
        low = re.sub(r"\s?[\[({]\s?at\s?[\])}]\s?|\sat\s", "@", value.lower())
        return re.sub(r"\s?[\[({]\s?dot\s?[\])}]\s?|\sdot\s", ".", low)
    if kind == "phone":
        m = _PREFIX.match(value)
        digits = re.sub(r"\D", "", re.sub(r"\(0\)", "", value[m.end() :] if m else value))
        if m:
            n = 1 if digits[:1] in ONE_DIGIT else 2 if digits[:2] in TWO_DIGITS else 3
            return digits[n:].lstrip("0")
        return digits.lstrip("0")
    if kind == "id_number":
        return re.sub(r"[\W_]", "", value).upper()
    return re.sub(r"\s+", " ", value).casefold()
