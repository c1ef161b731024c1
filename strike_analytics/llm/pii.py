"""Surrogates for personal data: keyed, type-consistent, distinct, coreferent.

Mail addresses, phone, card, social security and IBAN numbers, IPv4 addresses
and names after a title are detected and replaced. Each is made of parts (a
mail address of its domain and its local part within it, a name of given names
and a surname), and every part is replaced by a value that a keyed hash
(HMAC-SHA-256) draws in the part's own form: same length, case, script and
layout; digits for digits; a card number that passes the Luhn test gets one that passes it, an
IBAN valid check digits, a private address a private one; a given name one of
the gender that the title tells. Equal parts get equal surrogates in every
document, and a name's parts are also replaced where they stand alone later in
its text, so who is meant stays the same.

An entity is resolved before it is drawn: a given name's gender is the one that
most titles before it in the corpus tell, whatever title one mention has, and a
phone number is its national digits, whatever country code one mention adds.

Collision checks make different parts differ: over all parts of the corpus a
surrogate is taken only if no other part of its kind has it and it is itself
no part of the corpus. The others draw again, in rounds, each a pair of joins
on tables of parts; from every fourth round on names and local parts grow by
a letter, so their space can't run out. Numbers and addresses keep their form,
whose space can: where a form still has parts without a free surrogate after
``ROUNDS`` rounds (a crawl that holds all of 192.168.0.0/16), all parts of that
form are moved by a keyed permutation of it instead. That keeps them distinct and moves each,
but there a surrogate may equal another entity's value.

Scale: two passes over the texts. The first yields the parts of each document
(a small table), the second replaces them, with the first draw computed in
place; only parts that had to draw again are looked up, by a join on the
document's key. Nothing is collected or broadcast but what Spark itself finds
small. Parts that are in very many documents are aggregated before the shuffle.

Defined results: a null text stays null; texts without personal data are
returned as they are; repeated rows get equal texts; an empty table gives an empty one.
"""

from __future__ import annotations

import hashlib
import hmac
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strike_analytics.llm.common import read_table, written

#: Titles and the gender they tell.
TITLES = {"Mr": "m", "Mister": "m", "Sir": "m", "Herr": "m", "Herrn": "m", "Monsieur": "m", "Señor": "m", "Sr": "m", "Don": "m",
          "Mrs": "f", "Ms": "f", "Miss": "f", "Frau": "f", "Madame": "f", "Mme": "f", "Mlle": "f", "Señora": "f", "Sra": "f",
          "Doña": "f", "Dr": "u", "Prof": "u", "Господин": "m", "Госпожа": "f", "Κύριος": "m", "Κυρία": "f"}

#: A letter, or a vowel sign or point that is written with one.
_LETTER = r"(?:[^\W\d_]|[\u0591-\u05bd\u064b-\u065f\u0900-\u0903\u093a-\u094f\u0e31\u0e34-\u0e3a\u0e47-\u0e4e])"
_NAME = rf"[^\W\d_a-zà-öø-ÿа-яα-ω]{_LETTER}+(?:['’-]{_LETTER}+)*"
PATTERNS = {
    "email": re.compile(r"(?<![\w.+-])[\w.+-]+@[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?(?:\.[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?)+"),
    "iban": re.compile(r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)"),
    "phone": re.compile(r"(?<![\w+])(?:\+\d{1,3}[ .-]?(?:\(\d{2,4}\)[ .-]?)?\d{2,4}(?:[ .-]\d{2,4}){1,4}"
                        r"|\(\d{3}\) ?\d{3}[ .-]\d{4}|\d{3}[.-]\d{3}[.-]\d{4}|\+\d{8,15})(?!\w)"),
    "ssn": re.compile(r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])"),
    "card": re.compile(r"(?<!\w)(?:\d{4}([ -])\d{4}\1\d{4}\1\d{4}|\d{4}[ -]\d{6}[ -]\d{5}|\d{13,19})(?!\w)"),
    "ip": re.compile(r"(?<![\w.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\w|\.\d)"),
}
_SHORT = {"Mr", "Mrs", "Ms", "Dr", "Prof", "Sr", "Sra", "Mme", "Mlle"}
_TITLE = "|".join(t + r"\.?" if t in _SHORT else t for t in sorted(TITLES, key=len, reverse=True))
_TITLED = re.compile(rf"(?<!\w)({_TITLE}) +({_NAME}(?: +{_NAME}){{0,2}})")
_DIGIT = re.compile(r"\d{2}")


def iban_rest(text: str) -> int:
    """Of the division by 97; 1 for valid numbers."""
    moved = text[4:] + text[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97


def luhn(digits: str) -> int:
    """The check sum modulo ten; 0 for valid numbers."""
    twice = [int(d) * (2 if i % 2 else 1) for i, d in enumerate(reversed(digits))]
    return sum(x - 9 if x > 9 else x for x in twice) % 10


def digits_of(text: str) -> str:
    """The digits of ``text``, of any script, as 0 to 9."""
    return "".join(str(unicodedata.digit(c)) for c in text if c.isdecimal())


_CODE = re.compile(r"\+(1|\d{1,3}(?=[ .(-]))")


def national(found: str) -> int:
    """How many digits of a phone number come before its national number."""
    code = _CODE.match(found)
    return len(code[1]) if code else 0


def parts_of(kind: str, found: str) -> list[tuple[str, str]]:
    """(kind, value) of the parts that are replaced; values are canonical."""
    if kind == "email":
        local, domain = found.lower().rsplit("@", 1)
        return [("local", f"{local}@{domain}"), ("domain", domain)]
    if kind == "name":
        *given, surname = found.split()
        return [("given", g.lower()) for g in given] + [("surname", surname.lower())]
    if kind == "phone":
        return [(kind, digits_of(found)[national(found):])]
    if kind in ("card", "ssn"):
        return [(kind, digits_of(found))]
    return [(kind, found.replace(" ", "") if kind == "iban" else found)]


#: Words of letters, joined ones whole, and their pieces.
_LETTERS = re.compile(rf"{_LETTER}+")
_WORD = re.compile(rf"(?<!\w){_LETTER}+(?:['’-]{_LETTER}+)*(?!\w)")


def _alone(word: str, named: dict[str, str], longest: int) -> list[tuple[int, int]]:
    """Where the longest names are in a word that may be joined of several; names have ``longest`` pieces at most."""
    if word.lower() in named:
        return [(0, len(word))] if word[0].isupper() else []
    pieces = [m.span() for m in _LETTERS.finditer(word)]
    if len(pieces) == 1:
        return []
    out, k = [], 0
    while k < len(pieces):
        last = next((j for j in range(min(len(pieces), k + longest) - 1, k - 1, -1)
                     if word[pieces[k][0]].isupper() and word[pieces[k][0]:pieces[j][1]].lower() in named), None)
        if last is not None:
            out.append((pieces[k][0], pieces[last][1]))
            k = last
        k += 1
    return out


def detect(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, gender) of what doesn't overlap, in order."""
    found: list[tuple[int, int, str, str]] = []
    kinds = [k for k in PATTERNS if k == "email"] if "@" in text else []
    if _DIGIT.search(text):
        kinds += [k for k in PATTERNS if k != "email"]
    for kind in kinds:
        for m in PATTERNS[kind].finditer(text):
            if kind == "iban" and iban_rest(m[0].replace(" ", "")) != 1:
                continue
            found.append((m.start(), m.end(), kind, ""))
    named: dict[str, str] = {}
    for m in _TITLED.finditer(text):
        found.append((m.start(2), m.end(2), "name", TITLES[m[1].rstrip(".")]))
        named.update({v: k for k, v in parts_of("name", m[2]) if len(v) > 2})
    if named:  # where a part stands alone, with a capital as in the name
        longest = max(len(_LETTERS.findall(v)) for v in named)
        for m in _WORD.finditer(text):
            found += [(m.start() + a, m.start() + b, named[m[0][a:b].lower()], "") for a, b in _alone(m[0], named, longest)]
    out, at = [], 0
    for span in sorted(found, key=lambda s: (s[0], -s[1])):
        if span[0] >= at:
            out.append(span)
            at = span[1]
    return out


def span_parts(text: str, span: tuple[int, int, str, str]) -> list[tuple[str, str]]:
    start, end, kind, _ = span
    found = text[start:end]
    return [(kind, found.lower())] if kind in ("given", "surname") else parts_of(kind, found)


def genders(text: str, spans: list[tuple[int, int, str, str]]) -> dict[str, Counter]:
    """Of each given name after a title, how often titles tell which gender."""
    out: dict[str, Counter] = {}
    for span in spans:
        if span[2] == "name":
            for kind, value in span_parts(text, span):
                if kind == "given":
                    out.setdefault(value, Counter())[span[3]] += 1
    return out


def told(male: int, female: int) -> str:
    return "m" if male > female else "f" if female > male else "u"


class Draw:
    """A keyed source of numbers for one part and attempt."""

    def __init__(self, key: bytes, kind: str, value: str, attempt: int):
        self.key, self.seed, self.block, self.left = key, f"{kind}\0{value}\0{attempt}".encode(), 0, b""

    def below(self, n: int) -> int:
        if len(self.left) < 4:
            self.left += hmac.new(self.key, self.seed + self.block.to_bytes(4, "big"), hashlib.sha256).digest()
            self.block += 1
        x, self.left = int.from_bytes(self.left[:4], "big"), self.left[4:]
        return x % n

    def pick(self, letters: str) -> str:
        return letters[self.below(len(letters))]


#: Letters by script: those that begin a syllable, those that end one, and endings of names by gender.
SCRIPTS = {
    "latin": ("bcdfghjklmnprstvwz", "aeiou", {"f": ("a", "ia", "ella", "ine"), "m": ("o", "us", "ert", "an"), "u": ("e", "is", "en")}),
    "cyrillic": ("бвгджзклмнпрстфхчш", "аеиоу", {"f": ("а", "ия", "ина"), "m": ("ий", "ов", "ан"), "u": ("о", "ен")}),
    "greek": ("βγδζθκλμνπρστφχ", "αεηιο", {"f": ("α", "ία", "η"), "m": ("ος", "ης", "ας"), "u": ("ις", "ων")}),
    "arabic": ("بتثجحخدذرزسشصضطظعغفقكلمنه", "اوي", {"f": ("ة", "اء", "ى"), "m": ("د", "ر", "م"), "u": ("ن", "ل")}),
    "hebrew": ("בגדזחטכלמנספצקרשת", "אוי", {"f": ("ה", "ית"), "m": ("ן", "ר", "ל"), "u": ("י", "ם")}),
    "devanagari": ("कखगघचजटडतदनपबमयरलवशसह", "ािीुूेो", {"f": ("ा", "ी"), "m": ("न", "त", "र"), "u": ("ल", "य")}),
    "thai": ("กขคงจชดตทนบปพมยรลวสห", "าิีุู", {"f": ("า", "ี"), "m": ("น", "ม"), "u": ("ร", "ล")}),
}
#: Scripts without such syllables: first and last letter that a surrogate's may have.
RANGES = {"hiragana": ("あ", "ん"), "katakana": ("ア", "ン"), "hangul": ("가", "힣"), "han": ("一", "鿕")}
#: Where the letters of a script are.
_BLOCKS = [("greek", "Ͱ", "Ͽ"), ("cyrillic", "Ѐ", "ԯ"), ("hebrew", "\u0590", "\u05ff"), ("arabic", "\u0600", "\u06ff"),
           ("devanagari", "\u0900", "\u097f"), ("thai", "\u0e00", "\u0e7f"), ("hiragana", "\u3040", "\u309f"),
           ("katakana", "\u30a0", "\u30ff"), ("han", "\u3400", "\u9fff"), ("hangul", "\uac00", "\ud7af")]


def script_of(text: str) -> str:
    first = next((c for c in text if c.isalpha()), "a")
    return next((name for name, low, high in _BLOCKS if low <= first <= high), "latin")


def like(c: str, draw: Draw) -> str:
    """A letter of the script for a letter, a digit for a digit; other characters as they are."""
    if c.isdecimal():
        return digit_like(c, draw.below(10))
    if c.isalpha():
        script = script_of(c)
        if script in RANGES:
            return _in_range(script, draw)
        consonants, vowels, _ = SCRIPTS[script]
        return draw.pick(consonants + vowels)
    return c


def _in_range(script: str, draw: Draw) -> str:
    low, high = map(ord, RANGES[script])
    return chr(low + draw.below(high - low + 1))


def digit_like(c: str, digit: int) -> str:
    """``digit`` among the digits that ``c`` is one of."""
    return chr(ord(c) - unicodedata.digit(c) + digit)


#: The kinds that keep their form, and the rounds of draws before a form counts as used up.
FIXED, ROUNDS = ("phone", "ssn", "card", "iban", "ip"), 64


def form_of(kind: str, value: str) -> str:
    """What a surrogate shares with a value of a fixed kind: a space of its own."""
    if kind == "card":
        return f"{len(value)} {value[0]} {(int(value[-1]) - _check(value[:-1])) % 10}"
    if kind == "iban":
        return value[:2] + re.sub("[A-Z]", "A", re.sub(r"\d", "9", value[4:]))
    if kind == "ip":
        a, b, *_ = map(int, value.split("."))
        return "10" if a == 10 else "127" if a == 127 else "192.168" if (a, b) == (192, 168) else "172" if a == 172 and 16 <= b < 32 else "public"
    return str(len(value))


def _check(body: str) -> int:
    return next(d for d in range(10) if luhn(body + str(d)) == 0)


class Permutation:
    """A keyed permutation of 0 to n - 1: a Feistel network, walked until it is back in the range."""

    def __init__(self, key: bytes, name: str, n: int):
        self.key, self.name, self.n = key, name.encode(), n
        self.half = max(1, ((n - 1).bit_length() + 1) // 2)

    def _round(self, k: int, x: int) -> int:
        made = hmac.new(self.key, self.name + bytes([k]) + x.to_bytes(32, "big"), hashlib.sha256).digest()
        return int.from_bytes(made, "big") & ((1 << self.half) - 1)

    def _once(self, x: int, rounds: range) -> int:
        left, right = x >> self.half, x & ((1 << self.half) - 1)
        forward = rounds.step > 0
        for k in rounds:
            left, right = (right, left ^ self._round(k, right)) if forward else (right ^ self._round(k, left), left)
        return left << self.half | right

    def _walk(self, x: int, rounds: range) -> int:
        x = self._once(x, rounds)
        while x >= self.n:
            x = self._once(x, rounds)
        return x

    def moved(self, x: int) -> int:
        """The next of a keyed cycle through all numbers: never ``x`` itself if there is another."""
        return self._walk((self._walk(x, range(8)) + 1) % self.n, range(7, -1, -1))


def permuted(kind: str, value: str, key: bytes) -> str:
    """The surrogate of a value of a fixed kind within its form, by permutation."""
    form = form_of(kind, value)
    if kind == "ip":
        fixed = {"10": 1, "127": 1, "192.168": 2, "172": 0, "public": 0}[form]
        octets = value.split(".")
        first = 0xAC100000 if form == "172" else 0
        n = 1 << 20 if form == "172" else 256 ** (4 - fixed)
        at = sum(int(o) << 8 * (3 - fixed - k) for k, o in enumerate(octets[fixed:])) - first
        while True:
            at = Permutation(key, f"{kind} {form}", n).moved(at)
            made = ".".join(octets[:fixed] + [str(b) for b in (at + first).to_bytes(4 - fixed, "big")])
            if form_of(kind, made) == form:
                return made
    text = value[1:-1] if kind == "card" else value[4:] if kind == "iban" else value
    n = at = 0
    for c in text:
        size = 10 if c.isdigit() else 26
        at, n = at * size + int(c, 36) - (10 if size == 26 else 0), max(1, n) * size
    at, out = Permutation(key, f"{kind} {form}", max(1, n)).moved(at), []
    for c in reversed(text):
        at, x = divmod(at, 10 if c.isdigit() else 26)
        out.append(str(x) if c.isdigit() else chr(65 + x))
    body = "".join(reversed(out))
    if kind == "card":
        return value[0] + body + str((_check(value[0] + body) + int(value[-1]) - _check(value[:-1])) % 10)
    if kind == "iban":
        return next(made for k in range(2, 99) if iban_rest(made := f"{value[:2]}{k:02d}{body}") == 1)
    return body


def surrogate(kind: str, value: str, attempt: int, key: bytes) -> str:
    """The canonical surrogate of a part; attempt -1 is the permutation of its form."""
    if attempt < 0:
        return permuted(kind, value, key)
    draw = Draw(key, kind, value, attempt)
    extra = attempt // 4
    if kind == "local":
        local, _ = value.rsplit("@", 1)
        return "".join(like(c, draw) for c in local + "x" * extra)
    if kind == "domain":
        *labels, top = value.split(".")
        return ".".join(["".join(like(c, draw) for c in x + "x" * extra) for x in labels] + [top])
    if kind in ("phone", "ssn"):
        return "".join(draw.pick("0123456789") for _ in value)
    if kind == "card":
        body = value[0] + "".join(draw.pick("0123456789") for _ in value[1:-1])
        check = next(d for d in "0123456789" if luhn(body + d) == 0)
        if luhn(value) == 0:
            return body + check
        return body + draw.pick("0123456789".replace(check, ""))
    if kind == "iban":
        body = "".join(draw.pick("0123456789") if c.isdigit() else draw.pick("ABCDEFGHIJKLMNOPQRSTUVWXYZ") for c in value[4:])
        return next(made for n in range(2, 99) if iban_rest(made := f"{value[:2]}{n:02d}{body}") == 1)
    if kind == "ip":
        a, b, *_ = map(int, value.split("."))
        fixed = ["10"] if a == 10 else ["127"] if a == 127 else ["192", "168"] if (a, b) == (192, 168) else \
            ["172", str(16 + draw.below(16))] if a == 172 and 16 <= b < 32 else []
        if not fixed:
            fixed = [str(next(x for x in iter(lambda: 1 + draw.below(223), None) if x not in (10, 127, 172, 192)))]
        return ".".join(fixed + [str(1 + draw.below(254)) for _ in range(4 - len(fixed))])
    if script_of(value) in RANGES:
        return "".join(_in_range(script_of(value), draw) for _ in range(len(value) + extra))
    consonants, vowels, endings = SCRIPTS[script_of(value)]
    ends = endings[kind[-1]] if kind.startswith("given-") else tuple(consonants)
    syllables = max(1, min(4, (len(value) - 1) // 2)) + extra
    return "".join(draw.pick(consonants) + draw.pick(vowels) for _ in range(syllables)) + ends[draw.below(len(ends))]


def shaped(kind: str, found: str, values: list[str]) -> str:
    """The surrogates of a span's parts in the layout and case of what was found."""
    if kind == "email":
        local, domain = found.rsplit("@", 1)
        return _case(local, values[0]) + "@" + _case(domain, values[1])
    if kind == "iban":
        rest = iter(values[0])
        return "".join(next(rest) if c.isalnum() else c for c in found)
    if kind in ("phone", "card", "ssn"):
        rest = iter((digits_of(found)[:national(found)] if kind == "phone" else "") + values[0])
        return "".join(digit_like(c, int(next(rest))) if c.isdecimal() else c for c in found)
    if kind == "ip":
        return values[0]
    words = iter(values)
    return re.sub(r"\S+", lambda m: _case(m[0], next(words)), found)


def _case(found: str, made: str) -> str:
    if found.isupper():
        return made.upper()
    return made[:1].upper() + made[1:] if found[:1].isupper() else made


def replaced(text: str, key: bytes, redrawn: dict[tuple[str, str], tuple[int, str]]) -> tuple[str, Counter]:
    """``text`` with surrogates, and the number of spans by kind. ``redrawn``:
    attempt and gender of parts that have others than the first and the one this text tells."""
    out, at, kinds = [], 0, Counter()
    spans = detect(text)
    own = genders(text, spans)
    for span in spans:
        start, end, kind, _ = span
        values = []
        for k, v in span_parts(text, span):
            attempt, gender = redrawn.get((k, v)) or (0, told(own[v]["m"], own[v]["f"]) if v in own else "u")
            values.append(surrogate(f"given-{gender}" if k == "given" else k, v, attempt, key))
        out += [text[at:start], shaped(kind, text[start:end], values)]
        at = end
        kinds["name" if kind in ("given", "surname") else kind] += 1
    return "".join([*out, text[at:]]), kinds


_OCCURRENCE = pa.schema([("document", pa.int64()), ("kind", pa.string()), ("value", pa.string()), ("m", pa.int64()), ("f", pa.int64())])


def document_key():
    """The same in both passes, for null ids too; equal only for rows whose answers are equal."""
    return F.xxhash64("doc_id", "text")


def occurrences(docs: DataFrame) -> DataFrame:
    """(document, kind, value, m, f): the parts of each document, once, and how many titles tell which gender."""
    def rows(document: int, text: str) -> list[tuple]:
        spans = detect(text)
        own = genders(text, spans)
        return [(document, k, v, own[v]["m"] if k == "given" and v in own else 0, own[v]["f"] if k == "given" and v in own else 0)
                for k, v in sorted({p for s in spans for p in span_parts(text, s)})]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [r for d, t in zip(b.column("document").to_pylist(), b.column("text").to_pylist()) if t for r in rows(d, t)]
            yield pa.RecordBatch.from_pydict(dict(zip(_OCCURRENCE.names, map(list, zip(*made)))) if made else
                                             {n: [] for n in _OCCURRENCE.names}, schema=_OCCURRENCE)

    return docs.select(document_key().alias("document"), "text").mapInArrow(run, "document long, kind string, value string, m long, f long")


def gender_of(m: Column, f: Column) -> Column:
    return F.when(m > f, "m").when(f > m, "f").otherwise("u")


def used_up(pending: DataFrame, parts: DataFrame) -> DataFrame:
    """(kind, value) of all ``parts`` whose form has a value in ``pending``; of fixed kinds."""
    def formed(df: DataFrame) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                forms = [form_of(k, v) for k, v in zip(b.column("kind").to_pylist(), b.column("value").to_pylist())]
                yield b.append_column("form", pa.array(forms, pa.string()))

        return df.where(F.col("kind").isin(*FIXED)).select("kind", "value").mapInArrow(run, "kind string, value string, form string")

    return formed(parts).join(formed(pending).select("kind", "form").distinct(), ["kind", "form"], "left_semi").select("kind", "value")


def redraws(parts: DataFrame, key: bytes, rounds: int = ROUNDS) -> DataFrame:
    """(kind, value, attempt) of the parts (kind, value, and gender of given
    names) whose first draw can't be taken; -1 where a form is used up.

    In each round a draw is taken if it is no part of the corpus, was not taken
    before, and no smaller value draws the same.
    """
    schema = "kind string, value string, attempt int, made string"
    if "gender" not in parts.columns:
        parts = parts.withColumn("gender", F.lit("u"))

    def drawn(pending: DataFrame, attempt: int) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                kinds, values, told_ = (b.column(c).to_pylist() for c in ("kind", "value", "gender"))
                yield pa.RecordBatch.from_pydict(
                    {"kind": kinds, "value": values, "attempt": [attempt] * len(kinds),
                     "made": [scoped(k, v, surrogate(f"given-{g}" if k == "given" else k, v, attempt, key))
                              for k, v, g in zip(kinds, values, told_)]},
                    schema=pa.schema([("kind", pa.string()), ("value", pa.string()), ("attempt", pa.int32()), ("made", pa.string())]))

        return pending.select("kind", "value", "gender").mapInArrow(run, schema)

    # Given names of all genders are one space: a surrogate must be nobody's name.
    real = parts.select(F.col("kind").alias("space"), F.col("value").alias("made")).distinct()
    pending, taken, done, attempt = parts, None, None, 0
    while True:
        draws = written(drawn(pending, attempt).withColumn("space", F.col("kind")), "pii-draws")
        first = draws.groupBy("space", "made").agg(F.min(F.struct("kind", "value")).alias("first"))
        first = first.join(real, ["space", "made"], "left_anti")
        if taken is not None:
            first = first.join(taken, ["space", "made"], "left_anti")
        got = written(first.select("space", "made", "first.kind", "first.value"), "pii-taken")
        done_now = got.select("kind", "value", F.lit(attempt).alias("attempt"))
        pending = written(pending.join(got.select("kind", "value"), ["kind", "value"], "left_anti").select("kind", "value", "gender"), "pii-pending")
        now = got.select("space", "made")
        taken = now if taken is None else taken.unionByName(now)
        if attempt:
            done = done_now if done is None else done.unionByName(done_now)
        attempt += 1
        if attempt == rounds:
            moved = written(used_up(pending, parts), "pii-moved").withColumn("attempt", F.lit(-1))
            done = done.join(moved, ["kind", "value"], "left_anti").unionByName(moved)
            pending = pending.where(~F.col("kind").isin(*FIXED))  # the others grow, and find room
        if pending.isEmpty():
            return done if done is not None else done_now.limit(0)


def scoped(kind: str, value: str, made: str) -> str:
    """A local part must differ within its domain; the others anywhere."""
    return made + "@" + value.rsplit("@", 1)[1] if kind == "local" else made


def surrogates(docs: DataFrame, key: bytes, carry: list[str]) -> DataFrame:
    """``carry`` and ``text`` with surrogates, n_entities and kinds (``kind:number``, joined by commas)."""
    found = written(occurrences(docs), "pii-parts")
    parts = written(found.groupBy("kind", "value").agg(gender_of(F.sum("m"), F.sum("f")).alias("gender")), "pii-values")
    again = redraws(parts, key)
    resolved = written(parts.join(again, ["kind", "value"], "left").select("kind", "value", "gender", F.coalesce("attempt", F.lit(0)).alias("attempt")),
                       "pii-resolved")
    told_here = gender_of(F.col("m"), F.col("f"))
    by_document = written(found.join(resolved, ["kind", "value"]).where((F.col("attempt") != 0) | (F.col("gender") != told_here)).groupBy("document").agg(
        F.collect_set(F.struct("kind", "value", "attempt", "gender")).alias("redrawn")), "pii-by-document")
    others = [c for c in carry if c != "text"]
    texts = (docs.select(*others, "text", document_key().alias("document")).join(by_document, "document", "left")
             .select(*others, "text", "redrawn"))
    added = [("text", pa.string()), ("n_entities", pa.int64()), ("kinds", pa.string())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = []
            for text, redrawn in zip(b.column("text").to_pylist(), b.column("redrawn").to_pylist()):
                again = {(r["kind"], r["value"]): (r["attempt"], r["gender"]) for r in redrawn or ()}
                new, kinds = replaced(text or "", key, again)
                made.append((None if text is None else new, kinds.total(), ",".join(f"{k}:{kinds[k]}" for k in sorted(kinds))))
            columns = [pa.array([m[i] for m in made], t) for i, (_, t) in enumerate(added)]
            carried = b.select(others)
            yield pa.RecordBatch.from_arrays([*carried.columns, *columns],
                                             schema=pa.schema([*carried.schema, *(pa.field(n, t) for n, t in added)]))

    schema = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*others).schema]
    return texts.mapInArrow(run, ", ".join([*schema, "text string", "n_entities long", "kinds string"]))


def op1_pii_surrogates(spark: SparkSession, sf_dir: str, key: bytes = b"replace this key in production") -> DataFrame:
    """Every document with surrogates for personal data."""
    return surrogates(read_table(spark, sf_dir, "documents"), key, ["doc_id"])
