"""Entities, scripts and used-up forms of the surrogates."""
import random
import re
import unicodedata

import pytest

from strike_analytics.llm import pii

KEY = b"k"


def surrogates(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [r.text for r in sorted(pii.surrogates(df, KEY, ["doc_id"]).collect(), key=lambda r: r.doc_id)]


def test_one_person_one_surrogate_whatever_the_title(spark):
    texts = ["Dr. Anna Smith met Mrs. Anna Smith. Anna's friend Smith-Jones left.", "Dr. Anna Smith wrote.", "Dr. Kim Lee met Dr. Kim Lee"]
    new = surrogates(spark, texts)
    first = re.match(r"Dr\. (\w+) (\w+) met Mrs\. (\w+) (\w+)\. (\w+)'s friend (\w+)-Jones left\.", new[0])
    assert first[1] == first[3] == first[5] and first[2] == first[4] == first[6]
    assert new[1] == f"Dr. {first[1]} {first[2]} wrote."                    # the gender that another document tells
    assert first[1].lower().endswith(pii.SCRIPTS["latin"][2]["f"]) and first[1] != "Anna"


def test_one_phone_one_surrogate_with_and_without_its_country_code(spark):
    new, = surrogates(spark, ["+1 212-555-0100 or 212-555-0100 or (212) 555-0100 or +12125550100"])
    found = re.match(r"\+1 (\d{3}-\d{3}-\d{4}) or (\d{3}-\d{3}-\d{4}) or \((\d{3})\) (\d{3}-\d{4}) or \+1(\d{10})$", new)
    assert found[1] == found[2] == f"{found[3]}-{found[4]}" and found[5] == found[1].replace("-", "") and "555-0100" not in new


@pytest.mark.parametrize("text,script", [("Mr. محمد علي", "ARABIC"), ("Mr. 王小明", "CJK"), ("Mr. דוד כהן", "HEBREW"), ("Mr. राम शर्मा", "DEVANAGARI"),
                                         ("Mr. 김철수", "HANGUL"), ("Mr. Ярослав Петров", "CYRILLIC"), ("Mr. Γιώργος Παππάς", "GREEK")])
def test_names_keep_their_script(spark, text, script):
    new, = surrogates(spark, [text])
    letters = [c for c in new.removeprefix("Mr. ") if c.isalpha()]
    assert letters and all(unicodedata.name(c).startswith(script) for c in letters) and new != text


def test_digits_keep_their_script():
    text = "card ٤٥٣٢-٠١٥١-١٢٨٣-٠٣٦٦ end"
    new, kinds = pii.replaced(text, KEY, {})
    assert kinds["card"] == 1 and new != text
    assert re.fullmatch(r"card [٠-٩]{4}-[٠-٩]{4}-[٠-٩]{4}-[٠-٩]{4} end", new) and pii.luhn(pii.digits_of(new)) == 0


@pytest.mark.parametrize("n", [1, 2, 3, 10, 97, 1000])
def test_a_permutation_moves_each_and_keeps_them_distinct(n):
    moved = [pii.Permutation(KEY, "x", n).moved(x) for x in range(n)]
    assert sorted(moved) == list(range(n)) and (n == 1 or all(x != y for x, y in enumerate(moved)))


@pytest.mark.parametrize("kind,values", [
    ("ip", [f"192.168.{a}.{b}" for a in (0, 7, 255) for b in range(256)]), ("ip", ["8.8.8.8", "172.31.0.9", "172.16.255.255", "10.0.0.0", "223.1.2.3"]),
    ("ssn", ["123456789", "000000000"]), ("card", ["4532015112830366", "4532015112830360", "4532015112830367"]),
    ("iban", ["DE89370400440532013000", "GB82WEST12345698765432"]), ("phone", ["2125550100", "2125550101"])])
def test_permuted_values_keep_their_form(kind, values):
    made = [pii.surrogate(kind, v, -1, KEY) for v in values]
    assert len(set(made)) == len(set(values)) and not any(a == b for a, b in zip(made, values))
    assert [pii.form_of(kind, m) for m in made] == [pii.form_of(kind, v) for v in values]


def test_a_corpus_that_holds_a_whole_block(spark, monkeypatch):
    """No address of 192.168.0.0/16 is free; the others draw as ever."""
    monkeypatch.setattr(pii.redraws, "__defaults__", (3,))
    addresses = [f"192.168.{a}.{b}" for a in range(256) for b in range(256)]
    texts = [" ".join(addresses[i:i + 4096]) for i in range(0, 65536, 4096)] + ["8.8.4.4 and 10.1.2.3"]
    new = surrogates(spark, texts)
    made = " ".join(new[:16]).split()
    assert sorted(made) == sorted(addresses) and not any(a == b for a, b in zip(made, addresses))
    assert re.fullmatch(r"\d+\.\d+\.\d+\.\d+ and 10\.\d+\.\d+\.\d+", new[16]) and "8.8.4.4" not in new[16]


def test_distinct_and_coreferent_over_a_corpus(spark):
    """Over all documents: equal entities get equal surrogates, different ones different, none is an entity of the corpus."""
    rng = random.Random(1)
    given = ["anna", "john", "maria", "li", "omar", "eva"]
    people = [(rng.choice(["Mr.", "Mrs.", "Dr."]), rng.choice(given).title(), f"Sur{rng.choice('abcdefgh')}{rng.choice('aeiou')}n") for _ in range(60)]
    mails = [f"{rng.choice('abcd')}{rng.randint(0, 9)}@m{rng.randint(0, 3)}.org" for _ in range(60)]
    phones = [f"555-01{rng.randint(0, 9)}-{rng.randint(1000, 1020)}" for _ in range(60)]
    texts = [f"{t} {g} {s} | {m} | {p}" for (t, g, s), m, p in zip(people, mails, phones)]
    new = surrogates(spark, texts)
    for place in ("given", "surname", "mail", "phone"):
        pairs = set()
        for (t, g, s), m, p, row in zip(people, mails, phones, new):
            a, b, c = row.split(" | ")
            _, g2, s2 = a.split(" ")
            pairs.add({"given": (g, g2), "surname": (s, s2), "mail": (m, b), "phone": (p, c)}[place])
        assert len({x for x, _ in pairs}) == len({y for _, y in pairs}) == len(pairs)
        assert not {x for x, _ in pairs} & {y for _, y in pairs}
