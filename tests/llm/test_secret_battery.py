"""The randomness battery, its thresholds and many spans in one text, against plain versions."""
import math
import random
import re
import time
from collections import Counter

import pyspark.sql.functions as F

from llm_support import edges, prose  # noqa: F401
from strike_analytics.llm import secret_scan as S

ALPHABETS = {"hex": "0123456789abcdef", "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
             "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"}


def plain_encoding(body):
    for name, pattern in ((None, "[0-9]+"), ("hex", "[0-9a-f]+"), ("HEX", "[0-9A-F]+"), ("base32", "[A-Z2-7]+")):
        if re.fullmatch(pattern, body):
            return name
    return "base64"


def plain_surprise(token):
    body = token.rstrip("=")
    size, s2, s3 = S.ENCODINGS[plain_encoding(body)]
    n = len(body)
    chi = size * sum(c * c for c in Counter(body).values()) / n - n
    mean = size * (1 + (n - 1) * s2) - n
    deviation = size / n * math.sqrt(4 * n * (n - 1) * (n - 2) * (s3 - s2 * s2) + 2 * n * (n - 1) * (s2 - 2 * s3 + s2 * s2))
    kind = ["a" if c.islower() else "A" if c.isupper() else "0" if c.isdigit() else "+" for c in body]
    changes = sum(a != b for a, b in zip(kind, kind[1:]))
    runs = (changes - 0.5 - S.CHANGES * (n - 1)) / math.sqrt((n - 1) * S.CHANGES * (1 - S.CHANGES))
    codes = [ord(c) for c in body]
    centre = sum(codes) / n
    spread = sum((c - centre) ** 2 for c in codes)
    serial = min(1.0, abs(sum((a - centre) * (b - centre) for a, b in zip(codes, codes[1:])) / spread)) if spread > 1e-6 else 1.0
    z = ((mean - chi) / deviation + runs + (S.SERIAL - serial) * math.sqrt(n)) / math.sqrt(3)
    uniform = abs(chi - (size - 1)) / math.sqrt(2 * (size - 1)) <= S.FAR
    return z * z / 2 + math.log(2) if uniform and z > 0 else 0.0


def plain_base(text):
    out = []
    for k, p in enumerate(S.PATTERNS.values()):
        out += [(m.start(), k, m.end()) for m in re.finditer(p, text) if k or len(m[1]) >= 6]
    return sorted(out)


def plain_spans(texts, rate):
    found = [[(m.start(), m.end(), plain_encoding(m[0].rstrip("=")), m[0]) for m in re.finditer(S.CANDIDATE, t)] for t in texts]
    steps = [[(a, b, e, int(math.log2(b - a)), min(S.STEPS, math.floor(plain_surprise(m) / S.STEP))) for a, b, e, m in x if e] for x in found]
    least = {}
    for group in {(e, n) for x in steps for *_, e, n, _ in x}:
        of = [s for x in steps for *_, e, n, s in x if (e, n) == group]
        good = [s for s in set(of) if math.exp(-s * S.STEP) <= rate * sum(t >= s for t in of) / len(of)]
        if good:
            least[group] = min(good)
    out = []
    for t, x in zip(texts, steps):
        base = plain_base(t)
        out.append(sorted(base + [(a, 3, b) for a, b, e, n, s in x if s >= least.get((e, n), math.inf)
                                  and not any(p < b and a < q for p, _, q in base)]))
    return out


def texts_with_secrets(seed, n):
    rng = random.Random(seed)
    out = []
    for k in range(n):
        parts = prose(seed * 1000 + k, 12).split()
        for _ in range(rng.randint(0, 3)):
            name = rng.choice(list(ALPHABETS))
            token = "".join(rng.choice(ALPHABETS[name]) for _ in range(rng.choice([16, 20, 40, 64])))
            parts.insert(rng.randint(0, len(parts)), rng.choice(["", "", "key ", "password=", "é "]) + token)
        parts += rng.choice([["a-name-of-several-words"], ["some_long_identifier_of_code"], ["abcdefghijklmnopqrstuvwxyz"], ["0123456789" * 3], ["x" * 30]])
        out.append(" ".join(parts))
    return out


def test_spans_equal_the_plain_ones(spark):
    texts = texts_with_secrets(1, 80)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: [(s.start, s.kind, s.end) for s in r.every] for r in S.with_spans(df, 0.01).collect()}
    want = plain_spans(texts, 0.01)
    assert [got[k] for k in range(len(texts))] == want
    assert sum(k == 3 for x in want for _, k, _ in x) > 20


def test_running_is_a_prefix_scan(spark, monkeypatch):
    monkeypatch.setattr(S, "BLOCK", 4)
    rng = random.Random(3)
    rows = [([rng.randint(-5, 9) for _ in range(n)],) for n in (0, 1, 3, 4, 5, 8, 9, 50)]
    df = spark.createDataFrame(rows, "v array<int>").select("v", S.running(F.col("v"), lambda a, b: a + b).alias("s"), S.running(F.col("v"), F.greatest).alias("m"))
    for r in df.collect():
        assert r.s == [sum(r.v[:k + 1]) for k in range(len(r.v))] and r.m == [max(r.v[:k + 1]) for k in range(len(r.v))]


def test_one_text_with_very_many_spans(spark):
    text = " ".join(f"password: ab{k:06d}é AKIA{'Z' * 16}" for k in range(20_000))
    df = spark.createDataFrame([(1, text, 5)], "doc_id long, text string, n_chars long")
    start = time.time()
    row = S.redact_secrets(df).first()
    assert time.time() - start < 60
    assert row.text == " ".join(["[SECRET]é [SECRET]"] * 20_000) and row.n_chars == len(row.text)


def test_redaction_equals_the_plain_one_and_keeps_columns(spark, monkeypatch):
    monkeypatch.setattr(S, "BLOCK", 3)
    texts = texts_with_secrets(2, 30) + ["", "none", "password=secret=token=abcdef1234567 AKIA" + "Q" * 20, "😀 passwd: 'aaaaaaa' 😀", "a" * 24 + "secret:bbbbbbbb"]
    names = ["random", "base", "Every", "__random"]
    df = spark.createDataFrame([(k, t, len(t), *[7] * len(names)) for k, t in enumerate(texts)],
                               "doc_id long, text string, n_chars long" + "".join(f", {n} int" for n in names))
    got = S.redact_secrets(df)
    assert got.columns == df.columns
    rows = {r.doc_id: r for r in got.collect()}
    for k, (text, spans) in enumerate(zip(texts, plain_spans(texts, 0.01))):
        out, at = "", 0
        for a, _, b in spans:
            if a >= at:
                out += text[at:a] + "[SECRET]"
            at = max(at, b)
        assert rows[k].text == (out + text[at:] if spans else text) and rows[k].n_chars == len(rows[k].text)
        assert list(rows[k])[3:] == [7] * len(names)
