"""Hard negatives, language-model scores and phrases against plain versions."""
import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pyspark.sql.functions as F
import pytest

from llm_support import DOCUMENT, EDGES, edges, no_rows, prose  # noqa: F401
from strike_analytics.llm import hard_negatives as hn
from strike_analytics.llm import phrases, ppm

# --- hard negatives

VECTORS = "vec_id long, embedding array<float>, label int, query int, leaf string"


def plain_negatives(rows, every, positives=5, negatives=5):
    fine = [(i, [math.floor(256 * x) for x in v], y) for i, v, y, *_ in rows
            if i is not None and y is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = set()
    for a, va, ya in fine:
        if a % every:
            continue
        scored = sorted((-sum(x * y for x, y in zip(va, v)), i, y) for i, v, y in fine if i != a)
        for s, p, _ in [x for x in scored if x[2] == ya][:positives]:
            found = [x for x in scored if x[2] != ya and 80 * -s <= 100 * -x[0] <= 100 * -s][:negatives]
            out |= {(a, p, k + 1, n, -s, -t) for k, (t, n, _) in enumerate(found)}
    return out


def vectors(seed, n, d, hot=0.0):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        v = [0.25] * d if rng.random() < hot else np.round(rng.normal(0, 0.4, d), 2).tolist()
        rows.append((i, v, int(rng.integers(0, 3)), 1, "x"))
    return rows


@pytest.mark.parametrize("seed,hot,d", [(1, 0.0, 3), (2, 0.4, 3), (3, 0.0, 16)])
def test_negatives_equal_the_plain_ones(spark, monkeypatch, seed, hot, d):
    rows = vectors(seed, 400, d, hot)
    rows += [(None, [1.0] * d, 1, 1, "x"), (1000, None, 1, 1, "x"), (1010, [1.0] * d, None, 1, "x"), (1020, [float("nan")] * d, 1, 1, "x"),
             (1030, [None] * d, 1, 1, "x"), (1040, [float("inf")] + [0.0] * (d - 1), 1, 1, "x"), (1050, [], 1, 1, "x"), (1060, [0.5] * (d - 1), 2, 1, "x")]
    monkeypatch.setattr(hn.Index.search, "__defaults__", (64, 8))  # several parts of a leaf, several blocks of queries
    df = spark.createDataFrame(rows, VECTORS)
    q = hn.quantized(df, F.col("vec_id"), F.col("embedding"), F.col("label"))
    got = [tuple(r) for r in hn.hard_negatives(q, F.col("vec_id") % 20 == 0, sample=200).collect()]
    assert len(got) == len(set(got))
    assert set(got) == plain_negatives(rows, 20)


def test_ranges_eliminate(spark):
    """Clusters far apart: an anchor visits few of the leaves."""
    rng = np.random.default_rng(5)
    centres = rng.normal(0, 1, (20, 8))
    rows = (centres.repeat(100, axis=0) + rng.normal(0, 0.01, (2000, 8))) * 256
    rows = np.floor(rows).astype(np.int64)
    most = float((rows * rows).sum(1).max())
    tree = hn.Tree(rows[::5], np.zeros(400, int), np.arange(400), most)
    seen = {}
    for node, i, _, d in tree.walk(tree.lengthened(rows.astype(float))):
        for j in range(d.shape[1]):
            a, b = seen.get((node, i, j), (np.inf, -np.inf))
            seen[node, i, j] = min(a, d[:, j].min()), max(b, d[:, j].max())
    tree.with_ranges([(*k, *v) for k, v in seen.items()])
    query = rows[:1].astype(float)
    s = np.sort(rows @ rows[0])[::-1]
    outer = np.array([[math.sqrt((query @ query.T)[0, 0] + most - 2 * s[5]) + 1]])
    visited = [leaf for leaf, _ in tree.visits(query, np.zeros((1, 1)), outer)]
    assert 0 < len(visited) < tree.leaves / 3
    near = np.flatnonzero(rows @ rows[0] >= s[5])
    assert set(tree.leaf_of(tree.lengthened(rows[near].astype(float))).tolist()) <= set(visited)


def test_negatives_repeated_equal_and_no_rows(spark):
    same = [(i, [0.5, 0.5], i % 2, 1, "x") for i in range(30)]
    q = lambda rows: hn.quantized(spark.createDataFrame(rows, VECTORS), F.col("vec_id"), F.col("embedding"), F.col("label"))
    got = {tuple(r) for r in hn.hard_negatives(q(same), F.col("vec_id") % 10 == 0).collect()}
    assert got == plain_negatives(same, 10)
    twice = {tuple(r) for r in hn.hard_negatives(q(same[:12] + [same[0], same[0]]), F.col("vec_id") % 10 == 0).collect()}
    assert twice >= {(0, 2, 1, 1, 32768, 32768)} and all(r[0] not in (r[1], r[3]) for r in twice)
    assert hn.hard_negatives(q([]), F.col("vec_id") % 10 == 0).count() == 0
    assert hn.hard_negatives(q(same), F.col("vec_id") < 0).count() == 0


def test_long_vectors_are_refused(spark):
    q = hn.quantized(spark.createDataFrame([(1, [1e30], 1, 1, "x")], VECTORS), F.col("vec_id"), F.col("embedding"), F.col("label"))
    with pytest.raises(Exception, match="too large"):
        q.collect()


# --- language-model scores

def scored(rows, order, block=1 << 23):
    spark = rows.sparkSession
    df = ppm.score_texts(rows, F.crc32(F.col("doc_id").cast("string")) % 3 != 2, order, block)
    assert spark is df.sparkSession
    return df.collect()


def plain_scores(rows, order):
    """By (doc_id, text): what the trie that learned the same texts gives."""
    import zlib
    learn = lambda i: i is None or zlib.crc32(str(i).encode()) % 3 != 2
    trie, count = ppm.Trie(order), Counter()
    for i, text, *_ in rows:
        if learn(i):
            trie.code(text, predict=False)
            count.update([*ppm.symbols(text).split(), None])
    n, v, out = sum(count.values()), len(count), []
    for i, text, *_ in rows:
        words = [*ppm.symbols(text).split(), None]
        out.append((i, learn(i), len(words), sum(count[w] > 0 for w in words), n, sum(math.log10((count[w] + 1) / (n + v + 1)) for w in words),
                    trie.code(text, learn=False)))
    return out


def same_scores(got, expected):
    got = sorted(((r.doc_id, r.learn, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in got),
                 key=lambda r: (r[0] is None, r[0] or 0, r[5]))
    expected = sorted(expected, key=lambda r: (r[0] is None, r[0] or 0, r[5]))
    assert [r[:5] for r in got] == [r[:5] for r in expected]
    np.testing.assert_allclose([r[5:] for r in got], [r[5:] for r in expected], rtol=1e-9)


@pytest.mark.parametrize("order,block", [(0, 100), (4, 1 << 23), (5, 2000)])
def test_scores_equal_the_trie(spark, order, block):
    rng = random.Random(order)
    rows = [(k, prose(k, rng.randint(0, 60)) + rng.choice(["", " ÄÖ", "\0", " ABC"])) for k in range(60)]
    same_scores(scored(spark.createDataFrame(rows, "doc_id long, text string"), order, block), plain_scores(rows, order))


def test_scores_edges(spark, edges, no_rows):  # noqa: F811
    short = [r for r in EDGES if len(r[1] or "") < 10_000]
    got = scored(edges, 3, 4000)
    assert len(got) == len(EDGES)
    expected = plain_scores(EDGES, 3)
    same_scores(got, expected)
    assert len(short) < len(EDGES)
    assert scored(no_rows, 4) == []
    nothing = ppm.score_texts(spark.createDataFrame([(1, "ab")], "doc_id long, text string"), F.lit(False)).first()
    assert nothing.n_known == 0 and nothing.train_tokens == 0
    assert nothing.score == pytest.approx(-3 * math.log10(257)) and nothing.base_score == 0


def test_probabilities_add_up():
    """A trie's next symbols: no more than 1, and near it."""
    trie = ppm.Trie(3)
    trie.code("abracadabra abracadabra", predict=False)
    for text in (b"", b"abr", b"zzz", b"a"):
        total = sum(10 ** trie.step(text, len(text), s) for s in range(257))
        assert 0.999999 < total < 1.000001


def test_adaptive(spark):
    rows = [(1, "abcabcabc" * 30), (2, "".join(random.Random(1).choices("abcdefghij", k=270))), (3, None)]
    got = {r.doc_id: r.adaptive_score for r in ppm.adaptive_scores(spark.createDataFrame(rows, "doc_id long, text string"), ["doc_id"]).collect()}
    assert got[1] > got[2] / 2 and got[3] == pytest.approx(-math.log10(257))


# --- phrases

def plain_phrases(rows, support, limit, covered=80):
    """The contract, word for word, over all phrases."""
    n, f = Counter(), Counter()
    for _, text, lang, *_ in rows:
        lang = lang if lang is not None else "und"
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            words = tuple(re.findall(r"[^\x20\x09]+", piece))
            n[lang] += len(words)
            f.update((lang, words[i:i + k]) for k in range(1, 5) for i in range(len(words) - k + 1))
    found = {key: a for key, a in f.items() if len(key[1]) > 1 and a >= support}
    out = set()
    for lang in n:
        ranked = []
        for (of, w), a in found.items():
            if of != lang:
                continue
            inside = any(l2 == lang and len(w2) > len(w) and 100 * b >= covered * a
                         and any(w2[i:i + len(w)] == w for i in range(len(w2))) for (l2, w2), b in found.items())
            if not inside:
                score, k, l, r = min((2_000_000 * a // (f[lang, w[:k]] + f[lang, w[k:]]), k, f[lang, w[:k]], f[lang, w[k:]])
                                     for k in range(1, len(w)))
                ranked.append((-score, -a, " ".join(w).encode(), l, r))
        for rank, (s, a, p, l, r) in enumerate(sorted(ranked)[:limit], 1):
            out.add((lang, rank, p.decode(), -a, l, r, n[lang], -s))
    return out


def collocated(seed, n, langs=("en", "de", None)):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(12)] + ["Ä", "NEW", "york", "\0", "a　b"]
    rows = []
    for k in range(n):
        text = ""
        for _ in range(rng.randint(0, 40)):
            text += rng.choice([*words, "new york city", "of the new world"]) + rng.choice([" "] * 9 + [". ", "\t", "\n", ",x;"])
        rows.append((k, text, rng.choice(langs)))
    return rows


@pytest.mark.parametrize("fraction,slice_chars", [(2, 1 << 22), (40, 300), (10**9, 5000)])
def test_phrases_equal_the_plain_ones(spark, fraction, slice_chars):
    """Whatever the sample (with 10**9 there is none: all is found by the border's failures)."""
    rows = collocated(fraction % 7, 120)
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("phrase", F.lit(1)).withColumn("k", F.lit(2))
    for support, limit in ((5, 2000), (8, 7)):
        got = [tuple(r) for r in phrases.collocations(df, support, limit, fraction=fraction, slice_chars=slice_chars).collect()]
        assert len(got) == len(set(got))
        assert set(got) == plain_phrases(rows, support, limit)


def test_phrases_edges(spark, edges, no_rows):  # noqa: F811
    got = {tuple(r) for r in phrases.collocations(edges, 2).collect()}
    assert got == plain_phrases(EDGES, 2, 2000)
    assert phrases.collocations(no_rows).count() == 0


def test_a_filter_that_holds_everything_changes_nothing(spark, monkeypatch):
    """A full filter counts more, and the same comes out."""
    rows = collocated(3, 40)
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    plain = phrases.with_phrases
    monkeypatch.setattr(phrases, "with_phrases", lambda f, p: plain(f, p) | ~np.uint64(0))
    assert {tuple(r) for r in phrases.collocations(df, 4).collect()} == plain_phrases(rows, 4, 2000)


def test_scores_of_counts_past_64_bits(spark):
    """The score's arithmetic for counts whose product with 2000000 passes 64 bits."""
    row = spark.sql("SELECT CAST(9000000000000000000 AS BIGINT) AS a").select(
        (phrases._exact("a") * F.lit(2_000_000).cast("decimal(7,0)")).alias("two"), (phrases._exact("a") + phrases._exact("a")).alias("sum"))
    assert row.select(F.expr("two div sum")).first()[0] == 1_000_000


def test_phrase_passes_hold_little(spark, monkeypatch):
    """Hashes are dealt out before they are added up, and a task has one Python worker."""
    docs = spark.createDataFrame([("a b c d", "en", True)], "text string, lang string, sampled boolean")
    now, plan = np.zeros(phrases.FILTER_BITS // 64, np.uint64), lambda df: df._jdf.queryExecution().executedPlan().toString()
    with phrases.Shipped(spark, None, now) as filters:
        counting = plan(phrases.likely(phrases.sliced(docs, 1 << 10), filters, 2))
    before_dealing = counting[counting.rindex("Exchange hashpartitioning"):]
    assert "MapInArrow" in before_dealing and "HashAggregate" not in before_dealing
    made = []
    monkeypatch.setattr(phrases, "_with_bits", lambda filter_, bits: made.append(plan(bits)))
    phrases.with_phrases(now, spark.createDataFrame([("en", "a b")], "lang string, phrase string"))
    assert made[0].count("MapInArrow") == 1


def test_phrase_passes_hand_over_small_batches(spark, monkeypatch):
    """Every pass of Python runs with a few MB at once; the session's own limit comes back."""
    name, plain, seen = "spark.sql.execution.arrow.maxBytesPerBatch", phrases.written, {}

    def written(df, what, **options):
        seen.setdefault(what, spark.conf.get(name))
        return plain(df, what, **options)

    monkeypatch.setattr(phrases, "written", written)
    before, rows = spark.conf.get(name), collocated(1, 40)
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert {tuple(r) for r in phrases.collocations(df, 4).collect()} == plain_phrases(rows, 4, 2000)
    assert seen.keys() >= {"phrases-slices", "phrases-proposed", "phrases-likely", "phrases-counted"}
    assert all(int(v) == phrases.BATCH for k, v in seen.items() if k != "phrases-frequent")
    assert spark.conf.get(name) == before
    sizes = lambda batches: (pa.RecordBatch.from_pydict({"rows": [b.num_rows]}) for b in batches)
    with phrases.small_batches(spark):
        large = spark.range(0, 100, 1, 1).select("id", F.expr("repeat('x', 1000000)").alias("t"))
        assert max(r.rows for r in large.mapInArrow(sizes, "rows long").collect()) <= 8


def test_phrases_are_handed_on_in_packed_blocks(spark):
    """Tasks hand on a block for a bucket, not a row for a phrase; a key takes few bytes."""
    docs = spark.createDataFrame([(" ".join(f"w{k % 4001}" for k in range(i, 40_000 + i)), "en", True) for i in (0, 5)],
                                 "text string, lang string, sampled boolean").coalesce(1)
    slices, full = phrases.sliced(docs, 1 << 22), np.full(phrases.FILTER_BITS // 64, ~np.uint64(0))
    with phrases.Shipped(spark, None, full) as two, phrases.Shipped(spark, None, full, None) as three:
        by_key = phrases.key_blocks(slices, two, 3, 6).collect()
        by_phrase = phrases.phrase_blocks(slices, three, 6).collect()
        assert {len(r) for r in (by_key, by_phrase)} == {64}
        counts = [phrases.unpacked(r.steps, r.n) for r in by_key]
        assert sum(len(k) for k, _ in counts) == 4 * 4001 and all((n == 3).all() for _, n in counts)
        assert all((k >> np.uint64(34) == r.bucket).all() for r, (k, _) in zip(by_key, counts))
        assert sum(len(r.steps) + len(r.n) for r in by_key) < 7 * 4 * 4001
        assert sum(phrases._numbers(r.n).sum() for r in by_phrase) == 4 * 80_000 - 6 - 6
        assert sum(len(r.phrases) + len(r.n) for r in by_phrase) < 10 * 4 * 4001
        assert phrases.counted(slices, three, 10**6).count() == 0
        assert phrases.counted(slices, three, 18).count() == 4 * 4001
    assert phrases.bucket_bits(0) == 6 and phrases.bucket_bits(10**10) == 14


def test_phrases_of_tasks_that_hold_little(spark, monkeypatch):
    """A task that is full hands on the rarest phrases and goes on; nothing is lost."""
    monkeypatch.setattr(phrases, "MERGED", 50)
    monkeypatch.setattr(phrases, "ADDED", 3000)
    monkeypatch.setattr(phrases, "BLOCKS", 3)
    rows = collocated(5, 80)
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert {tuple(r) for r in phrases.collocations(df, 4, slice_chars=300).collect()} == plain_phrases(rows, 4, 2000)
