"""Outliers, toxicity, language identification, surrogates and the pipeline."""
import collections
import random
import re
import zlib

import numpy as np
import pyspark.sql.functions as F

import corpus_pipeline
from llm_support import EDGES, SF, edges, no_rows, prose, table  # noqa: F401
from strike_analytics.llm import langid, outliers, pii, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def counts(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    runs = collections.Counter(tuple(words[i:i + 5]) for i in range(len(words) - 4))
    again = {j for i in range(len(words) - 4) if runs[tuple(words[i:i + 5])] > 1 for j in range(i, i + 5)}
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(again),
            len(words) < 10 or 100 * len(again) > 20 * len(words))


def test_counts(spark, edges):
    rng = random.Random(2)
    texts = [" ".join(rng.choice("a b c # <x> é \n\n \t".split(" ")) for _ in range(rng.randint(0, 60))) for _ in range(150)]
    rows = [(k, t) for k, t in enumerate(texts)] + [(1000 + k, r[1]) for k, r in enumerate(EDGES)]
    got = {r.doc_id: tuple(r)[1:6] + (r.base_failed,) for r in outliers.text_counts(
        spark.createDataFrame(rows, "doc_id long, text string"), ["doc_id"]).collect()}
    assert got == {k: counts(t) for k, t in rows}


def plain_mcd(v, prior, steps=3):
    """The same estimator in numpy: regularised concentration steps from two starts."""
    floor = np.diag(outliers.FLOOR)
    alpha = outliers.chi2_quantile(outliers.SUBSET, outliers.P)
    factor = outliers.SUBSET / outliers.chi2_cdf(alpha, outliers.P + 2)

    def mixed(rows, scale):
        m, c = rows.mean(0), scale * np.cov(rows.T, bias=True)
        if prior is not None:
            s = outliers.PRIOR / (len(rows) + outliers.PRIOR)
            d = m - prior[0]
            m, c = (1 - s) * m + s * prior[0], (1 - s) * c + s * prior[1] + s * (1 - s) * np.outer(d, d)
        return m, c

    q = np.quantile(v, [0.25, 0.5, 0.75], axis=0, method="inverted_cdf")
    best = None
    for m, c in (mixed(v, 1.0), (q[1], np.diag(((q[2] - q[0]) / 1.349) ** 2))):
        for _ in range(steps):
            d = np.einsum("ni,ij,nj->n", v - m, np.linalg.inv(c + floor), v - m)
            at = np.floor(np.log(np.maximum(d, 1e-6)) * outliers.FINE)
            order = np.sort(at)
            m, c = mixed(v[at <= order[int(np.ceil(outliers.SUBSET * len(v))) - 1]], factor)
        det = np.linalg.slogdet(c + floor)[1]
        if best is None or det < best[0] - 1e-9:
            best = (det, m, c)
    return best[1:]


def test_mcd_against_numpy(spark):
    rng = np.random.default_rng(3)
    sizes = {"a": 300, "b": 80, "c": 4}
    rows, by_group = [], {}
    for g, n in sizes.items():
        v = rng.normal([5, 1.6, 0, 0, 0.02], [1, 0.1, 0.01, 0.02, 0.03], (n, 5))
        v[: n // 5] += [0, 0.7, 2.5, 0, 0]
        by_group[g] = np.round(v * outliers.UNIT) / outliers.UNIT
        rows += [(g, "x", *map(int, np.round(r * outliers.UNIT))) for r in v]
    df = spark.createDataFrame(rows, "inner string, outer string, " + ", ".join(f"q{i} long" for i in range(5)))
    outer = outliers.mcd(df, "outer", None, None, 3, "test-mcd")
    inner = outliers.mcd(df, "inner", "outer", outer, 3, "test-mcd")
    prior = plain_mcd(np.concatenate(list(by_group.values())), None)
    r = outer.first()
    assert np.allclose([r[f"m{i}"] for i in range(5)], prior[0], atol=1e-6)
    for r in inner.collect():
        m, c = plain_mcd(by_group[r.group], prior)
        assert np.allclose([r[f"m{i}"] for i in range(5)], m, atol=1e-6)
        w = np.linalg.inv(c + np.diag(outliers.FLOOR))
        assert np.allclose([r[f"w{i}{j}"] for i, j in outliers.PAIRS], [w[i, j] for i, j in outliers.PAIRS], rtol=1e-6, atol=1e-6)


def test_estimates_compile(spark, capsys):
    """The methods that Spark generates for an estimate are small enough for the JVM to compile."""
    columns = "group string, outer string, start int, " + ", ".join(f"q{i} long" for i in range(outliers.P))
    sums = spark.createDataFrame([("a", "x", 0, 1, 2, 3, 4, 5)], columns).groupBy("group", "outer", "start").agg(*outliers.moments())
    estimate = outliers.estimates(sums, ["group", "outer", "start"], None, 1.0)
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        estimate.explain("codegen")
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(-?\d+)", capsys.readouterr().out)]
    assert sizes and all(0 < n < 8000 for n in sizes)


def test_outliers_go_and_clean_texts_stay(spark, edges, no_rows):
    rows = [(k, prose(k, 60 + k), "en", "a") for k in range(100)]
    rows += [(1000 + k, " ".join(w + "###" for w in prose(k, 80).split()), "en", "a") for k in range(15)]
    rows += [(2000 + k, prose(k, 90), None, None) for k in range(3)]
    got = {r.doc_id: r.kept for r in outliers.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert all(got[k] == (k < 1000 or k >= 2000) for k, *_ in rows)
    judged = outliers.judge(edges)
    assert judged.count() == len(EDGES) and judged.where("kept AND base_failed").count() == 0
    assert outliers.judge(no_rows).count() == 0


def test_chi_squared():
    assert abs(outliers.chi2_quantile(0.95, 5) - 11.0705) < 1e-3 and abs(outliers.chi2_cdf(11.0705, 5) - 0.95) < 1e-5


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = table(spark, "documents", sf), table(spark, "labels", sf)
    got = toxicity.op6_toxicity(spark, sf)
    rows = got.join(labels, "doc_id").where("held_out").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in rows)
    toxic = [r.predicted for r in rows if r.toxic]
    clean = [r.predicted for r in rows if not r.toxic]
    assert sum(toxic) / len(toxic) > 0.85 and sum(clean) / len(clean) < 0.03
    assert got.count() == docs.count()


def test_non_negative_risk():
    rng = np.random.default_rng(1)
    x = (rng.random((3000, 6)) < 0.3).astype(np.float32)
    truth = x[:, 0] > 0
    positive = np.concatenate([np.ones(300, bool), np.zeros(3000, bool)])
    w, b = toxicity.fit(np.concatenate([x[truth][:300], x]), positive, truth.mean())
    assert w[0] + b > 0 > b and abs(w[1:]).max() < 0.5 * w[0]


def test_toxicity_edges(spark, edges, no_rows):
    labels = spark.createDataFrame([(4, 1), (4, 0), (9, None), (None, 1), (77, 1)], "doc_id long, toxic int")
    for docs, known in ((edges, labels), (edges, labels.limit(0)), (no_rows, labels)):
        scored = toxicity.score_texts(docs, toxicity.train_classifier(docs, known), ["doc_id"])
        assert scored.count() == docs.count() and scored.where("score BETWEEN 0 AND 1").count() == docs.count()


def test_language_held_out(spark):
    sf = "/root/testdata/sf0.01"
    rows = langid.op9_language_id(spark, sf).join(table(spark, "documents", sf), "doc_id").collect()
    held = [r.lang_pred == r.lang for r in rows if r.held_out]
    assert sum(held) / len(held) > 0.98
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)


def test_tables_give_the_convolution():
    net = langid.ByteCnn(["a", "b", "c"])
    x = np.random.default_rng(2).integers(0, 256, (9, langid.WINDOW)).astype(np.uint8)
    assert np.allclose(langid.scorer(net)(x), net.forward(x)[0], atol=1e-4)


def test_gradients():
    langid_x = np.random.default_rng(2).integers(97, 110, (6, langid.WINDOW)).astype(np.uint8)
    y = np.array([0, 1, 1, 0, 1, 0])
    net = langid.ByteCnn(["a", "b"])
    for w in net.weights:
        w[...] = w.astype(np.float32)

    def loss():
        p = langid.softmax(net.forward(langid_x)[0].astype(np.float64))
        return -np.log(p[np.arange(6), y]).mean()

    for w, g in zip(net.weights, net.gradients(langid_x, y)):
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        old = w[at]
        w[at] = old + 1e-2
        high = loss()
        w[at] = old - 1e-2
        assert abs((high - loss()) / 2e-2 - g[at]) < 0.05 * abs(g[at]) + 1e-3
        w[at] = old


def test_language_edges(spark, edges, no_rows):
    identifier = langid.train_identifier(edges.where("lang IS NOT NULL"))
    got = langid.identify(edges, identifier, ["doc_id", "text"]).collect()
    for r in got:
        letters = any(c.isalpha() for c in r.text or "")
        assert (r.lang_pred != "und") == letters and 0 <= r.score <= 1
    unlearned = langid.identify(edges, langid.train_identifier(no_rows), ["doc_id"]).collect()
    assert {(r.lang_pred, r.score) for r in unlearned} == {("und", 0.0)}


PRIVATE = ["Write to Anna.Muster+x@Mail7.Example.com, or ANNA.MUSTER+X@mail7.example.com; call +1 (017) 555-7713 or (017) 555-7713.",
           "Cards 4111 1111 1111 1111, 4111111111111111 and 9000426309966109; hosts 10.1.2.3 and 8.8.4.4. Not 4.0. or 1.2.3.4.5",
           "IBAN DE89 3704 0044 0532 0130 00, number 078-05-1120. Frau Anna Schmidt met Mr. John Smith-Doe. Schmidt left, and anna too.",
           "Госпожа Иванова пришла. ИВАНОВА ушла. Dr. Müller", "nothing here"]


def test_surrogates_keep_type_and_form():
    key = b"k"
    new = [pii.replaced(t, key, {})[0] for t in PRIVATE]
    assert new == [pii.replaced(t, key, {})[0] for t in PRIVATE] and new != [pii.replaced(t, b"other", {})[0] for t in PRIVATE]
    assert new[4] == PRIVATE[4]
    form = lambda t: re.sub(r"\d", "9", re.sub(r"[^\W\d]", "a", t))
    assert form(new[0]) == form(PRIVATE[0]) and form(new[1]).count("9") >= 40
    found = [[(t[a:b], k) for a, b, k, _ in pii.detect(t)] for t in new[:2]]
    assert [k for _, k in found[0]] == ["email", "email", "phone", "phone"]
    assert found[0][0][0].lower() == found[0][1][0].lower()
    cards = [x for x, k in found[1] if k == "card"]
    assert [pii.luhn(re.sub(r"\D", "", x)) == 0 for x in cards] == [True, True, False] and cards[0].replace(" ", "") == cards[1]
    assert [x.startswith("10.") for x, k in found[1] if k == "ip"] == [True, False] and new[1].endswith("Not 4.0. or 1.2.3.4.5")
    iban = next(t for t in [new[2][a:b] for a, b, k, _ in pii.detect(new[2]) if k == "iban"])
    assert pii.iban_rest(iban.replace(" ", "")) == 1 and iban.startswith("DE")
    surname = re.search(r"Frau (\w+) (\w+) met", new[2])
    assert f". {surname[2]} left" in new[2] and "Schmidt" not in new[2] and "Smith" not in new[2] and "anna too" in new[2]
    assert surname[1].lower().endswith(pii.SCRIPTS["latin"][2]["f"])
    assert re.fullmatch(r"Госпожа ([А-Я][а-я]+) пришла\. ([А-Я]+) ушла\. Dr\. [A-Z]\w+", new[3])


def test_distinct_parts_stay_distinct(spark, monkeypatch):
    """Three-digit cards collide on every draw: a thousand values, 700 of them used."""
    monkeypatch.setitem(pii.PATTERNS, "ssn", re.compile(r"(?<![\w-])\d{2}-\d(?![\w-])"))
    values = [f"{k // 10:02d}-{k % 10}" for k in range(0, 400)]
    parts = spark.createDataFrame([("ssn", v.replace("-", "")) for v in values], "kind string, value string")
    again = {(r.kind, r.value): r.attempt for r in pii.redraws(parts, b"k").collect()}
    made = [pii.surrogate("ssn", v.replace("-", ""), again.get(("ssn", v.replace("-", "")), 0), b"k") for v in values]
    assert len(set(made)) == len(values) and not set(made) & {v.replace("-", "") for v in values} and again


def test_surrogates_in_documents(spark, edges, no_rows):
    rows = [(k, PRIVATE[k % 5] + f" {k}@a{k % 7}.org") for k in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in pii.surrogates(docs, b"k", ["doc_id"]).collect()}
    assert len({re.search(r"\S+@\S+$", r.text)[0] for r in got.values()}) == 60
    assert not any(re.search(rf"(?<!\S){k}@a{k % 7}\.org", r.text) for k, r in got.items())
    assert len({got[k].text.rsplit(" ", 1)[0] for k in range(0, 60, 5)}) == 1
    same = pii.surrogates(edges, b"k", ["doc_id"])
    assert sorted((str(r.doc_id), r.text or "", r.n_entities) for r in same.collect()) == sorted((str(r[0]), r[1] or "", 0) for r in EDGES)
    assert pii.surrogates(no_rows, b"k", ["doc_id"]).count() == 0


def test_pipeline(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    docs = table(spark, "documents")
    kept, stages = docs, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = spark.createDataFrame(stage(spark, kept, SF).collect(), docs.schema)
        stages.append({r.doc_id: r.text for r in kept.collect()})
    texts = {r.doc_id: r.text for r in docs.collect()}
    language, single, clean, redacted = stages
    from test_pairs_and_urls import fingerprint, groups
    from test_text_operators import ASSIGN, hits
    ids = sorted(language)
    label = groups([fingerprint(texts[k]) for k in ids], 4)
    assert set(single) == {ids[x] for x in label}
    items = [(r.item_id, r.text) for r in table(spark, "benchmark").collect()]
    assert set(clean) == {k for k in single if not hits(texts[k], items)[0]}
    assert set(redacted) == set(clean) and not any(len(m[1]) >= 6 for t in redacted.values() for m in ASSIGN.finditer(t))
    assert {r.doc_id for r in out.collect()} == set(redacted) and len(language) >= 0.97 * len(texts)


def test_pipeline_edges(spark, edges, no_rows):
    for docs in (edges, no_rows):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            kept = stage(spark, docs, SF)
            assert kept.columns == docs.columns
            docs = spark.createDataFrame(kept.collect(), docs.schema)
        assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() == docs.count()
