"""Nothing is cut off: languages, words, steps; names that clash."""
import random

import numpy as np
import public_tokenizers as P
import pyspark.sql.functions as F

from llm_support import prose
from strike_analytics.llm import bpe, common, langid, outliers, toxicity


def test_every_language_is_learned(spark, monkeypatch):
    rows = [(f"l{k:03d}", prose(k, 20)) for k in range(201)] + [("l000", prose(1000 + k, 20)) for k in range(50)]
    train = langid.ByteCnn.train
    monkeypatch.setattr(langid.ByteCnn, "train", lambda self, x, y, seed: train(self, x, y, steps=1, seed=seed))
    docs = spark.createDataFrame([(k, t, lang) for k, (lang, t) in enumerate(rows)], "doc_id long, text string, lang string")
    assert len(langid.train_identifier(docs, sample=20).net.classes) == 201


def test_every_telling_word_counts(spark):
    """More than 512 words tell; a text with any of them alone is found."""
    rng = random.Random(1)
    bad = [f"vile{''.join(rng.choices('bcdfgh', k=6))}" for _ in range(900)]
    docs = [(k, " ".join([*(f"w{rng.randint(0, 300)}" for _ in range(20)), *(rng.sample(bad, 40) if k % 4 == 0 else [])])) for k in range(1600)]
    labels = [(k, 1) for k in range(0, 1600, 4)] + [(k, 0) for k in range(1, 1600, 4)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    classifier = toxicity.train_classifier(df, spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert len(classifier.weights) > 512


def test_the_determinant_settles(spark):
    rng = np.random.default_rng(4)
    v = rng.normal([5, 1.6, 0, 0, 0.02], [1.5, 0.3, 0.2, 0.1, 0.1], (1500, 5))
    v[:500] += [2, 0.7, 1.5, 0.3, 0.2]
    rows = [("a", *map(int, np.round(r * outliers.UNIT))) for r in v]
    df = spark.createDataFrame(rows, "g string, " + ", ".join(f"q{i} long" for i in range(5)))
    settled = outliers.mcd(df, "g", None, None, None, "t-settled").first().logdet
    few, many = (outliers.mcd(df, "g", None, None, n, f"t-{n}").first().logdet for n in (1, 12))
    assert settled <= few and settled <= many + 12 * outliers.SETTLED


def test_clashing_names(spark):
    assert common.free_names(spark.createDataFrame([(1, 2)], "A int, a_ int"), "a", "b", "b") == ["a__", "b", "b_"]
    docs = spark.createDataFrame([(1, "ab ab", 5, 6, 7)], "doc_id long, text string, __text int, ids int, words int")
    row = outliers.text_counts(docs, ["doc_id", "__text", "words"]).first()
    assert (row["__text"], row["words"], row.n_words) == (5, 7, 2)
    encoded = bpe.encode_texts(docs, P.path(bpe.RANKS), P.PATTERN, ["doc_id", "ids", "text", "__text"])
    assert encoded.columns == ["doc_id", "text", "__text", "ids"]
    decoded = bpe.decode_ids(encoded.withColumn("text", F.lit("other")), P.path(bpe.RANKS)).first()
    assert decoded.text == "ab ab" and decoded["__text"] == 5
