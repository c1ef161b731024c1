"""Toxicity by non-negative positive-unlabelled learning.

The classifier learns from confirmed toxic texts (positive) and from texts of
all kinds, toxic or not (unlabelled). With the class prior pi, the risk

    pi E_P[l(f)] + max(0, E_U[l(-f)] - pi E_P[l(-f)])

takes the share of toxic texts in the unlabelled sample out of its negative
part; when that part falls below zero, which only overfitting does, the step
goes the other way (the non-negative estimator's rule). f is a logistic model
in numpy over the presence of words and of beginnings of words (which stand
for words that the sample lacks), whose loss makes the sigmoid of f the
probability of the label. Its words are those, in ``LEAST_TEXTS`` positive
texts and more, whose share among these exceeds that among the unlabelled ones
by ``LEAST_Z`` standard errors and more, the ``WORDS`` strongest; other words
say nothing, so a long text gathers no noise from them.

The prior is the toxic share of the labelled texts. Training uses a bounded,
documented sample: of each class the ids that hash lowest, about ``POSITIVE``
and ``UNLABELLED``.

Scale: the sample is chosen by ids alone, its words are counted as a Spark
aggregate, and only the chosen words' presence (bounded by the sample) comes to
the driver. Scoring reads every text once, whole, without a shuffle.

Defined results: a text without words, empty or null, gets the sigmoid of the
bias, as any text without a chosen word; with no positive or no unlabelled text every score is 0;
several labels of one doc_id count as toxic if one is; null labels count as
none. Repeated rows get equal scores.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strike_analytics.llm.common import map_texts, read_table
from strike_analytics.session import fresh_dir

POSITIVE, UNLABELLED, LEAST_Z, LEAST_TEXTS = 4000, 12000, 4.0, 3
PREFIXES = (8, 7, 6)
THRESHOLD = 0.7

#: What is no ASCII letter, lower-cased, separates words; other characters are parts of words.
_SEPARATORS = bytes(b if b >= 128 else ord(chr(b).lower()) if chr(b).isalpha() else 32 for b in range(256))


def words_of(text: str) -> set[bytes]:
    """The words of a text, and the beginnings (bytes ``PREFIXES``, with a mark) of longer ones."""
    words = set(text.lower().encode("utf-8", "surrogatepass").translate(_SEPARATORS).split())
    for n in PREFIXES:
        words.update([w[:n] + b"-" for w in words if len(w) > n])
    return words


def held_out() -> Column:
    """Rows whose labels training must not see."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))


def choose(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, float]:
    """(doc_id, positive) of the sample, about POSITIVE + UNLABELLED rows, and the class prior."""
    known = labels.where("toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = known.where(~held_out())
    prior = known.agg(F.avg(F.col("toxic").cast("double"))).first()[0] or 0.0
    ids = docs.select("doc_id").where("doc_id IS NOT NULL").where(~held_out())
    toxic = known.where("toxic = 1").select("doc_id")
    # The unlabelled sample stands for all texts, so confirmed ones may be in it too.
    named = (ids.join(toxic, "doc_id", "left_semi").withColumn("positive", F.lit(True))
             .unionByName(ids.withColumn("positive", F.lit(False))))
    # Hashes are even, so a share of their range is that share of the ids.
    part = F.shiftrightunsigned(F.xxhash64("doc_id"), 11) / F.lit(float(1 << 53))
    n = {r["positive"]: r["count"] for r in named.groupBy("positive").count().collect()}
    share = F.when(F.col("positive"), POSITIVE / n.get(True, 1)).otherwise(UNLABELLED / n.get(False, 1))
    return named.where(part < share).distinct(), prior


class Classifier:
    """Words with weights, and a bias."""

    def __init__(self, weights: dict[bytes, float], bias: float):
        self.weights, self.bias = weights, bias

    def __call__(self, texts: list[str]) -> list[float]:
        keys, get = self.weights.keys(), self.weights.__getitem__
        sums = np.array([sum(map(get, sorted(words_of(t) & keys))) for t in texts]) + self.bias
        return (1 / (1 + np.exp(-np.clip(sums, -500, 500)))).tolist()


def fit(x: np.ndarray, positive: np.ndarray, prior: float, steps: int = 600, rate: float = 0.1,
        decay: float = 1e-5) -> tuple[np.ndarray, float]:
    """``fit_places`` of a matrix (texts x words) of zeros and ones."""
    return fit_places(*np.nonzero(x), x.shape[1], positive, prior, steps, rate, decay)


def fit_places(rows: np.ndarray, cols: np.ndarray, n_words: int, positive: np.ndarray, prior: float, steps: int = 600,
               rate: float = 0.1, decay: float = 1e-5) -> tuple[np.ndarray, float]:
    """Weights and bias that minimise the non-negative risk with the logistic
    loss, by Adam. Text ``rows[i]`` has the word ``cols[i]``: few words of many are in a text."""
    n = len(positive)
    w, b = np.zeros(n_words), np.log(prior / (1 - prior))
    first, second = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    n_p, n_u = positive.sum(), (~positive).sum()
    for t in range(1, steps + 1):
        f = np.bincount(rows, w[cols], n) + b
        loss, s = np.logaddexp(0, f), 1 / (1 + np.exp(-f))
        negative = loss[~positive].mean() - prior * loss[positive].mean()
        # Derivatives by f of E_U[l(-f)] - pi E_P[l(-f)], and of pi E_P[l(f)].
        of_negative = np.where(positive, -prior * s / n_p, s / n_u)
        of_positive = np.where(positive, prior * (s - 1) / n_p, 0)
        r = of_positive + of_negative if negative >= 0 else -of_negative  # away from the negative part's descent
        g = np.append(np.bincount(cols, r[rows], len(w)) + decay * w, r.sum())
        first += 0.1 * (g - first)
        second += 0.001 * (g * g - second)
        step = rate * (first / (1 - 0.9 ** t)) / (np.sqrt(second / (1 - 0.999 ** t)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
    return w, float(b)


def train_classifier(docs: DataFrame, labels: DataFrame) -> Classifier | None:
    """From ``docs`` (doc_id, text) and ``labels`` (doc_id, toxic)."""
    spark = docs.sparkSession
    chosen, prior = choose(docs, labels)
    # POSITIVE and UNLABELLED bound the sample's ids: they may be broadcast.
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("positive"),
                 pa.array([sorted(words_of(t or "")) for t in b.column("text").to_pylist()], pa.list_(pa.binary()))],
                names=["doc_id", "positive", "words"])

    path = fresh_dir(spark, "toxicity-sample")
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, positive boolean, words array<binary>"
    texts.select("doc_id", "positive", "text").mapInArrow(split, schema).dropDuplicates(["doc_id", "positive"]).write.parquet(path)
    sample = spark.read.schema(schema).parquet(path)
    totals = sample.agg(F.count_if("positive").alias("p"), F.count_if(~F.col("positive")).alias("u")).first()
    if not totals["p"] or not totals["u"] or not 0 < prior < 1:
        return None
    p, u = F.col("p") / totals["p"], F.col("u") / totals["u"]
    pooled = (F.col("p") + F.col("u") + 1) / (totals["p"] + totals["u"] + 2)
    error = F.sqrt(pooled * (1 - pooled) * (1 / totals["p"] + 1 / totals["u"]))
    counts = (sample.select("positive", F.explode("words").alias("word")).groupBy("word")
              .agg(F.count_if("positive").alias("p"), F.count_if(~F.col("positive")).alias("u")))
    z = (p - u) / error
    words = [bytes(r["word"]) for r in counts.where((z >= LEAST_Z) & (F.col("p") >= LEAST_TEXTS)).orderBy(F.desc(z), "word").collect()]  # of a bounded sample
    if not words:
        return Classifier({}, float(np.log(prior / (1 - prior))))
    place = {w: k for k, w in enumerate(words)}

    def present(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = [[place[w] for w in found if w in place] for found in b.column("words").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("positive"), pa.array(at, pa.list_(pa.int32()))],
                                             names=["doc_id", "positive", "at"])

    rows = sample.mapInArrow(present, f"doc_id {kind}, positive boolean, at array<int>").orderBy("doc_id", "positive").collect()
    sizes = [len(r["at"]) for r in rows]
    cols = np.fromiter((k for r in rows for k in r["at"]), np.int64, sum(sizes))
    w, b = fit_places(np.repeat(np.arange(len(rows)), sizes), cols, len(words), np.array([r["positive"] for r in rows]), prior)
    return Classifier(dict(zip(words, w.tolist())), b)


def score_texts(docs: DataFrame, classifier: Callable[[list[str]], list[float]] | None, carry: list[str]) -> DataFrame:
    """``carry`` and ``score``."""
    def rows(texts: list[str]) -> dict[str, list]:
        return {"score": classifier(texts) if classifier else [0.0] * len(texts)}

    return map_texts(docs, carry, rows, {"score": ("double", pa.float64())})


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's score."""
    docs = read_table(spark, sf_dir, "documents")
    classifier = train_classifier(docs, read_table(spark, sf_dir, "labels"))
    return score_texts(docs, classifier, ["doc_id"]).select(
        "doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
