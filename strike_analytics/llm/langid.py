"""Language identification by a byte convolutional network.

Filters of several widths run over the bytes of a window, each is max-pooled
over the window, and a softmax gives the languages. Everything is numpy: the
network is trained with Adam on windows of a bounded sample of labelled
documents (about ``SAMPLE`` for each language, however rare, those whose ids
hash lowest; windows at a hashed place of each), and applied to batches of
fixed-length windows that together cover every text whole. The network has an
output for each language; it and their counts are what the driver holds.

A filter's input is a byte, so the network is applied by adding up table rows:
the embedding and each filter position make one row for each byte, and
neighbouring positions are merged into one row for each two bytes. That gives
the convolution's numbers without its multiplications.

Windows are lower-cased in ASCII with ASCII non-letters made spaces and runs of
spaces made one, so that digits, addresses and marks say nothing. A text's
score is the softmax of the mean of its windows' logits, weighted by length.

Scale: rows are counted by language, then each row decides by its own hash
whether it is in the sample. The weights (some 10 KB) go to the executors with
the task. The texts are read once for scoring; no text is shuffled.

Defined results: ``und`` and score 0 for null and empty texts and those
without a letter; a text with letters gets a language even when short; with no
labelled row at all every text is ``und``. Repeated rows get equal answers.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strike_analytics.llm.common import keep_texts, map_texts, read_table

WINDOW, SAMPLE, WIDTHS, FILTERS, EMBED = 256, 1500, (2, 3, 4), 8, 8
UNKNOWN = "und"
_LETTER = regex.compile(r"\p{L}")

#: ASCII letters lower-cased, other ASCII a space.
_PLAIN = bytes(b if b >= 128 else ord(chr(b).lower()) if chr(b).isalpha() else 32 for b in range(256))
_SPACES = re.compile(b"  +")


def plain(text: str) -> bytes:
    return _SPACES.sub(b" ", text.encode("utf-8", "surrogatepass").translate(_PLAIN)).strip()


def windows(data: bytes) -> np.ndarray:
    """Rows of WINDOW bytes that cover ``data``, the last padded with spaces."""
    n = max(1, -(-len(data) // WINDOW))
    return np.frombuffer(data.ljust(n * WINDOW), np.uint8).reshape(n, WINDOW)


class ByteCnn:
    """Embedding, filters of several widths, max pooling and softmax."""

    def __init__(self, classes: list[str], seed: int = 7):
        rng = np.random.default_rng(seed)
        self.classes = classes
        self.embed = rng.normal(0, 0.3, (256, EMBED)).astype(np.float32)
        self.filters = [rng.normal(0, (2 / (w * EMBED)) ** 0.5, (w, EMBED, FILTERS)).astype(np.float32) for w in WIDTHS]
        self.bias = [np.zeros(FILTERS, np.float32) for _ in WIDTHS]
        self.out = rng.normal(0, 0.1, (FILTERS * len(WIDTHS), len(classes))).astype(np.float32)
        self.out_bias = np.zeros(len(classes), np.float32)

    @property
    def weights(self) -> list[np.ndarray]:
        return [self.embed, *self.filters, *self.bias, self.out, self.out_bias]

    def forward(self, x: np.ndarray):
        e = self.embed[x]
        pooled, best = [], []
        for f, b in zip(self.filters, self.bias):
            n = x.shape[1] - len(f) + 1
            z = sum(e[:, i:i + n] @ f[i] for i in range(len(f))) + b
            best.append(z.argmax(axis=1))
            pooled.append(np.take_along_axis(z, best[-1][:, None], 1)[:, 0])
        h = np.maximum(np.concatenate(pooled, 1), 0)
        return h @ self.out + self.out_bias, h, best

    def gradients(self, x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
        logits, h, best = self.forward(x)
        p = softmax(logits)
        p[np.arange(len(y)), y] -= 1
        p /= len(y)
        back = (p @ self.out.T) * (h > 0)
        d_embed = np.zeros_like(self.embed)
        d_filters, d_bias = [], []
        rows = np.arange(len(x))[:, None]
        for k, f in enumerate(self.filters):
            g = back[:, k * FILTERS:(k + 1) * FILTERS]
            d = np.zeros_like(f)
            for i in range(len(f)):
                at = x[rows, best[k] + i]  # the byte under position i of each filter at its maximum
                d[i] = np.einsum("nfe,nf->ef", self.embed[at], g)
                np.add.at(d_embed, at, g[:, :, None] * f[i].T[None])
            d_filters.append(d)
            d_bias.append(g.sum(0))
        return [d_embed, *d_filters, *d_bias, h.T @ p, p.sum(0)]

    def train(self, x: np.ndarray, y: np.ndarray, steps: int = 500, batch: int = 64, rate: float = 0.01,
              seed: int = 7) -> "ByteCnn":
        rng = np.random.default_rng(seed)
        first = [np.zeros_like(w) for w in self.weights]
        second = [np.zeros_like(w) for w in self.weights]
        by_class = [np.flatnonzero(y == c) for c in range(len(self.classes))]
        for t in range(1, steps + 1):
            pick = np.concatenate([rng.choice(rows, -(-batch // len(by_class))) for rows in by_class])
            now = rate * min(1, 2 * (1 - t / (steps + 1)))
            for w, g, m, v in zip(self.weights, self.gradients(x[pick], y[pick]), first, second):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                w -= now * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.999 ** t)) + 1e-8)
        return self

    def tables(self) -> list[list[np.ndarray]]:
        """For each width the rows to add up: for two bytes at a time, a last one alone."""
        made = []
        for f, b in zip(self.filters, self.bias):
            single = [self.embed @ f[i] for i in range(len(f))]
            rows = [(single[i][:, None] + single[i + 1][None]).reshape(65536, -1) for i in range(0, len(f) - 1, 2)]
            rows += [single[-1]] * (len(f) % 2)
            rows[0] = rows[0] + b
            made.append([np.ascontiguousarray(r, np.float32) for r in rows])
        return made


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def scorer(net: ByteCnn) -> Callable[[np.ndarray], np.ndarray]:
    """The logits of windows, by table rows."""
    tables = net.tables()

    def logits(x: np.ndarray) -> np.ndarray:
        out = np.empty((len(x), len(net.classes)), np.float32)
        for s in range(0, len(x), 64):
            part = x[s:s + 64].astype(np.int32)
            two = part[:, :-1] * 256 + part[:, 1:]
            pooled = []
            for width, rows in zip(WIDTHS, tables):
                n = WINDOW - width + 1
                z = rows[0][two[:, :n]]
                for i, table in enumerate(rows[1:], 1):
                    z += table[(two if len(table) > 256 else part)[:, 2 * i:2 * i + n]]
                pooled.append(z.max(axis=1))
            out[s:s + 64] = np.maximum(np.concatenate(pooled, 1), 0) @ net.out + net.out_bias
        return out

    return logits


class Identifier:
    """Language and score of whole texts; the tables are built once for each worker's task."""

    def __init__(self, net: ByteCnn | None):
        self.net, self.logits = net, None

    def __getstate__(self):
        return {"net": self.net, "logits": None}

    def __call__(self, texts: list[str]) -> list[tuple[str, float]]:
        out = [(UNKNOWN, 0.0)] * len(texts)
        if self.net is None:
            return out
        self.logits = self.logits or scorer(self.net)
        known = [i for i, t in enumerate(texts) if _LETTER.search(t)]
        data = [plain(texts[i]) for i in known]
        parts = [windows(d) for d in data]
        if not parts:
            return out
        logits = self.logits(np.concatenate(parts))
        at = 0
        for i, d, w in zip(known, data, parts):
            weight = np.full(len(w), WINDOW, np.float32)
            weight[-1] = max(1, len(d) - (len(w) - 1) * WINDOW)
            p = softmax((weight @ logits[at:at + len(w)]) / weight.sum())
            at += len(w)
            best = int(p.argmax())
            out[i] = (self.net.classes[best], float(p[best]))
        return out


def train_identifier(labelled: DataFrame, sample: int = SAMPLE, per_text: int = 4, seed: int = 7) -> Identifier:
    """From rows (doc_id, text, lang) without nulls in lang. Of each language the
    ids that hash lowest are used, about ``sample``: of each text at most
    ``per_text`` windows that begin at places drawn from a seeded generator."""
    # Hashes are even, so a share of their range is that share of the ids.
    part = F.shiftrightunsigned(F.xxhash64("doc_id"), 11) / F.lit(float(1 << 53))
    counts = labelled.groupBy("lang").count().collect()
    if not counts:
        return Identifier(None)
    share = F.create_map(*[F.lit(x) for r in counts for x in (r["lang"], sample / r["count"])])
    # Only the surroundings of the windows leave the executors, never whole texts.
    size = 3 * WINDOW
    place = F.lit(1) + F.pmod(F.xxhash64("text"), F.greatest(F.char_length("text") - size, F.lit(1))).cast("int")
    rows = (labelled.where(part < share[F.col("lang")]).where("text IS NOT NULL")
            .select("lang", F.xxhash64("doc_id").alias("h"), F.substring("text", place, F.lit(size)).alias("t"))
            .groupBy("lang", "h").agg(F.min("t").alias("t"))  # repeated ids count once: the bound holds
            .orderBy("lang", "h").collect())
    rng = np.random.default_rng(seed)
    x, y = [], []
    for r in rows:
        data = plain(r["t"])
        for k in range(min(per_text, -(-len(data) // WINDOW))):
            # Short windows too, as short texts and last windows are.
            length = WINDOW if k % 2 == 0 else int(rng.integers(16, WINDOW))
            start = int(rng.integers(0, max(1, len(data) - length)))
            x.append(windows(data[start:start + length])[0])
            y.append(r["lang"])
    if not x:
        return Identifier(None)
    classes, numbers = np.unique(y, return_inverse=True)
    return Identifier(ByteCnn(classes.tolist(), seed).train(np.array(x), numbers, seed=seed))


def identify(docs: DataFrame, identifier: Identifier, carry: list[str]) -> DataFrame:
    """``carry``, ``lang_pred`` and ``score``."""
    def rows(texts: list[str]) -> dict[str, list]:
        lang, score = zip(*identifier(texts))
        return {"lang_pred": list(lang), "score": list(score)}

    return map_texts(docs, carry, rows, {"lang_pred": ("string", pa.string()), "score": ("double", pa.float64())})


def held_out() -> Column:
    """Rows that training must not see."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


def _trained(docs: DataFrame) -> Identifier:
    return train_identifier(docs.where(~held_out()).where("lang IS NOT NULL").select("doc_id", "text", "lang"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's language."""
    docs = read_table(spark, sf_dir, "documents")
    return identify(docs, _trained(docs), ["doc_id"]).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def keep_identified(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """Rows whose text has a language with a score of ``least`` or more, all columns as they are."""
    identifier = _trained(docs)
    return keep_texts(docs, lambda texts: [lang != UNKNOWN and score >= least for lang, score in identifier(texts)])
