"""Language-model scoring by prediction by partial matching (PPM).

A trie of byte contexts up to ``ORDER`` bytes holds how often each symbol
followed. A text's symbols are its UTF-8 bytes, lower-cased in ASCII, and an
end. A symbol is predicted in its longest context; one that was not seen there
escapes to the next shorter one. Escapes are estimated by the number of
different symbols (method C: of t symbols, u of them different, the escape has
u / (t + u)), and symbols of the longer context are excluded from the counts
of the shorter one. After the empty context, symbols never seen are equally
likely. With counts kept as documents are read, the symbols of a context are
among those of every shorter one; so what is excluded depends on the context
alone and is kept with its node.

Pretrained (``score_texts``): the trie of a corpus.

1. Texts are written once in blocks of about ``BLOCK`` characters.
2. Each block tells its different grams (context and symbol) and words, with
   their counts in learned texts. Spark adds them up; the counts of shorter
   contexts come from those of longer ones, order by order.
3. Every different gram gets its log-probability by joins along the orders;
   only grams that are not found go on to the next one.
4. Each block is sent the values of its own grams and words and scores its
   texts with them.

Adaptive (``adaptive_scores``): each text's code length by a trie that starts
empty and learns the text as it goes.

Scale: neither the trie nor the vocabulary is ever in one place. What is
gathered and joined is the different grams and words of each block, in
proportion to the corpus; a task holds one block (or one text, if longer) and
its grams. Grams, words and contexts are keys of shuffles; the only broadcasts
are orders below three, at most 256**2 rows. Of one long context there are at
most 257 symbols. Blocks hold any rows, so no key of the data is one task.

Defined results: null is the empty text: the end alone. With nothing to learn
from, all symbols are equally likely and no token is known. Rows are scored
each for itself, repeated ones too; a row without an id is learned from. Other
columns are not read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strike_analytics.llm.common import let_workers_import, map_texts, read_table, written

ORDER, BLOCK = 4, 32 << 20
END, SYMBOLS = 256, 257
#: A gram in 64 bits: order, context (its last byte lowest), symbol.
ORDER_BIT, SYMBOL_BITS = 49, 9
#: Positions that are worked on at once.
SPAN = 1 << 20


def symbols(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass").lower()


def grams(texts: list[bytes], order: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(grams, their texts' places), in spans of positions; the end is a position."""
    sizes = np.array([len(t) + 1 for t in texts], np.int64)
    ends = np.cumsum(sizes)
    data = np.frombuffer(b"\0".join([*texts, b""]), np.uint8)  # an end's byte is not read
    for first in range(0, len(data), SPAN):
        last = min(first + SPAN, len(data))
        at = np.arange(first, last)
        text = np.searchsorted(ends, at, side="right")
        behind = at - (ends - sizes)[text]  # symbols before it
        key = data[first:last].astype(np.int64)
        key[at == ends[text] - 1] = END
        key |= np.minimum(behind, order) << ORDER_BIT
        for j in range(1, order + 1):
            there = behind >= j
            byte = data[np.maximum(at - j, 0)].astype(np.int64)
            key |= np.where(there, byte, 0) << (SYMBOL_BITS + 8 * (j - 1))
        yield key, text


def in_blocks(docs: DataFrame, block: int) -> DataFrame:
    """Rows with ``block``: of consecutive rows, about so many characters."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, size = TaskContext.get().partitionId() << 32, 0
        for b in batches:
            made = []
            for t in b.column("text").to_pylist():
                made.append(number)
                size += len(t or "")
                if size >= block:
                    number, size = number + 1, 0
            yield b.append_column("block", pa.array(made, pa.int64()))

    return docs.mapInArrow(run, docs.withColumn("block", F.lit(0).cast("long")).schema)


NEEDS = pa.schema([("block", pa.int64()), ("gram", pa.int64()), ("word", pa.binary()), ("n", pa.int64())])


class Needs:
    """The different grams and words of a block, with their counts in learned texts."""

    def __init__(self, order: int):
        self.order = order
        self.held = {True: 0, False: 0}  # bytes of texts not yet counted
        self.texts: dict[bool, list[bytes]] = {True: [], False: []}
        self.grams: dict[bool, list[np.ndarray]] = {True: [], False: []}
        self.times: dict[bool, list[np.ndarray]] = {True: [], False: []}
        self.words: Counter = Counter()
        self.others: set[bytes] = set()

    def add(self, text: bytes, learn: bool) -> None:
        self.held[learn] += len(text) + 1
        self.texts[learn].append(text)
        if self.held[learn] >= SPAN:
            self._count(learn)
        (self.words if learn else self.others).update(text.split())

    def _count(self, learn: bool) -> None:
        for keys, _ in grams(self.texts[learn], self.order):
            found = pa.array(keys).value_counts()
            self.grams[learn].append(found.field("values").to_numpy())
            self.times[learn].append(found.field("counts").to_numpy())
        self.texts[learn], self.held[learn] = [], 0

    def _summed(self, learn: bool) -> tuple[np.ndarray, np.ndarray]:
        self._count(learn)
        if not self.grams[learn]:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        key, at = np.unique(np.concatenate(self.grams[learn]), return_inverse=True)
        return key, np.bincount(at, np.concatenate(self.times[learn]), len(key)).astype(np.int64)

    def rows(self, number: int) -> Iterator[pa.RecordBatch]:
        known, n = self._summed(True)
        more = np.setdiff1d(self._summed(False)[0], known, assume_unique=True)
        rest = list(self.others.difference(self.words))
        for gram, word, count in ((known, None, n), (more, None, np.zeros(len(more), np.int64)),
                                  (None, list(self.words), list(self.words.values())), (None, rest, [0] * len(rest))):
            size = len(count)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(size, number), pa.int64()), pa.nulls(size, pa.int64()) if gram is None else pa.array(gram),
                 pa.array(word if gram is None else [None] * size, pa.binary()), pa.array(count, pa.int64())], schema=NEEDS)


def needs_of(blocks: DataFrame, order: int) -> DataFrame:
    """(block, gram or word, n): what each block needs, and how often it was learned there."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held = None, Needs(order)
        for b in batches:
            for k, t, x in zip(b.column("block").to_pylist(), b.column("text").to_pylist(), b.column("learn").to_pylist()):
                if number is not None and k != number:
                    yield from held.rows(number)
                    held = Needs(order)
                number = k
                held.add(symbols(t), x)
        if number is not None:
            yield from held.rows(number)

    return blocks.select("block", "text", "learn").mapInArrow(run, "block long, gram long, word binary, n long")


def _mask(k: int) -> Column:
    return F.lit((1 << 8 * k) - 1).cast("long")


def log_probabilities(counts: DataFrame, order: int) -> DataFrame:
    """(gram, value): the log10 probability of every gram of ``counts`` (gram, n)."""
    table = counts.select("gram", F.shiftright("gram", ORDER_BIT).alias("k"),
                          F.shiftright("gram", SYMBOL_BITS).bitwiseAND(_mask(5)).alias("context"),
                          F.col("gram").bitwiseAND(F.lit((1 << SYMBOL_BITS) - 1).cast("long")).alias("symbol"), "n")
    # From the longest contexts to the empty one: counts of (context, symbol), and
    # a node's total, different symbols, and total of those in the next shorter context.
    followed: dict[int, DataFrame] = {}
    for k in range(order, -1, -1):
        own = table.where((F.col("k") == k) & (F.col("n") > 0)).select("context", "symbol", "n")
        if k < order:
            longer = followed[k + 1].select(F.col("context").bitwiseAND(_mask(k)).alias("context"), "symbol", "n")
            own = own.unionByName(longer).groupBy("context", "symbol").agg(F.sum("n").alias("n"))
        followed[k] = written(own, f"ppm-order{k}")

    def node(k: int) -> DataFrame:
        below = F.lit(0).cast("long")
        rows = followed[k]
        if k:
            shorter = followed[k - 1].select(F.col("context").alias("shorter"), F.col("symbol").alias("s"), F.col("n").alias("below"))
            rows = rows.join(shorter, (F.col("context").bitwiseAND(_mask(k - 1)) == F.col("shorter")) & (F.col("symbol") == F.col("s")))
            below = F.col("below")
        made = rows.groupBy("context").agg(F.sum("n").alias("total"), F.count("*").alias("different"), F.sum(below).alias("below"))
        return F.broadcast(made) if k < 3 else made  # at most 256**2 rows

    parts, open_ = [], None
    for k in range(order, -1, -1):
        rows = table.where(F.col("k") == k).select("gram", "context", "symbol", F.lit(0.0).alias("value"),
                                                   F.lit(0).cast("long").alias("out"), F.lit(0).cast("long").alias("out_different"))
        if open_ is not None:
            rows = rows.unionByName(open_.withColumn("context", F.col("context").bitwiseAND(_mask(k))))
        at = followed[k] if k > 1 else F.broadcast(followed[k])  # at most 256 * 257 rows
        rows = rows.join(at, ["context", "symbol"], "left")
        total, different = F.col("total") - F.col("out"), F.col("different") - F.col("out_different")
        rows = rows.join(node(k), "context", "left")
        step = (F.when(F.col("n").isNotNull(), F.log10(F.try_divide("n", total + different)))
                .when(different > 0, F.log10(F.try_divide(different, total + different))).otherwise(0.0))
        level = written(rows.select(
            "gram", "context", "symbol", F.col("n").isNotNull().alias("found"), (F.col("value") + step).alias("value"),
            F.coalesce("below", "out").alias("out"), F.coalesce("different", "out_different").alias("out_different")), "ppm-level")
        parts.append(level.where("found").select("gram", "value"))
        open_ = level.where("not found").drop("found")
    parts.append(open_.select("gram", (F.col("value") - F.log10(F.lit(SYMBOLS) - F.col("out_different"))).alias("value")))
    made = parts[0]
    for part in parts[1:]:
        made = made.unionByName(part)
    return written(made, "ppm-values")


def score_texts(docs: DataFrame, learn: Column, order: int = ORDER, block: int = BLOCK) -> DataFrame:
    """For each row of ``docs`` (doc_id, text), learned from where ``learn``:
    doc_id, learn, n_tokens, n_known, train_tokens, base_score and score.

    Tokens are the lower-cased words and one end; ``base_score`` is their
    add-one unigram log10 probability, ``score`` the trie's of the whole text.
    """
    if not 0 <= order <= 5:
        raise ValueError("order must be 0 to 5")
    let_workers_import(docs.sparkSession)
    learn = F.coalesce(learn, F.lit(True))
    blocks = written(in_blocks(docs.select("doc_id", "text", learn.alias("learn")), block), "ppm-texts", "zstd")
    needs = written(needs_of(blocks, order), "ppm-needs", "zstd")
    gram_needs, word_needs = needs.where("gram is not null"), needs.where("word is not null")
    values = log_probabilities(written(gram_needs.groupBy("gram").agg(F.sum("n").alias("n")), "ppm-grams"), order)
    # A word has at most one row of each block and task, far fewer than it has occurrences.
    of_word = Window.partitionBy("word").orderBy("block")
    every = of_word.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    words = written(word_needs.select("block", "word", "n", F.sum("n").over(every).alias("total"), (F.row_number().over(of_word) == 1).alias("first"))
                    .where("first or n != total"), "ppm-words")
    ended = blocks.where("learn").count()
    tokens = word_needs.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] + ended
    different = words.where("first and total > 0").count() + (ended > 0)

    def score(key: tuple, texts: pa.Table, sent: pa.Table) -> pa.Table:
        data = [symbols(t) for t in texts.column("text").to_pylist()]
        of_words = pc.is_valid(sent.column("word"))
        known = sent.filter(of_words)
        # Words that no other block learned are not sent: the block counts its own.
        count = Counter()
        for t, learn in zip(data, texts.column("learn").to_pylist()):
            if learn:
                count.update(t.split())
        count = dict(count) | dict(zip(known.column("word").to_pylist(), known.column("value").to_pylist()))
        sent = sent.filter(pc.invert(of_words))
        # A block that two tasks told its needs has some grams twice.
        gram, first = np.unique(sent.column("gram").to_numpy(), return_index=True)
        gram, value = pd.Index(gram), sent.column("value").to_numpy()[first]
        scores = np.zeros(len(data))
        for keys, text in grams(data, order):
            scores += np.bincount(text, value[gram.get_indexer(keys)], len(data))
        n_tokens, n_known, base = [], [], []
        for t in data:
            words = t.split()
            c = np.append(np.fromiter(map(count.get, words, repeat(0)), np.float64, len(words)), ended)
            n_tokens.append(len(c))
            n_known.append(int((c > 0).sum()))
            base.append(float(np.log10((c + 1) / (tokens + different + 1)).sum()))
        return pa.table([texts.column("doc_id"), texts.column("learn"), pa.array(n_tokens, pa.int64()),
                         pa.array(n_known, pa.int64()), pa.array(base, pa.float64()), pa.array(scores)],
                        names=["doc_id", "learn", "n_tokens", "n_known", "base_score", "score"])

    sent = (gram_needs.select("block", "gram").join(values, "gram")
            .select("block", "gram", F.lit(None).cast("binary").alias("word"), "value")
            .unionByName(words.where("n != total").select("block", F.lit(None).cast("long").alias("gram"), "word",
                                                          F.col("total").cast("double").alias("value"))))
    kind = blocks.schema["doc_id"].dataType.simpleString()
    return (blocks.groupBy("block").cogroup(sent.groupBy("block"))
            .applyInArrow(score, f"doc_id {kind}, learn boolean, n_tokens long, n_known long, base_score double, score double")
            .withColumn("train_tokens", F.lit(tokens).cast("long")))


class Trie:
    """A context trie that learns as it codes."""

    def __init__(self, order: int = ORDER):
        self.order, self.nodes = order, {}

    def step(self, data: bytes, at: int, symbol: int) -> float:
        """log10 of the symbol's probability behind ``data[:at]``; learns nothing."""
        total, out = 0.0, ()
        for k in range(min(at, self.order), -1, -1):
            node = self.nodes.get(data[at - k:at])
            if node is None:
                continue
            left = {s: n for s, n in node.items() if s not in out}
            t, u = sum(left.values()), len(left)
            if symbol in node:
                return total + math.log10(node[symbol] / (t + u))
            total += math.log10(u / (t + u)) if u else 0.0
            out = node
        return total - math.log10(SYMBOLS - len(out))

    def learn(self, data: bytes, at: int, symbol: int) -> None:
        for k in range(min(at, self.order), -1, -1):
            node = self.nodes.setdefault(data[at - k:at], {})
            node[symbol] = node.get(symbol, 0) + 1

    def code(self, text: str | None, learn: bool = True, predict: bool = True) -> float:
        """log10 probability of the whole text and its end."""
        data, total = symbols(text), 0.0
        for at, symbol in enumerate([*data, END]):
            if predict:
                total += self.step(data, at, symbol)
            if learn:
                self.learn(data, at, symbol)
        return total


def adaptive_scores(docs: DataFrame, carry: list[str], order: int = ORDER) -> DataFrame:
    """``carry`` and ``adaptive_score``: each text's log10 probability by a trie
    of its own that starts empty (its code length is -score / log10(2) bits)."""
    return map_texts(docs, carry, lambda texts: {"adaptive_score": [Trie(order).code(t) for t in texts]},
                     {"adaptive_score": ("double", pa.float64())})


def op12_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's score by the trie of those that are not held out."""
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 == 2, F.lit(False))
    return (score_texts(read_table(spark, sf_dir, "documents"), ~held_out)
            .select("doc_id", (~F.col("learn")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score"))
