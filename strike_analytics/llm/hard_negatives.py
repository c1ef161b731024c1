"""Hard-negative mining with a GNAT-style multiway hyperplane tree.

Rows are vectors of integers (each component x becomes ``floor(scale * x)``)
and a score is an inner product, exact. With one more component that brings
all rows to the same length, a score s between a query q and a row is the
distance sqrt(|q|^2 + M - 2 s), M the largest squared length: a window of
scores is an annulus around the query, in a metric space.

1. Tree: a bounded sample of rows gives the split points. A node has up to
   ``ARITY`` of them, far from one another; a row belongs to the nearest one's
   child. Every row of the table is dealt to its leaf.
2. Ranges: for each child and each split point of its node, the least and the
   largest distance between the point and the rows below the child, over all
   rows of the table. Their number depends on the tree alone.
3. Search: at a node, a query eliminates every child whose range around any
   split point can't meet the annulus (too near, too far, or in its hole). The
   sample's own k-th best row, where it has k, narrows the window first.
4. Leaves: queries meet the rows of the leaves they must visit, which are
   scored exactly. Nothing is approximate, so recall is 1 (tested).

Scale: the tree, its ranges and the sample are bounded by ``SAMPLE`` and are
all that is broadcast. A leaf's rows are dealt into parts of about ``CELL``
rows, its queries into parts of about ``QUERIES``, and each two parts meet in
a cell of their own, so neither a hot leaf (a vector that a third of all rows
share) nor a leaf that all queries visit is one task's work. A cell gives k
rows for each query and window.

Defined results: rows with a null id, label or vector, or with a null or
non-finite component, take no part; vectors that are shorter than the longest
one count as if zeros followed; repeated rows count as rows of their own, but
for those with the anchor's id, which are the anchor itself, and an anchor
that is repeated is mined once; an empty table gives no row; other columns are
not read. Squared lengths of 2**52 and more are refused with a ValueError,
since scores would not be exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strike_analytics.llm.common import let_workers_import, read_table, written

SCALE = 256
#: Children of a node, rows the split points are chosen from, and the most of them in a leaf.
ARITY, SAMPLE, LEAF = 16, 4096, 32
#: Rows and queries that meet in a cell; scores held at once.
CELL, QUERIES, SCORES = 1 << 16, 1 << 14, 1 << 21
LEAST, MOST = -(1 << 62), 1 << 62


def integers(column: pa.ChunkedArray | pa.Array, width: int | None = None) -> np.ndarray:
    """A list column without nulls as rows of one length; zeros follow short lists."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.diff(lists.offsets.to_numpy())
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    width = int(sizes.max(initial=0)) if width is None else width
    if (sizes == width).all():
        return flat.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width), flat.dtype)
    out[np.arange(width) < sizes[:, None]] = flat
    return out


def quantized(df: DataFrame, row_id: Column, vector: Column, label: Column, scale: int = SCALE) -> DataFrame:
    """(vec_id, label, vec): rows that can take part, components as integers."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column("vec")
            sizes = np.diff(lists.offsets.to_numpy())
            flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            bad = np.concatenate(([0], np.cumsum(~np.isfinite(flat))))
            ends = np.cumsum(sizes)
            fine = bad[ends] == bad[ends - sizes]
            made = np.floor(scale * np.where(np.isfinite(flat), flat, 0))
            made[~np.repeat(fine, sizes)] = 0
            if np.abs(made).max(initial=0) >= 1 << 26:
                raise ValueError("a component is too large for exact scores")
            vec = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)), pa.int32()), pa.array(made.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("label"), vec],
                                             names=["vec_id", "label", "vec"]).filter(pa.array(fine))

    let_workers_import(df.sparkSession)
    rows = df.select(row_id.cast("long").alias("vec_id"), label.cast("long").alias("label"),
                     vector.cast("array<double>").alias("vec")).dropna()
    return rows.mapInArrow(run, "vec_id long, label long, vec array<int>")


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    square = (a * a).sum(1)[:, None] + (b * b).sum(1) - 2 * (a @ b.T)
    return np.sqrt(np.maximum(square, 0))


class Tree:
    """Split points by node; ``children[n][i]`` is a node, or ``~leaf``."""

    def __init__(self, sample: np.ndarray, labels: np.ndarray, ids: np.ndarray, most: float,
                 arity: int = ARITY, leaf: int = LEAF):
        self.sample, self.labels, self.ids, self.most = sample.astype(np.float64), labels, ids, most
        self.points: list[np.ndarray] = []
        self.children: list[list[int]] = []
        self.ranges: list[np.ndarray] = []  # of a node: child, point, (least, largest)
        self.leaves, self.arity, self.leaf = 0, arity, leaf
        if len(sample):
            self.root = self._grow(self.lengthened(self.sample))

    def lengthened(self, rows: np.ndarray) -> np.ndarray:
        """With the component that brings all rows to one length."""
        rest = np.sqrt(np.maximum(self.most - (rows * rows).sum(1), 0))
        return np.concatenate([rows, rest[:, None]], axis=1)

    def _grow(self, rows: np.ndarray) -> int:
        chosen = [0]
        far = distances(rows, rows[:1])[:, 0]
        while len(rows) > self.leaf and len(chosen) < self.arity and far.max() > 1e-3:
            chosen.append(int(far.argmax()))
            far = np.minimum(far, distances(rows, rows[chosen[-1:]])[:, 0])
        if len(chosen) == 1:
            self.leaves += 1
            return ~(self.leaves - 1)
        node = len(self.points)
        self.points.append(rows[chosen])
        self.children.append([])
        nearest = distances(rows, rows[chosen]).argmin(1)
        self.children[node] = [self._grow(rows[nearest == i]) for i in range(len(chosen))]
        return node

    def walk(self, rows: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(node, child's place, places of the rows there, their distances to the node's points)."""
        open_ = [(self.root, np.arange(len(rows)))]
        while open_:
            node, at = open_.pop()
            if node < 0 or not len(at):
                continue
            d = distances(rows[at], self.points[node])
            nearest = d.argmin(1)
            for i, child in enumerate(self.children[node]):
                here = nearest == i
                if here.any():
                    yield node, i, at[here], d[here]
                    open_.append((child, at[here]))

    def leaf_of(self, rows: np.ndarray) -> np.ndarray:
        leaf = np.zeros(len(rows), np.int64)
        for node, i, at, _ in self.walk(rows):
            if self.children[node][i] < 0:
                leaf[at] = ~self.children[node][i]
        return leaf

    def with_ranges(self, rows: list) -> Tree:
        self.ranges = [np.stack([np.full((len(p), len(p)), np.inf), np.full((len(p), len(p)), -np.inf)], axis=2)
                       for p in self.points]
        for node, child, point, least, largest in rows:
            self.ranges[node][child, point] = least, largest
        return self

    def visits(self, queries: np.ndarray, inner: np.ndarray, outer: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(leaf, places of the queries that must visit it). ``inner`` and
        ``outer``: the annuli, a column for each window (empty if inner > outer)."""
        queries = np.concatenate([queries, np.zeros((len(queries), 1))], axis=1)
        open_ = [(self.root, np.flatnonzero((inner <= outer).any(1)))]
        while open_:
            node, at = open_.pop()
            if not len(at):
                continue
            if node < 0:
                yield ~node, at
                continue
            r = distances(queries[at], self.points[node])
            for i, child in enumerate(self.children[node]):
                least, largest = self.ranges[node][i].T
                if least[0] <= largest[0]:
                    nearest = np.maximum(r - largest, least - r).max(1)[:, None]
                    farthest = (r + largest).min(1)[:, None]
                    stay = ((nearest <= outer[at]) & (farthest >= inner[at])).any(1)
                    open_.append((child, at[stay]))


def first_k(scores: np.ndarray, allowed: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each row of ``scores`` the places of its k highest allowed ones, ties
    by place, and whether there are so many."""
    n = scores.shape[1]
    k = min(k, n)
    # Scores are whole numbers: a place's part of one never outranks a score.
    key = np.where(allowed, scores.astype(np.float64), -np.inf)
    if n > k:
        kth = -np.partition(-key, k - 1, axis=1)[:, k - 1:k]
        rows, places = np.nonzero(key >= np.where(np.isfinite(kth), kth, -np.inf))
        fine = allowed[rows, places]
        rows, places = rows[fine], places[fine]
    else:
        rows, places = np.nonzero(allowed)
    order = np.lexsort((places, -key[rows, places], rows))
    rows, places = rows[order], places[order]
    starts = np.searchsorted(rows, np.arange(len(scores)))
    rank = np.arange(len(rows)) - starts[rows]
    best = np.full((len(scores), k), -1)
    keep = rank < k
    best[rows[keep], rank[keep]] = places[keep]
    return best, best >= 0


def exact_type(most: float) -> type:
    """In which sums of products up to ``most`` are exact."""
    return np.float32 if most < 1 << 24 else np.float64


def best_of(queries: pa.Table, rows: np.ndarray, labels: np.ndarray, ids: np.ndarray, k: int, same: bool,
            most: float) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(query's place, window's place, places of its first k rows, their scores).
    ``rows`` are in ascending order of ``ids``."""
    kind = exact_type(most)
    rows = np.ascontiguousarray(rows.astype(kind).T)
    q = integers(queries.column("vec"), len(rows)).astype(kind)
    q_label, q_id = queries.column("label").to_numpy(), queries.column("vec_id").to_numpy()
    lows, highs = queries.column("lo").to_pylist(), queries.column("hi").to_pylist()
    step = max(1, SCORES // max(1, rows.shape[1]))
    for first in range(0, len(q), step):
        at = slice(first, first + step)
        scores = q[at] @ rows
        fits = ((labels == q_label[at, None]) == same) & (ids != q_id[at, None])
        for w in range(max(map(len, lows[at]), default=0)):
            have = [i for i, low in enumerate(lows[at]) if w < len(low)]
            low = np.array([lows[first + i][w] for i in have], np.float64)[:, None]
            high = np.array([highs[first + i][w] for i in have], np.float64)[:, None]
            part = scores[have]
            best, there = first_k(part, fits[have] & (part >= low) & (part <= high), k)
            for j, i in enumerate(have):
                found = best[j][there[j]]
                if len(found):
                    yield first + i, w, found, part[j, found]


class Index:
    """The dealt rows (vec_id, label, vec, leaf) and the tree over them."""

    def __init__(self, rows: DataFrame, tree: Tree, width: int, most: float):
        self.rows, self.tree, self.width, self.most = rows, tree, width, most

    @staticmethod
    def build(vectors: DataFrame, sample: int = SAMPLE) -> Index | None:
        """Of a written table (vec_id, label, vec); None if it has no rows."""
        square = F.aggregate("vec", F.lit(0).cast("long"), lambda s, x: s + x.cast("long") * x)
        bounds = vectors.agg(F.max(F.size("vec")).alias("width"), F.max(square).alias("most")).first()
        if bounds["width"] is None:
            return None
        width, most = bounds["width"], float(bounds["most"])
        if most >= 1 << 52:
            raise ValueError("vectors are too long for exact scores")
        chosen = vectors.orderBy(F.xxhash64("vec_id"), "vec_id", "label", "vec").limit(sample).toArrow()
        chosen = chosen.sort_by([("vec_id", "ascending")])
        tree = Tree(integers(chosen.column("vec"), width), chosen.column("label").to_numpy(),
                    chosen.column("vec_id").to_numpy(), most)

        def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                leaf = tree.leaf_of(tree.lengthened(integers(b.column("vec"), width).astype(np.float64)))
                yield b.append_column("leaf", pa.array(leaf, pa.int64()))

        def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            seen: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
            for b in batches:
                for node, i, _, d in tree.walk(tree.lengthened(integers(b.column("vec"), width).astype(np.float64))):
                    least, largest = seen.get((node, i), (np.inf, -np.inf))
                    seen[node, i] = np.minimum(least, d.min(0)), np.maximum(largest, d.max(0))
            found = [(node, i, j, a, b) for (node, i), (low, high) in seen.items() for j, (a, b) in enumerate(zip(low, high))]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*found)],
                                                 names=["node", "child", "point", "least", "largest"])

        rows = written(vectors.mapInArrow(deal, "vec_id long, label long, vec array<int>, leaf long"), "gnat-rows")
        seen = (rows.mapInArrow(ranges, "node long, child long, point long, least double, largest double")
                .groupBy("node", "child", "point").agg(F.min("least"), F.max("largest")).collect())
        return Index(rows, tree.with_ranges(seen), width, most)

    def search(self, queries: DataFrame, k: int, same: bool, cell: int = CELL, each: int = QUERIES) -> DataFrame:
        """(query, window, vec_id, score, rank): for each query (query, vec_id,
        label, vec, lo, hi) and each of its windows of scores lo[i] to hi[i], the
        first ``k`` rows of the same label, or of others; never rows of its own id."""
        spark = queries.sparkSession
        tree, width, most = spark.sparkContext.broadcast(self.tree), self.width, self.most
        slack = 1e-6 * (1 + np.sqrt(most))  # of rounded distances

        def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            t = tree.value
            for batch in batches:
                for first in range(0, batch.num_rows, 1024):
                    b = batch.slice(first, 1024)
                    q = integers(b.column("vec"), width).astype(np.float64)
                    low, high = b.column("lo").to_pylist(), b.column("hi").to_pylist()
                    for i, w, found, scores in best_of(pa.Table.from_batches([b]), t.sample, t.labels, t.ids, k, same, most):
                        if len(found) == k:  # so many rows are there: lower ones can't be among the first k
                            low[i][w] = max(low[i][w], int(scores[-1]))
                    size = max(map(len, low), default=0)
                    inner, outer = np.full((len(q), size), np.inf), np.full((len(q), size), -np.inf)
                    for i, (lo, hi) in enumerate(zip(low, high)):
                        square = (q[i] @ q[i]) + most
                        fits = np.array(lo) <= np.array(hi)
                        inner[i, :len(hi)] = np.where(fits, np.sqrt(np.maximum(square - 2 * np.array(hi, float), 0)) - slack, np.inf)
                        outer[i, :len(lo)] = np.where(fits, np.sqrt(np.maximum(square - 2 * np.array(lo, float), 0)) + slack, -np.inf)
                    narrowed = b.set_column(b.schema.get_field_index("lo"), "lo", pa.array(low, pa.list_(pa.int64())))
                    for leaf, at in t.visits(q, inner, outer):
                        part = narrowed.take(pa.array(at))
                        yield part.append_column("leaf", pa.array(np.full(len(at), leaf), pa.int64()))

        def meet(key: tuple, rows: pa.Table, asked: pa.Table) -> pa.Table:
            rows = rows.sort_by([("vec_id", "ascending")])
            out = {"query": [], "window": [], "vec_id": [], "score": []}
            ids = rows.column("vec_id").to_numpy()
            if len(ids) and len(asked):
                for i, w, found, scores in best_of(asked, integers(rows.column("vec"), width), rows.column("label").to_numpy(),
                                                   ids, k, same, most):
                    out["query"] += [asked.column("query")[i].as_py()] * len(found)
                    out["window"] += [w] * len(found)
                    out["vec_id"] += ids[found].tolist()
                    out["score"] += scores.astype(np.int64).tolist()
            return pa.table(out, schema=pa.schema([("query", pa.int64()), ("window", pa.int32()), ("vec_id", pa.int64()),
                                                   ("score", pa.int64())]))

        asked = written(queries.select("query", "vec_id", "label", "vec", "lo", "hi").mapInArrow(
            visit, "query long, vec_id long, label long, vec array<int>, lo array<long>, hi array<long>, leaf long"), "gnat-visits")
        # One row for each leaf of the tree: bounded by the sample.
        plan = (self.rows.groupBy("leaf").agg(F.ceil(F.count("*") / cell).alias("parts"))
                .join(asked.groupBy("leaf").agg(F.ceil(F.count("*") / each).alias("asked")), "leaf"))
        every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
        rows = (self.rows.join(F.broadcast(plan), "leaf").withColumn("part", F.pmod(F.xxhash64("vec_id", "vec"), "parts"))
                .select("leaf", "part", every("asked").alias("block"), "vec_id", "label", "vec"))
        met = (asked.join(F.broadcast(plan), "leaf").withColumn("block", F.pmod(F.xxhash64("query"), "asked"))
               .select("leaf", every("parts").alias("part"), "block", "query", "vec_id", "label", "vec", "lo", "hi"))
        cell_of = ["leaf", "part", "block"]
        found = rows.groupBy(*cell_of).cogroup(met.groupBy(*cell_of)).applyInArrow(
            meet, "query long, window int, vec_id long, score long")
        order = Window.partitionBy("query", "window").orderBy(F.col("score").desc(), "vec_id")
        return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def hard_negatives(rows: DataFrame, anchor: Column, positives: int = 5, negatives: int = 5,
                   low: int = 80, high: int = 100, sample: int = SAMPLE) -> DataFrame:
    """Anchors are the rows (vec_id, label, vec) with ``anchor``. For each, its
    first ``positives`` rows of the same label, and for each of them the first
    ``negatives`` rows of other labels with ``low * positive_score <=
    100 * negative_score <= high * positive_score``."""
    vectors = written(rows, "gnat-vectors")
    index = Index.build(vectors, sample)
    spark = rows.sparkSession
    if index is None:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, "
                                         "positive_score long, negative_score long")
    one = lambda x: F.array(F.lit(x).cast("long"))
    anchors = written(vectors.where(anchor).dropDuplicates().select(
        F.monotonically_increasing_id().alias("query"), "vec_id", "label", "vec"), "gnat-anchors")
    near = written(index.search(anchors.select("*", one(LEAST).alias("lo"), one(MOST).alias("hi")), positives, same=True)
                   .select("query", "rank", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")),
                   "gnat-positives")
    # At most ``positives`` rows for each anchor; in whole numbers, rounded inwards.
    s = F.col("positive_score")
    windows = near.groupBy("query").agg(F.sort_array(F.collect_list(F.struct(
        "rank", F.ceil(s * low / F.lit(100).cast("decimal(38,0)")).cast("long").alias("lo"),
        F.floor(s * high / F.lit(100).cast("decimal(38,0)")).cast("long").alias("hi")))).alias("windows"))
    asked = (anchors.join(windows, "query")
             .select("query", "vec_id", "label", "vec", F.col("windows.lo").alias("lo"), F.col("windows.hi").alias("hi")))
    found = (index.search(asked, negatives, same=False)
             .select("query", (F.col("window") + 1).alias("positive_rank"), F.col("rank").cast("int").alias("rank"),
                     F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score")))
    return (found.join(near.withColumnRenamed("rank", "positive_rank"), ["query", "positive_rank"])
            .join(anchors.select("query", F.col("vec_id").alias("anchor_id")), "query")
            .select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every hundredth row, against all rows; every seventh row has the next label."""
    df = read_table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(quantized(df, F.col("vec_id"), F.col("embedding"), label), F.col("vec_id") % 100 == 0)


OP11_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS vec
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(CAST(x AS DOUBLE))]) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, r.vec_id AS row_id, a.label = r.label AS same,
         CAST(list_sum([coalesce(z[1] * z[2], 0) FOR z IN list_zip(a.vec, r.vec)]) AS BIGINT) AS score
  FROM v a JOIN v r ON a.vec_id % 100 = 0 AND a.vec_id <> r.vec_id),
p AS (
  SELECT anchor_id, row_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, row_id) <= 5)
SELECT p.anchor_id, p.positive_id,
       CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.row_id) AS INTEGER) AS rank,
       s.row_id AS negative_id, p.positive_score, s.score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same
  AND 80 * p.positive_score <= 100 * s.score AND 100 * s.score <= 100 * p.positive_score
QUALIFY rank <= 5
"""
