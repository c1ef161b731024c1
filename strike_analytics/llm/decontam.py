"""Benchmark decontamination by Wu-Manber search over words.

The patterns are the windows of ``window`` consecutive words of every
benchmark item (an item with fewer words is one window). Patterns of one
length share a search table in the manner of Wu and Manber, with words as the
symbols: the last block of two words under the window's end is hashed into a
shift table, whose entry says how far the window can move without missing any
pattern. Only where it is zero a suffix-hash bucket is opened, its prefix
hashes are compared, and the words themselves are compared at last, so a hash
collision never makes a hit.

Scale: the documents are read once, no text is shuffled. Patterns reach the
executors in blocks of at most ``block_patterns`` windows; there are as many
blocks as the benchmark needs, and a worker holds one at a time when there is
more than one, over slices of ``MANY`` characters, so that a block is read for
much text. The benchmark is streamed through the driver block by block.

Defined results: a null or empty text, or one of separators only, has no words
and no hit; a null or empty item has no window; repeated rows are each judged;
items with the same windows are all reported; an item without an id hits and is
counted, but has no place in the list of ids; an empty benchmark hits nothing.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strike_analytics.llm.common import keep_texts, map_texts, read_table

#: Characters that are searched at once, with one block of patterns and with many.
ONE, MANY = 1 << 20, 1 << 23

#: ASCII that is no digit and, after lower-casing, no letter, separates words.
_SEPARATORS = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    """Maximal runs of lower-cased ASCII letters, digits and non-ASCII characters."""
    return (text or "").encode("utf-8", "surrogatepass").lower().translate(_SEPARATORS).split()


class WuManber:
    """Search for patterns of one length over arrays of word numbers (0: a word of no pattern)."""

    TABLE = 1 << 16

    def __init__(self, patterns: dict[tuple[int, ...], list[int]]):
        """patterns: word numbers -> places in the caller's list of items."""
        self.m = len(next(iter(patterns)))
        self.block = min(2, self.m)
        shift = np.full(self.TABLE, min(255, self.m - self.block + 1), np.uint8)
        self.buckets: dict[int, list] = defaultdict(list)
        for words, items in patterns.items():
            h = self.hashes(np.array(words, np.int64))
            for end, x in enumerate(h.tolist()):
                shift[x] = min(shift[x], len(h) - 1 - end, 255)
            self.buckets[int(h[-1])].append((int(h[0]), words, items))
        self.shift = shift

    def hashes(self, ids: np.ndarray) -> np.ndarray:
        """Of the block that begins at each position."""
        if self.block == 1:
            return ids * 40503 % 65521
        return (ids[:-1] * 40503 + ids[1:] * 30011) % 65521

    def find(self, ids: np.ndarray) -> Iterator[tuple[int, list[int]]]:
        """(start, items) of each occurrence."""
        if len(ids) < self.m:
            return
        h = self.hashes(ids)
        skip = self.shift[h].tobytes()
        back = self.m - self.block
        at, last = back, len(h)
        buckets = self.buckets
        while at < last:
            move = skip[at]
            if move:
                at += move
                continue
            bucket = buckets.get(int(h[at]))
            if bucket:
                start = at - back
                first, here = int(h[start]), None
                for prefix, words, items in bucket:
                    if prefix == first:
                        here = here or tuple(ids[start:start + self.m].tolist())
                        if here == words:
                            yield start, items
            at += 1


class Block:
    """Search tables over some of the windows."""

    def __init__(self, windows: dict[tuple[bytes, ...], list]):
        self.numbers: dict[bytes, int] = {}
        self.items = sorted({i for found in windows.values() for i in found}, key=str)
        place = {x: k for k, x in enumerate(self.items)}
        by_length: dict[int, dict] = defaultdict(dict)
        for words, found in windows.items():
            key = tuple(self.numbers.setdefault(w, len(self.numbers) + 1) for w in words)
            by_length[len(key)][key] = sorted(place[i] for i in set(found))
        self.searches = [WuManber(p) for p in by_length.values()]

    def search(self, words: list[bytes]) -> tuple[np.ndarray | None, set]:
        """Which words are hit (None: none), and the items found."""
        get = self.numbers.get
        ids = np.fromiter((get(w, 0) for w in words), np.int64, len(words))
        hit, found = None, set()
        for s in self.searches:
            for start, items in s.find(ids):
                if hit is None:
                    hit = np.zeros(len(words), bool)
                hit[start:start + s.m] = True
                found.update(items)
        return hit, {self.items[k] for k in found}


def windows_of(item: str | None, window: int) -> set[tuple[bytes, ...]]:
    words = words_of(item)
    if not words:
        return set()
    return {tuple(words[i:i + window]) for i in range(max(1, len(words) - window + 1))}


def pattern_blocks(benchmark: DataFrame, window: int, block_patterns: int) -> Iterator[Block]:
    """The benchmark's windows in blocks; an item with more windows than a
    block holds is spread over several."""
    windows: dict[tuple[bytes, ...], list] = defaultdict(list)
    for row in benchmark.select("item_id", "text").orderBy("item_id").toLocalIterator(prefetchPartitions=False):
        for w in sorted(windows_of(row["text"], window)):
            windows[w].append(row["item_id"])
            if len(windows) >= block_patterns:
                yield Block(windows)
                windows = defaultdict(list)
    if windows:
        yield Block(windows)


def runs(hit: np.ndarray) -> list[list[int]]:
    """[first, end) of each run of hit words."""
    edges = np.flatnonzero(np.diff(np.concatenate(([0], hit.view(np.int8), [0]))))
    return edges.reshape(-1, 2).tolist()


class Searcher:
    """All blocks over the texts of a batch; at most one block in memory if there are several."""

    def __init__(self, spark: SparkSession, benchmark: DataFrame, window: int, block_patterns: int):
        self.blocks = [spark.sparkContext.broadcast(b) for b in pattern_blocks(benchmark, window, block_patterns)]
        self.chars = ONE if len(self.blocks) < 2 else MANY

    def __call__(self, texts: list[str]) -> tuple[list[int], list[np.ndarray | None], list[set]]:
        """Of each text: its number of words, which of them are hit (None: none), the items found."""
        words = [words_of(t) for t in texts]
        hits: list[np.ndarray | None] = [None] * len(words)
        items: list[set] = [set() for _ in words]
        for b in self.blocks:
            block = b.value
            for k, w in enumerate(words):
                hit, found = block.search(w)
                if hit is not None:
                    hits[k] = hit if hits[k] is None else hits[k] | hit
                    items[k] |= found
            if len(self.blocks) > 1:
                del block
                b.__dict__.pop("_value", None)
        return [len(w) for w in words], hits, items


def find_benchmark(docs: DataFrame, benchmark: DataFrame, window: int = 10, block_patterns: int = 200_000) -> DataFrame:
    """For each row of ``docs`` (doc_id, text): n_words, n_hit (words inside an
    occurrence of any window), n_items, items (their ids as strings, sorted)
    and hit_spans (word ranges, end exclusive)."""
    search = Searcher(docs.sparkSession, benchmark, window, block_patterns)

    def rows(texts: list[str]) -> dict[str, list]:
        n, hits, items = search(texts)
        return {"n_words": n, "n_hit": [0 if h is None else int(h.sum()) for h in hits],
                "n_items": [len(x) for x in items], "items": [sorted(str(i) for i in x if i is not None) for x in items],
                "hit_spans": [[] if h is None else runs(h) for h in hits]}

    return map_texts(docs, ["doc_id"], rows, {
        "n_words": ("long", pa.int64()), "n_hit": ("long", pa.int64()), "n_items": ("long", pa.int64()),
        "items": ("array<string>", pa.list_(pa.string())),
        "hit_spans": ("array<array<long>>", pa.list_(pa.list_(pa.int64())))}, search.chars)


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document against every benchmark item."""
    found = find_benchmark(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items",
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
                        (F.col("n_hit") > 0).alias("contaminated"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = 10, block_patterns: int = 200_000) -> DataFrame:
    """The rows of ``docs``, whole, in which no benchmark window occurs."""
    search = Searcher(docs.sparkSession, benchmark, window, block_patterns)
    return keep_texts(docs, lambda texts: [h is None for h in search(texts)[1]], search.chars)


OP8_SQL = r"""
WITH dw AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
iw AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS m, array_to_string(w[p : p + 9], ' ') AS s
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS p FROM iw WHERE len(w) > 0)),
lens AS (SELECT DISTINCT m FROM win),
dwin AS (
  SELECT doc_id, p, m, array_to_string(w[p : p + m - 1], ' ') AS s
  FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS p FROM dw, lens WHERE len(w) >= m)),
occ AS (SELECT doc_id, p, dwin.m, item_id FROM dwin JOIN win USING (m, s)),
hit AS (SELECT doc_id, count(DISTINCT q) AS n FROM (SELECT doc_id, unnest(range(p, p + m)) AS q FROM occ) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(*) AS n, string_agg(i, ',' ORDER BY i) AS s
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM occ) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(hit.n, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(items.n, 0) AS BIGINT) AS n_items, sha256(coalesce(items.s, '')) AS items_sha256,
       coalesce(hit.n, 0) > 0 AS contaminated
FROM dw LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)
"""
