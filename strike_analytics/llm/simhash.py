"""SimHash near-duplicates with bit-sliced comparison.

1. Fingerprints: one pass over the texts, no shuffle of them. A 64-bit
   fingerprint has a bit set if it is set in over half of the hashes of the
   word shingles (repeats count).
2. Only different fingerprints are compared. Their 64 bits are cut into
   ``radius + 2`` parts; two fingerprints within the radius agree on two parts
   at least, so each fingerprint goes into one bucket for every two parts.
   No pair within the radius is missed, and nothing is capped.
3. A bucket of more than ``cell`` fingerprints is dealt by hash into
   sub-buckets, and every two of them meet in a cell of their own, so that no
   task gets a hot bucket whole.
4. In a run of cells, bit planes are stored vertically: plane b holds bit b of
   64 fingerprints a word. One XOR of a plane with itself moved by k compares
   64 pairs at distance k in the run; carry-save counters add up the planes,
   and a word is abandoned as soon as all its pairs exceed the radius, lie in
   different cells, or are already known to be connected.
5. A cell yields at most one link for each of its fingerprints (to the smallest
   of its group), never all pairs. Links become components by alternating
   large-star and small-star steps as joins of Spark tables, each written to
   the shared folder, so a lost executor costs no recomputation from the start.

Scale: for n different fingerprints about 15 n keys of 20 bytes are shuffled
(radius 4); nothing is broadcast or collected.

Defined results: texts without words (null, empty, white space) have the
fingerprint zero and are linked like any other; repeated rows get the same
answer; a row with a null doc_id takes part, but names a component (null) only
where no member has a doc_id; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strike_analytics.llm.common import map_texts, read_table, written

SHINGLE, RADIUS, SEED = 4, 4, 42


def shingle_hashes(text: str, shingle: int) -> np.ndarray:
    """XXH64 of each shingle of the text's words, lower-cased in ASCII."""
    words = text.encode("utf-8", "surrogatepass").lower().split()  # splits at space and \t to \r, as bytes do
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - shingle + 1)
    last = ends[min(shingle, len(words)) - 1:]
    h = xxhash.xxh64_intdigest
    return np.array([h(joined[a:b], SEED) for a, b in zip(starts[:n].tolist(), last.tolist())], np.uint64)


def fingerprint(hashes: np.ndarray) -> int:
    """Bits that are set in over half of the hashes; zero if there are none."""
    counts = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 14):
        part = hashes[i:i + (1 << 14)]
        counts += np.unpackbits(part.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, carry: list[str], shingle: int = SHINGLE, name: str = "fp") -> DataFrame:
    """``carry`` and the fingerprint as a signed 64-bit integer."""
    def rows(texts: list[str]) -> dict[str, list]:
        return {name: [_signed(fingerprint(shingle_hashes(t, shingle))) for t in texts]}

    return map_texts(docs, carry, rows, {name: ("long", pa.int64())})


def masks(radius: int) -> list[int]:
    """For every two of ``radius + 2`` parts of the 64 bits, the mask of both."""
    edges = [round(i * 64 / (radius + 2)) for i in range(radius + 3)]
    parts = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:])]
    return [a | b for a, b in combinations(parts, 2)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def cells_of(fps: DataFrame, radius: int, cell: int) -> DataFrame:
    """(table, key, i, j, fp): the fingerprints of each cell; buckets of one are left out."""
    tables = F.array(*[F.struct(F.lit(t).alias("table"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key"))
                       for t, m in enumerate(masks(radius))])
    keyed = fps.select("fp", F.inline(tables))
    # Written, so that the join below deals out both its sides and Spark can split a hot bucket.
    sizes = written(keyed.groupBy("table", "key").agg(F.count("*").alias("n")).where("n > 1"), "simhash-sizes")
    own = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("parts") - 1),
                        lambda k: F.struct(F.least(k, F.col("own")).alias("i"), F.greatest(k, F.col("own")).alias("j")))
    # Of two parts and more, the cell of a part with itself is within its cells with others.
    pairs = F.when(F.col("parts") > 1, F.filter(pairs, lambda p: p["i"] < p["j"])).otherwise(pairs)
    return (keyed.join(sizes, ["table", "key"])
            .withColumn("parts", F.ceil(F.col("n") / F.lit(cell)).cast("int")).withColumn("own", own)
            .select("table", "key", "fp", F.inline(pairs)))


def planes_of(fps: np.ndarray) -> np.ndarray:
    """Bit planes: 64 rows of words; bit r of word w of row b is bit b of fingerprint 64 w + r."""
    n = -(-len(fps) // 64) * 64
    padded = np.zeros(n, "<u8")
    padded[:len(fps)] = fps
    bits = np.unpackbits(padded.view(np.uint8).reshape(n, 8), axis=1, bitorder="little")
    return np.ascontiguousarray(np.packbits(bits.T, axis=1, bitorder="little")).view("<u8")


def moved(planes: np.ndarray, words: np.ndarray, k: int) -> np.ndarray:
    """The given words of the planes moved towards lower places by k places."""
    step, bit = divmod(k, 64)
    padded = planes.shape[-1]
    low = np.where(words + step < padded, words + step, padded - 1)
    out = planes[..., low] >> np.uint64(bit)
    if bit:
        high = np.where(words + step + 1 < padded, words + step + 1, padded - 1)
        out = out | (planes[..., high] << np.uint64(64 - bit))
    return out


def within(planes: np.ndarray, k: int, words: np.ndarray, alive: np.ndarray, radius: int) -> np.ndarray:
    """Which of the pairs (place, place + k) marked in ``alive`` are within the
    radius: words of bits, like ``alive`` for each of ``words``."""
    result = np.zeros(len(words), np.uint64)
    at = np.arange(len(words))
    levels = radius.bit_length()
    ones = ~np.uint64(0)
    over = ~alive
    counter = np.zeros((levels, len(words)), np.uint64)
    for first in range(0, 64, 8):
        rows = planes[first:first + 8]
        differ = rows[:, words[at]] ^ moved(rows, words[at], k)
        for carry in differ:
            for level in range(levels):  # carry-save: add one bit to every pair's counter
                counter[level], carry = counter[level] ^ carry, counter[level] & carry
            over |= carry
        over |= _more_than(counter, radius)
        stay = over != ones
        if not stay.all():
            at, over, counter = at[stay], over[stay], counter[:, stay]
            if not len(at):
                return result
    result[at] = ~over
    return result


def _more_than(counter: np.ndarray, radius: int) -> np.ndarray:
    """Bitwise: the number in the counter's levels (lowest first) is over ``radius``."""
    more, equal = np.zeros(counter.shape[1], np.uint64), np.full(counter.shape[1], ~np.uint64(0))
    for level in range(len(counter) - 1, -1, -1):
        if radius >> level & 1:
            equal = equal & counter[level]
        else:
            more |= equal & counter[level]
            equal = equal & ~counter[level]
    return more


def groups_in(fps: np.ndarray, cell: np.ndarray, radius: int) -> np.ndarray:
    """For each place the first place connected to it within its cell by steps
    of at most ``radius`` bits. ``cell`` is non-decreasing."""
    n = len(fps)
    label = np.arange(n)
    first = np.flatnonzero(np.concatenate(([True], cell[1:] != cell[:-1])))
    end = np.repeat(np.append(first[1:], n), np.diff(np.append(first, n)))  # of each place's cell
    room = end - np.arange(n)
    planes = planes_of(fps)
    for k in range(1, int(room.max(initial=1))):
        places = np.flatnonzero(room > k)
        places = places[label[places] != label[places + k]]  # those connected already need no comparison
        if not len(places):
            continue
        marked = np.zeros(planes.shape[1] * 64, bool)
        marked[places] = True
        pairs = np.packbits(marked, bitorder="little").view("<u8")
        words = np.flatnonzero(pairs)
        near = np.zeros_like(pairs)
        near[words] = within(planes, k, words, pairs[words], radius)
        places = np.flatnonzero(np.unpackbits(near.view(np.uint8), bitorder="little"))
        label = _join(label, places, places + k)
    return label


def _join(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels after connecting a[i] with b[i]: the smallest place of each group."""
    while len(a):
        la, lb = label[a], label[b]
        open_ = la != lb
        a, b, la, lb = a[open_], b[open_], la[open_], lb[open_]
        if not len(a):
            break
        np.minimum.at(label, np.maximum(la, lb), np.minimum(la, lb))
        while (deeper := label[label] != label).any():
            label = np.where(deeper, label[label], label)
    return label


#: Rows of cells that are compared together.
RUN = 1 << 16


def links_of(cells: DataFrame, radius: int) -> DataFrame:
    """(a, b): in each cell, its connected fingerprints to one of their group."""
    names = ["table", "key", "i", "j"]

    def starts(rows: pa.Table) -> np.ndarray:
        """Whether a new cell begins after each row but the last."""
        return np.any([k[1:] != k[:-1] for k in (rows.column(c).to_numpy() for c in names)], axis=0)

    def whole_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        """Tables of some RUN rows that end where a cell ends."""
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size >= RUN:
                table = pa.Table.from_batches(held)
                new = np.flatnonzero(starts(table))
                if len(new):
                    yield table.slice(0, int(new[-1]) + 1)
                    held = table.slice(int(new[-1]) + 1).to_batches()
                    size = sum(b.num_rows for b in held)
        if size:
            yield pa.Table.from_batches(held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in whole_cells(batches):
            fps = rows.column("fp").to_numpy()
            label = groups_in(fps.view(np.uint64), np.concatenate(([0], np.cumsum(starts(rows)))), radius)
            far = label != np.arange(len(label))
            yield pa.RecordBatch.from_pydict({"a": fps[far], "b": fps[label[far]]})

    return (cells.repartition(*names).sortWithinPartitions(*names, "fp")
            .select(*names, "fp").mapInArrow(run, "a long, b long"))


def components(links: DataFrame) -> DataFrame:
    """(node, component): the smallest node that can be reached, for every node
    of ``links`` (a, b) but those smallest ones themselves.

    Large-star and small-star in turn, until a round changes nothing: each
    replaces the links around a node by links to the smallest neighbour, which
    shortens the chains by a factor and never adds links.
    """
    edges = written(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
                    .where("a > b").distinct(), "simhash-links")
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # Written, so that the join deals out both its sides and Spark can split the links of a hot node.
        least = written(both.groupBy("a").agg(F.least("a", F.min("b")).alias("m")), "simhash-least")
        large = (both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
                 .where("a > b").distinct())
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
                 .unionByName(least.select("a", F.col("m").alias("b"))))
        edges = written(small.where("a > b").distinct(), "simhash-links")
        now = edges.agg(F.count("*"), F.expr("sum(cast(a AS decimal(38,0)))"), F.expr("sum(cast(b AS decimal(38,0)))"),
                        F.expr("bit_xor(xxhash64(a, b))")).first()
        if now == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
        before = now


def classes(fps: DataFrame, least: Column, radius: int, cell: int) -> DataFrame:
    """(fp, least) for every different ``fp`` of ``fps``: the smallest value of
    the column ``least`` in its component (nulls don't count)."""
    nodes = written(fps.groupBy("fp").agg(F.min(least).alias("least")), "simhash-nodes")
    found = components(links_of(cells_of(nodes.select("fp"), radius, cell), radius))
    members = found.unionByName(found.select(F.col("component").alias("node"), "component").distinct())
    members = written(members.join(nodes, members["node"] == nodes["fp"]).select("fp", "component", "least"),
                      "simhash-members")
    names = written(members.groupBy("component").agg(F.min("least").alias("least")), "simhash-names")
    named = members.select("fp", "component").join(names, "component").select("fp", "least")
    return named.unionByName(nodes.join(members.select("fp"), "fp", "left_anti"))


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS, cell: int = 2048) -> DataFrame:
    """For each row of ``docs`` (doc_id, text): doc_id, fingerprint (16
    hexadecimal digits) and component_id, the smallest doc_id that can be
    reached by steps of at most ``radius`` differing bits."""
    fps = written(fingerprints(docs, ["doc_id"], shingle), "simhash-fps")
    named = classes(fps, F.col("doc_id"), radius, cell)
    return fps.join(named, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("least").alias("component_id"))


def drop_near_duplicates(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS, cell: int = 2048) -> DataFrame:
    """One row of each component of ``docs``, all columns as they are: that of
    the smallest doc_id (null last; of repeated ids any one row).

    The rows are written once with a number and the fingerprint; what follows
    shuffles only those, and the numbers of the rows that go meet the table.
    """
    fp, row = (next(n for n in (f"{x}{'_' * k}" for k in range(99)) if n not in docs.columns) for x in ("fp", "row"))
    table = written(fingerprints(docs.withColumn(row, F.monotonically_increasing_id()), [*docs.columns, row],
                                 shingle, fp), "simhash-rows")
    fps = table.select("doc_id", F.col(row).alias("row"), F.col(fp).alias("fp"))
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "row")
    gone = (fps.join(classes(fps, order, radius, cell), "fp").where("row != least.row")
            .select(F.col("row").alias(row)))
    return table.join(gone, row, "left_anti").select(*docs.columns)


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint and component."""
    return near_duplicates(read_table(spark, sf_dir, "documents"))
