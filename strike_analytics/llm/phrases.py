"""Phrase collocations by Toivonen's sampling, counted exactly.

Phrases are one to four words in a row inside a piece of text. Every part of a
frequent phrase is frequent, so a phrase can only be frequent if the two
phrases it consists of, without its last and without its first word, are.

1. A sample (one document of ``FRACTION``, by the hash of its id) is mined
   level by level with a lowered support. It proposes a set of phrases.
2. One full pass counts the proposed phrases and their negative border: all
   phrases that are not proposed, but both of whose parts are. Of one word,
   that is every word; longer ones are found where they occur.
3. Where a phrase of the border turns out frequent, the sample missed it and
   longer ones could be frequent too: it joins the set, and a further pass
   counts the phrases whose parts are both in the set only now. This goes on
   until no pass adds one. Every frequent phrase has then been counted over
   the whole corpus, whatever the sample was like.

The set goes to the executors as a filter of ``FILTER_BITS`` bits, whatever its
size. A phrase the filter takes for one of the set is counted too, which costs
time and nothing else: counts are exact, and what was counted in a pass follows
from the filters alone. The full pass reads the slices twice: first it adds up
the phrases' keys, hashes of ``KEY_BITS`` bits, and then it counts the phrases
themselves whose key occurs often enough (a frequent phrase's always does).

Keys are dealt out by their first bits, in blocks: sorted, as steps from one to
the next, with counts that end at the support. That is some three bytes for a
key. A bucket's blocks are added up at once; there are as many buckets as the
words ask for.

Texts are split once and written as slices of one language: different words
and a number for each word; the passes read those. Counts are added up in a
task before they are dealt out, by the same buckets, in blocks of sorted
phrases: a task that holds too many phrases hands on the rarest and goes on
with the others. All that the driver holds is the filter.

Score, dropping and ranking are joins by (language, phrase); a language's
ranking is cut to the limit by each task before its rows meet.

Defined results: null text has no words; null language is ``und``; ties in
score are broken by count and then by the phrase's bytes, so the result doesn't
depend on the order of rows; repeated rows count each time; an empty table has
no phrase. Other columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strike_analytics.llm.common import LARGE_VALUES, let_workers_import, read_table, written

WORDS, SUPPORT, LIMIT = 4, 30, 2000
FRACTION, LOWERED = 4, 0.6
#: Characters of a slice, slices' worth of them that a task holds, and bits of the filter (8 MB).
SLICE, HELD, FILTER_BITS = 1 << 18, 16, 1 << 26
#: Bits of a key; occurrences that a bucket of keys may have, and the fewest bits that number the buckets.
KEY_BITS, BUCKET, BUCKET_BITS = 40, 1 << 22, 6
#: Different keys, and bytes of phrases and counts, that a task adds up before it hands them on.
MERGED, ADDED = 1 << 20, 1 << 25
#: Blocks that a task hands on at once.
BLOCKS = 1 << 10
#: Bytes of the rows that a Python worker gets at once. Spark's own limit of 64 MB would
#: be held several times over, by the executor and by the worker of every task.
BATCH = 1 << 22
UNKNOWN = "und"

#: A byte that UTF-8 doesn't have stands for the end of a piece.
_CUT = b"\xff"
_PLAIN = bytes(0xFF if chr(b) in ".,;:!?\n\x0b\x0c\r" else b + 32 if 65 <= b <= 90 else b for b in range(256))


def tokens(texts: list[str]) -> list[bytes]:
    """The words of all texts; ``_CUT`` between pieces and between texts."""
    data = _CUT.join(t.encode("utf-8", "surrogatepass") for t in texts)
    return data.translate(_PLAIN).replace(_CUT, b" \xff ").split()


def code_type(n_words: int) -> str:
    """Of the numbers of so many different words and of a cut, which is -1."""
    return "<i2" if n_words < 1 << 15 else "<i4"


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """What runs meanwhile hands its Python workers ``BATCH`` bytes at once."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(BATCH))
    try:
        yield
    finally:
        spark.conf.set(name, before)


SLICES = "lang string, sampled boolean, words binary, codes binary, n_words long"


def sliced(docs: DataFrame, slice_chars: int) -> DataFrame:
    """``docs`` (text, lang, sampled) split into words: slices of one language
    with its different words and, for each word, its number (-1: a cut)."""
    def made(key: tuple[str, bool], texts: list[str]) -> pa.RecordBatch:
        coded = pa.array(tokens(texts), pa.binary()).dictionary_encode()
        words = coded.dictionary.to_pylist()
        codes = coded.indices.to_numpy().astype(np.int64)
        if _CUT in words:
            cut = words.index(_CUT)
            codes = np.where(codes == cut, -1, codes - (codes > cut))
            words.pop(cut)
        n_words = int((codes >= 0).sum())
        codes = codes.astype(code_type(len(words)))
        return pa.RecordBatch.from_pylist([{"lang": key[0], "sampled": key[1], "words": _CUT.join(words), "codes": codes.tobytes(),
                                            "n_words": n_words}],
                                          schema=pa.schema([("lang", pa.string()), ("sampled", pa.bool_()), ("words", pa.binary()),
                                                            ("codes", pa.binary()), ("n_words", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, bool], list[str]] = {}
        size: Counter = Counter()
        for b in batches:
            for text, lang, sampled in zip(*(b.column(c).to_pylist() for c in ("text", "lang", "sampled"))):
                key = lang, sampled
                held.setdefault(key, []).append(text)
                size[key] += len(text) + 1
                # A whole slice, or the largest one of more than a task should hold.
                if size[key] >= slice_chars or size.total() >= HELD * slice_chars:
                    key = max(size, key=size.get)
                    yield made(key, held.pop(key))
                    del size[key]
        yield from (made(*x) for x in held.items())

    let_workers_import(docs.sparkSession)
    return docs.where("text is not null").select("text", "lang", "sampled").mapInArrow(run, SLICES)


_STEP, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def word_hashes(lang: str, words: list[bytes]) -> np.ndarray:
    h, seed = xxhash.xxh64_intdigest, xxhash.xxh64_intdigest(lang) >> 1
    return np.array([h(w, seed) for w in words], np.uint64)


def longer(hashes: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Of phrases, from the hashes of all but the last word and of the last word."""
    return hashes * _STEP + last


def mixed(numbers: np.ndarray) -> np.ndarray:
    numbers = (numbers ^ (numbers >> np.uint64(30))) * _MIX
    return numbers ^ (numbers >> np.uint64(31))


def keys(hashes: np.ndarray) -> np.ndarray:
    """What passes know phrases by: ``KEY_BITS`` bits of each."""
    return mixed(hashes) >> np.uint64(64 - KEY_BITS)


def places(keys_: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two bits of the filter for each key."""
    spread, last = mixed(keys_ * _STEP), np.uint64(FILTER_BITS - 1)
    return spread & last, (spread >> np.uint64(32)) & last


def holds(filter_: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    there = np.ones(len(hashes), bool)
    for at in places(keys(hashes)):
        there &= (filter_[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) == 1
    return there


def _bits(keys_: np.ndarray) -> pa.RecordBatch:
    """(slot, bits): what ``keys_`` set in a filter."""
    at = np.concatenate(places(keys_))
    return pa.RecordBatch.from_arrays([pa.array((at >> np.uint64(6)).astype(np.int64)),
                                       pa.array((np.uint64(1) << (at & np.uint64(63))).view(np.int64))], names=["slot", "bits"])


def _with_bits(filter_: np.ndarray, bits: DataFrame) -> np.ndarray:
    """The filter with ``bits`` (slot, bits) set; what comes back is no larger than the filter."""
    bits = bits.groupBy("slot").agg(F.bit_or("bits").alias("bits")).toArrow()
    made = filter_.copy()
    made[bits.column("slot").to_numpy()] |= bits.column("bits").to_numpy().view(np.uint64)
    return made


def with_keys(filter_: np.ndarray, found: DataFrame) -> np.ndarray:
    """The filter with the phrases of ``found`` (key) added."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield _bits(b.column("key").to_numpy().view(np.uint64))

    return _with_bits(filter_, found.select("key").mapInArrow(run, "slot long, bits long"))


def with_phrases(filter_: np.ndarray, phrases: DataFrame) -> np.ndarray:
    """The filter with ``phrases`` (lang, phrase) added; one Python worker for each task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hashes = []
            for lang, phrase in zip(b.column("lang").to_pylist(), b.column("phrase").to_pylist()):
                words = word_hashes(lang, phrase.encode("utf-8", "surrogatepass").split(b" "))
                hashes.append(reduce(longer, words[1:, None], words[:1])[0])
            yield _bits(keys(np.array(hashes, np.uint64)))

    return _with_bits(filter_, phrases.select("lang", "phrase").mapInArrow(run, "slot long, bits long"))


def chosen(codes: np.ndarray, of_words: np.ndarray, before: np.ndarray | None, now: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(k, places, hashes) of a slice's phrases of k words whose parts are both
    in the filter ``now`` and were not both in ``before``; without ``before`` also of all words."""
    is_word = codes >= 0
    if not is_word.any():
        return
    hashes = word = np.where(is_word, of_words[codes], np.uint64(0))
    if before is None:
        at = np.flatnonzero(is_word)
        yield 1, at, word[at]
    inside, was = holds(now, of_words)[codes] & is_word, None if before is None else holds(before, of_words)[codes] & is_word
    for k in range(2, WORDS + 1):
        hashes = longer(hashes[:-1], word[k - 1:])
        both = inside[:-1] & inside[1:]
        had = None if before is None else was[:-1] & was[1:]
        at = np.flatnonzero(both if had is None else both & ~had)
        if len(at):
            yield k, at, hashes[at]
        if k == WORDS:
            return
        inside, was = np.zeros(len(both), bool), None if had is None else np.zeros(len(both), bool)
        at = np.flatnonzero(both)
        inside[at] = holds(now, hashes[at])
        if had is not None:
            at = np.flatnonzero(had)
            was[at] = holds(before, hashes[at])


def read_slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, list[bytes], np.ndarray]]:
    for b in batches:
        for row in range(b.num_rows):
            words = b.column("words")[row].as_py()
            words = words.split(_CUT) if words else []
            yield (b.column("lang")[row].as_py(), words,
                   np.frombuffer(b.column("codes")[row].as_py(), code_type(len(words))).astype(np.int64))


class Shipped:
    """Filters on their way to the executors, packed (most bits are not set); unpacked once in a task."""

    def __init__(self, spark: SparkSession, *filters: np.ndarray | None):
        pack = zstandard.ZstdCompressor(level=1).compress
        self.packed = spark.sparkContext.broadcast([None if f is None else pack(f.tobytes()) for f in filters])

    def __call__(self) -> list[np.ndarray | None]:
        unpack = zstandard.ZstdDecompressor().decompress
        return [None if f is None else np.frombuffer(unpack(f), np.uint64) for f in self.packed.value]

    def __enter__(self) -> Shipped:
        return self

    def __exit__(self, *_) -> None:
        self.packed.destroy()  # what was made with them is written


def summed(keys_: np.ndarray, n: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The different keys in order, and what they count together (``most`` at most)."""
    order = np.argsort(keys_, kind="stable")
    keys_ = keys_[order]
    first = np.flatnonzero(np.diff(keys_, prepend=~keys_[:1]))
    return keys_[first], np.minimum(np.add.reduceat(n[order], first), most)


def _bytes(numbers: np.ndarray) -> bytes:
    """All first bytes of the numbers, all second ones and so on, packed."""
    return zstandard.ZstdCompressor(level=1).compress(numbers.view(np.uint8).reshape(-1, 8).T.tobytes())


def _numbers(data: bytes) -> np.ndarray:
    data = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(data.T).view(np.int64).ravel()


def packed(keys_: np.ndarray, n: np.ndarray) -> tuple[bytes, bytes]:
    """A block of keys in order, as steps from one to the next, and their counts."""
    return _bytes(np.diff(keys_, prepend=np.uint64(0))), _bytes(n.astype(np.int64))


def unpacked(steps: bytes, n: bytes) -> tuple[np.ndarray, np.ndarray]:
    return np.cumsum(_numbers(steps).view(np.uint64), dtype=np.uint64), _numbers(n)


def bucket_bits(n_words: int) -> int:
    """Of the number of a bucket, for phrases of so many words in all."""
    return max(BUCKET_BITS, (WORDS * n_words // BUCKET).bit_length())


def buckets_of(slices: DataFrame) -> int:
    return bucket_bits(slices.agg(F.sum("n_words")).first()[0] or 0)


def key_blocks(slices: DataFrame, filters: Shipped, support: int, bits: int) -> DataFrame:
    """(bucket, steps, n): blocks of the keys of the phrases to be counted, with counts up to ``support``."""
    edges = np.arange(1 << bits, dtype=np.uint64) << np.uint64(KEY_BITS - bits)

    def blocks(keys_: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
        ends = np.append(np.searchsorted(keys_, edges), len(keys_))
        there = np.flatnonzero(np.diff(ends))
        for first in range(0, len(there), BLOCKS):
            some = there[first:first + BLOCKS]
            steps, counts = zip(*(packed(keys_[ends[b]:ends[b + 1]], n[ends[b]:ends[b + 1]]) for b in some))
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(steps, pa.binary()), pa.array(counts, pa.binary())],
                                             names=["bucket", "steps", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, (before, now) = [], 0, filters()
        for lang, words, codes in read_slices(batches):
            for _, _, hashes in chosen(codes, word_hashes(lang, words), before, now):
                held.append(np.unique(keys(hashes), return_counts=True))
                size += len(held[-1][0])
            if size >= MERGED:
                held = [summed(*map(np.concatenate, zip(*held)), support)]
                size = len(held[0][0])
                if size > MERGED // 2:  # mostly different ones: hand them on
                    yield from blocks(*held[0])
                    held, size = [], 0
        if held:
            yield from blocks(*summed(*map(np.concatenate, zip(*held)), support))

    return slices.select("lang", "words", "codes").mapInArrow(run, "bucket int, steps binary, n binary")


def likely(slices: DataFrame, filters: Shipped, support: int) -> DataFrame:
    """(key) of the phrases to be counted whose key occurs ``support`` times or
    more: all of the frequent ones, and others that share a key. ``filters``: before and now."""
    def frequent(table: pa.Table) -> pa.Table:
        blocks = zip(*(table.column(c).to_pylist() for c in ("steps", "n")))
        keys_, n = summed(*map(np.concatenate, zip(*(unpacked(*b) for b in blocks))), support)
        return pa.table({"key": keys_[n >= support].view(np.int64)})

    return key_blocks(slices, filters, support, buckets_of(slices)).groupBy("bucket").applyInArrow(frequent, "key long")


def occurring(codes: np.ndarray, at: np.ndarray, k: int, n_words: int) -> tuple[np.ndarray, np.ndarray]:
    """Of the phrases of ``k`` words at ``at``, which of them is the first of each different one, and its count."""
    group = codes[at]
    if k == 1:
        _, first, n = np.unique(group, return_index=True, return_counts=True)
    for j in range(1, k):
        _, first, group, n = np.unique(group * n_words + codes[at + j], return_index=True, return_inverse=True, return_counts=True)
    return first, n


def phrase_blocks(slices: DataFrame, filters: Shipped, bits: int) -> DataFrame:
    """(bucket, lang, phrases, n): blocks of the phrases to be counted that a
    third filter holds (None: of all) and their counts, added up in a task as
    far as it holds them. ``filters``: before, now and that one."""
    def added(held: dict[str, list[pa.Table]]) -> dict[str, list[pa.Table]]:
        made = {lang: pa.concat_tables(t).group_by("phrase", use_threads=False).aggregate([("n", "sum"), ("bucket", "min")])
                for lang, t in held.items()}
        return {lang: [t.rename_columns(["phrase", "n", "bucket"])] for lang, t in made.items()}

    def blocks(held: dict[str, list[pa.Table]]) -> Iterator[pa.RecordBatch]:
        for lang, (t,) in held.items():
            t = t.sort_by([("bucket", "ascending"), ("phrase", "ascending")])
            there, first = np.unique(t.column("bucket").to_numpy(), return_index=True)
            ends, n, pack = np.append(first, t.num_rows), t.column("n").to_numpy(), zstandard.ZstdCompressor(level=3).compress
            for at in range(0, len(there), BLOCKS):
                some = range(at, min(at + BLOCKS, len(there)))
                phrases = [pack(b"\n".join(t.column("phrase").slice(ends[b], ends[b + 1] - ends[b]).to_pylist())) for b in some]
                yield pa.RecordBatch.from_arrays([pa.array(there[some.start:some.stop], pa.int32()), pa.array([lang] * len(some), pa.string()),
                                                  pa.array(phrases, pa.binary()),
                                                  pa.array([_bytes(n[ends[b]:ends[b + 1]]) for b in some], pa.binary())],
                                                 names=["bucket", "lang", "phrases", "n"])

    def split(held: dict[str, list[pa.Table]]) -> tuple[dict[str, list[pa.Table]], dict[str, list[pa.Table]]]:
        """The rarer three quarters at least, and the others."""
        n = np.concatenate([t.column("n").to_numpy() for t, in held.values()])
        at = 3 * len(n) // 4
        rare = np.partition(n, at)[at]
        return ({lang: [t.filter(pc.less_equal(t.column("n"), rare))] for lang, (t,) in held.items()},
                {lang: [t.filter(pc.greater(t.column("n"), rare))] for lang, (t,) in held.items()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, now, only = filters()
        held, size = {}, 0
        for lang, words, codes in read_slices(batches):
            spelled = pa.array(words, pa.binary())
            for k, at, hashes in chosen(codes, word_hashes(lang, words), before, now):
                if only is not None:
                    there = holds(only, hashes)
                    at, hashes = at[there], hashes[there]
                if not len(at):
                    continue
                first, n = occurring(codes, at, k, len(words))
                parts = [spelled.take(pa.array(codes[at[first] + j])) for j in range(k)]
                phrase = pc.binary_join_element_wise(*parts, b" ") if k > 1 else parts[0]
                bucket = keys(hashes[first]) >> np.uint64(KEY_BITS - bits)
                made = pa.table({"phrase": phrase, "n": pa.array(n, pa.int64()), "bucket": pa.array(bucket, pa.int32())})
                held.setdefault(lang, []).append(made)
                size += made.nbytes
            if size >= ADDED:
                held = added(held)
                size = sum(t.nbytes for t, in held.values())
                if size > ADDED // 2:  # mostly different ones: hand the rarest on
                    rare, held = split(held)
                    yield from blocks(rare)
                    del rare
                    size = sum(t.nbytes for t, in held.values())
        if held:
            yield from blocks(added(held))
        held = None
        pa.default_memory_pool().release_unused()  # the worker stays for other tasks

    return slices.select("lang", "words", "codes").mapInArrow(run, "bucket int, lang string, phrases binary, n binary")


def counted(slices: DataFrame, filters: Shipped, support: int) -> DataFrame:
    """(lang, k, phrase, n) of the phrases of ``phrase_blocks`` with ``n >= support``."""
    def frequent(table: pa.Table) -> pa.Table:
        unpack, by_lang = zstandard.ZstdDecompressor().decompress, {}
        for lang, phrases, n in zip(*(table.column(c).to_pylist() for c in ("lang", "phrases", "n"))):
            by_lang.setdefault(lang, []).append(pa.table({"phrase": pa.array(unpack(phrases).split(b"\n"), pa.binary()), "n": _numbers(n)}))
        found = []
        for lang, parts in by_lang.items():
            t = pa.concat_tables(parts).group_by("phrase", use_threads=False).aggregate([("n", "sum")]).rename_columns(["phrase", "n"])
            t = t.filter(pc.greater_equal(t.column("n"), support))
            phrase = t.column("phrase").cast(pa.string())
            found.append(pa.table({"lang": pa.repeat(pa.scalar(lang, pa.string()), t.num_rows),
                                   "k": pc.add(pc.count_substring(phrase, " "), 1).cast(pa.int32()), "phrase": phrase, "n": t.column("n")}))
        return pa.concat_tables(found)

    return (phrase_blocks(slices, filters, buckets_of(slices)).groupBy("bucket")
            .applyInArrow(frequent, "lang string, k int, phrase string, n long"))


def proposed(slices: DataFrame, support: int) -> np.ndarray:
    """The filter of the phrases, but the longest, that may be frequent in
    ``slices``, level by level. Their keys say enough: a proposal may be wrong."""
    before, now = None, np.zeros(FILTER_BITS // 64, np.uint64)
    for _ in range(WORDS - 1):
        with Shipped(slices.sparkSession, before, now) as filters:
            found = written(likely(slices, filters, support), "phrases-proposed")
        before, now = now, with_keys(now, found)
    return now


def mined(slices: DataFrame, support: int, filter_: np.ndarray) -> DataFrame:
    """(lang, k, phrase, n) of all phrases with ``n >= support``, starting from
    the set in ``filter_``."""
    spark, before, now, found = slices.sparkSession, None, filter_, []
    while True:
        only = None
        if before is None:  # the first pass counts most; those after it little, at once
            with Shipped(spark, before, now) as filters:
                keys_ = written(likely(slices, filters, support), "phrases-likely")
            only = with_keys(np.zeros_like(now), keys_)
        with Shipped(spark, before, now, only) as filters:
            part = written(counted(slices, filters, support), "phrases-counted")
        found.append(part)
        grown = with_phrases(now, part.where(F.col("k") < WORDS))
        if (grown == now).all():
            return reduce(DataFrame.unionByName, found)
        before, now = now, grown


def frequent_phrases(docs: DataFrame, support: int = SUPPORT, fraction: int = FRACTION, slice_chars: int = SLICE) -> tuple[DataFrame, DataFrame]:
    """(lang, k, phrase, n) of every phrase of up to ``WORDS`` words that occurs
    ``support`` times or more in ``docs`` (doc_id, text, lang), and (lang, n) of
    all words."""
    texts = docs.select("text", F.coalesce("lang", F.lit(UNKNOWN)).alias("lang"),
                         (F.pmod(F.xxhash64("doc_id"), F.lit(fraction)) == 0).alias("sampled"))
    with small_batches(docs.sparkSession):
        slices = written(sliced(texts, slice_chars), "phrases-slices", **LARGE_VALUES)
        lowered = max(2, int(LOWERED * support / fraction))
        found = mined(slices, support, proposed(slices.where("sampled"), lowered))
    totals = slices.groupBy("lang").agg(F.sum("n_words").alias("n"))
    return written(found, "phrases-frequent"), totals


def _exact(column: Column | str) -> Column:
    return (F.col(column) if isinstance(column, str) else column).cast("decimal(20,0)")


def collocations(docs: DataFrame, support: int = SUPPORT, limit: int = LIMIT, covered: int = 80,
                 fraction: int = FRACTION, slice_chars: int = SLICE) -> DataFrame:
    """Each language's first ``limit`` phrases of two words and more by
    ``floor(2000000 a / (l + r))`` of their lowest-scoring cut, without those
    that a longer candidate with ``covered`` per cent of their count contains."""
    found, totals = frequent_phrases(docs, support, fraction, slice_chars)
    words = F.split("phrase", " ")
    candidates = found.where("k > 1").select("lang", "k", "phrase", F.col("n").alias("a"), words.alias("w"))
    part = lambda first, size: F.array_join(F.slice("w", first, size), " ")
    cuts = (candidates.withColumn("cut", F.explode(F.sequence(F.lit(1), F.col("k") - 1)))
            .select("lang", "phrase", "a", "cut", part(F.lit(1), F.col("cut")).alias("first"),
                    part(F.col("cut") + 1, F.col("k") - F.col("cut")).alias("rest")))
    of = lambda name, count: found.select("lang", F.col("phrase").alias(name), F.col("n").alias(count))
    cuts = cuts.join(of("first", "l"), ["lang", "first"]).join(of("rest", "r"), ["lang", "rest"])
    # 2000000 a passes 64 bits before a does.
    cuts = cuts.withColumn("two", _exact("a") * F.lit(2_000_000).cast("decimal(7,0)")).withColumn("sum", _exact("l") + _exact("r"))
    scored = cuts.groupBy("lang", "phrase").agg(F.first("a").alias("a"), F.min(F.struct(F.expr("two div sum").alias("score"), "cut", "l", "r")).alias("best"))
    inner = F.flatten(F.transform(F.sequence(F.lit(2), F.col("k") - 1), lambda size: F.transform(
        F.sequence(F.lit(1), F.col("k") - size + 1), lambda first: F.array_join(F.slice("w", first, size), " "))))
    within = (candidates.where("k > 2").select("lang", "a", F.explode(inner).alias("phrase"))
              .groupBy("lang", "phrase").agg(F.max("a").alias("outer")))
    kept = scored.join(within, ["lang", "phrase"], "left").where(
        F.col("outer").isNull() | (_exact("outer") * 100 < _exact("a") * covered))
    order = Window.partitionBy("lang").orderBy(F.col("best.score").desc(), F.col("a").desc(), "phrase")
    ranked = kept.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "best.l", "best.r", "n", "best.score")


def op13_phrase_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each language's collocations."""
    return collocations(read_table(spark, sf_dir, "documents"))


OP13_SQL = r"""
WITH pieces AS MATERIALIZED (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
lists AS MATERIALIZED (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
totals AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM lists GROUP BY lang),
grams AS MATERIALIZED (SELECT lang, k, unnest([array_to_string(w[i:i + k - 1], ' ') FOR i IN range(1, len(w) - k + 2)]) AS phrase
  FROM lists, range(1, 5) AS t(k) WHERE len(w) >= k),
f AS MATERIALIZED (SELECT lang, k, phrase, count(*) AS n FROM grams GROUP BY ALL HAVING count(*) >= 30),
c AS MATERIALIZED (SELECT lang, k, phrase, n AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1),
parts AS MATERIALIZED (SELECT lang, k, phrase, a, unnest(range(1, k)) AS cut, w FROM c),
named AS MATERIALIZED (SELECT lang, phrase, a, cut, array_to_string(w[1:cut], ' ') AS head, array_to_string(w[cut + 1:], ' ') AS tail FROM parts),
counts AS MATERIALIZED (SELECT lang || ':' || phrase AS key, n FROM f),
cuts AS MATERIALIZED (SELECT lang, phrase, a, cut, l.n AS l, r.n AS r, CAST(CAST(2000000 AS HUGEINT) * a // (l.n + r.n) AS BIGINT) AS score
  FROM named JOIN counts l ON l.key = lang || ':' || head JOIN counts r ON r.key = lang || ':' || tail),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
inner_ AS MATERIALIZED (SELECT lang, max(a) AS covering, phrase FROM (
  SELECT lang, a, unnest(flatten([[array_to_string(w[i:i + size - 1], ' ') FOR i IN range(1, k - size + 2)] FOR size IN range(2, k)])) AS phrase
  FROM c) GROUP BY lang, phrase)
SELECT b.lang, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.phrase) AS rank, b.phrase, a, l, r, n, score
FROM best b JOIN totals USING (lang) LEFT JOIN inner_ i ON i.lang = b.lang AND i.phrase = b.phrase
WHERE covering IS NULL OR 100 * CAST(covering AS HUGEINT) < 80 * CAST(a AS HUGEINT)
QUALIFY rank <= 2000
"""
