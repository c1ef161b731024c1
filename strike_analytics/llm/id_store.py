"""Token ids as binary shards with a shared zstandard dictionary.

Documents are put in ascending doc_id order by a range shuffle; every range
becomes one shard file in the output folder. A document's ids (with the end id
behind them) are serialized as little-endian unsigned integers of 16 bits, or
32 where the vocabulary needs them, and compressed on their own with a
dictionary that all shards share: any one document can be read by itself, and
short ones still compress well.

A shard is: ``MAGIC``, the SHA-256 of the dictionary, width of an id in bytes
(u8), the frames, then the index of n + 1 entries (u64 first id, u64 first
byte), n doc_ids (i64), n bytes that tell which of them are null, and at the
end the number of documents n and the index's place (u64 each). The dictionary lies beside the shards as ``<SHA-256>.dict``; readers refuse a shard
whose hash they don't have.

The dictionary is trained on a bounded sample: the ids of the ``SAMPLE``
documents whose doc_ids hash lowest, ``SAMPLE_IDS`` ids of each at most. Every
document is encoded and written, whatever the sample.

Files go through ``pyarrow.fs``, so the folder may lie on any shared file
system it knows. A task writes to a name of its own and renames at the end:
tasks that are repeated, or run twice at a time, leave one whole shard, since
a range's rows and their order don't depend on the attempt.

Scale: the texts are shuffled once, in ranges that Spark samples, of doc_id,
the text's hash and the row's number, so that neither one id of many rows nor
many equal rows are one task's work; a writer
holds one document's ids and its shard's index. The manifest has one row for
each shard, and only there the ids before a shard are added up.

Defined results: null and empty texts have the end id only; null doc_ids come
first; rows of one doc_id are all written, in the order of their texts' hashes;
an empty table gives no shard. Special tokens are as the tokenizer's file has
them.
"""

from __future__ import annotations

import hashlib
import posixpath
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strike_analytics.llm.bpe import encoder_from_file, tokenizer_from_file
from strike_analytics.llm.common import read_table, slices
from strike_analytics.session import fresh_dir

TOKENIZER = "byte_bpe_50k.json"
MAGIC = b"IDSHARD1"
HEADER = "<8s32sB"
SAMPLE, SAMPLE_IDS, DICTIONARY_BYTES, LEVEL = 2000, 2048, 64 << 10, 3


def qualified(spark: SparkSession, folder: str) -> str:
    """``folder`` with the scheme that Spark takes it to have, as pyarrow spells it."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    full = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toString()
    scheme, rest = full.split(":", 1)
    if scheme == "file":
        return "file://" + "/" + rest.lstrip("/")
    return f"{ {'s3a': 's3', 's3n': 's3'}.get(scheme, scheme)}:{rest}"


def file_system(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(folder)


def id_type(tokenizer_path: str) -> str:
    return "<u2" if tokenizer_from_file(tokenizer_path).get_vocab_size() <= 1 << 16 else "<u4"


def train_dictionary(docs: DataFrame, tokenizer_path: str, end_id: int) -> bytes:
    """From a bounded sample's serialized ids; empty if they are too few to learn from."""
    kind = id_type(tokenizer_path)
    lowest = (docs.select("doc_id", F.xxhash64("doc_id").alias("h")).orderBy("h").limit(SAMPLE)
              .agg(F.max("h").alias("h")).first()["h"])
    if lowest is None:
        return b""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder_from_file(tokenizer_path)
        for b in batches:
            texts = [t or "" for t in b.column("text").to_pylist()]
            ids = [with_end(e, end_id)[:SAMPLE_IDS].astype(kind).tobytes() for s in slices(texts) for e in encode(texts[s])]
            yield pa.RecordBatch.from_arrays([b.column("h"), pa.array(ids, pa.binary())], names=["h", "ids"])

    rows = (docs.select(F.xxhash64("doc_id").alias("h"), "text").where(F.col("h") <= lowest)
            .mapInArrow(run, "h long, ids binary").orderBy("h", "ids").limit(SAMPLE).collect())
    samples = [bytes(r["ids"]) for r in rows]
    try:
        return zstandard.train_dictionary(min(DICTIONARY_BYTES, max(256, sum(map(len, samples)) // 8)), samples).as_bytes()
    except zstandard.ZstdError:
        return b""


def with_end(encoded: bytes, end_id: int) -> np.ndarray:
    return np.frombuffer(encoded + struct.pack("<I", end_id), "<u4")


def _dictionary(data: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(data) if data else None


#: ``low`` and ``high``: doc_id and text hash of a shard's first and last document.
MANIFEST = "shard string, n_docs long, n_ids long, low long, low_hash long, high long, high_hash long, dictionary string"
_MANIFEST = pa.schema([("shard", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("low", pa.int64()), ("low_hash", pa.int64()),
                       ("high", pa.int64()), ("high_hash", pa.int64()), ("dictionary", pa.string())])


def write_shards(docs: DataFrame, folder: str, tokenizer_path: str, end_id: int = 0) -> DataFrame:
    """Writes ``docs`` (doc_id, text) and gives the manifest: shard, n_docs, n_ids,
    its first and last document and the dictionary's hash."""
    spark_folder, folder = folder, qualified(docs.sparkSession, folder)
    dictionary = train_dictionary(docs, tokenizer_path, end_id)
    digest = hashlib.sha256(dictionary).digest()
    where, base = file_system(folder)
    where.create_dir(base, recursive=True)
    with where.open_output_stream(posixpath.join(base, digest.hex() + ".dict")) as out:
        out.write(dictionary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next((b for b in batches if b.num_rows), None)
        if first is None:
            return
        where, base = file_system(folder)
        kind, encode = id_type(tokenizer_path), encoder_from_file(tokenizer_path)
        press = zstandard.ZstdCompressor(level=LEVEL, dict_data=_dictionary(dictionary))
        temporary = posixpath.join(base, f"_{uuid.uuid4().hex}")
        ids, keys, index, last = 0, [], [], first
        named = hashlib.sha256()
        with where.open_output_stream(temporary) as out:
            out.write(struct.pack(HEADER, MAGIC, digest, int(kind[-1])))
            at = struct.calcsize(HEADER)

            def put(batch: pa.RecordBatch) -> None:
                nonlocal ids, at
                texts = [t or "" for t in batch.column("text").to_pylist()]
                keys.extend(batch.column("doc_id").to_pylist())
                for s in slices(texts):
                    for encoded in encode(texts[s]):
                        document = with_end(encoded, end_id)
                        frame = press.compress(document.astype(kind).tobytes())
                        index.append((ids, at))
                        out.write(frame)
                        named.update(frame)
                        ids, at = ids + len(document), at + len(frame)

            put(first)
            for batch in batches:
                if batch.num_rows:
                    put(batch)
                    last = batch
            index.append((ids, at))
            out.write(np.array(index, "<u8").tobytes())
            out.write(np.array([k or 0 for k in keys], "<i8").tobytes())
            out.write(np.array([k is None for k in keys], np.uint8).tobytes())
            out.write(struct.pack("<QQ", len(keys), at))
        # Of equal rows the same name: an attempt that is repeated replaces its own shard.
        named.update(np.array([k or 0 for k in keys], "<i8").tobytes())
        shard = f"{named.hexdigest()[:32]}.ids"
        where.move(temporary, posixpath.join(base, shard))
        yield pa.RecordBatch.from_pylist([{"shard": shard, "n_docs": len(keys), "n_ids": ids, "low": keys[0], "low_hash": first.column("hash")[0].as_py(),
                                           "high": keys[-1], "high_hash": last.column("hash")[-1].as_py(),
                                           "dictionary": digest.hex()}], schema=_MANIFEST)

    manifest = posixpath.join(spark_folder, "manifest.parquet")
    # The row's number tells equal rows apart, so that any number of them can be dealt to several shards.
    order = ["doc_id", "hash", "text", "row"]
    (docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("hash"),
                 F.monotonically_increasing_id().alias("row"))
     .repartitionByRange("doc_id", "hash", "row").sortWithinPartitions(*order).select("doc_id", "text", "hash")
     .mapInArrow(run, MANIFEST).write.parquet(manifest))
    return docs.sparkSession.read.schema(MANIFEST).parquet(manifest)


class Shard:
    """Reads documents of one shard, each on its own."""

    def __init__(self, folder: str, name: str):
        where, base = file_system(folder)
        self.file = where.open_input_file(posixpath.join(base, name))
        magic, digest, width = struct.unpack(HEADER, self.file.read_at(struct.calcsize(HEADER), 0))
        if magic != MAGIC:
            raise ValueError(f"{name} is no shard")
        with where.open_input_stream(posixpath.join(base, digest.hex() + ".dict")) as source:
            dictionary = source.read()
        if hashlib.sha256(dictionary).digest() != digest:
            raise ValueError(f"{name} was written with another dictionary")
        size = self.file.size()
        self.n, place = struct.unpack("<QQ", self.file.read_at(16, size - 16))
        index = self.file.read_at(size - 16 - place, place)
        self.index = np.frombuffer(index, "<u8", 2 * (self.n + 1)).reshape(-1, 2).astype(np.int64)
        self.doc_ids = np.frombuffer(index, "<i8", self.n, 16 * (self.n + 1))
        self.null = np.frombuffer(index, np.uint8, self.n, 24 * self.n + 16).astype(bool)
        self.kind = f"<u{width}"
        self.unpress = zstandard.ZstdDecompressor(dict_data=_dictionary(dictionary))

    def ids(self, k: int) -> np.ndarray:
        """The ids of document ``k`` of the shard."""
        start, end = self.index[k, 1], self.index[k + 1, 1]
        return np.frombuffer(self.unpress.decompress(self.file.read_at(int(end - start), int(start))), self.kind)

    def close(self) -> None:
        self.file.close()


def shard_starts(manifest: DataFrame) -> DataFrame:
    """The manifest with ``before``, the ids of all shards before; one row for each shard is summed."""
    order = Window.orderBy(*(F.col(c).asc_nulls_first() for c in ("low", "low_hash", "high", "high_hash")), "shard").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    return manifest.withColumn("before", F.sum("n_ids").over(order) - F.col("n_ids"))


def read_shards(manifest: DataFrame, folder: str, with_ids: bool = False) -> DataFrame:
    """For each document, from the files: doc_id, start (ids of all documents
    before it), n_tokens, ids_crc32, and with ``with_ids`` the ids."""
    fields = [("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())]
    folder = qualified(manifest.sparkSession, folder)
    out = pa.schema(fields + ([("ids", pa.list_(pa.int32()))] if with_ids else []))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, before in zip(batch.column("shard").to_pylist(), batch.column("before").to_pylist()):
                shard = Shard(folder, name)
                for first in range(0, shard.n, 500):
                    rows = range(first, min(first + 500, shard.n))
                    ids = [shard.ids(k) for k in rows]
                    made = {"doc_id": [None if shard.null[k] else int(shard.doc_ids[k]) for k in rows],
                            "start": [before + int(shard.index[k, 0]) for k in rows], "n_tokens": [len(x) for x in ids],
                            "ids_crc32": [zlib.crc32(x.astype("<u4").tobytes()) for x in ids]}
                    yield pa.RecordBatch.from_pydict(made | ({"ids": ids} if with_ids else {}), schema=out)
                shard.close()

    ranges = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return shard_starts(manifest).select("shard", "before").repartition(ranges, "shard").mapInArrow(
        run, "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<int>" if with_ids else ""))


def op5_id_store(spark: SparkSession, sf_dir: str, tokenizer: str = TOKENIZER) -> DataFrame:
    """Every document, written and read back."""
    folder = fresh_dir(spark, "id-store")
    manifest = write_shards(read_table(spark, sf_dir, "documents"), folder, public_tokenizers.path(tokenizer))
    return read_shards(manifest, folder)
