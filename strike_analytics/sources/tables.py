"""Readers and writers for frames, strikes and outcomes (Parquet).

Layout at scale:

* ``frames``   -- raw landed frames (or a Kafka topic with ``value BINARY``).
* ``decoded``  -- every frame with its decoded fields and reject reason, by
  receive date. Written once by the ingest job; it is the durable, replayable
  log (no mutable counters anywhere). Outcomes are a projection of it, four
  columns read from the file.
* ``strikes``  -- accepted strikes, by ``strike_date``, clustered by grid cell
  and time inside each date (see plans/layout.py).
* ``hourly``, ``counters`` -- partial roll-ups of each batch (see
  operators/rollups.py).

Each run of a batch has its own folder in each table and is published by one
entry of the batch list (see sources/commits.py): all tables change together,
and a batch that is run again with other content, or with none, leaves nothing
of its first run behind. ``compact`` merges the folders of many batches.

``run`` and ``batch_id`` tell the runs of one batch apart for streaming
readers, which see the files of both.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.timeutil import utc
from ..operators.decode import accepted_strikes, decode_frames, outcomes
from ..operators.rollups import COUNTERS, HOURLY, counter_parts, hourly_parts
from ..plans.layout import DATE_COLUMN, clustered
from ..plans.zorder import ZKEY
from ..schemas import FRAMES, STRIKES
from . import commits

_BATCH = [T.StructField("run", T.LongType()), T.StructField("batch_id", T.StringType())]
#: The tables of a root.
TABLES = ["decoded", "strikes", "hourly", "counters"]
#: What readers expect of the tables; an empty table has no file to tell it.
STRIKE_TABLE = T.StructType([*STRIKES.fields, T.StructField(ZKEY, T.LongType()), *_BATCH, T.StructField(DATE_COLUMN, T.DateType())])
LOG_TABLE = T.StructType([*(f for f in FRAMES.fields if f.name in ("frame_id", "session_id", "sample_no", "received_at")),
                          T.StructField("reason", T.StringType()), *_BATCH, T.StructField("received_date", T.DateType())])


def read_frames(spark: SparkSession, path: str, streaming: bool = False,
                max_files_per_trigger: int | None = None) -> DataFrame:
    """Raw frames from Parquet files; a streaming read follows new files."""
    if not streaming:
        return spark.read.schema(FRAMES).parquet(path)
    reader = spark.readStream.schema(FRAMES)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.parquet(path)


def frames_from_kafka(records: DataFrame, frame_id_bits: int = 40) -> DataFrame:
    """Map Kafka source records (``key, value, topic, partition, offset,
    timestamp, ...``) to the frame schema.

    One topic partition is one connection: ``session_id = partition``,
    ``sample_no = offset + 1`` and ``frame_id = partition << 40 | offset``
    (unique while offsets stay below 2**40). Use with
    ``spark.readStream.format("kafka")...load()`` when the Kafka connector is
    on the classpath; the mapping itself is plain column arithmetic.
    """
    return records.select(
        (F.shiftleft(F.col("partition").cast("long"), frame_id_bits) + F.col("offset")).alias("frame_id"),
        F.col("partition").cast("long").alias("session_id"),
        (F.col("offset") + 1).cast("long").alias("sample_no"),
        F.col("timestamp").cast("timestamp").alias("received_at"),
        F.lit(False).alias("is_text"),
        F.col("value").cast("binary").alias("payload"),
    )


def _root(path: str) -> tuple[str, str]:
    root, _, table = path.rstrip("/").rpartition("/")
    return root, table


def _read(spark: SparkSession, path: str, schema: T.StructType, streaming: bool) -> DataFrame:
    if streaming:
        return spark.readStream.schema(schema).parquet(path)
    return commits.read_live(spark, *_root(path), schema)


def read_strikes(spark: SparkSession, path: str, streaming: bool = False, zkey: bool = False) -> DataFrame:
    """The strike table; keeps ``strike_date`` so time filters prune partitions,
    and with ``zkey`` the key that boxes are pruned by (null in folders that
    were not written here). A stream also has ``batch_id`` and ``run`` (see
    ``streaming.continuous.settled``)."""
    df = _read(spark, path, STRIKE_TABLE, streaming)
    df = df if zkey else df.drop(ZKEY)
    return df if streaming else df.drop("batch_id", "run")


def read_outcomes(spark: SparkSession, path: str, streaming: bool = False) -> DataFrame:
    """One row per frame, from the decoded log; a stream also has ``batch_id`` and ``run``."""
    log = _read(spark, path, LOG_TABLE, streaming)
    return outcomes(log, "batch_id", "run") if streaming else outcomes(log)


def read_hourly(spark: SparkSession, root: str) -> DataFrame:
    """The partial roll-ups by hour and hemisphere (``operators.rollups``)."""
    return commits.read_live(spark, root, "hourly", T.StructType([*HOURLY.fields, *_BATCH]))


def read_counters(spark: SparkSession, root: str) -> DataFrame:
    """The counters of each batch, one row for each."""
    return commits.read_live(spark, root, "counters", T.StructType([*COUNTERS.fields, *_BATCH]))


def write_strikes(strikes: DataFrame, path: str, batch_id: str) -> None:
    """Write the strikes of a batch by date, clustered for row-group skipping;
    replaces the batch whole. ``path`` is a ``strikes`` table without others."""
    spark, (root, table) = strikes.sparkSession, _root(path)
    run = commits.new_run()
    commits.open_list(spark, root)
    written = _write_run(clustered(strikes), root, table, run, batch_id, DATE_COLUMN)
    commits.publish(spark, root, run, spark.read.schema(STRIKE_TABLE).parquet(written).count(), batch_id)


def _write_run(df: DataFrame, root: str, table: str, run: int, batch_id: str | None, by: str | None = None) -> str:
    """``batch_id``: of all rows; None if they have their own."""
    folder = f"{root.rstrip('/')}/{table}/run={run}"
    df = df if batch_id is None else df.withColumn("batch_id", F.lit(batch_id))
    writer = df.write.mode("overwrite").option("partitionOverwriteMode", "static").option("maxRecordsPerFile", 5_000_000)
    (writer.partitionBy(by) if by else writer).parquet(folder)
    return folder


def ingest_batch(frames: DataFrame, root: str, batch_id: str) -> dict[str, str]:
    """Batch ingest of one batch of landed frames; safe to re-run.

    Decodes once and writes the decoded log (the barrier between the CPU-heavy
    decode and its consumers, and the lineage cut: a lost executor recomputes
    from that file, not from the decode). The strike table is then a scan of
    that log with the ``reason`` predicate pushed into Parquet; outcomes are
    read from the log itself. The partial roll-ups are aggregates of what was
    written. The batch counts when its entry is published, last of all.
    """
    spark = frames.sparkSession
    root, run = root.rstrip("/"), commits.new_run()
    commits.open_list(spark, root)
    decoded = decode_frames(frames, "strict")
    decoded = decoded.withColumn("received_date", F.to_date(utc("received_at")))
    folder = _write_run(decoded, root, "decoded", run, batch_id, "received_date")
    # Explicit schema: an empty batch leaves no data files to infer it from.
    log = spark.read.schema(decoded.schema).parquet(folder)
    folder = _write_run(clustered(accepted_strikes(log, with_date=True)), root, "strikes", run, batch_id, DATE_COLUMN)
    _write_run(hourly_parts(spark.read.schema(STRIKE_TABLE).parquet(folder)), root, "hourly", run, batch_id)
    counters = _write_run(counter_parts(outcomes(log)), root, "counters", run, batch_id)
    rows = spark.read.schema(COUNTERS).parquet(counters).first()["received"]
    commits.publish(spark, root, run, rows, batch_id)
    return {"decoded": f"{root}/decoded", "strikes": f"{root}/strikes", "outcomes": f"{root}/decoded"}


def compact(spark: SparkSession, root: str) -> int | None:
    """Merges the folders of all batches since the last compaction into one of
    each table, by date and clustered; gives its run, or None if there is
    nothing to merge. Rows, and answers, stay the same; ``retire`` removes the
    old folders.

    An earlier compaction is merged too if it has no more rows than all that
    is merged with it, or outdated ones: each row is rewritten a number of times that
    grows with the logarithm of the table, and the folders stay as few.
    Compactions must not overlap; ingests may go on meanwhile.
    """
    root = root.rstrip("/")
    live = commits.live_runs(spark, root)
    if live is None:
        return None
    chosen, size = list(live.batches), sum(live.rows[r] for r in live.batches)
    # Outdated rows can only be there if a batch came in again: its newer run is merged with them.
    again = _outdated(spark, root, live)
    for run in sorted(live.merged, key=lambda r: live.rows[r]):
        if run in again or live.rows[run] <= size:
            chosen.append(run)
            size += live.rows[run]
    if len(chosen) < 2:
        return None
    part = commits.Live({r: b for r, b in live.batches.items() if r in chosen}, {r: b for r, b in live.merged.items() if r in chosen}, live.rows)
    run = commits.new_run()
    log = T.StructType([*decode_frames(spark.createDataFrame([], FRAMES)).schema.fields, *_BATCH, T.StructField("received_date", T.DateType())])
    keys = ["received_date", "session_id", "sample_no", "frame_id"]
    decoded = commits.read_live(spark, root, "decoded", log, part).drop("run")
    _write_run(decoded.repartitionByRange(*keys).sortWithinPartitions(*keys), root, "decoded", run, None, "received_date")
    _write_run(clustered(commits.read_live(spark, root, "strikes", STRIKE_TABLE, part).drop("run")), root, "strikes", run, None, DATE_COLUMN)
    for table, schema, key in (("hourly", HOURLY, "hour"), ("counters", COUNTERS, "batch_id")):
        rows = commits.read_live(spark, root, table, T.StructType([*schema.fields, *_BATCH]), part).drop("run")
        _write_run(rows.repartitionByRange(key, "batch_id").sortWithinPartitions(key, "batch_id"), root, table, run, None)
    commits.publish(spark, root, run, size, merges=part.runs)
    return run


def _outdated(spark: SparkSession, root: str, live: commits.Live) -> set[int]:
    """The compactions with rows of a batch that came in again, by their counters."""
    if not live.merged or not live.batches:
        return set()
    folder = f"{root}/counters"
    rows = (spark.read.schema(T.StructType([*COUNTERS.fields, *_BATCH])).option("basePath", folder)
            .parquet(*(f"{folder}/run={r}" for r in live.merged)).where(F.col("batch_id").isin(list(live.batches.values()))))
    return {r.run for r in rows.select("run").distinct().collect()}


def retire(spark: SparkSession, root: str, grace_seconds: float = 86_400) -> list[int]:
    """Removes the folders that readers of the list no longer see, after a time of grace."""
    return commits.retire(spark, root, TABLES, grace_seconds)


def read_kafka(spark: SparkSession, servers: str, topic: str, streaming: bool = True, **options: str) -> DataFrame:
    """Frames of a Kafka topic (needs the Kafka connector on the classpath)."""
    reader = (spark.readStream if streaming else spark.read).format("kafka").options(**options)
    return frames_from_kafka(reader.option("kafka.bootstrap.servers", servers).option("subscribe", topic).load())
