"""Structured Streaming forms of ingest and the live roll-ups.

``start_ingest`` decodes a stream of raw frames once per micro-batch and
keeps the strike and outcome tables up to date through ``foreachBatch`` with
idempotent, batch-keyed writes (exactly-once on replay).

The roll-ups over the written tables (``*_rollup_stream``) keep one state row
for each run of a batch and key, in ``update`` or ``complete`` mode: late rows
count in their hour, and the newest hours are there at once. A batch that is
ingested again shows up as a second run; ``settled`` keeps the runs of the
batch list (``sources.commits.runs_of``), so nothing is counted twice, and a
run without any row takes back the one before it. Where the folders of batches
are compacted, ask the roll-ups that ingest keeps itself (``read_hourly``,
``read_counters``): they follow the list without a stream.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.numeric import pct
from ..functions.timeutil import floor_hour
from ..operators.decode import decode_frames
from ..sources.tables import ingest_batch

# Local property the stream execution thread carries: the query's stable id.
QUERY_ID_PROPERTY = "sql.streaming.queryId"


def _trigger(writer, trigger: str | None):
    if trigger is None or trigger == "availableNow":
        return writer.trigger(availableNow=True)
    return writer.trigger(processingTime=trigger)


def start_ingest(frames: DataFrame, root: str, checkpoint: str,
                 trigger: str | None = "availableNow", name: str = "ingest") -> StreamingQuery:
    """Continuously decode a frame stream into the strike and outcome tables.

    One query, one decode per micro-batch: each micro-batch goes through
    ``ingest_batch`` (all tables, then one entry of the batch list). The key is
    the streaming query id (stable across restarts from the same checkpoint)
    plus the epoch, so a micro-batch replayed after a failure replaces its own
    entry: exactly-once output without a second decode. ``sources.tables.compact``
    merges the folders of many micro-batches while this goes on.

    ``root`` and ``checkpoint`` must be on shared storage (see
    ``session.shared_dir``). ``trigger`` is ``"availableNow"`` or a
    processing-time interval such as ``"10 seconds"``.
    """
    def write(batch, epoch: int) -> None:
        query_id = batch.sparkSession.sparkContext.getLocalProperty(QUERY_ID_PROPERTY)
        if not query_id:  # any other key could be that of another ingest into the same root
            raise RuntimeError(f"{QUERY_ID_PROPERTY} is not set")
        ingest_batch(batch, root, batch_id=f"{query_id}-{epoch}")

    writer = (frames.writeStream.foreachBatch(write)
              .option("checkpointLocation", checkpoint).queryName(name))
    return _trigger(writer, trigger).start()


def hourly_rollup_stream(strikes: DataFrame) -> DataFrame:
    """Per batch run and clock hour: strikes and positive ones. No watermark:
    an hour's row is updated whenever rows of that hour arrive."""
    positive = F.count_if(F.col("polarity") == "positive")
    return (strikes.groupBy("batch_id", "run", floor_hour(F.col("strike_timestamp")).alias("hour"))
            .agg(F.count(F.lit(1)).alias("strike_count"), positive.alias("positive")))


def hourly_activity_of(rollup: DataFrame, runs: DataFrame | None = None) -> DataFrame:
    """Per clock hour: strike count and % positive polarity, of the settled runs."""
    sums = settled(rollup, runs).groupBy("hour").agg(F.sum("strike_count").alias("strike_count"), F.sum("positive").alias("positive"))
    return sums.select("hour", "strike_count", (F.col("positive") / F.col("strike_count") * 100).alias("pct_positive"))


def ingestion_rollup_stream(outcome_rows: DataFrame) -> DataFrame:
    """Per batch run: frames received and stored, last time received."""
    return outcome_rows.groupBy("batch_id", "run").agg(
        F.count(F.lit(1)).alias("received"), F.count_if("stored").alias("stored"), F.max("received_at").alias("last"))


def ingestion_stats_of(rollup: DataFrame, runs: DataFrame | None = None) -> DataFrame:
    """The counters of ``ingestion_stats``, summed over the settled runs."""
    agg = settled(rollup, runs).agg(
        F.coalesce(F.sum("received"), F.lit(0)).alias("total_received"),
        F.coalesce(F.sum("stored"), F.lit(0)).alias("total_stored"),
        F.coalesce(F.sum(F.col("received") - F.col("stored")), F.lit(0)).alias("total_failed"),
        F.max("last").alias("last_strike_time"), F.max("last").alias("updated_at"))
    return agg.withColumn("success_rate", pct(F.col("total_stored"), F.col("total_received"), 2))


def settled(rollup: DataFrame, runs: DataFrame | None = None) -> DataFrame:
    """The rows of the runs that count: those of the batch list, ``runs``
    (batch_id, run). ``rollup`` has one current row for each key: of an
    update-mode sink, the last row written for it.

    Without ``runs`` the newest run that has a row counts for its batch; that
    can't see that a batch was run again without leaving a row.
    """
    if runs is not None:
        return rollup.join(runs, ["batch_id", "run"], "left_semi")
    newest = F.max("run").over(Window.partitionBy("batch_id"))
    return rollup.withColumn("_newest", newest).where("run = _newest").drop("_newest")


def decode_report_stream(frames: DataFrame) -> DataFrame:
    """The diagnostic decoder's running report over a frame stream
    (``complete`` output mode): samples, documents that parse as JSON,
    success rate (%, 1 dp) and documents with coordinate warnings.

    The lenient decode is per-row; the report is one global group, so the
    streaming state is a single row however long the feed runs.
    """
    lenient = decode_frames(frames, "lenient")
    agg = lenient.groupBy().agg(
        F.count(F.lit(1)).alias("samples_processed"),
        F.count_if(F.col("json_ok")).alias("successful_decodes"),
        F.count_if(F.col("json_ok") & (F.size("warnings") > 0)).alias("validation_warnings"))
    return agg.withColumn("success_rate", pct(F.col("successful_decodes"), F.col("samples_processed"), 1))


def progress_rollup_stream(outcome_rows: DataFrame) -> DataFrame:
    """Per batch run and connection: frames processed and decoded, the highest sample number.

    State is one row for each connection of a batch run, not for each frame.
    """
    return outcome_rows.groupBy("batch_id", "run", "session_id").agg(
        F.count(F.lit(1)).alias("processed"), F.count_if(F.col("decoded")).alias("stored"),
        F.max("sample_no").alias("sample_no"))


def progress_of(rollup: DataFrame, runs: DataFrame | None = None) -> DataFrame:
    """The live progress line of each connection: cumulative processed / stored
    (decoded) / failed counts and the rate (%, 1 dp), of the settled runs."""
    agg = settled(rollup, runs).groupBy("session_id").agg(
        F.sum("processed").alias("processed"), F.sum("stored").alias("stored"), F.max("sample_no").alias("sample_no"))
    return (agg.withColumn("failed", F.col("processed") - F.col("stored"))
               .withColumn("success_rate", pct(F.col("stored"), F.col("processed"), 1)))
