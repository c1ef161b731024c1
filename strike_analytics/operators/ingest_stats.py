"""Ingestion and decode-quality reports over the per-frame outcome table.

The source service keeps mutable counters (a one-row table bumped per frame
and in-memory counters reset per connection). Here every counter is an
aggregate over append-only outcome rows, so it is exactly-once, survives
restarts and can be recomputed for any time range.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import pct
from ..plans.prefix import running_sums

# Rows per window partition at each level of the progress log's running sum.
PROGRESS_FANOUT = 4096


def ingestion_stats(outcomes: DataFrame) -> DataFrame:
    """Frames received / stored / failed, last activity and success rate (%, 2 dp).

    ``last_strike_time`` and ``updated_at`` are both the time of the last
    frame processed (the source sets both on every frame, failed ones too).
    One global aggregate: partial counts per task, one final row.
    """
    agg = outcomes.agg(
        F.count(F.lit(1)).alias("total_received"),
        F.count_if(F.col("stored")).alias("total_stored"),
        F.count_if(~F.col("stored")).alias("total_failed"),
        F.max("received_at").alias("last_strike_time"),
        F.max("received_at").alias("updated_at"),
    )
    return agg.withColumn("success_rate", pct(F.col("total_stored"), F.col("total_received"), 2))


#: The place of frames without a sample number, before all others.
UNNUMBERED = -(1 << 50)


def ingest_progress(outcomes: DataFrame, every: int = 10, fanout: int = PROGRESS_FANOUT,
                    levels: int = 3) -> DataFrame:
    """The periodic progress line: at every ``every``-th frame of a connection
    and at its last one (the closing line), cumulative processed / stored /
    failed and the success rate (%, 1 dp).

    Frames are counted by rank: ``sample_no`` orders a connection's frames,
    and may begin anywhere, have gaps, repeat or be missing (such frames come
    first; of one number those that failed come first). "stored" counts frames
    that decoded, including those the table later refused (that is what the
    source's progress line reports).

    Scales with skew: frames are first counted by (session, sample number), so
    a number that repeats without end is one row; the running sums over these
    are then a multi-level scan (``plans.prefix.running_sums``), so a session
    holding a third of all frames is still spread over many tasks.
    """
    numbers = (outcomes.groupBy("session_id", "sample_no")
               .agg(F.count(F.lit(1)).alias("_n"), F.count_if(F.col("decoded")).alias("_ok"))
               .withColumn("_index", F.coalesce("sample_no", F.lit(UNNUMBERED).cast("long"))))
    cum = running_sums(numbers, "session_id", "_index", ["_n", "_ok"], fanout, levels)
    before = F.col("_n_cum") - F.col("_n")
    first = every - F.pmod(before, F.lit(every))
    lines = (cum.where(first <= F.col("_n"))
             .select("session_id", "sample_no", before.alias("_before"), (F.col("_ok_cum") - F.col("_ok")).alias("_ok_before"),
                     (F.col("_n") - F.col("_ok")).alias("_bad"), F.explode(F.sequence(first, F.col("_n"), F.lit(every).cast("long"))).alias("_at")))
    ok = F.greatest(F.col("_at") - F.col("_bad"), F.lit(0))
    periodic = lines.select("session_id", "sample_no", (F.col("_before") + F.col("_at")).alias("processed"),
                            (F.col("_ok_before") + ok).alias("stored"))
    closing = numbers.groupBy("session_id").agg(
        F.max("sample_no").alias("sample_no"), F.sum("_n").alias("processed"), F.sum("_ok").alias("stored")).where(F.col("processed") % every != 0)
    return (periodic.unionByName(closing)
            .select("session_id", "sample_no", "processed", "stored",
                    (F.col("processed") - F.col("stored")).alias("failed"),
                    pct(F.col("stored"), F.col("processed"), 1).alias("success_rate")))


def decode_report(lenient: DataFrame) -> DataFrame:
    """Final report of the lenient decoder: samples, documents that parse as
    JSON, success rate (%, 1 dp) and documents with coordinate warnings."""
    agg = lenient.agg(
        F.count(F.lit(1)).alias("samples_processed"),
        F.count_if(F.col("json_ok")).alias("successful_decodes"),
        F.count_if(F.col("json_ok") & (F.size("warnings") > 0)).alias("validation_warnings"),
    )
    return agg.withColumn("success_rate", pct(F.col("successful_decodes"), F.col("samples_processed"), 1))
