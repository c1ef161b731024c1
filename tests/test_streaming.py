"""Streaming ingest equals batch; restarts do not duplicate; live roll-ups."""

import uuid

from conftest import SF_SMALL
from strike_analytics.operators.aggregates import hourly_activity, strike_stats
from strike_analytics.operators.decode import accepted_strikes, decode_frames
from strike_analytics.plans.registry import NOW
from strike_analytics.session import fresh_dir
from strike_analytics.sources.events import read_frames_from_events
from strike_analytics.operators.ingest_stats import ingest_progress, ingestion_stats
from strike_analytics.sources.tables import ingest_batch, read_frames, read_outcomes, read_strikes
from strike_analytics.streaming.continuous import (hourly_activity_of, hourly_rollup_stream, ingestion_rollup_stream,
                                                   ingestion_stats_of, progress_of, progress_rollup_stream, start_ingest)


def test_stream_equals_batch_and_restart_is_idempotent(spark):
    src = fresh_dir(spark, "frames")
    frames = read_frames_from_events(spark, SF_SMALL)
    frames.repartition(3).write.parquet(src)
    root, ck = fresh_dir(spark, "tables"), fresh_dir(spark, "ck")
    for _ in range(2):                                # second run = restart from checkpoint
        start_ingest(read_frames(spark, src, streaming=True, max_files_per_trigger=1), root, ck).awaitTermination()
    got = read_strikes(spark, f"{root}/strikes").drop("strike_date")
    want = accepted_strikes(decode_frames(frames))
    assert got.count() == 800 and read_outcomes(spark, f"{root}/decoded").count() == 1000
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0
    log = spark.read.parquet(f"{root}/decoded")
    assert log.select("batch_id").distinct().count() == 3  # one per micro-batch (3 files, 1 per trigger)

    live = hourly_activity_of(stream_to_table(hourly_rollup_stream(read_strikes(spark, f"{root}/strikes", streaming=True))))
    batch = hourly_activity(got, now=NOW, hours=24 * 31)
    assert live.exceptAll(batch).count() == 0 and batch.exceptAll(live).count() == 0 and live.count() > 400
    rollup = stream_to_table(progress_rollup_stream(read_outcomes(spark, f"{root}/decoded", streaming=True)))
    lines = {r.session_id: r for r in progress_of(rollup).collect()}
    closing = ingest_progress(read_outcomes(spark, f"{root}/decoded")).where("sample_no = 250").collect()
    assert len(closing) == 4 and all(
        (r.processed, r.stored, r.failed, r.success_rate) ==
        tuple(lines[r.session_id][c] for c in ("processed", "stored", "failed", "success_rate")) for r in closing)


def stream_to_table(df):
    name = f"t_{uuid.uuid4().hex}"
    df.writeStream.format("memory").queryName(name).outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    return df.sparkSession.table(name)


def test_a_batch_run_again_is_not_counted_twice(spark):
    root, ck = fresh_dir(spark, "again"), fresh_dir(spark, "again-ck")
    frames = read_frames_from_events(spark, SF_SMALL)
    rollup = fresh_dir(spark, "again-rollup")

    def follow():
        stream = ingestion_rollup_stream(read_outcomes(spark, f"{root}/decoded", streaming=True))
        (stream.writeStream.outputMode("complete").option("checkpointLocation", ck)
         .foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(rollup))
         .trigger(availableNow=True).start().awaitTermination())
        return ingestion_stats_of(spark.read.parquet(rollup)).first()

    for _ in range(2):
        ingest_batch(frames, root, "1")
        r = follow()
        assert (r.total_received, r.total_stored, r.total_failed, r.success_rate) == (1000, 800, 200, 80.0)
    ingest_batch(frames.limit(10), root, "1")
    assert read_outcomes(spark, f"{root}/decoded").count() == 10 == follow().total_received


def test_a_batch_run_again_leaves_nothing_behind(spark):
    root = fresh_dir(spark, "fewer")
    frames = read_frames_from_events(spark, SF_SMALL)
    good = accepted_strikes(decode_frames(frames), with_date=True).orderBy("strike_timestamp")
    first, last = good.first(), good.orderBy(good.strike_timestamp.desc()).first()
    assert first.strike_date != last.strike_date
    ingest_batch(frames.where(frames.frame_id.isin(first.id, last.id)), root, "1")
    assert read_strikes(spark, f"{root}/strikes").count() == 2
    ingest_batch(frames.where(frames.frame_id == last.id), root, "1")
    assert [r.id for r in read_strikes(spark, f"{root}/strikes").collect()] == [last.id]


def test_a_first_batch_without_strikes_reads_as_an_empty_table(spark, make_frames):
    root = fresh_dir(spark, "rejected")
    ingest_batch(make_frames(["no frame", "none either"]), root, "1")
    strikes = read_strikes(spark, f"{root}/strikes")
    r = strike_stats(strikes).first()
    assert strikes.count() == 0 and r.total_strikes == 0 and r.avg_latitude is None
    assert ingestion_stats(read_outcomes(spark, f"{root}/decoded")).first().total_received == 2


def test_progress_with_gaps_and_closing_line(spark):
    rows = [(1, 1000 + 7 * k, k % 5 > 0) for k in range(23)] + [(2, k, True) for k in range(1, 4)]
    got = ingest_progress(spark.createDataFrame(rows, "session_id long, sample_no long, decoded boolean")).collect()
    assert sorted((r.session_id, r.sample_no, r.processed, r.stored) for r in got) == [
        (1, 1063, 10, 8), (1, 1133, 20, 16), (1, 1154, 23, 18), (2, 3, 3, 3)]


def test_live_decode_report_equals_batch(spark):
    from strike_analytics.operators.decode import decode_frames
    from strike_analytics.operators.ingest_stats import decode_report
    from strike_analytics.streaming.continuous import decode_report_stream
    src = fresh_dir(spark, "frames-report")
    frames = read_frames_from_events(spark, SF_SMALL)
    frames.repartition(3).write.parquet(src)
    q = (decode_report_stream(read_frames(spark, src, streaming=True, max_files_per_trigger=1))
         .writeStream.format("memory").queryName("report_t").outputMode("complete")
         .trigger(availableNow=True).start())
    q.awaitTermination()
    live = spark.table("report_t").collect()[0].asDict()
    batch = decode_report(decode_frames(frames, "lenient")).collect()[0].asDict()
    assert live == batch and live["samples_processed"] == 1000
