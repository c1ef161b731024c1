"""Counters derived from outcomes: invariants and the two-level running sum."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from strike_analytics.operators.decode import decode_frames, outcomes
from strike_analytics.operators.ingest_stats import ingest_progress, ingestion_stats
from strike_analytics.schemas import OUTCOMES
from strike_analytics.sources.events import read_frames_from_events


@pytest.fixture(scope="module")
def outs(spark):
    return outcomes(decode_frames(read_frames_from_events(spark, SF_SMALL))).cache()


def test_received_is_stored_plus_failed(outs):
    r = ingestion_stats(outs).collect()[0]
    assert r.total_received == r.total_stored + r.total_failed == 1000
    assert r.total_stored == 800 and r.success_rate == 80.0


def test_one_outcome_per_frame(outs):
    assert outs.groupBy("frame_id").count().where("count <> 1").count() == 0
    assert outs.where(F.col("stored") & ~F.col("decoded")).count() == 0


def test_progress_block_size_does_not_matter(outs):
    a = ingest_progress(outs, every=10, levels=1).orderBy("session_id", "sample_no").collect()
    b = ingest_progress(outs, every=10, fanout=3, levels=3).orderBy("session_id", "sample_no").collect()
    c = ingest_progress(outs, every=10, fanout=2, levels=4).orderBy("session_id", "sample_no").collect()
    assert a == b == c and len(a) == 100
    assert a[0].processed == 10 and a[-1].processed == 250


def test_progress_hot_session(spark):
    # One session holding every frame: the multi-level sum spans many blocks.
    rows = [(i, 7, i + 1, dt.datetime(2024, 1, 1), i % 3 != 0, i % 3 != 0, None) for i in range(5000)]
    df = spark.createDataFrame(rows, OUTCOMES)
    got = ingest_progress(df, every=10, fanout=8, levels=3).orderBy("sample_no").collect()
    assert len(got) == 500
    ok = 0
    for i in range(5000):
        ok += i % 3 != 0
        if (i + 1) % 10 == 0:
            r = got[(i + 1) // 10 - 1]
            assert (r.sample_no, r.processed, r.stored, r.failed) == (i + 1, i + 1, ok, i + 1 - ok)
            assert r.success_rate == float(format(ok / (i + 1) * 100, ".1f"))


def test_empty_stats(spark):
    empty = spark.createDataFrame([], OUTCOMES)
    r = ingestion_stats(empty).collect()[0]
    assert (r.total_received, r.total_stored, r.success_rate, r.last_strike_time) == (0, 0, 0.0, None)


def test_two_notions_of_stored(outs):
    # T8: the progress line counts decoded frames (storage rejects included);
    # the ingestion counters count rows actually stored.
    assert outs.where("decoded").count() == 850
    assert outs.where("stored").count() == 800
    last = ingest_progress(outs).where("session_id = 3 AND sample_no = 250").collect()[0]
    assert last.stored == outs.where("session_id = 3 AND decoded").count()
