"""Results must not depend on the session time zone."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from strike_analytics.functions.timeutil import epoch_micros, floor_hour, from_epoch, ntz, to_datetime
from strike_analytics.operators.decode import decode_frames, outcomes
from strike_analytics.plans.registry import QUERIES

VALS = [dt.datetime(2024, 7, 15, 10, 30, 5, 123456), dt.datetime(2024, 1, 15, 10, 30, 5, 123456),
        dt.datetime(2024, 3, 10, 2, 30), dt.datetime(1970, 1, 1), dt.datetime(9999, 12, 31, 23, 59, 59, 999999)]


@pytest.fixture()
def zone(spark, request):
    old = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", request.param)
    yield request.param
    spark.conf.set("spark.sql.session.timeZone", old)


@pytest.mark.parametrize("zone", ["America/New_York", "Asia/Kolkata", "Australia/Lord_Howe"], indirect=True)
def test_helpers_are_zone_free(spark, zone):
    df = spark.createDataFrame([(v.isoformat(sep=" "),) for v in VALS], "s string") \
              .select(F.col("s").cast("timestamp_ntz").alias("ts"))
    rows = df.select(epoch_micros(F.col("ts")).alias("us"), floor_hour(F.col("ts")).alias("h"),
                     from_epoch("MICROSECOND", epoch_micros(F.col("ts"))).alias("back"),
                     (F.col("ts") >= ntz("2024-01-15 10:30:05.123456")).alias("ge")).collect()
    for v, r in zip(VALS, rows):
        assert r.us == (v - dt.datetime(1970, 1, 1)) // dt.timedelta(microseconds=1)
        assert r.h == v.replace(minute=0, second=0, microsecond=0)
        assert r.back == v
        assert r.ge == (v >= dt.datetime(2024, 1, 15, 10, 30, 5, 123456))


@pytest.mark.parametrize("zone", ["America/New_York"], indirect=True)
def test_queries_are_zone_free(spark, zone):
    for name in ("recent_strikes", "hourly_activity", "decode_frames_strict", "epoch_unit"):
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        base = QUERIES[name](spark, SF_SMALL).collect()
        spark.conf.set("spark.sql.session.timeZone", zone)
        assert QUERIES[name](spark, SF_SMALL).collect() == base, name


def test_offsets_are_converted():
    plus12 = dt.timezone(dt.timedelta(hours=12))
    for v in ("2024-01-10T00:00:00+12:00", dt.datetime(2024, 1, 10, tzinfo=plus12)):
        assert to_datetime(v) == dt.datetime(2024, 1, 9, 12)


@pytest.mark.parametrize("zone", ["America/Los_Angeles"], indirect=True)
def test_inserted_at_is_the_utc_time(spark, zone, make_frames):
    frames = make_frames(["x"]).withColumn("received_at", F.timestamp_micros(F.lit(1704067201000000)))
    assert outcomes(decode_frames(frames)).first().received_at == dt.datetime(2024, 1, 1, 0, 0, 1)
