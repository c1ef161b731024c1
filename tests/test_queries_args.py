"""Argument checks and edge cases of the listing queries."""

import datetime as dt

import pytest

from conftest import SF_SMALL
from strike_analytics.operators import aggregates as A
from strike_analytics.operators import queries as Q
from strike_analytics.plans.registry import NOW
from strike_analytics.sources.events import read_strikes_from_events
from strike_analytics.sources.tables import frames_from_kafka
from strike_analytics.operators.decode import decode_frames, accepted_strikes


@pytest.fixture(scope="module")
def strikes(spark):
    return read_strikes_from_events(spark, SF_SMALL)


@pytest.mark.parametrize("call", [
    lambda s: Q.list_strikes(s, limit=0),
    lambda s: Q.list_strikes(s, limit=1001),
    lambda s: Q.list_strikes(s, offset=-1),
    lambda s: Q.list_strikes(s, min_lat=-91),
    lambda s: Q.list_strikes(s, max_lon=181),
    lambda s: Q.recent_strikes(s, now=NOW, minutes=0),
    lambda s: Q.recent_strikes(s, now=NOW, minutes=1441),
    lambda s: Q.nearby_strikes(s, now=NOW, lat=0, lon=0, radius=0.5),
    lambda s: Q.nearby_strikes(s, now=NOW, lat=0, lon=0, radius=501),
    lambda s: Q.nearby_strikes(s, now=NOW, lat=91, lon=0),
])
def test_argument_ranges(strikes, call):
    with pytest.raises(ValueError):
        call(strikes)


def test_min_above_max_is_empty(strikes):
    assert Q.list_strikes(strikes, min_lat=10, max_lat=5).count() == 0


def test_bounds_are_inclusive(strikes):
    row = Q.latest_strikes(strikes, 1).collect()[0]
    got = Q.list_strikes(strikes, since=row.strike_timestamp, until=row.strike_timestamp,
                         min_lat=row.latitude, max_lat=row.latitude).collect()
    assert [r.id for r in got] == [row.id]


def test_recent_window_inclusive_and_stats_empty(strikes):
    row = Q.latest_strikes(strikes, 1).collect()[0]
    now = row.strike_timestamp + dt.timedelta(minutes=5)
    assert [r.id for r in Q.recent_strikes(strikes, now=now, minutes=5).collect()] == [row.id]
    s = A.strike_stats(strikes, since=dt.datetime(2030, 1, 1)).collect()[0]
    assert (s.total_strikes, s.time_range_start, s.avg_latitude) == (0, None, None)


def test_nearby_is_not_k_nearest(strikes):
    args = dict(now=NOW, lat=32.7157, lon=-117.1611, radius=500, minutes=1440, limit=3)
    pre = Q.nearby_strikes(strikes, recency_prelimit=True, **args).collect()
    exact = Q.nearby_strikes(strikes, **args).collect()
    assert len(pre) == len(exact) == 3
    assert max(r.distance_km for r in exact) <= max(r.distance_km for r in pre)
    assert [r.distance_km for r in pre] == sorted(r.distance_km for r in pre)


def test_kafka_records_decode(spark):
    rec = spark.createDataFrame(
        [(None, bytearray('{"time":1699564800,"latĆ10.5,"lonĆ20.25,'.encode()), "t", 3, 41,
          dt.datetime(2024, 1, 1))],
        "key binary, value binary, topic string, partition int, offset long, timestamp timestamp")
    frames = frames_from_kafka(rec)
    r = frames.collect()[0]
    assert (r.frame_id, r.session_id, r.sample_no) == ((3 << 40) + 41, 3, 42)
    s = accepted_strikes(decode_frames(frames)).collect()[0]
    assert (s.latitude, s.longitude) == (10.5, 20.25)


def test_box_does_not_wrap_the_antimeridian(spark):
    from strike_analytics.schemas import STRIKES
    rows = [(1, 0, dt.datetime(2024, 1, 30, 23), 0.0, 179.95, None, None, None, None, None),
            (2, 0, dt.datetime(2024, 1, 30, 23), 0.0, -179.95, None, None, None, None, None)]
    s = spark.createDataFrame(rows, STRIKES)
    got = Q.nearby_strikes(s, now=NOW, lat=0.0, lon=179.99, radius=50, minutes=120).collect()
    assert [r.id for r in got] == [1]          # -179.95 is 6.7 km away but outside the box
