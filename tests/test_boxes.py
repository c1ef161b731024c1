"""Boxes as runs of keys, nearest by rings, pages by number."""
import datetime as dt
import math
import random

import pytest

from conftest import SF_SMALL
from strike_analytics.functions.geo import EARTH_RADIUS_KM, covering_boxes
from strike_analytics.operators import queries as Q
from strike_analytics.plans.zorder import BITS, in_box, runs_of_box, with_zkey, zkey_of
from strike_analytics.session import fresh_dir
from strike_analytics.sources import tables
from strike_analytics.sources.events import read_frames_from_events


def boxes(n):
    rng = random.Random(n)
    for _ in range(n):
        a, b = sorted(rng.uniform(-90, 90) for _ in "ab")
        c, d = sorted(rng.uniform(-180, 180) for _ in "ab")
        if rng.random() < 0.6:
            b, d = min(90, a + rng.random() * 3), min(180, c + rng.random() * 3)
        yield a, b, c, d
    yield from [(-90, 90, -180, 180), (90, 90, 180, 180), (0, 0, 0, 0), (32.7, 32.7, -117.2, -117.1)]


def test_runs_cover_the_box_and_little_else():
    rng = random.Random(2)
    for box in boxes(400):
        runs = runs_of_box(*box)
        assert len(runs) <= 24 and all(a <= b for a, b in runs) and all(x[1] + 1 < y[0] for x, y in zip(runs, runs[1:]))
        for _ in range(20):
            z = zkey_of(rng.uniform(*box[:2]), rng.uniform(*box[2:]))
            assert any(a <= z <= b for a, b in runs)
    covered = sum(b - a + 1 for a, b in runs_of_box(30, 35, -120, -115)) / (1 << 2 * BITS)
    assert covered < 3 * (5 * 5) / (180 * 360)
    assert runs_of_box(5, 4, 0, 1) == []


def test_the_column_is_the_key(spark):
    rng = random.Random(3)
    rows = [(rng.uniform(-90, 90), rng.uniform(-180, 180)) for _ in range(300)] + [(90.0, 180.0), (-90.0, -180.0), (0.0, 0.0), (89.9999999, 179.9999999)]
    got = with_zkey(spark.createDataFrame(rows, "latitude double, longitude double")).collect()
    assert all(r.zkey == zkey_of(r.latitude, r.longitude) for r in got)


@pytest.fixture(scope="module")
def table(spark):
    """One date of many small row groups."""
    rng = random.Random(4)
    rows = [(k, 0, dt.datetime(2024, 1, 1) + dt.timedelta(seconds=k % 80_000), rng.uniform(-90, 90), rng.uniform(-180, 180)) for k in range(40_000)]
    df = spark.createDataFrame(rows, "id long, strike_time long, strike_timestamp timestamp_ntz, latitude double, longitude double")
    df = df.selectExpr("*", "int(null) altitude", "string(null) polarity", "int(null) mds", "int(null) mcg", "cast(null as timestamp_ntz) inserted_at")
    path = fresh_dir(spark, "boxes") + "/strikes"
    spark.sparkContext._jsc.hadoopConfiguration().set("parquet.block.size", "16384")
    try:
        tables.write_strikes(df, path, "1")
    finally:
        spark.sparkContext._jsc.hadoopConfiguration().unset("parquet.block.size")
    return path


def groups_read(spark, path, box, with_key):
    """Row groups whose statistics the pushed bounds can't rule out."""
    import glob

    import pyarrow.parquet as pq
    runs, seen, every = runs_of_box(*box), 0, 0
    for file in glob.glob(f"{path}/run=*/*/*.parquet"):
        meta = pq.ParquetFile(file).metadata
        names = [meta.schema.column(i).name for i in range(meta.num_columns)]
        for g in range(meta.num_row_groups):
            stat = lambda c: meta.row_group(g).column(names.index(c)).statistics
            every += 1
            fits = stat("latitude").max >= box[0] and stat("latitude").min <= box[1] and stat("longitude").max >= box[2] and stat("longitude").min <= box[3]
            if with_key:
                fits = fits and any(stat("zkey").max >= a and stat("zkey").min <= b for a, b in runs)
            seen += fits
    return seen, every


def test_fewer_row_groups_and_the_same_rows(spark, table):
    keyed, plain = tables.read_strikes(spark, table, zkey=True), tables.read_strikes(spark, table)
    total = [0, 0]
    for box in list(boxes(12))[:12]:
        assert sorted(r.id for r in in_box(keyed, *box).select("id").collect()) == sorted(r.id for r in in_box(plain, *box).select("id").collect())
        (with_key, every), (without, _) = groups_read(spark, table, box, True), groups_read(spark, table, box, False)
        assert with_key <= without <= every and every > 20
        total = [total[0] + with_key, total[1] + without]
    assert total[0] < total[1]
    spark.conf.set("spark.sql.maxMetadataStringLength", "100000")
    try:
        plan = in_box(keyed, 30, 35, -120, -115)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.maxMetadataStringLength")
    pushed = plan.split("PushedFilters")[1]
    assert "Or(" in pushed and "GreaterThanOrEqual(zkey" in pushed


def distance(a, b, c, d):
    p, q = math.radians(a), math.radians(c)
    h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(d - b) / 2) ** 2
    return 2 * EARTH_RADIUS_KM * math.asin(math.sqrt(min(1, h)))


def test_boxes_cover_a_circle():
    rng = random.Random(6)
    for _ in range(4000):
        lat, lon, km = rng.uniform(-90, 90), rng.uniform(-180, 180), rng.choice([1, 50, 500, 5000, 20_100])
        x, y = max(-90, min(90, lat + rng.uniform(-60, 60))), rng.uniform(-180, 180)
        if distance(lat, lon, x, y) <= km:
            assert any(a <= x <= b and c <= y <= d for a, b, c, d in covering_boxes(lat, lon, km))


@pytest.mark.parametrize("lat,lon,limit", [(32.7, -117.1, 10), (10.0, 179.99, 25), (89.9, 0.0, 5), (-45.0, -180.0, 40)])
def test_rings_equal_the_scan(spark, table, lat, lon, limit):
    strikes = tables.read_strikes(spark, table, zkey=True)
    got = [r.id for r in Q.nearest_strikes(strikes, lat=lat, lon=lon, limit=limit, first_km=10).collect()]
    every = strikes.select("id", "latitude", "longitude").collect()
    assert got == [i for _, i in sorted((distance(lat, lon, r.latitude, r.longitude), r.id) for r in every)[:limit]]
    few = strikes.where("id < 3")
    assert len(Q.nearest_strikes(few, lat=lat, lon=lon, limit=limit).collect()) == 3


@pytest.mark.parametrize("limit,offset,since,until", [(10, 0, None, None), (100, 250, None, None), (50, 790, None, None), (5, 5000, None, None),
                                                      (30, 100, "2024-01-10 05:17:00", "2024-01-20 03:00:00"), (1000, 0, "2024-01-30", None)])
def test_pages_by_number_equal_the_list(spark, limit, offset, since, until):
    if "root" not in _ROOT:
        _ROOT["root"] = fresh_dir(spark, "pages")
        tables.ingest_batch(read_frames_from_events(spark, SF_SMALL), _ROOT["root"], "1")
    strikes, hourly = tables.read_strikes(spark, f"{_ROOT['root']}/strikes", zkey=True), tables.read_hourly(spark, _ROOT["root"])
    page = Q.page_of_strikes(strikes, hourly, limit=limit, offset=offset, since=since, until=until)
    assert page.collect() == Q.list_strikes(strikes, limit=limit, offset=offset, since=since, until=until).collect()


_ROOT = {}
