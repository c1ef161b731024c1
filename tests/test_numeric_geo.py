"""Python-exact rounding, percentages, distances."""

import math
import random

import pandas as pd
from pyspark.sql import functions as F

from strike_analytics.functions.geo import equirect_miles, haversine_km, search_box
from strike_analytics.functions.numeric import pct, py_round


def test_pct_matches_python(spark):
    rows = [(s, p) for p in range(1, 161) for s in range(0, p + 1)]
    random.seed(7)
    rows += [(random.randint(0, p), p) for p in (random.randint(1, 10**12) for _ in range(3000))]
    rows.append((0, 0))
    df = spark.createDataFrame(pd.DataFrame(rows, columns=["s", "p"]))
    out = df.select(pct(F.col("s"), F.col("p"), 1).alias("r1"), pct(F.col("s"), F.col("p"), 2).alias("r2")).toPandas()
    exp1 = [float(format(s / p * 100, ".1f")) if p else 0.0 for s, p in rows]
    exp2 = [round(s / p * 100, 2) if p else 0.0 for s, p in rows]
    assert list(out.r1) == exp1
    assert list(out.r2) == exp2


def test_py_round_ties_follow_binary_value(spark):
    vals = [2.675, 1.005, 0.125, 0.375, 28.749999999999996, 76.25, 0.0, 12345.675, 0.004999]
    df = spark.createDataFrame([(v,) for v in vals], "d double")
    got = [r.x for r in df.select(py_round(F.col("d"), 2).alias("x")).collect()]
    assert got == [round(v, 2) for v in vals]


def _haversine(lat1, lon1, lat2, lon2):
    a = math.sin(math.radians(lat2 - lat1) / 2) ** 2 + math.cos(math.radians(lat1)) * math.cos(
        math.radians(lat2)) * math.sin(math.radians(lon2 - lon1) / 2) ** 2
    return 6371 * (2 * math.asin(math.sqrt(a)))


def test_haversine(spark):
    pts = [(32.7157, -117.1611, 34.0522, -118.2437), (0.0, 0.0, 0.0, 180.0), (51.5, -0.1, -33.9, 151.2)]
    df = spark.createDataFrame(pts, "a double, b double, c double, d double")
    got = [r.x for r in df.select(haversine_km(F.col("a"), F.col("b"), F.col("c"), F.col("d")).alias("x")).collect()]
    for g, p in zip(got, pts):
        assert abs(g - _haversine(*p)) < 1e-9


def test_search_box_and_miles(spark):
    a, b, c, d = search_box(32.7157, -117.1611, 111.0)
    assert (round(a, 6), round(b, 6)) == (31.7157, 33.7157)
    assert c < -117.1611 - 1.0 and d > -117.1611 + 1.0
    df = spark.createDataFrame([(33.0, -117.0)], "lat double, lon double")
    got = df.select(equirect_miles(F.col("lat"), F.col("lon"), 32.7157, -117.1611).alias("m")).collect()[0].m
    exp = math.sqrt((69.1 * (33.0 - 32.7157)) ** 2 + (69.1 * (-117.1611 + 117.0) * math.cos(33.0 / 57.3)) ** 2)
    assert abs(got - exp) < 1e-9


def _py_float(s):
    try:
        return float(s)
    except ValueError:
        return None


def test_number_parsing_matches_python(spark):
    # Captures are [0-9.-]+; Python's float() is the reference behaviour.
    from strike_analytics.functions.decode import parse_double, truncate_int
    random.seed(11)
    samples = {"".join(random.choice("0123456789.-") for _ in range(random.randint(1, 12)))
               for _ in range(3000)}
    samples |= {"1.", ".5", "-.5", "-0", "00012", "1-2", "--1", "-", ".", "..", "1..2", "9" * 400}
    samples = sorted(samples)
    df = spark.createDataFrame([(s,) for s in samples], "s string")
    rows = df.select("s", parse_double(F.col("s")).alias("d"),
                     truncate_int(parse_double(F.col("s")), "long").alias("i")).collect()
    for r in rows:
        exp = _py_float(r.s)
        assert r.d == exp, r.s
        if exp is not None and math.isfinite(exp) and abs(exp) < 2**63:
            assert r.i == int(exp), r.s
