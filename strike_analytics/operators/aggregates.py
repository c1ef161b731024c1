"""Aggregations over the strike table.

All are hash aggregations with a partial (map-side) stage, so a key holding
a third of all rows costs no more shuffle than any other: each task sends one
partial row per key it saw.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.timeutil import floor_hour, to_datetime
from ..plans.layout import time_predicate

# Hemisphere labels of the documented roll-up.
NORTH = "Northern Hemisphere"
SOUTH = "Southern Hemisphere"


def strike_stats(strikes: DataFrame, *, since=None, until=None) -> DataFrame:
    """count, first/last time, mean position; empty input gives 0 and NULLs."""
    return (strikes.where(time_predicate(strikes, since=since, until=until))
            .agg(F.count(F.lit(1)).alias("total_strikes"),
                 F.min("strike_timestamp").alias("time_range_start"),
                 F.max("strike_timestamp").alias("time_range_end"),
                 F.avg("latitude").alias("avg_latitude"),
                 F.avg("longitude").alias("avg_longitude")))


def strike_count(strikes: DataFrame) -> DataFrame:
    """Total stored strikes (the health check)."""
    return strikes.agg(F.count(F.lit(1)).alias("total_strikes"))


def hemisphere_activity(strikes: DataFrame, *, now, hours: int = 1) -> DataFrame:
    """Count and mean position per hemisphere (equator counts as north),
    over the trailing ``hours`` (exclusive lower bound)."""
    since = to_datetime(now) - _dt.timedelta(hours=hours)
    hemi = F.when(F.col("latitude") >= 0, F.lit(NORTH)).otherwise(F.lit(SOUTH))
    return (strikes.where(time_predicate(strikes, since=since, since_inclusive=False))
            .groupBy(hemi.alias("hemisphere"))
            .agg(F.count(F.lit(1)).alias("strike_count"),
                 F.avg("latitude").alias("avg_lat"),
                 F.avg("longitude").alias("avg_lon")))


def hourly_activity(strikes: DataFrame, *, now, hours: int = 24) -> DataFrame:
    """Strikes per clock hour and the share of positive polarity (NULL
    polarity counts as not positive), newest hour first."""
    since = to_datetime(now) - _dt.timedelta(hours=hours)
    positive = F.when(F.col("polarity") == "positive", 1).otherwise(0)
    return (strikes.where(time_predicate(strikes, since=since, since_inclusive=False))
            .groupBy(floor_hour(F.col("strike_timestamp")).alias("hour"))
            .agg(F.count(F.lit(1)).alias("strike_count"),
                 (F.avg(positive) * 100).alias("pct_positive"))
            .orderBy(F.col("hour").desc()))
