"""Roll-ups that are kept with each batch and merged when asked.

Ingest writes, for each batch, a row for each clock hour and hemisphere with
counts, sums and extremes, and one row of counters. A question about a window
merges the rows of the whole hours inside it with the strikes of the two
incomplete hours at its ends: the same numbers as a scan (sums of positions up
to rounding), from a few rows for each hour instead of all strikes.

A batch that is ingested again replaces its rows, one without any accepted
frame leaves none, and what readers see of them follows the batch list.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.numeric import pct
from ..functions.timeutil import floor_hour, ntz, to_datetime
from ..plans.layout import time_predicate
from .aggregates import NORTH, SOUTH

HOURLY = T.StructType([
    T.StructField("hour", T.TimestampNTZType()), T.StructField("north", T.BooleanType()),
    T.StructField("strike_count", T.LongType()), T.StructField("positive", T.LongType()),
    T.StructField("sum_lat", T.DoubleType()), T.StructField("sum_lon", T.DoubleType()),
    T.StructField("first", T.TimestampNTZType()), T.StructField("last", T.TimestampNTZType()),
])
COUNTERS = T.StructType([
    T.StructField("received", T.LongType()), T.StructField("decoded", T.LongType()),
    T.StructField("stored", T.LongType()), T.StructField("last", T.TimestampNTZType()),
])


def hourly_parts(strikes: DataFrame) -> DataFrame:
    """Per clock hour and hemisphere: counts, sums and extremes of ``strikes``."""
    return (strikes.groupBy(floor_hour(F.col("strike_timestamp")).alias("hour"), (F.col("latitude") >= 0).alias("north"))
            .agg(F.count(F.lit(1)).alias("strike_count"), F.count_if(F.col("polarity") == "positive").alias("positive"),
                 F.sum("latitude").alias("sum_lat"), F.sum("longitude").alias("sum_lon"),
                 F.min("strike_timestamp").alias("first"), F.max("strike_timestamp").alias("last")))


def counter_parts(outcomes: DataFrame) -> DataFrame:
    """One row: frames received, decoded and stored, last time received."""
    return outcomes.agg(F.count(F.lit(1)).alias("received"), F.count_if("decoded").alias("decoded"),
                        F.count_if("stored").alias("stored"), F.max("received_at").alias("last"))


def in_window(hourly: DataFrame, strikes: DataFrame, since=None, until=None, since_inclusive: bool = True) -> DataFrame:
    """Partial rows that together are the strikes of a window: the kept ones of
    its whole hours, and those of the incomplete hours, made from ``strikes``."""
    columns = HOURLY.fieldNames()
    hour = _dt.timedelta(hours=1)
    floor = lambda t: t.replace(minute=0, second=0, microsecond=0)
    whole, edges = F.lit(True), []
    if since is not None:
        since = to_datetime(since)
        # With an exclusive bound its own hour is incomplete even if it begins there.
        begin = floor(since) if since == floor(since) and since_inclusive else floor(since) + hour
        whole = whole & (F.col("hour") >= ntz(begin))
        edges.append((since, begin))
    if until is not None:
        until = to_datetime(until)
        end = floor(until)  # its own hour is incomplete: ``until`` is inclusive
        whole = whole & (F.col("hour") < ntz(end))
        edges.append((end, until))
    if len(edges) == 2 and edges[0][1] >= edges[1][0]:  # no whole hour in between
        return hourly_parts(strikes.where(time_predicate(strikes, since=since, until=until, since_inclusive=since_inclusive)))
    parts = hourly.where(whole).select(*columns)
    if since is not None and begin > since:
        edge = time_predicate(strikes, since=since, until=begin, since_inclusive=since_inclusive) & (F.col("strike_timestamp") < ntz(begin))
        parts = parts.unionByName(hourly_parts(strikes.where(edge)))
    if until is not None:
        parts = parts.unionByName(hourly_parts(strikes.where(time_predicate(strikes, since=end, until=until))))
    return parts


def _mean(total: str) -> Column:
    return F.try_divide(F.sum(total), F.sum("strike_count"))


def stats_of(parts: DataFrame) -> DataFrame:
    """As ``strike_stats``, of partial rows."""
    return parts.agg(F.coalesce(F.sum("strike_count"), F.lit(0)).alias("total_strikes"), F.min("first").alias("time_range_start"),
                     F.max("last").alias("time_range_end"), _mean("sum_lat").alias("avg_latitude"), _mean("sum_lon").alias("avg_longitude"))


def hemisphere_of(parts: DataFrame) -> DataFrame:
    """As ``hemisphere_activity``, of partial rows."""
    label = F.when(F.col("north"), F.lit(NORTH)).otherwise(F.lit(SOUTH))
    return parts.groupBy(label.alias("hemisphere")).agg(F.sum("strike_count").alias("strike_count"), _mean("sum_lat").alias("avg_lat"),
                                                        _mean("sum_lon").alias("avg_lon"))


def hourly_of(parts: DataFrame) -> DataFrame:
    """As ``hourly_activity``, of partial rows; newest hour first."""
    sums = parts.groupBy("hour").agg(F.sum("strike_count").alias("strike_count"), F.sum("positive").alias("positive"))
    return sums.select("hour", "strike_count", (F.col("positive") / F.col("strike_count") * 100).alias("pct_positive")).orderBy(F.col("hour").desc())


def ingestion_of(counters: DataFrame) -> DataFrame:
    """As ``ingestion_stats``, of the counters of each batch."""
    agg = counters.agg(
        F.coalesce(F.sum("received"), F.lit(0)).alias("total_received"), F.coalesce(F.sum("stored"), F.lit(0)).alias("total_stored"),
        F.coalesce(F.sum(F.col("received") - F.col("stored")), F.lit(0)).alias("total_failed"),
        F.max("last").alias("last_strike_time"), F.max("last").alias("updated_at"))
    return agg.withColumn("success_rate", pct(F.col("total_stored"), F.col("total_received"), 2))
