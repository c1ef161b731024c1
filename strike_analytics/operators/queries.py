"""Strike listing queries: filter, sort, page, top-k, nearby.

All take the strike table as a DataFrame and return a DataFrame. Sorting is
always ``strike_timestamp DESC, id DESC`` (the id breaks timestamp ties, so
pages and top-k are deterministic). Every ``orderBy(...).limit(k)`` plans as
``TakeOrderedAndProject``: each task keeps its own top k and only k rows per
task reach the final merge, so no full sort or shuffle of the table happens.
"""

from __future__ import annotations

import datetime as _dt
import math
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import EARTH_RADIUS_KM, covering_boxes, equirect_miles, haversine_km, search_box
from ..functions.numeric import py_round
from ..functions.timeutil import ntz, to_datetime
from ..plans.layout import time_predicate
from ..plans.zorder import in_box
from ..schemas import STRIKE_COLUMNS
from .rollups import in_window


def _response(df: DataFrame, *extra: str) -> DataFrame:
    """The strike response shape: the strike columns (and extras), nothing else
    (e.g. no ``strike_date`` partition column from the table layout)."""
    return df.select(*[c for c in STRIKE_COLUMNS if c in df.columns], *extra)


def newest_first():
    """Sort keys of every listing: newest first, id breaking timestamp ties."""
    return F.col("strike_timestamp").desc(), F.col("id").desc()


# Argument ranges of the query endpoints.
LIMIT_RANGE = (1, 1000)
MINUTES_RANGE = (1, 1440)
RADIUS_RANGE = (1, 500)
LAT_RANGE = (-90, 90)
LON_RANGE = (-180, 180)


def _check(name: str, value, lo=None, hi=None):
    if value is None:
        return
    if (lo is not None and value < lo) or (hi is not None and value > hi):
        raise ValueError(f"{name}={value} outside [{lo}, {hi}]")


def _since(now, minutes: int) -> _dt.datetime:
    return to_datetime(now) - _dt.timedelta(minutes=minutes)


def list_strikes(strikes: DataFrame, *, limit: int = 100, offset: int = 0,
                 since=None, until=None, min_lat: float | None = None,
                 max_lat: float | None = None, min_lon: float | None = None,
                 max_lon: float | None = None, after: tuple | None = None) -> DataFrame:
    """Newest-first page of strikes; every bound optional and inclusive.

    ``min > max`` gives an empty page, not an error.

    ``offset`` pages cost ``offset + limit`` rows per task in the top-k
    merge. For deep paging pass ``after=(strike_timestamp, id)`` of the last
    row of the previous page instead (keyset paging): it is a plain range
    predicate, so every page costs one top-``limit`` whatever its depth.
    """
    _check("limit", limit, *LIMIT_RANGE)
    _check("offset", offset, 0)
    for name, v, rng in (("min_lat", min_lat, LAT_RANGE), ("max_lat", max_lat, LAT_RANGE),
                         ("min_lon", min_lon, LON_RANGE), ("max_lon", max_lon, LON_RANGE)):
        _check(name, v, *rng)
    df = strikes.where(time_predicate(strikes, since=since, until=until))
    df = in_box(df, min_lat, max_lat, min_lon, max_lon)
    if after is not None:
        ts, last_id = after
        ts = ntz(to_datetime(ts))
        df = df.where((F.col("strike_timestamp") < ts)
                      | ((F.col("strike_timestamp") == ts) & (F.col("id") < F.lit(last_id))))
    df = df.orderBy(*newest_first())
    if offset:
        df = df.offset(offset)
    return _response(df.limit(limit))


def recent_strikes(strikes: DataFrame, *, now, minutes: int = 60, limit: int = 100) -> DataFrame:
    """Strikes of the trailing ``minutes`` (inclusive), newest first."""
    _check("minutes", minutes, *MINUTES_RANGE)
    _check("limit", limit, *LIMIT_RANGE)
    since = _since(now, minutes)
    return _response(strikes.where(time_predicate(strikes, since=since))
                     .orderBy(*newest_first()).limit(limit))


def nearby_strikes(strikes: DataFrame, *, lat: float, lon: float, radius: float = 50,
                   minutes: int = 60, limit: int = 100, now, recency_prelimit: bool = False) -> DataFrame:
    """Strikes within ``radius`` km of a point in the trailing window.

    The ``limit`` nearest strikes of the window: a coarse search box, refined
    by exact great-circle distance (``<= radius`` on the unrounded distance)
    and sorted by the distance rounded to 0.01 km the way Python rounds (ties:
    newest first). ``recency_prelimit=True`` is for compatibility only: like
    the source service it looks at the newest ``2 * limit`` strikes of the box
    alone, and so may miss nearer ones.
    """
    _check("lat", lat, *LAT_RANGE)
    _check("lon", lon, *LON_RANGE)
    _check("radius", radius, *RADIUS_RANGE)
    _check("minutes", minutes, *MINUTES_RANGE)
    _check("limit", limit, *LIMIT_RANGE)
    since = _since(now, minutes)
    min_lat, max_lat, min_lon, max_lon = search_box(lat, lon, radius)
    box = in_box(strikes.where(time_predicate(strikes, since=since)), min_lat, max_lat, min_lon, max_lon)
    if recency_prelimit:
        box = box.orderBy(*newest_first()).limit(limit * 2)
    dist = haversine_km(F.lit(lat), F.lit(lon), F.col("latitude"), F.col("longitude"))
    near = (box.withColumn("_d", dist).where(F.col("_d") <= radius)
            .withColumn("distance_km", py_round(F.col("_d"), 2)).drop("_d"))
    return _response(near.orderBy(F.col("distance_km").asc(), *newest_first()).limit(limit),
                     "distance_km")


def latest_strikes(strikes: DataFrame, n: int = 5) -> DataFrame:
    """The ``n`` newest strikes, all columns."""
    return _response(strikes.orderBy(*newest_first()).limit(n))


def nearest_strikes_miles(strikes: DataFrame, *, now, lat0: float = 32.7157, lon0: float = -117.1611,
                          lat_range=(30, 35), lon_range=(-120, -115), minutes: int = 60,
                          limit: int = 10) -> DataFrame:
    """Equirectangular-miles ranking inside a box over a trailing window.

    The window is exclusive (``> now - minutes``); no radius cut.
    """
    since = _since(now, minutes)
    df = (in_box(strikes.where(time_predicate(strikes, since=since, since_inclusive=False)), *lat_range, *lon_range)
          .select("id", "strike_timestamp", "latitude", "longitude",
                  equirect_miles(F.col("latitude"), F.col("longitude"), lat0, lon0).alias("distance_miles")))
    return df.orderBy(F.col("distance_miles").asc(), F.col("id").asc()).limit(limit)


def nearest_strikes(strikes: DataFrame, *, lat: float, lon: float, limit: int = 10, since=None, until=None,
                    first_km: float = 25.0) -> DataFrame:
    """The ``limit`` strikes nearest to a point by great circle, however far;
    ties: newest first.

    Rings that double are searched, from ``first_km`` on, until one holds
    ``limit`` strikes: none outside it can be nearer. Each ring is a box (two
    at the antimeridian) that the scan is pruned by, so a query reads the
    surroundings of its answer and not the table. Only counts up to ``limit``
    come to the driver.
    """
    _check("lat", lat, *LAT_RANGE)
    _check("lon", lon, *LON_RANGE)
    _check("limit", limit, *LIMIT_RANGE)
    window = strikes.where(time_predicate(strikes, since=since, until=until))
    far, km = math.pi * EARTH_RADIUS_KM, first_km
    while True:
        parts = [in_box(window, *box) for box in covering_boxes(lat, lon, km)]
        ring = reduce(DataFrame.unionByName, parts)
        near = ring.withColumn("distance_km", haversine_km(F.lit(lat), F.lit(lon), F.col("latitude"), F.col("longitude")))
        if km < far:
            near = near.where(F.col("distance_km") <= km)
        if km >= far or near.limit(limit).count() == limit:
            return _response(near.orderBy("distance_km", *newest_first()).limit(limit), "distance_km")
        km *= 2


def page_of_strikes(strikes: DataFrame, hourly: DataFrame, *, limit: int = 100, offset: int = 0, since=None, until=None) -> DataFrame:
    """The page of ``list_strikes`` without a box, at any depth.

    The kept roll-ups (``sources.tables.read_hourly``) tell in which hours the
    page lies: only their strikes are read, and the top-k holds no more rows
    than these hours have before the page's end. One row comes to the driver.
    """
    _check("limit", limit, *LIMIT_RANGE)
    _check("offset", offset, 0)
    parts = in_window(hourly, strikes, since, until).groupBy("hour").agg(F.sum("strike_count").alias("n"))
    newest = Window.orderBy(F.col("hour").desc())  # one row for each hour
    placed = parts.withColumn("end", F.sum("n").over(newest.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    hit = placed.where((F.col("end") > offset) & (F.col("end") - F.col("n") < offset + limit)).agg(
        F.min("hour").alias("first"), F.max("hour").alias("last"), F.min(F.col("end") - F.col("n")).alias("before")).first()
    if hit["first"] is None:
        return _response(strikes.where(F.lit(False)))
    first, last = hit["first"], hit["last"] + _dt.timedelta(hours=1) - _dt.timedelta(microseconds=1)
    first = first if since is None else max(first, to_datetime(since))
    last = last if until is None else min(last, to_datetime(until))
    return list_strikes(strikes, limit=limit, offset=offset - hit["before"], since=first, until=last)


__all__ = ["list_strikes", "recent_strikes", "nearby_strikes", "latest_strikes",
           "nearest_strikes_miles", "nearest_strikes", "page_of_strikes"]
