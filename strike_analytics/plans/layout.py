"""Physical layout of the strike table and the predicates that exploit it.

The strike table is written partitioned by ``strike_date`` and, inside each
date, sorted by a Z-order key of position (``plans/zorder.py``) and time. Time
predicates are doubled with a ``strike_date`` predicate so the scan prunes whole
date directories; the sort makes Parquet row-group min/max statistics on the
key, latitude and longitude selective, so box predicates skip row groups too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.timeutil import ntz, to_datetime
from .zorder import ZKEY, with_zkey

DATE_COLUMN = "strike_date"


def time_predicate(strikes: DataFrame, *, since=None, until=None,
                   since_inclusive: bool = True) -> Column:
    """``since <= strike_timestamp <= until`` (each optional), plus the
    matching ``strike_date`` bounds when the table is date-partitioned."""
    ts = F.col("strike_timestamp")
    cond = F.lit(True)
    has_date = DATE_COLUMN in strikes.columns
    if since is not None:
        s = to_datetime(since)
        cond = cond & ((ts >= ntz(s)) if since_inclusive else (ts > ntz(s)))
        if has_date:
            cond = cond & (F.col(DATE_COLUMN) >= F.lit(s.date()))
    if until is not None:
        u = to_datetime(until)
        cond = cond & (ts <= ntz(u))
        if has_date:
            cond = cond & (F.col(DATE_COLUMN) <= F.lit(u.date()))
    return cond


def with_layout_columns(strikes: DataFrame) -> DataFrame:
    if DATE_COLUMN in strikes.columns:
        return strikes
    return strikes.withColumn(DATE_COLUMN, F.to_date("strike_timestamp"))


def clustered(strikes: DataFrame) -> DataFrame:
    """Rows ordered for writing, with ``zkey``: by date directory, then key, then time.

    ``repartition(date)`` would put a hot day (a third of a storm season)
    into one task. Range partitioning on (date, key, time, id) splits by
    sampled boundaries instead, and the trailing time and id keys let those
    boundaries cut through a single hot key of a single day as well, so no
    writer task gets more than its share.
    """
    df = with_zkey(with_layout_columns(strikes))
    keys = [DATE_COLUMN, ZKEY, "strike_timestamp", "id"]
    return df.repartitionByRange(*keys).sortWithinPartitions(*keys)

