"""Zone-free timestamp helpers.

Everything in the batch model is ``TIMESTAMP_NTZ`` (the Parquet inputs are
written without a zone, and the source stores zone-less UTC wall clock).
Nothing here depends on ``spark.sql.session.timeZone``:

* literals are cast from ISO strings (a Python ``datetime`` literal would be
  an instant, re-read in the session zone);
* epoch offsets are computed from NTZ *fields* (days since epoch + time of
  day) -- ``timestamp_diff`` on NTZ goes through a zoned cast and is off
  around DST changes -- and added back with sub-day ``timestamp_add``
  units, which are zone-free.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column
from pyspark.sql import functions as F

MICROS_PER_DAY = 86_400_000_000
_UNIT_MICROS = {"MICROSECOND": 1, "MILLISECOND": 1_000, "SECOND": 1_000_000}


def to_datetime(value: str | _dt.datetime | _dt.date) -> _dt.datetime:
    """A naive UTC datetime; values with an offset are converted to UTC."""
    if isinstance(value, str):
        value = _dt.datetime.fromisoformat(value)
    if not isinstance(value, _dt.datetime):
        return _dt.datetime(value.year, value.month, value.day)
    return value.astimezone(_dt.timezone.utc).replace(tzinfo=None) if value.tzinfo else value


def ntz(value: str | _dt.datetime | Column) -> Column:
    """A ``TIMESTAMP_NTZ`` literal (or cast) for strings, datetimes and columns."""
    if isinstance(value, Column):
        return value.cast("timestamp_ntz")
    return F.lit(to_datetime(value).isoformat(sep=" ")).cast("timestamp_ntz")


def epoch_ntz() -> Column:
    """1970-01-01 00:00:00 as a TIMESTAMP_NTZ literal."""
    return ntz("1970-01-01 00:00:00")


def epoch_micros(ts: Column) -> Column:
    """Microseconds since 1970-01-01 of an NTZ timestamp (from its fields)."""
    return (F.unix_date(F.to_date(ts)).cast("long") * F.lit(MICROS_PER_DAY)
            + F.hour(ts).cast("long") * F.lit(3_600_000_000)
            + F.minute(ts).cast("long") * F.lit(60_000_000)
            + (F.date_part(F.lit("SECOND"), ts) * F.lit(1_000_000)).cast("long"))


def from_epoch(unit: str, value: Column) -> Column:
    """NTZ timestamp ``value`` units after 1970-01-01 (MICROSECOND, MILLISECOND, SECOND).

    Sub-day units are plain microsecond arithmetic on an NTZ value (checked
    equal to a calendar-free construction in DST zones), so no zone enters.
    ``value`` must stay within year 9999 (callers guard it).
    """
    if unit not in _UNIT_MICROS:
        raise ValueError(f"unsupported unit {unit!r}")
    return F.timestamp_add(unit, value, epoch_ntz())


def utc(instant: str) -> Column:
    """The UTC wall clock of a zoned TIMESTAMP column, whatever the session zone."""
    return from_epoch("MICROSECOND", F.unix_micros(F.col(instant)))


def floor_hour(ts: Column) -> Column:
    """Truncate an NTZ timestamp to the hour, staying NTZ."""
    return F.make_timestamp_ntz(F.year(ts), F.month(ts), F.dayofmonth(ts), F.hour(ts),
                                F.lit(0), F.lit(0))
