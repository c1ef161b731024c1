"""The registered queries: one Spark callable and one independent SQL oracle each.

Every callable takes ``(spark, sf_dir)``, reads the driver's ``events`` table
and derives the strike table or the raw frames from it (FIXTURES.md), so all
work grows with the input. The oracle SQL (DuckDB dialect, ``events`` is a
pre-registered view) computes the same answer without decoding anything: the
expected decode of each frame follows from its defect class.

Parameters are fixed so results are deterministic; "now" is the day after the
last event.
"""

from __future__ import annotations

import datetime as _dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.decode import epoch_unit
from ..functions.numeric import pct_sql, py_round_sql
from ..operators import aggregates as A
from ..operators import ingest_stats as I
from ..operators import queries as Q
from ..operators import rollups as R
from ..operators.decode import accepted_strikes, decode_frames, outcomes, reject_counts
from ..schemas import STRIKE_COLUMNS
from ..session import fresh_dir
from ..sources.events import frames_from_events, read_events, read_strikes_from_events
from ..sources.tables import compact, ingest_batch, read_counters, read_frames, read_hourly, read_outcomes, read_strikes

NOW = _dt.datetime(2024, 1, 31)
NOW_SQL = "TIMESTAMP '2024-01-31 00:00:00'"
SAN_DIEGO = (32.7157, -117.1611)
WHOLE_MONTH_HOURS = 24 * 31

LIST_ARGS = dict(limit=100, offset=20, since=_dt.datetime(2024, 1, 10),
                 until=_dt.datetime(2024, 1, 20, 23, 59, 59),
                 min_lat=30.0, max_lat=35.0, min_lon=-120.0, max_lon=-115.0)
#: Incomplete hours at both ends.
ROLLUP_WINDOW = (_dt.datetime(2024, 1, 10, 5, 17, 3), _dt.datetime(2024, 1, 20, 21, 42, 11))
NEARBY_ARGS = dict(lat=SAN_DIEGO[0], lon=SAN_DIEGO[1], radius=100, minutes=1440, limit=10)
ENTRY_ARGS = dict(lat=SAN_DIEGO[0], lon=SAN_DIEGO[1], radius=500, minutes=1440, limit=100)

REJECT_CLASSES = (0, 1, 2, 3, 5, 6, 7, 8)
DECODE_FAIL_CLASSES = (0, 1, 2, 3, 5, 8)


def _strikes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_strikes_from_events(spark, sf_dir)


#: Made once for each application and input.
_MADE: dict[tuple[str, str, str], object] = {}


def _once(kind: str, spark: SparkSession, sf_dir: str, make: Callable[[], object]):
    key = (spark.sparkContext.applicationId, sf_dir, kind)
    if key not in _MADE:
        _MADE[key] = make()
    return _MADE[key]


def land_frames(spark: SparkSession, sf_dir: str) -> str:
    """Writes the frames of ``events`` as a feed lands them, in many files; gives the folder."""
    path = fresh_dir(spark, "query-frames")
    files = 2 * spark.sparkContext.defaultParallelism
    # Events are dealt out, which are shorter than frames, so that a table of few splits doesn't make its frames in as few tasks.
    frames_from_events(read_events(spark, sf_dir).repartition(files)).write.parquet(path)
    return path


def _frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_frames(spark, _once("frames", spark, sf_dir, lambda: land_frames(spark, sf_dir)))


def _decoded(spark: SparkSession, sf_dir: str, profile: str = "strict") -> DataFrame:
    return decode_frames(_frames(spark, sf_dir), profile)


def _tables(spark: SparkSession, sf_dir: str) -> dict[str, str]:
    """The tables that ``ingest_batch`` writes from the frames."""
    return _once("tables", spark, sf_dir, lambda: ingest_batch(_frames(spark, sf_dir), fresh_dir(spark, "query-tables"), "0"))


def _compacted(spark: SparkSession, sf_dir: str) -> str:
    """A root of four batches by connection, one of them ingested twice, whose
    first three are merged; the fourth came with all frames of another at first."""
    def make() -> str:
        root, frames = fresh_dir(spark, "query-compacted"), _frames(spark, sf_dir)
        part = lambda k: frames.where(F.col("session_id") % 4 == k)
        for k in (0, 1, 1, 2):
            ingest_batch(part(k), root, str(k))
        ingest_batch(part(0), root, "3")
        compact(spark, root)
        ingest_batch(part(3), root, "3")
        return root

    return _once("compacted", spark, sf_dir, make)


def _root(spark: SparkSession, sf_dir: str) -> str:
    return _tables(spark, sf_dir)["strikes"].rpartition("/")[0]


def _written(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_strikes(spark, _tables(spark, sf_dir)["strikes"], zkey=True)


def _round6(df: DataFrame, *cols: str) -> DataFrame:
    """Six decimals for floating aggregates whose last bits depend on summation order."""
    return df.withColumns({c: F.round(F.col(c), 6) for c in cols})


# --------------------------------------------------------------------------- Spark

def q_list_strikes(spark, sf_dir):
    return Q.list_strikes(_strikes(spark, sf_dir), **LIST_ARGS)


def q_recent_strikes(spark, sf_dir):
    return Q.recent_strikes(_strikes(spark, sf_dir), now=NOW, minutes=1440, limit=100)


def q_nearby_strikes(spark, sf_dir):
    return Q.nearby_strikes(_strikes(spark, sf_dir), now=NOW, recency_prelimit=True, **NEARBY_ARGS)


def q_nearby_strikes_exact(spark, sf_dir):
    return Q.nearby_strikes(_strikes(spark, sf_dir), now=NOW, **NEARBY_ARGS)


def q_latest_strikes(spark, sf_dir):
    return Q.latest_strikes(_strikes(spark, sf_dir), 5)


def q_nearest_strikes_miles(spark, sf_dir):
    return _round6(Q.nearest_strikes_miles(_strikes(spark, sf_dir), now=NOW, minutes=1440),
                   "distance_miles")


def q_strike_stats(spark, sf_dir):
    return _round6(A.strike_stats(_strikes(spark, sf_dir)), "avg_latitude", "avg_longitude")


def q_strike_count(spark, sf_dir):
    return A.strike_count(_strikes(spark, sf_dir))


def q_hemisphere_activity(spark, sf_dir):
    return _round6(A.hemisphere_activity(_strikes(spark, sf_dir), now=NOW, hours=WHOLE_MONTH_HOURS),
                   "avg_lat", "avg_lon")


def q_hourly_activity(spark, sf_dir):
    return _round6(A.hourly_activity(_strikes(spark, sf_dir), now=NOW, hours=WHOLE_MONTH_HOURS),
                   "pct_positive")


def q_decode_frames_strict(spark, sf_dir):
    return accepted_strikes(_decoded(spark, sf_dir))


def q_decode_rejects(spark, sf_dir):
    return reject_counts(_decoded(spark, sf_dir))


def q_ingestion_stats(spark, sf_dir):
    return I.ingestion_stats(outcomes(_decoded(spark, sf_dir)))


def q_ingest_progress(spark, sf_dir):
    return I.ingest_progress(outcomes(_decoded(spark, sf_dir)), every=10)


def q_ingest_progress_gaps(spark, sf_dir):
    """Sample numbers that begin at 1003 and leave gaps, as those of a broker do."""
    rows = outcomes(_decoded(spark, sf_dir)).withColumn("sample_no", F.col("sample_no") * 3 + 1000)
    return I.ingest_progress(rows, every=10)


def q_table_strike_stats(spark, sf_dir):
    return _round6(A.strike_stats(_written(spark, sf_dir), since=LIST_ARGS["since"], until=LIST_ARGS["until"]),
                   "avg_latitude", "avg_longitude")


def q_table_recent_strikes(spark, sf_dir):
    return Q.recent_strikes(_written(spark, sf_dir), now=NOW, minutes=1440, limit=100)


def q_table_nearby_strikes(spark, sf_dir):
    return Q.nearby_strikes(_written(spark, sf_dir), now=NOW, **NEARBY_ARGS)


def q_table_list_strikes(spark, sf_dir):
    return Q.list_strikes(_written(spark, sf_dir), **LIST_ARGS)


def q_table_ingestion_stats(spark, sf_dir):
    return I.ingestion_stats(read_outcomes(spark, _tables(spark, sf_dir)["outcomes"]))


def q_table_nearest_strikes(spark, sf_dir):
    """By rings that grow around a point."""
    lat, lon = SAN_DIEGO
    return _round6(Q.nearest_strikes(_written(spark, sf_dir), lat=lat, lon=lon, limit=20, since=LIST_ARGS["since"], until=LIST_ARGS["until"],
                                     first_km=5), "distance_km")


def q_table_page_strikes(spark, sf_dir):
    """A page found by number, from the kept roll-ups."""
    hourly = read_hourly(spark, _root(spark, sf_dir))
    return Q.page_of_strikes(_written(spark, sf_dir), hourly, limit=50, offset=300)


def q_table_rollup_stats(spark, sf_dir):
    """From the roll-ups kept with each batch, and the strikes of the incomplete hours."""
    strikes, hourly = _written(spark, sf_dir), read_hourly(spark, _root(spark, sf_dir))
    return _round6(R.stats_of(R.in_window(hourly, strikes, *ROLLUP_WINDOW)), "avg_latitude", "avg_longitude")


def q_table_rollup_hemisphere(spark, sf_dir):
    strikes, hourly = _written(spark, sf_dir), read_hourly(spark, _root(spark, sf_dir))
    return _round6(R.hemisphere_of(R.in_window(hourly, strikes, *ROLLUP_WINDOW)), "avg_lat", "avg_lon")


def q_table_rollup_hourly(spark, sf_dir):
    strikes, hourly = _written(spark, sf_dir), read_hourly(spark, _root(spark, sf_dir))
    return _round6(R.hourly_of(R.in_window(hourly, strikes, *ROLLUP_WINDOW)), "pct_positive")


def q_compacted_strike_stats(spark, sf_dir):
    strikes = read_strikes(spark, f"{_compacted(spark, sf_dir)}/strikes")
    return _round6(A.strike_stats(strikes, since=LIST_ARGS["since"], until=LIST_ARGS["until"]), "avg_latitude", "avg_longitude")


def q_compacted_list_strikes(spark, sf_dir):
    return Q.list_strikes(read_strikes(spark, f"{_compacted(spark, sf_dir)}/strikes", zkey=True), **LIST_ARGS)


def q_compacted_ingestion_stats(spark, sf_dir):
    """From the counters of each batch; taken back where a batch came in again."""
    return R.ingestion_of(read_counters(spark, _compacted(spark, sf_dir)))


def q_decode_frames_lenient(spark, sf_dir):
    return _decoded(spark, sf_dir, "lenient").select(
        "frame_id", "time_text", "latitude", "longitude", "altitude", "polarity",
        "mds", "mcg", "json", "json_ok", F.size("warnings").alias("n_warnings"),
        F.array_join("warnings", "; ").alias("warnings"),
        F.col("other_fields.alt").alias("other_alt"), F.col("other_fields.pol").alias("other_pol"),
        F.col("other_fields.mds").alias("other_mds"), F.col("other_fields.mcg").alias("other_mcg"))


def q_decode_report(spark, sf_dir):
    return I.decode_report(_decoded(spark, sf_dir, "lenient"))


def q_longitude_repair(spark, sf_dir):
    return _decoded(spark, sf_dir).select(
        "frame_id", F.col("lon_txt").alias("lon_text"), "longitude")


def q_epoch_unit(spark, sf_dir):
    return (_decoded(spark, sf_dir).where(F.col("time_txt").isNotNull())
            .select("frame_id", "strike_time", epoch_unit(F.col("strike_time")).alias("epoch_unit"),
                    "strike_timestamp"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "list_strikes": q_list_strikes,
    "recent_strikes": q_recent_strikes,
    "nearby_strikes": q_nearby_strikes,
    "nearby_strikes_exact": q_nearby_strikes_exact,
    "latest_strikes": q_latest_strikes,
    "nearest_strikes_miles": q_nearest_strikes_miles,
    "strike_stats": q_strike_stats,
    "strike_count": q_strike_count,
    "hemisphere_activity": q_hemisphere_activity,
    "hourly_activity": q_hourly_activity,
    "decode_frames_strict": q_decode_frames_strict,
    "decode_rejects": q_decode_rejects,
    "ingestion_stats": q_ingestion_stats,
    "ingest_progress": q_ingest_progress,
    "ingest_progress_gaps": q_ingest_progress_gaps,
    "table_strike_stats": q_table_strike_stats,
    "table_recent_strikes": q_table_recent_strikes,
    "table_nearby_strikes": q_table_nearby_strikes,
    "table_list_strikes": q_table_list_strikes,
    "table_ingestion_stats": q_table_ingestion_stats,
    "table_nearest_strikes": q_table_nearest_strikes,
    "table_page_strikes": q_table_page_strikes,
    "table_rollup_stats": q_table_rollup_stats,
    "table_rollup_hemisphere": q_table_rollup_hemisphere,
    "table_rollup_hourly": q_table_rollup_hourly,
    "compacted_strike_stats": q_compacted_strike_stats,
    "compacted_list_strikes": q_compacted_list_strikes,
    "compacted_ingestion_stats": q_compacted_ingestion_stats,
    "decode_frames_lenient": q_decode_frames_lenient,
    "decode_report": q_decode_report,
    "longitude_repair": q_longitude_repair,
    "epoch_unit": q_epoch_unit,
}


def entry_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: strikes within 500 km of San Diego in the last day."""
    return Q.nearby_strikes(_strikes(spark, sf_dir), now=NOW, **ENTRY_ARGS)


# --------------------------------------------------------------------------- SQL oracle

_LAT_M = ("(CASE WHEN user_id % 2 = 0 THEN 32716 + (event_id * 7919) % 4001 - 2000 "
          "ELSE (event_id * 7919) % 180001 - 90000 END)")
_LON_M = ("(CASE WHEN user_id % 2 = 0 THEN -117161 + (event_id * 104729) % 4001 - 2000 "
          "ELSE (event_id * 104729) % 360001 - 180000 END)")
_POLARITY = ("(CASE WHEN event_type IN ('click', 'view') THEN 'positive' "
             "WHEN event_type IN ('signup', 'purchase') THEN 'negative' END)")

STRIKES_CTE = f"""strikes AS (
  SELECT event_id AS id,
         epoch_us(ts) AS strike_time,
         ts AS strike_timestamp,
         CAST({_LAT_M} AS DOUBLE) / 1000.0 AS latitude,
         CAST({_LON_M} AS DOUBLE) / 1000.0 AS longitude,
         CAST(user_id AS INTEGER) AS altitude,
         {_POLARITY} AS polarity,
         CAST(json_extract_string(props, '$.k') AS INTEGER) AS mds,
         CAST(trunc(value) AS INTEGER) AS mcg,
         ts + INTERVAL 1 SECOND AS inserted_at
  FROM events)"""

FRAMES_CTE = f"""f AS (
  SELECT event_id, event_id % 40 AS cls, event_id % 3 AS unit, ts, user_id, value,
         {_POLARITY} AS polarity,
         CAST(json_extract_string(props, '$.k') AS INTEGER) AS k,
         {_LAT_M} AS lat_m, {_LON_M} AS lon_m,
         epoch_us(ts) AS us
  FROM events)"""

_RAW_TIME = ("(CASE WHEN cls = 1 THEN us * 1000 WHEN unit = 0 THEN us "
             "WHEN unit = 1 THEN us // 1000 ELSE us // 1000000 END)")
_TIMESTAMP = ("(CASE WHEN cls = 1 THEN NULL WHEN unit = 0 THEN ts "
              "WHEN unit = 1 THEN date_trunc('millisecond', ts) ELSE date_trunc('second', ts) END)")


def _in(classes) -> str:
    return "(" + ", ".join(str(c) for c in classes) + ")"


def _sql_nearby(exact: bool = False, strikes: str = STRIKES_CTE) -> str:
    lat, lon = SAN_DIEGO
    r, limit = NEARBY_ARGS["radius"], NEARBY_ARGS["limit"]
    since = NOW - _dt.timedelta(minutes=NEARBY_ARGS["minutes"])
    hav = (f"6371.0 * (2 * asin(sqrt(pow(sin(radians(latitude - {lat!r}) / 2), 2) + "
           f"cos(radians({lat!r})) * cos(radians(latitude)) * "
           f"pow(sin(radians(longitude - ({lon!r})) / 2), 2))))")
    cols = ", ".join(STRIKE_COLUMNS)
    return f"""WITH {strikes},
pre AS (
  SELECT * FROM strikes
  WHERE strike_timestamp >= TIMESTAMP '{since}'
    AND abs(latitude - ({lat!r})) <= {r} / 111.0
    AND abs(longitude - ({lon!r})) <= {r} / (111.0 * cos(radians({lat!r})))
  {"" if exact else f"ORDER BY strike_timestamp DESC, id DESC LIMIT {2 * limit}"}),
dist AS (SELECT *, {hav} AS d FROM pre)
SELECT {cols}, {py_round_sql('d', 2)} AS distance_km
FROM dist WHERE d <= {r}
ORDER BY distance_km, strike_timestamp DESC, id DESC LIMIT {limit}"""


ORACLE_SQL: dict[str, str] = {
    "list_strikes": f"""WITH {STRIKES_CTE}
SELECT * FROM strikes
WHERE strike_timestamp >= TIMESTAMP '2024-01-10 00:00:00'
  AND strike_timestamp <= TIMESTAMP '2024-01-20 23:59:59'
  AND latitude >= 30 AND latitude <= 35 AND longitude >= -120 AND longitude <= -115
ORDER BY strike_timestamp DESC, id DESC LIMIT 100 OFFSET 20""",

    "recent_strikes": f"""WITH {STRIKES_CTE}
SELECT * FROM strikes WHERE strike_timestamp >= {NOW_SQL} - INTERVAL 1440 MINUTE
ORDER BY strike_timestamp DESC, id DESC LIMIT 100""",

    "nearby_strikes": _sql_nearby(),
    "nearby_strikes_exact": _sql_nearby(exact=True),

    "latest_strikes": f"""WITH {STRIKES_CTE}
SELECT * FROM strikes ORDER BY strike_timestamp DESC, id DESC LIMIT 5""",

    "nearest_strikes_miles": f"""WITH {STRIKES_CTE}
SELECT id, strike_timestamp, latitude, longitude,
       round(sqrt(pow(69.1 * (latitude - 32.7157), 2)
                  + pow(69.1 * (-117.1611 - longitude) * cos(latitude / 57.3), 2)), 6) AS distance_miles
FROM strikes
WHERE strike_timestamp > {NOW_SQL} - INTERVAL 1440 MINUTE
  AND latitude BETWEEN 30 AND 35 AND longitude BETWEEN -120 AND -115
ORDER BY sqrt(pow(69.1 * (latitude - 32.7157), 2)
              + pow(69.1 * (-117.1611 - longitude) * cos(latitude / 57.3), 2)), id
LIMIT 10""",

    "strike_stats": f"""WITH {STRIKES_CTE}
SELECT count(*) AS total_strikes, min(strike_timestamp) AS time_range_start,
       max(strike_timestamp) AS time_range_end,
       round(avg(latitude), 6) AS avg_latitude, round(avg(longitude), 6) AS avg_longitude
FROM strikes""",

    "strike_count": f"""WITH {STRIKES_CTE}
SELECT count(*) AS total_strikes FROM strikes""",

    "hemisphere_activity": f"""WITH {STRIKES_CTE}
SELECT CASE WHEN latitude >= 0 THEN 'Northern Hemisphere' ELSE 'Southern Hemisphere' END AS hemisphere,
       count(*) AS strike_count, round(avg(latitude), 6) AS avg_lat, round(avg(longitude), 6) AS avg_lon
FROM strikes
WHERE strike_timestamp > {NOW_SQL} - INTERVAL {WHOLE_MONTH_HOURS} HOUR
GROUP BY 1""",

    "hourly_activity": f"""WITH {STRIKES_CTE}
SELECT date_trunc('hour', strike_timestamp) AS hour, count(*) AS strike_count,
       round(avg(CASE WHEN polarity = 'positive' THEN 1 ELSE 0 END) * 100, 6) AS pct_positive
FROM strikes
WHERE strike_timestamp > {NOW_SQL} - INTERVAL {WHOLE_MONTH_HOURS} HOUR
GROUP BY 1 ORDER BY hour DESC""",

    "decode_frames_strict": f"""WITH {FRAMES_CTE}
SELECT event_id AS id,
       {_RAW_TIME} AS strike_time,
       {_TIMESTAMP} AS strike_timestamp,
       CAST(lat_m AS DOUBLE) / 1000.0 AS latitude,
       CASE WHEN cls = 4 THEN 16.040089 ELSE CAST(lon_m AS DOUBLE) / 1000.0 END AS longitude,
       CASE WHEN cls = 9 THEN NULL ELSE CAST(user_id AS INTEGER) END AS altitude,
       CASE WHEN cls = 10 THEN '0,' WHEN cls = 13 THEN 'back\\slash' ELSE polarity END AS polarity,
       CASE WHEN cls = 11 THEN -12 ELSE k END AS mds,
       CAST(trunc(value) AS INTEGER) AS mcg,
       ts + INTERVAL 1 SECOND AS inserted_at
FROM f WHERE cls NOT IN {_in(REJECT_CLASSES)}""",

    "decode_rejects": f"""WITH {FRAMES_CTE}
SELECT reason, count(*) AS frames FROM (
  SELECT CASE cls WHEN 0 THEN 'no_time' WHEN 1 THEN 'time_out_of_range'
                  WHEN 2 THEN 'no_coordinates' WHEN 3 THEN 'out_of_bounds'
                  WHEN 5 THEN 'out_of_bounds' WHEN 6 THEN 'storage' WHEN 7 THEN 'storage'
                  WHEN 8 THEN 'bad_number' END AS reason
  FROM f) WHERE reason IS NOT NULL GROUP BY reason""",

    "ingestion_stats": f"""WITH {FRAMES_CTE}, c AS (
  SELECT count(*) AS total_received,
         count(*) FILTER (WHERE cls NOT IN {_in(REJECT_CLASSES)}) AS total_stored,
         count(*) FILTER (WHERE cls IN {_in(REJECT_CLASSES)}) AS total_failed,
         max(ts) + INTERVAL 1 SECOND AS last_strike_time,
         max(ts) + INTERVAL 1 SECOND AS updated_at
  FROM f)
SELECT *, {pct_sql('total_stored', 'total_received', 2)} AS success_rate FROM c""",

    "ingest_progress": f"""WITH {FRAMES_CTE}, o AS (
  SELECT event_id // 250 AS session_id, event_id % 250 + 1 AS sample_no,
         CASE WHEN cls IN {_in(DECODE_FAIL_CLASSES)} THEN 0 ELSE 1 END AS ok
  FROM f),
c AS (
  SELECT session_id, sample_no,
         count(*) OVER w AS processed, CAST(sum(ok) OVER w AS BIGINT) AS stored
  FROM o WINDOW w AS (PARTITION BY session_id ORDER BY sample_no
                      ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT session_id, sample_no, processed, stored, processed - stored AS failed,
       {pct_sql('stored', 'processed', 1)} AS success_rate
FROM c QUALIFY processed % 10 = 0 OR processed = max(processed) OVER (PARTITION BY session_id)""",

    "decode_frames_lenient": f"""WITH {FRAMES_CTE}
SELECT *, altitude AS other_alt, polarity AS other_pol, mds AS other_mds, mcg AS other_mcg,
       '{{' || concat_ws(', ', '"time": ' || time_text, '"lat": ' || CAST(latitude AS VARCHAR), '"lon": ' || CAST(longitude AS VARCHAR),
                        '"alt": ' || CAST(altitude AS VARCHAR), '"pol": "' || polarity || '"', '"mds": ' || CAST(mds AS VARCHAR),
                        '"mcg": ' || CAST(mcg AS VARCHAR)) || '}}' AS json
FROM (
SELECT event_id AS frame_id,
       CASE WHEN cls = 0 THEN NULL ELSE CAST({_RAW_TIME} AS VARCHAR) END AS time_text,
       CASE WHEN cls = 2 THEN NULL WHEN cls = 3 THEN 95.0 ELSE CAST(lat_m AS DOUBLE) / 1000.0 END AS latitude,
       CASE WHEN cls = 4 THEN 16.040089 WHEN cls = 5 THEN 99999.0
            ELSE CAST(lon_m AS DOUBLE) / 1000.0 END AS longitude,
       CASE WHEN cls = 9 THEN NULL ELSE user_id END AS altitude,
       CASE WHEN cls = 6 THEN repeat('z', 60) WHEN cls = 10 THEN '0,'
            WHEN cls = 13 THEN 'back\\slash' ELSE polarity END AS polarity,
       CASE WHEN cls = 7 THEN 99999999999 WHEN cls = 11 THEN -12 ELSE CAST(k AS BIGINT) END AS mds,
       CASE WHEN cls = 8 THEN NULL ELSE CAST(trunc(value) AS BIGINT) END AS mcg,
       cls <> 13 AS json_ok,
       CASE WHEN cls IN (3, 5) THEN 1 ELSE 0 END AS n_warnings,
       CASE cls WHEN 3 THEN 'Invalid latitude: 95.0 (must be -90 to 90)'
                WHEN 5 THEN 'Invalid longitude: 99999.0 (must be -180 to 180)' ELSE '' END AS warnings
FROM f)""",

    "decode_report": f"""WITH {FRAMES_CTE}, c AS (
  SELECT count(*) AS samples_processed,
         count(*) FILTER (WHERE cls <> 13) AS successful_decodes,
         count(*) FILTER (WHERE cls IN (3, 5)) AS validation_warnings
  FROM f)
SELECT *, {pct_sql('successful_decodes', 'samples_processed', 1)} AS success_rate FROM c""",

    "longitude_repair": f"""WITH {FRAMES_CTE}
SELECT event_id AS frame_id,
       CASE WHEN cls = 4 THEN '16040089' WHEN cls = 5 THEN '99999'
            ELSE CAST(CAST(lon_m AS DECIMAL(12, 0)) / 1000 AS DECIMAL(9, 3))::VARCHAR END AS lon_text,
       CASE WHEN cls = 4 THEN 16.040089 WHEN cls = 5 THEN 99999.0
            ELSE CAST(lon_m AS DOUBLE) / 1000.0 END AS longitude
FROM f""",

    "epoch_unit": f"""WITH {FRAMES_CTE}
SELECT event_id AS frame_id, {_RAW_TIME} AS strike_time,
       CASE WHEN cls = 1 OR unit = 0 THEN 'us' WHEN unit = 1 THEN 'ms' ELSE 's' END AS epoch_unit,
       {_TIMESTAMP} AS strike_timestamp
FROM f WHERE cls <> 0""",
}

# The written tables hold the decoded frames; what each must be follows from its defect class.
_TABLE_CTE = ORACLE_SQL["decode_frames_strict"].replace("\nSELECT event_id AS id", ",\nstrikes AS (SELECT event_id AS id", 1) + ")"
_TABLE_CTE = _TABLE_CTE.removeprefix("WITH ")
ORACLE_SQL |= {f"table_{k}": ORACLE_SQL[k].replace(STRIKES_CTE, _TABLE_CTE) for k in ("strike_stats", "recent_strikes", "list_strikes")}
ORACLE_SQL["table_strike_stats"] += """
WHERE strike_timestamp >= TIMESTAMP '2024-01-10 00:00:00' AND strike_timestamp <= TIMESTAMP '2024-01-20 23:59:59'"""
ORACLE_SQL["table_nearby_strikes"] = _sql_nearby(True, _TABLE_CTE)
ORACLE_SQL["table_ingestion_stats"] = ORACLE_SQL["ingestion_stats"]
_HAVERSINE = (f"6371.0 * (2 * asin(sqrt(pow(sin(radians(latitude - {SAN_DIEGO[0]!r}) / 2), 2) + cos(radians({SAN_DIEGO[0]!r})) * "
              f"cos(radians(latitude)) * pow(sin(radians(longitude - ({SAN_DIEGO[1]!r})) / 2), 2))))")
ORACLE_SQL["table_nearest_strikes"] = f"""WITH {_TABLE_CTE}
SELECT {", ".join(STRIKE_COLUMNS)}, round({_HAVERSINE}, 6) AS distance_km
FROM strikes WHERE strike_timestamp >= TIMESTAMP '{LIST_ARGS["since"]}' AND strike_timestamp <= TIMESTAMP '{LIST_ARGS["until"]}'
ORDER BY {_HAVERSINE}, strike_timestamp DESC, id DESC LIMIT 20"""
ORACLE_SQL["table_page_strikes"] = f"""WITH {_TABLE_CTE}
SELECT * FROM strikes ORDER BY strike_timestamp DESC, id DESC LIMIT 50 OFFSET 300"""
_WINDOW_SQL = "strike_timestamp >= TIMESTAMP '{}' AND strike_timestamp <= TIMESTAMP '{}'".format(*ROLLUP_WINDOW)
ORACLE_SQL["table_rollup_stats"] = ORACLE_SQL["strike_stats"].replace(STRIKES_CTE, _TABLE_CTE) + "\nWHERE " + _WINDOW_SQL
ORACLE_SQL |= {f"table_rollup_{k}": ORACLE_SQL[f"{k}_activity"].replace(STRIKES_CTE, _TABLE_CTE).replace(
    f"strike_timestamp > {NOW_SQL} - INTERVAL {WHOLE_MONTH_HOURS} HOUR", _WINDOW_SQL) for k in ("hemisphere", "hourly")}
ORACLE_SQL |= {f"compacted_{k}": ORACLE_SQL[f"table_{k}"] for k in ("strike_stats", "list_strikes", "ingestion_stats")}
ORACLE_SQL["ingest_progress_gaps"] = ORACLE_SQL["ingest_progress"].replace(
    "event_id % 250 + 1 AS sample_no", "(event_id % 250 + 1) * 3 + 1000 AS sample_no")

assert set(ORACLE_SQL) == set(QUERIES)
