"""Strikes and raw frames derived from the ``events`` table.

The driver's tables contain no strikes, so both inputs are derived from
``events`` by fixed formulas (see FIXTURES.md). Everything is a projection:
no shuffle, no driver round-trip, and the work grows with ``events``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.timeutil import epoch_micros
from ..plans.fence import fence

# Fixed values of the fixture formulas (FIXTURES.md §1-2).
STORM_LAT, STORM_LON = 32716, -117161          # San Diego, in 1/1000 degree
LAT_MULT, LON_MULT = 7919, 104729
STORM_SPAN, LAT_SPAN, LON_SPAN = 4001, 180001, 360001
SESSION_FRAMES = 250
DEFECT_CLASSES = 40
POSITIVE_TYPES = ("click", "view")
NEGATIVE_TYPES = ("signup", "purchase")

# Characters written for the digits 0-9 (in digit order) and for "." in
# encoded frames; the decoder maps them back. Three digit families of the
# substitution table are used, by ``event_id % 5``.
DIGIT_FAMILIES = {
    0: "ĈĉĊċČčĎďĐđ",       # U+0108..U+0111 -> 0..9
    1: "ĠġĢģĤĥĦħĨĩ",       # U+0120..U+0129 -> 0..9
    2: "ĚěĒēĔĕĖėĘę",       # U+011A, U+011B, U+0112..U+0119 -> 0..9
}
ENCODED_POINT = "ć"
COLON = "Ć"


def read_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/events.parquet")


def _lat_milli(eid: Column, even: Column) -> Column:
    return F.when(even, F.lit(STORM_LAT) + (eid * LAT_MULT) % STORM_SPAN - 2000) \
            .otherwise((eid * LAT_MULT) % LAT_SPAN - 90000)


def _lon_milli(eid: Column, even: Column) -> Column:
    return F.when(even, F.lit(STORM_LON) + (eid * LON_MULT) % STORM_SPAN - 2000) \
            .otherwise((eid * LON_MULT) % LON_SPAN - 180000)


def _polarity(event_type: Column) -> Column:
    return F.when(event_type.isin(*POSITIVE_TYPES), F.lit("positive")) \
            .when(event_type.isin(*NEGATIVE_TYPES), F.lit("negative"))


def _props_k(props: Column) -> Column:
    """``k`` of the ``{"k": N}`` props document (NULL when malformed).

    ``get_json_object`` rather than ``from_json``: the latter has no code
    generation and would push the whole fused projection out of codegen.
    """
    return F.get_json_object(props, "$.k").try_cast("int")


def strikes_from_events(events: DataFrame) -> DataFrame:
    """The strike table of FIXTURES.md §1 (same schema as a decoded table)."""
    eid = F.col("event_id")
    even = F.col("user_id") % 2 == 0
    return events.select(
        eid.alias("id"),
        epoch_micros(F.col("ts")).alias("strike_time"),
        F.col("ts").cast("timestamp_ntz").alias("strike_timestamp"),
        (_lat_milli(eid, even).cast("double") / 1000.0).alias("latitude"),
        (_lon_milli(eid, even).cast("double") / 1000.0).alias("longitude"),
        F.col("user_id").try_cast("int").alias("altitude"),
        _polarity(F.col("event_type")).alias("polarity"),
        _props_k(F.col("props")).alias("mds"),
        F.col("value").try_cast("int").alias("mcg"),
        F.timestamp_add("SECOND", F.lit(1), F.col("ts")).alias("inserted_at"),
    )


def read_strikes_from_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return strikes_from_events(read_events(spark, sf_dir))


def _idiv(v: Column, n: int) -> Column:
    """Integer division (floor) of a non-negative LONG column by a constant."""
    return ((v - v % n) / n).cast("long")


def _milli_text(v: Column) -> Column:
    """Exact DECIMAL(9,3) text of an integer count of thousandths."""
    a = F.abs(v)
    return F.concat(F.when(v < 0, F.lit("-")).otherwise(F.lit("")),
                    _idiv(a, 1000).cast("string"), F.lit("."),
                    F.lpad((a % 1000).cast("string"), 3, "0"))


def frames_from_events(events: DataFrame) -> DataFrame:
    """Encoded raw frames with injected defects (FIXTURES.md §2).

    Defect class = ``event_id % 40``; classes 0-8 fail strict decoding,
    9-13 exercise repairs and quirks, the rest are clean.

    Built in stages of named columns: each intermediate value is computed
    once and referenced by name, which keeps the generated code small
    (reusing one Column object in several places copies its whole tree).
    """
    eid = F.col("event_id")
    even = F.col("user_id") % 2 == 0
    base = events.select(
        eid.alias("frame_id"), "user_id", "ts",
        (eid % DEFECT_CLASSES).alias("_cls"), (eid % 5).alias("_fam"), (eid % 7).alias("_var"),
        (eid % 3).alias("_unit"),
        epoch_micros(F.col("ts")).alias("_us"),
        _lat_milli(eid, even).alias("_lat_m"), _lon_milli(eid, even).alias("_lon_m"),
        _polarity(F.col("event_type")).alias("_pol"),
        _props_k(F.col("props")).cast("string").alias("_mds"),
        F.col("value").try_cast("decimal(12,2)").cast("string").alias("_mcg"),
    )
    cls, fam, us = F.col("_cls"), F.col("_fam"), F.col("_us")
    texts = base.withColumns({
        "_raw": (F.when(cls == 1, us * 1000)
                  .when(F.col("_unit") == 0, us)
                  .when(F.col("_unit") == 1, _idiv(us, 1000))
                  .otherwise(_idiv(us, 1000000))).cast("long").cast("string"),
        "_lat_dec": F.when(cls == 3, F.lit("95.000")).otherwise(_milli_text(F.col("_lat_m"))),
        "_lon_dec": (F.when(cls == 4, F.lit("16040089")).when(cls == 5, F.lit("99999"))
                      .otherwise(_milli_text(F.col("_lon_m")))),
    })
    raw = F.col("_raw")

    def point(c: str) -> Column:
        return F.when(fam == 0, F.translate(F.col(c), ".", ENCODED_POINT)).otherwise(F.col(c))

    # Fenced: as one piece the generated method passes 8000 bytes, which the JVM never compiles.
    encoded = fence(texts).withColumns({
        "_t": (F.when(fam == 0, F.translate(raw, "0123456789", DIGIT_FAMILIES[0]))
                .when(fam == 1, F.translate(raw, "0123456789", DIGIT_FAMILIES[1]))
                .when(fam == 2, F.translate(raw, "0123456789", DIGIT_FAMILIES[2]))
                .otherwise(raw)),
        "_lat_txt": point("_lat_dec"),
        "_lon_txt": point("_lon_dec"),
        "_quote": F.when(F.col("_var") == 1, F.lit("İ")).otherwise(F.lit('"')),
    })
    pol = F.col("_pol")
    parts = [
        F.when(cls == 0, F.concat(F.lit('"time' + COLON), F.col("_t")))
         .otherwise(F.concat(F.lit('"time":'), F.col("_t"))),
        F.when(cls == 2, F.concat(F.lit('"lat":'), F.col("_lat_txt")))
         .otherwise(F.concat(F.lit('"lat' + COLON), F.col("_lat_txt"))),
        F.concat(F.lit('"lon' + COLON), F.col("_lon_txt")),
        F.concat(F.when(cls == 9, F.lit('"alt' + COLON)).otherwise(F.lit('"al' + COLON)),
                 F.col("user_id").cast("string")),
        F.when(cls == 6, F.lit('"pol' + COLON + '"' + "z" * 60 + '"'))
         .when(cls == 10, F.lit('"pol' + COLON + "0"))
         .when(cls == 13, F.lit('"pol' + COLON + '"back\\slash"'))
         .when(pol.isNotNull(), F.concat(F.lit('"pol' + COLON), F.col("_quote"), pol, F.col("_quote"))),
        F.concat(F.lit('"mds' + COLON),
                 F.when(cls == 7, F.lit("99999999999")).when(cls == 11, F.lit("-12.9")).otherwise(F.col("_mds"))),
        F.concat(F.lit('"mcg' + COLON), F.when(cls == 8, F.lit("1.2.3")).otherwise(F.col("_mcg"))),
    ]
    lead = F.when(F.col("_var") == 0, F.lit("{Ā")).otherwise(F.lit("{"))
    text = encoded.withColumn("_text", F.concat(lead, F.concat_ws(",", *parts), F.lit(",")))
    utf8 = F.encode(F.col("_text"), "UTF-8")
    payload = F.when(cls == 12, F.concat(utf8, F.unhex(F.lit("FF")))).otherwise(utf8)
    fid = F.col("frame_id")
    return text.select(
        fid,
        _idiv(fid, SESSION_FRAMES).alias("session_id"),
        (fid % SESSION_FRAMES + 1).cast("long").alias("sample_no"),
        F.timestamp_micros(epoch_micros(F.col("ts")) + 1_000_000).alias("received_at"),
        (fid % 2 == 1).alias("is_text"),
        payload.alias("payload"),
    )


def read_frames_from_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames_from_events(read_events(spark, sf_dir))
