"""Frame decoding: raw frames -> strikes, outcomes and decode reports.

``decode_frames`` is a single projection (no shuffle), usable on batch and
streaming DataFrames alike. Two profiles follow the two decoders of the
source service:

* ``strict``  -- the ingest decoder: every frame gets exactly one ``reason``
  (NULL when the strike is stored), checked in a fixed order.
* ``lenient`` -- the diagnostic decoder: fields that fail to parse become
  NULL, a JSON document is rebuilt from whatever was found, and the report
  counts whether that document parses.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import decode as D
from ..functions.timeutil import utc
from ..plans.fence import fence


def _extracted(frames: DataFrame) -> DataFrame:
    """Frame keys + the seven raw field captures of the substituted text.

    Two projections: the text is built once, then each pattern reads it.
    """
    keys = [c for c in ("frame_id", "session_id", "sample_no", "received_at") if c in frames.columns]
    text = frames.select(*keys, D.decode_payload(F.col("payload")).alias("_text"))
    return text.select(*keys, *[D.extract(F.col("_text"), f).alias(f"{f}_txt") for f in D.PATTERNS])


def _parsed(x: DataFrame) -> DataFrame:
    """Parse the numeric captures once (``_<field>_d`` doubles, the raw epoch)
    and repair the longitude. Two projections: the longitude's parsed value
    and integer digits first, the repair rule over them second."""
    lon_v = D.parse_double(F.col("lon_txt"))
    x = x.withColumns({
        "strike_time": F.col("time_txt").try_cast("long"),
        "_lat_d": D.parse_double(F.col("lat_txt")),
        "_alt_d": D.parse_double(F.col("alt_txt")),
        "_mds_d": D.parse_double(F.col("mds_txt")),
        "_mcg_d": D.parse_double(F.col("mcg_txt")),
        "_lon_v": lon_v,
        # Only values above 1000 are repaired; skip the digit text otherwise.
        "_lon_digits": F.when(D.is_finite(lon_v) & (F.abs(lon_v) > 1000), D.integer_digits(lon_v)),
    })
    x = x.withColumn("longitude", D.repair_longitude_parts(F.col("_lon_v"), F.col("_lon_digits")))
    # Fenced: in one piece with what follows, the generated method passes 8000 bytes, which the JVM never compiles.
    return fence(x.drop("_lon_v", "_lon_digits"))


def _raises(field: str) -> Column:
    """``int(float(x))`` raises: text present but unparsable or infinite."""
    d = F.col(f"_{field}_d")
    return F.col(f"{field}_txt").isNotNull() & (d.isNull() | ~D.is_finite(d))


def _int32_overflow(field: str) -> Column:
    d = F.col(f"_{field}_d")
    return d.isNotNull() & D.is_finite(d) & ~D.in_int32_after_trunc(d)


def _strict(frames: DataFrame) -> DataFrame:
    x = _parsed(_extracted(frames))
    x = x.withColumns({
        "strike_timestamp": D.epoch_to_timestamp(F.col("strike_time")),
        "latitude": F.col("_lat_d"),
        "altitude": D.truncate_int(F.col("_alt_d"), "int"),
        "mds": D.truncate_int(F.col("_mds_d"), "int"),
        "mcg": D.truncate_int(F.col("_mcg_d"), "int"),
        "_pol": F.nullif(F.col("pol_txt"), F.lit("mds")),
    })
    pol = F.col("_pol")
    pol_too_long = F.when(F.length(pol) > D.POLARITY_MAX_CHARS,
                          F.length(F.rtrim(pol)) > D.POLARITY_MAX_CHARS).otherwise(F.lit(False))
    pol_nul = F.instr(pol, "\u0000") > 0
    storage = (_int32_overflow("alt") | _int32_overflow("mds") | _int32_overflow("mcg")
               | F.coalesce(pol_too_long | pol_nul, F.lit(False)))
    reason = (
        F.when(F.col("time_txt").isNull(), F.lit("no_time"))
         .when(F.col("strike_timestamp").isNull(), F.lit("time_out_of_range"))
         .when(F.col("lat_txt").isNull() | F.col("lon_txt").isNull(), F.lit("no_coordinates"))
         .when(F.col("latitude").isNull(), F.lit("bad_number"))
         .when(_raises("alt") | _raises("mds") | _raises("mcg"), F.lit("bad_number"))
         .when(F.col("longitude").isNull(), F.lit("bad_longitude"))
         .when((F.abs("latitude") > 90) | (F.abs("longitude") > 180), F.lit("out_of_bounds"))
         .when(storage, F.lit("storage"))
    )
    # A VARCHAR(50) column silently drops excess characters that are all spaces.
    polarity = F.when(F.length(pol) > D.POLARITY_MAX_CHARS,
                      F.substring(pol, 1, D.POLARITY_MAX_CHARS)).otherwise(pol)
    out = x.withColumns({"reason": reason, "polarity": polarity})
    return fence(out.drop("_lat_d", "_alt_d", "_mds_d", "_mcg_d", "_pol"))


def _lenient(frames: DataFrame) -> DataFrame:
    x = _parsed(_extracted(frames))
    # float(lat) failing, or int(inf) for alt/mds/mcg, raises out of the
    # lenient decoder: such a frame is never counted as a sample.
    inf = [F.col(f"_{f}_d").isNotNull() & ~D.is_finite(F.col(f"_{f}_d")) for f in ("alt", "mds", "mcg")]
    raises = (F.col("lat_txt").isNotNull() & F.col("_lat_d").isNull()) | inf[0] | inf[1] | inf[2]
    x = fence(x.withColumn("_raises", raises)).where(~F.col("_raises")).select(
        "frame_id",
        F.col("time_txt").alias("time_text"),
        # The time as the diagnostic decoder shows it (NULL = shown raw).
        D.epoch_to_timestamp(F.col("strike_time")).alias("strike_timestamp"),
        F.col("_lat_d").alias("latitude"),
        "longitude",
        D.truncate_int(F.col("_alt_d"), "long").alias("altitude"),
        D.python_strip(F.nullif(F.col("pol_txt"), F.lit("mds"))).alias("_pol"),
        D.truncate_int(F.col("_mds_d"), "long").alias("mds"),
        D.truncate_int(F.col("_mcg_d"), "long").alias("mcg"),
    )
    x = x.withColumn("polarity", F.nullif(F.col("_pol"), F.lit(""))).drop("_pol")

    def num(key: str, c: str) -> Column:
        return F.when(F.col(c).isNotNull(), F.concat(F.lit(f'"{key}": '), F.col(c).cast("string")))

    parts = [
        F.when(F.col("time_text").isNotNull(), F.concat(F.lit('"time": '), F.col("time_text"))),
        num("lat", "latitude"), num("lon", "longitude"), num("alt", "altitude"),
        F.when(F.col("polarity").isNotNull(), F.concat(F.lit('"pol": "'), F.col("polarity"), F.lit('"'))),
        num("mds", "mds"), num("mcg", "mcg"),
    ]
    x = x.withColumn("json", F.concat(F.lit("{"), F.concat_ws(", ", *parts), F.lit("}")))
    # The time is judged separately: Python accepts JSON integers of up to
    # 4300 digits (no leading zero), Spark's parser stops near 1000 digits.
    time_ok = F.col("time_text").isNull() | (
        F.col("time_text").rlike("^(0|[1-9][0-9]*)$")
        & (F.length("time_text") <= D.PY_INT_MAX_DIGITS))
    parts[0] = F.when(F.col("time_text").isNotNull(), F.lit('"time": 0'))
    probe = F.concat(F.lit("{"), F.concat_ws(", ", *parts), F.lit("}"))
    # Everything but time and position, as the diagnostic decoder reports it.
    x = x.withColumn("other_fields", F.struct(
        F.col("altitude").alias("alt"), F.col("polarity").alias("pol"), "mds", "mcg"))
    # Python writes an infinite latitude as ``inf``, which is not JSON.
    ok = time_ok & F.try_parse_json(probe).isNotNull() & \
        (F.col("latitude").isNull() | D.is_finite(F.col("latitude")))
    x = x.withColumn("json_ok", ok)
    # The wording of the warnings.
    warn_lat = F.when(F.abs("latitude") > 90, F.concat(
        F.lit("Invalid latitude: "), F.col("latitude").cast("string"), F.lit(" (must be -90 to 90)")))
    warn_lon = F.when(F.abs("longitude") > 180, F.concat(
        F.lit("Invalid longitude: "), F.col("longitude").cast("string"), F.lit(" (must be -180 to 180)")))
    # concat of 0/1-element arrays (array_compact would be a lambda filter,
    # which has no code generation).
    none = F.array().cast("array<string>")
    warnings = F.when(F.col("json_ok"), F.concat(
        F.when(warn_lat.isNotNull(), F.array(warn_lat)).otherwise(none),
        F.when(warn_lon.isNotNull(), F.array(warn_lon)).otherwise(none))).otherwise(none)
    return fence(x.withColumn("warnings", warnings))


def decode_frames(frames: DataFrame, profile: str = "strict") -> DataFrame:
    """Decode raw frames. ``profile`` is ``"strict"`` or ``"lenient"``."""
    if profile == "strict":
        return _strict(frames)
    if profile == "lenient":
        return _lenient(frames)
    raise ValueError(f"unknown profile {profile!r}")


def accepted_strikes(decoded: DataFrame, with_date: bool = False) -> DataFrame:
    """Stored strikes from a strict decode, in the strike table schema."""
    cols = [
        F.col("frame_id").alias("id"),
        "strike_time", "strike_timestamp", "latitude", "longitude",
        "altitude", "polarity", "mds", "mcg",
        utc("received_at").alias("inserted_at"),
    ]
    out = decoded.where(F.col("reason").isNull()).select(*cols)
    if with_date:
        out = out.withColumn("strike_date", F.to_date("strike_timestamp"))
    return out


def outcomes(decoded: DataFrame, *more: str) -> DataFrame:
    """One row per frame: was it decoded, was it stored, and why not; and the columns ``more``."""
    return decoded.select(
        "frame_id", "session_id", "sample_no",
        utc("received_at").alias("received_at"),
        (F.col("reason").isNull() | (F.col("reason") == "storage")).alias("decoded"),
        F.col("reason").isNull().alias("stored"),
        "reason", *more,
    )


def reject_counts(decoded: DataFrame) -> DataFrame:
    """(reason, frames) over rejected frames; partial aggregation before the shuffle."""
    return (decoded.where(F.col("reason").isNotNull())
            .groupBy("reason").agg(F.count(F.lit(1)).alias("frames")))


__all__ = ["decode_frames", "accepted_strikes", "outcomes", "reject_counts"]
