"""Schemas of the three tables of the model."""

from pyspark.sql import types as T

# Accepted strikes (one row per stored frame).
STRIKES = T.StructType([
    T.StructField("id", T.LongType(), False),
    T.StructField("strike_time", T.LongType(), False),
    T.StructField("strike_timestamp", T.TimestampNTZType(), False),
    T.StructField("latitude", T.DoubleType(), False),
    T.StructField("longitude", T.DoubleType(), False),
    T.StructField("altitude", T.IntegerType(), True),
    T.StructField("polarity", T.StringType(), True),
    T.StructField("mds", T.IntegerType(), True),
    T.StructField("mcg", T.IntegerType(), True),
    T.StructField("inserted_at", T.TimestampNTZType(), True),
])
STRIKE_COLUMNS = [f.name for f in STRIKES.fields]

# Raw frames as landed from the feed (Kafka-compatible: payload is BINARY).
FRAMES = T.StructType([
    T.StructField("frame_id", T.LongType(), False),
    T.StructField("session_id", T.LongType(), False),
    T.StructField("sample_no", T.LongType(), False),
    T.StructField("received_at", T.TimestampType(), False),
    T.StructField("is_text", T.BooleanType(), False),
    T.StructField("payload", T.BinaryType(), True),
])

# One outcome row per frame; counters are aggregates over it.
OUTCOMES = T.StructType([
    T.StructField("frame_id", T.LongType(), False),
    T.StructField("session_id", T.LongType(), False),
    T.StructField("sample_no", T.LongType(), False),
    T.StructField("received_at", T.TimestampNTZType(), False),
    T.StructField("decoded", T.BooleanType(), False),
    T.StructField("stored", T.BooleanType(), False),
    T.StructField("reason", T.StringType(), True),
])

# Reject reasons, in the order the strict decoder checks them.
REJECT_REASONS = (
    "no_time",
    "time_out_of_range",
    "no_coordinates",
    "bad_number",
    "bad_longitude",
    "out_of_bounds",
    "storage",
)
