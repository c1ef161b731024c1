"""Live progress lines equal the batch log, however frames arrive."""
import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from strike_analytics.operators.ingest_stats import ingest_progress
from strike_analytics.session import fresh_dir
from strike_analytics.streaming.progress import progress_line_stream

SCHEMA = "session_id long, sample_no long, received_at timestamp_ntz, decoded boolean"
START = dt.datetime(2024, 1, 1)


def frames(seed):
    """Connections of 1 to 57 frames, one a second, numbers with gaps."""
    rng = random.Random(seed)
    rows = []
    for session in range(8):
        number = rng.randint(0, 1000)
        for k in range(rng.choice([1, 9, 10, 11, 30, 57])):
            number += rng.choice([1, 1, 1, 5])
            rows.append((session, number, START + dt.timedelta(seconds=k), rng.random() < 0.8))
    return rows


def as_rows(df):
    return sorted(tuple(r) for r in df.select("session_id", "sample_no", "processed", "stored", "failed", "success_rate").collect())


@pytest.mark.parametrize("seed", [1, 2])
def test_stream_equals_batch_under_shuffled_arrival(spark, seed):
    rows, path, name = frames(seed), fresh_dir(spark, "live-frames"), f"lines_{seed}"
    random.Random(seed).shuffle(rows)
    # Later frames of other connections move the watermark past the connections' end.
    for k, part in enumerate([rows[i::4] for i in range(4)] + [[(100, 1, START + dt.timedelta(hours=1), True)],
                                                               [(101, 1, START + dt.timedelta(hours=2), True)]]):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.parquet(f"{path}/{k}")
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(path)
    lines = progress_line_stream(stream, delay=dt.timedelta(minutes=2), idle=dt.timedelta(minutes=5))
    lines.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    got = [r for r in as_rows(spark.table(name)) if r[0] < 100]
    assert got == as_rows(ingest_progress(spark.createDataFrame(rows, SCHEMA)))


def test_repeated_and_missing_numbers(spark):
    rows = [(1, None, k % 3 > 0) for k in range(25)] + [(1, 7, k % 2 > 0) for k in range(36)] + [(2, None, True)]
    got = as_rows(ingest_progress(spark.createDataFrame(rows, "session_id long, sample_no long, decoded boolean")
                                  .withColumn("received_at", F.lit(START))).fillna({"sample_no": -1}))
    order = sorted(rows, key=lambda r: (r[0], -1 if r[1] is None else r[1], r[2]))
    want = []
    for session in (1, 2):
        own = [r for r in order if r[0] == session]
        for k in range(1, len(own) + 1):
            if k % 10 == 0 or k == len(own):
                ok = sum(r[2] for r in own[:k])
                number = -1 if own[k - 1][1] is None else own[k - 1][1]
                want.append((session, number, k, ok, k - ok))
    assert [r[:5] for r in got] == sorted(want)
