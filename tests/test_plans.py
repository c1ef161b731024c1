"""Plan shape: pushdown, pruning, top-k, no Python in the hot path."""

import datetime as dt
import re

from conftest import SF_SMALL
from strike_analytics.operators import aggregates as A
from strike_analytics.operators import queries as Q
from strike_analytics.operators.decode import accepted_strikes, decode_frames
from strike_analytics.plans import registry
from strike_analytics.plans.registry import NEARBY_ARGS, NOW, QUERIES
from strike_analytics.session import fresh_dir
from strike_analytics.sources.events import read_frames_from_events, read_strikes_from_events
from strike_analytics.sources.tables import ingest_batch, read_outcomes, read_strikes


def plan(df):
    df.sparkSession.conf.set("spark.sql.maxMetadataStringLength", "100000")
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_python_udfs_anywhere(spark):
    for name, fn in QUERIES.items():
        p = plan(fn(spark, SF_SMALL))
        assert "BatchEvalPython" not in p and "ArrowEvalPython" not in p, name


def test_time_filter_reaches_the_scan(spark):
    p = plan(QUERIES["recent_strikes"](spark, SF_SMALL))
    assert "PushedFilters: [IsNotNull(ts), GreaterThanOrEqual(ts" in p
    assert "TakeOrderedAndProject" in p


def test_written_table_prunes_dates_and_pushes_box(spark):
    root = fresh_dir(spark, "plan-test")
    ingest_batch(read_frames_from_events(spark, SF_SMALL), root, batch_id="b1")
    strikes = read_strikes(spark, f"{root}/strikes")
    p = plan(Q.nearby_strikes(strikes, now=NOW, **NEARBY_ARGS))
    assert "PartitionFilters: [isnotnull(strike_date" in p and "strike_date#" in p
    assert "GreaterThanOrEqual(latitude" in p and "LessThanOrEqual(longitude" in p
    # pruning is exact: same rows as scanning everything
    full = Q.nearby_strikes(strikes.drop("strike_date"), now=NOW, **NEARBY_ARGS).collect()
    assert Q.nearby_strikes(strikes, now=NOW, **NEARBY_ARGS).drop("strike_date").collect() == full
    assert strikes.count() == 800
    s = A.strike_stats(strikes, since=dt.datetime(2024, 1, 10), until=dt.datetime(2024, 1, 12)).collect()[0]
    assert s.time_range_start >= dt.datetime(2024, 1, 10)


def test_decode_filter_is_not_inlined(spark):
    # The fence keeps `reason IS NULL` above the decode: the decode runs once per row.
    p = plan(QUERIES["decode_frames_strict"](spark, SF_SMALL))
    assert "Generate inline" in p
    assert p.count("regexp_extract") <= 8


def test_keyset_paging_equals_offset_paging(spark):
    strikes = read_strikes_from_events(spark, SF_SMALL)
    by_offset = Q.list_strikes(strikes, limit=7, offset=7).collect()
    first = Q.list_strikes(strikes, limit=7).collect()
    last = first[-1]
    by_key = Q.list_strikes(strikes, limit=7, after=(last.strike_timestamp, last.id)).collect()
    assert by_key == by_offset


def test_batch_ingest_is_idempotent(spark):
    root = fresh_dir(spark, "idem")
    frames = read_frames_from_events(spark, SF_SMALL)
    first, second = frames.where("frame_id < 600"), frames.where("frame_id >= 600")
    ingest_batch(first, root, batch_id="a")
    ingest_batch(first, root, batch_id="a")           # a retried batch
    ingest_batch(second, root, batch_id="b")
    strikes = read_strikes(spark, f"{root}/strikes")
    assert strikes.count() == 800
    assert strikes.select("id").distinct().count() == 800
    assert read_outcomes(spark, f"{root}/decoded").count() == 1000


def test_empty_batch_ingest(spark):
    root = fresh_dir(spark, "empty")
    frames = read_frames_from_events(spark, SF_SMALL).where("frame_id < 0")
    ingest_batch(frames, root, batch_id="e")
    ingest_batch(read_frames_from_events(spark, SF_SMALL).where("frame_id < 100"), root, batch_id="f")
    assert read_strikes(spark, f"{root}/strikes").count() == 76     # 100 frames, 24 in reject classes


def test_hot_cell_is_split_across_writers(spark):
    from pyspark.sql import functions as F
    from strike_analytics.plans.layout import clustered
    # every strike in one grid cell on one day
    hot = read_strikes_from_events(spark, SF_SMALL).withColumns({
        "latitude": F.lit(32.5), "longitude": F.lit(-117.5),
        "strike_timestamp": F.lit("2024-01-05 00:00:00").cast("timestamp_ntz")
        + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.col("id").cast("decimal(18,6)"))})
    # AQE would merge these tiny partitions back into one; look at the split itself.
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sizes = [r["n"] for r in clustered(hot).groupBy(F.spark_partition_id().alias("p"))
                 .agg(F.count(F.lit(1)).alias("n")).collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert len(sizes) >= 4 and max(sizes) < 500


def test_every_projection_and_filter_is_codegen(spark):
    # An expression without code generation (from_json, lambda functions, ...)
    # silently pushes its whole fused stage out of whole-stage codegen.
    # Without fallback a generated class that fails to compile raises instead
    # of silently running interpreted.
    spark.conf.set("spark.sql.codegen.fallback", "false")
    try:
        _check_codegen(spark)
    finally:
        spark.conf.set("spark.sql.codegen.fallback", "true")


def _check_codegen(spark):
    for name, fn in QUERIES.items():
        df = fn(spark, SF_SMALL)
        df.collect()                      # adaptive plans get codegen stages when they run
        final = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
        for line in final.splitlines():
            node = line.lstrip(" :+-")
            if node.startswith(("Project [", "Filter ", "Generate ")):
                raise AssertionError(f"{name}: not in codegen: {node[:80]}")


def _largest_method(df, capsys):
    """Bytes of the largest generated method. The JVM interprets those of more than 8000, whatever their use."""
    capsys.readouterr()
    df.explain("codegen")
    return max(int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", capsys.readouterr().out))


def test_generated_frames_are_compiled(spark, capsys, monkeypatch):
    given, plain = [], registry.frames_from_events
    monkeypatch.setattr(registry, "frames_from_events", lambda events: given.append(events.rdd.getNumPartitions()) or plain(events))
    landed = registry.read_frames(spark, registry.land_frames(spark, SF_SMALL))
    # Events of however few splits are made into frames by many tasks.
    assert given == [2 * spark.sparkContext.defaultParallelism]
    frames = read_frames_from_events(spark, SF_SMALL)
    assert landed.exceptAll(frames).count() == 0 and landed.count() == frames.count()
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        assert _largest_method(frames, capsys) < 8000
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_strict_decode_is_compiled(spark, capsys):
    frames = registry.read_frames(spark, registry.land_frames(spark, SF_SMALL))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        assert _largest_method(accepted_strikes(decode_frames(frames)), capsys) < 8000
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
