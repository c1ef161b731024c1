"""The batch list: all tables change together, compaction, roll-ups and retiring."""
import datetime as dt

import pytest

from conftest import SF_SMALL
from strike_analytics.operators import rollups as R
from strike_analytics.operators.aggregates import hemisphere_activity, hourly_activity, strike_stats
from strike_analytics.operators.ingest_stats import ingestion_stats
from strike_analytics.session import fresh_dir
from strike_analytics.sources import commits, tables
from strike_analytics.sources.events import read_frames_from_events
from strike_analytics.streaming.continuous import ingestion_rollup_stream, ingestion_stats_of, settled


@pytest.fixture(scope="module")
def frames(spark):
    path = fresh_dir(spark, "commit-frames")
    read_frames_from_events(spark, SF_SMALL).write.parquet(path)
    return tables.read_frames(spark, path)


def ids(spark, root):
    return sorted(r.id for r in tables.read_strikes(spark, f"{root}/strikes").select("id").collect())


def seen(spark, root):
    """All that readers of the four tables get."""
    return (ids(spark, root), sorted(r.frame_id for r in tables.read_outcomes(spark, f"{root}/decoded").collect()),
            ingestion_stats(tables.read_outcomes(spark, f"{root}/decoded")).first(), R.ingestion_of(tables.read_counters(spark, root)).first(),
            sorted(map(str, R.hourly_of(tables.read_hourly(spark, root)).collect())))


@pytest.mark.parametrize("table", ["strikes", "hourly", "counters"])
def test_a_crash_between_tables_leaves_the_old_batch_whole(spark, frames, monkeypatch, table):
    root = fresh_dir(spark, "crash")
    tables.ingest_batch(frames.where("frame_id < 300"), root, "1")
    before = seen(spark, root)
    write = tables._write_run

    def crash(df, root, name, *more):
        if name == table:
            raise RuntimeError("lost")
        return write(df, root, name, *more)

    monkeypatch.setattr(tables, "_write_run", crash)
    with pytest.raises(RuntimeError):
        tables.ingest_batch(frames.where("frame_id >= 300"), root, "1")
    assert seen(spark, root) == before
    monkeypatch.undo()
    tables.ingest_batch(frames.where("frame_id >= 300"), root, "1")
    after = seen(spark, root)
    assert min(after[1]) == 300 and after[2] == after[3]


def test_a_reader_during_a_run_sees_the_old_batch_whole(spark, frames, monkeypatch):
    root = fresh_dir(spark, "reader")
    tables.ingest_batch(frames.where("frame_id < 200"), root, "1")
    before, found = seen(spark, root), []
    reader = tables.read_strikes(spark, f"{root}/strikes")  # planned before, read after
    publish = commits.publish
    monkeypatch.setattr(commits, "publish", lambda *a, **b: (found.append(seen(spark, root)), publish(*a, **b)))
    tables.ingest_batch(frames.where("frame_id < 50"), root, "1")
    assert found == [before] and seen(spark, root)[1] == list(range(50))
    assert sorted(r.id for r in reader.collect()) == before[0]


def test_a_first_run_that_crashes_is_not_seen(spark, frames, monkeypatch):
    root = fresh_dir(spark, "first")
    monkeypatch.setattr(commits, "publish", lambda *a, **b: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        tables.ingest_batch(frames.where("frame_id < 100"), root, "1")
    assert ids(spark, root) == []


def test_a_run_without_accepted_rows_takes_the_old_one_back(spark, frames, make_frames):
    root = fresh_dir(spark, "empty-again")
    tables.ingest_batch(frames, root, "1")
    assert R.ingestion_of(tables.read_counters(spark, root)).first().total_stored == 800
    rows = []

    def follow():
        """The live roll-up of the strikes' stream, as a sink that keeps what it got."""
        from pyspark.sql import functions as F
        df = tables.read_strikes(spark, f"{root}/strikes", streaming=True).groupBy("batch_id", "run").agg(F.count("*").alias("n"))
        rows.clear()
        (df.writeStream.outputMode("complete").foreachBatch(lambda d, _: (rows.clear(), rows.extend(d.collect())))
         .trigger(availableNow=True).start().awaitTermination())
        return settled(spark.createDataFrame(rows, df.schema), commits.runs_of(spark, root)).collect()

    assert [r.n for r in follow()] == [800]
    tables.ingest_batch(make_frames(["none"]), root, "1")     # no strike
    assert follow() == [] and ids(spark, root) == []
    assert R.ingestion_of(tables.read_counters(spark, root)).first().total_received == 1
    tables.ingest_batch(make_frames([]), root, "1")            # no frame at all
    assert R.ingestion_of(tables.read_counters(spark, root)).first().total_received == 0
    rollup = ingestion_rollup_stream(tables.read_outcomes(spark, f"{root}/decoded", streaming=True))
    kept = []
    (rollup.writeStream.outputMode("complete").foreachBatch(lambda d, _: (kept.clear(), kept.extend(d.collect())))
     .trigger(availableNow=True).start().awaitTermination())
    stats = ingestion_stats_of(spark.createDataFrame(kept, rollup.schema), commits.runs_of(spark, root)).first()
    assert stats.total_received == 0 == stats.total_stored


def test_compaction_keeps_the_answers_and_bounds_the_folders(spark, frames):
    root = fresh_dir(spark, "compact")

    def folders():
        import os
        return {t: sum(n.startswith("run=") for n in os.listdir(f"{root}/{t}")) for t in tables.TABLES}

    assert tables.compact(spark, root) is None
    for k in range(5):
        tables.ingest_batch(frames.where(f"session_id % 4 = {k % 4}").where(f"frame_id % 5 <> {k}"), root, str(k))
        if k == 2:
            assert tables.compact(spark, root) is not None
    tables.ingest_batch(frames.where("frame_id < 20"), root, "1")       # one of a merged batch again
    before = seen(spark, root)
    entries = len(commits.live_runs(spark, root).entries)
    old = tables.read_strikes(spark, f"{root}/strikes")
    assert tables.compact(spark, root) is not None
    assert seen(spark, root) == before and before[2] == before[3]
    assert sorted(r.id for r in old.collect()) == before[0]            # old readers go on until the folders are retired
    assert tables.retire(spark, root) == []                             # within the time of grace
    assert len(tables.retire(spark, root, 0)) >= entries
    assert seen(spark, root) == before and folders() == dict.fromkeys(tables.TABLES, 1)
    assert len(commits.live_runs(spark, root).entries) == 1
    assert tables.compact(spark, root) is None
    tables.ingest_batch(frames.where("frame_id < 20"), root, "9")
    tables.ingest_batch(frames.where("frame_id between 20 and 22"), root, "0")
    now = seen(spark, root)
    assert tables.compact(spark, root) is not None and seen(spark, root) == now
    tables.retire(spark, root, 0)
    assert seen(spark, root) == now and folders() == dict.fromkeys(tables.TABLES, 1)


def test_a_large_compaction_is_left_alone_until_as_much_has_come(spark, frames):
    root = fresh_dir(spark, "tiers")
    for k in range(2):
        tables.ingest_batch(frames.where(f"frame_id % 2 = {k}"), root, str(k))
    first = tables.compact(spark, root)
    for k in range(2, 4):
        tables.ingest_batch(frames.where(f"frame_id = {k}"), root, str(k))
    second = tables.compact(spark, root)
    live = commits.live_runs(spark, root)
    assert set(live.merged) == {first, second} and live.rows[second] == 2
    tables.ingest_batch(frames, root, "5")
    third = tables.compact(spark, root)
    assert set(commits.live_runs(spark, root).merged) == {third}


@pytest.mark.parametrize("since,until,inclusive", [
    (None, None, True), ("2024-01-10 05:17:03", "2024-01-20 21:42:11", True), ("2024-01-10", "2024-01-20", True),
    ("2024-01-10", None, False), (None, "2024-01-12 03:00:00", True), ("2024-01-10 05:10:00", "2024-01-10 05:50:00", True),
    ("2024-01-10 05:10:00", "2024-01-10 06:50:00", False), ("2030-01-01", None, True)])
def test_rollups_equal_the_scan(spark, frames, tmp_path_factory, since, until, inclusive):
    root = _root(spark, frames)
    strikes, hourly = tables.read_strikes(spark, f"{root}/strikes"), tables.read_hourly(spark, root)
    parts = R.in_window(hourly, strikes, since, until, inclusive)
    if inclusive:
        got, want = R.stats_of(parts).first(), strike_stats(strikes, since=since, until=until).first()
        assert got[:3] == want[:3] and got[3:] == pytest.approx(want[3:]) if want[0] else got == want
    elif until is None:
        now, hours = dt.datetime(2024, 1, 31), 21 * 24
        assert R.hourly_of(parts).collect() == hourly_activity(strikes, now=now, hours=hours).collect()
        got = {r.hemisphere: r for r in R.hemisphere_of(parts).collect()}
        for r in hemisphere_activity(strikes, now=now, hours=hours).collect():
            assert got[r.hemisphere].strike_count == r.strike_count and got[r.hemisphere].avg_lat == pytest.approx(r.avg_lat)


_ROOTS = {}


def _root(spark, frames):
    """Two batches, one of them ingested twice."""
    if "root" not in _ROOTS:
        _ROOTS["root"] = fresh_dir(spark, "rollups")
        for k in (0, 1, 1):
            tables.ingest_batch(frames.where(f"frame_id % 2 = {k}"), _ROOTS["root"], str(k))
    return _ROOTS["root"]


def test_write_strikes_replaces_a_batch(spark, frames):
    from strike_analytics.operators.decode import accepted_strikes, decode_frames
    good = accepted_strikes(decode_frames(frames))
    path = fresh_dir(spark, "written") + "/strikes"
    for limit in ("id < 500", "id < 100"):
        tables.write_strikes(good.where(limit), path, "1")
    tables.write_strikes(good.where("id >= 900"), path, "2")
    assert tables.read_strikes(spark, path).count() == good.where("id < 100 or id >= 900").count()
