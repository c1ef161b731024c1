"""The batch list of a table root: which runs of which batches readers see.

Every ingest of a batch is a *run* with a folder of its own in each table,
``<table>/run=<run>``, written once and never changed. The run counts only when
its entry is in the list, ``_commits/<run>.json``, which is written under
another name and renamed last of all. So all tables of a batch change together:
a crash in between leaves folders that nobody reads, and a reader sees a batch
that is being ingested again whole, as it was.

An entry names its batch, or, of a compaction, the runs it merges. Readers see

* of each batch, the newest run that no compaction merged;
* of each compaction that no later one merged, all rows but those of batches
  that have such a newer run.

``retire`` removes what readers no longer see, after a time of grace for those
that still read it. The list stays short: entries of merged runs go too.
"""

from __future__ import annotations

import json
import time
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

LIST = "_commits"
ENTRY = T.StructType([T.StructField("run", T.LongType()), T.StructField("batch_id", T.StringType()),
                      T.StructField("merges", T.ArrayType(T.LongType())), T.StructField("rows", T.LongType())])


def new_run() -> int:
    """Later runs have greater numbers (nanoseconds since 1970)."""
    return time.time_ns()


def _at(spark: SparkSession, *parts: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path("/".join([parts[0].rstrip("/"), *parts[1:]]))
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def open_list(spark: SparkSession, root: str) -> None:
    """From now on readers of ``root`` go by its list."""
    files, folder = _at(spark, root, LIST)
    files.mkdirs(folder)


def publish(spark: SparkSession, root: str, run: int, rows: int, batch_id: str | None = None, merges: list[int] | None = None) -> None:
    files, temporary = _at(spark, root, LIST, f"_{uuid.uuid4().hex}")
    out = files.create(temporary, False)
    out.write(bytearray(json.dumps({"run": run, "batch_id": batch_id, "merges": merges, "rows": rows}).encode()))
    out.close()
    _, entry = _at(spark, root, LIST, f"{run}.json")
    if files.exists(entry) or not files.rename(temporary, entry):
        raise FileExistsError(f"run {run} is in the list already")


@dataclass(frozen=True)
class Live:
    """What readers see: ``batches`` (run -> batch_id), ``merged`` (run of a
    compaction -> batch_ids whose rows in it are outdated); ``rows`` of each run."""

    batches: dict[int, str] = field(default_factory=dict)
    merged: dict[int, list[str]] = field(default_factory=dict)
    rows: dict[int, int] = field(default_factory=dict)
    entries: tuple[int, ...] = ()

    @property
    def runs(self) -> list[int]:
        return sorted([*self.batches, *self.merged])


def live_runs(spark: SparkSession, root: str) -> Live | None:
    """None where there is no list (a plain folder of files)."""
    files, folder = _at(spark, root, LIST)
    if not files.exists(folder):
        return None
    entries = spark.read.schema(ENTRY).json(str(folder.toString())).collect()  # one for each run since the last compaction
    gone = {m for e in entries for m in e.merges or []}
    open_ = sorted((e for e in entries if e.run not in gone), key=lambda e: e.run)
    newest = {e.batch_id: e.run for e in open_ if e.merges is None}
    return Live({run: b for b, run in newest.items()}, {e.run: sorted(newest) for e in open_ if e.merges is not None},
                {e.run: e.rows or 0 for e in open_}, tuple(e.run for e in entries))


def runs_of(spark: SparkSession, root: str) -> DataFrame:
    """(batch_id, run) of the batches that no compaction merged, as a table."""
    live = live_runs(spark, root)
    rows = [(b, r) for r, b in (live.batches if live else {}).items()]
    return spark.createDataFrame(rows, "batch_id string, run long")


def read_live(spark: SparkSession, root: str, table: str, schema: T.StructType, live: Live | None = None) -> DataFrame:
    """The rows of ``table`` that readers see, by one look at the list."""
    live = live or live_runs(spark, root)
    folder = f"{root.rstrip('/')}/{table}"
    if live is None:
        return spark.read.schema(schema).parquet(folder)
    if not live.runs:
        return spark.createDataFrame([], schema)
    df = spark.read.schema(schema).option("basePath", folder).parquet(*(f"{folder}/run={r}" for r in live.runs))
    for run, outdated in live.merged.items():
        if outdated:
            df = df.where(~((F.col("run") == run) & F.col("batch_id").isin(outdated)))
    return df


def retire(spark: SparkSession, root: str, tables: list[str], grace_seconds: float = 86_400) -> list[int]:
    """Removes the runs that readers no longer see, and those that were never
    published, if they are older than ``grace_seconds``; gives their numbers."""
    live = live_runs(spark, root)
    if live is None:
        return []
    seen, until = set(live.runs), time.time_ns() - int(grace_seconds * 1e9)
    removed = set()
    # Older entries first: an entry that merges others must outlive theirs.
    for run in sorted(live.entries):
        if run not in seen and run < until:
            files, entry = _at(spark, root, LIST, f"{run}.json")
            files.delete(entry, False)
            removed.add(run)
    for table in tables:
        files, folder = _at(spark, root, table)
        if files.exists(folder):
            for status in files.listStatus(folder):
                name = status.getPath().getName()
                if name.startswith("run=") and int(name[4:]) not in seen and int(name[4:]) < until:
                    files.delete(status.getPath(), True)
                    removed.add(int(name[4:]))
    return sorted(removed)
