"""What the operators of this subpackage share."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from strike_analytics.session import fresh_dir

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

DOCUMENT = ["doc_id", "text", "lang", "source", "n_chars"]


def let_workers_import(spark: SparkSession) -> None:
    """Lets Python workers that see this machine's files import the package;
    elsewhere ship it with --py-files."""
    paths = spark.sparkContext.environment.get("PYTHONPATH", "").split(os.pathsep)
    if ROOT not in paths:
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join([ROOT, *filter(None, paths)])


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    let_workers_import(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_names(df: DataFrame, *names: str) -> list[str]:
    """``names``, each with as many underscores behind it as ``df`` needs for it to be new (in any case of letters)."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


#: For tables with large values: a page is looked at after each row (Parquet's
#: default is a hundred), and a file's rows, which are read together, are few.
LARGE_VALUES = {"parquet.page.size.row.check.min": "1", "parquet.page.size.row.check.max": "1", "maxRecordsPerFile": "128"}


def written(df: DataFrame, name: str, compression: str = "snappy", **options: str) -> DataFrame:
    """``df`` as a table in the shared folder: its lineage ends there."""
    path = fresh_dir(df.sparkSession, name)
    df.write.options(**options).option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def slices(texts: list[str], chars: int = 1 << 20) -> Iterator[slice]:
    """Consecutive slices of about ``chars`` characters (one text at least),
    so that memory follows neither batch size nor the longest texts."""
    start = size = 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= chars:
            yield slice(start, i + 1)
            start, size = i + 1, 0
    if start < len(texts):
        yield slice(start, len(texts))


def map_texts(df: DataFrame, carry: list[str], rows: Callable[[list[str]], dict[str, list]],
              added: dict[str, tuple[str, pa.DataType]], chars: int = 1 << 20) -> DataFrame:
    """The columns ``carry`` of every row and what ``rows`` makes of its text.

    Runs in ``mapInArrow``: ``rows`` gets the texts of a slice (null as the
    empty string) and returns one list for each column of ``added`` (name ->
    Spark's and Arrow's type). No other column of ``df`` is read. A column of
    ``carry`` whose name one of ``added`` has gives way to it.
    """
    let_workers_import(df.sparkSession)
    carry = [c for c in carry if c.lower() not in {n.lower() for n in added}]
    df = df.select(*dict.fromkeys([*carry, "text"]))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*carry).schema),
                        *(f"{n} {t}" for n, (t, _) in added.items())])
    fields = [pa.field(n, t) for n, (_, t) in added.items()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            for s in slices(texts, chars):
                part = batch.slice(s.start, s.stop - s.start).select(carry)
                made = rows(texts[s])
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, *(pa.array(made[f.name], f.type) for f in fields)],
                    schema=pa.schema([*part.schema, *fields]))

    return df.mapInArrow(run, schema)


def keep_texts(df: DataFrame, keep: Callable[[list[str]], list[bool]], chars: int = 1 << 20) -> DataFrame:
    """The rows of ``df``, all columns as they are, whose text ``keep`` approves."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            yield batch.filter(pa.array([k for s in slices(texts, chars) for k in keep(texts[s])], pa.bool_()))

    let_workers_import(df.sparkSession)
    return df.mapInArrow(run, df.schema)
