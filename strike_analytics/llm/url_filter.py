"""URL filters as a sort-merge range join.

A host is written in reverse, every label followed by a NUL
(``www.example.com`` becomes ``com\\0example\\0www\\0``), so a rule's host is a
prefix of the keys of its host and all subdomains: an interval [key, key with
its last NUL raised). Rules and urls are dealt out by ranges of (key, salt)
and sorted, and each range is swept once: a stack holds the hosts whose
interval is open, nested ones above their parents. A host's paths are prefixes
too, so they are intervals of the sorted paths, nested ones within their
parents: a url's place among them gives the innermost interval that can hold
it, and the way up to its parents the longest rule that fits. A url costs a
binary search for each host on the stack, however many rules the hosts have.

The bounds of the ranges come from a bounded random sample of keys; they
decide how evenly the work is spread, never a result. The salt (the hash of the url and
its id) lets bounds fall inside a hot host or url, which is thus split. A rule
goes to every range that its interval meets: a nested rule to a few, one of a
whole top-level domain to those of that domain.

Scale: urls and ids are shuffled once; html is never read. To the driver come
at most ``SAMPLE`` keys of at most ``KEY_BYTES`` bytes; nothing that grows with the
rules or the urls is broadcast or collected.

Defined results: a null url, or one without ``://``, has an empty host and
path, and fits no rule; a url with an empty path fits no rule with a path; no
fitting rule gives a null rule and the default verdict. Equal rules count
once; if they disagree, block wins. Of rules of equal length the one that
sorts last wins. Repeated pages are each judged.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strike_analytics.llm.common import read_table

#: The rules (host, path) and their verdicts.
RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"),
         ("net", "/es/", "block"), ("net", "/fr/", "block")]

SAMPLE, KEY_BYTES = 20_000, 256


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host, path): between the first ``://`` and ``/``, ``?``, ``#`` or the
    end, A-Z lower-cased; and from there to ``?``, ``#`` or the end."""
    after = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)([^?#]*)", 1)
    host = F.translate(after, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)([^?#]*)", 2), F.lit(""))


def host_key(host: Column) -> Column:
    """The reversed labels, each followed by NUL; empty for an empty host."""
    key = F.concat(F.array_join(F.reverse(F.split(host, r"\.", -1)), "\0"), F.lit("\0"))
    return F.when(host == "", F.lit("")).otherwise(key).cast("binary")


def bounds_of(keys: DataFrame, ranges: int) -> list[tuple[bytes, int]]:
    """``ranges - 1`` bounds from a random sample of (key, salt)."""
    n = keys.count()
    share = min(1.0, SAMPLE / 2 / max(1, n))  # twice as many are hardly ever drawn
    rows = keys.select(F.substring("key", 1, KEY_BYTES).alias("key"), "salt").sample(share, seed=7).limit(SAMPLE).collect()
    drawn = sorted((bytes(r["key"]), r["salt"]) for r in rows)
    return sorted({drawn[i * len(drawn) // ranges] for i in range(1, ranges)}) if drawn else []


#: Below every salt.
LOWEST = -(1 << 63)


class Paths:
    """The path rules of one host, added in the order of their paths."""

    def __init__(self, key: bytes):
        self.key, self.paths, self.rules, self.outer = key, [], [], []

    def add(self, path: str, rule: str, verdict: str) -> None:
        at = len(self.paths) - 1
        while at >= 0 and not path.startswith(self.paths[at]):
            at = self.outer[at]
        self.outer.append(at)
        self.paths.append(path)
        self.rules.append((len(rule), rule, verdict))

    def longest(self, path: str) -> tuple[int, str, str] | None:
        """The innermost interval that holds ``path``: those that begin behind it
        don't, and of the last one before it only the ones around it can."""
        at = bisect_right(self.paths, path) - 1
        while at >= 0 and not path.startswith(self.paths[at]):
            at = self.outer[at]
        return self.rules[at] if at >= 0 else None


def sweep(batches: Iterator[pa.RecordBatch], default: str, out: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Judges the sorted rows of one range after another: of a key rules (kind 0,
    by path) come before urls."""
    here = None
    stack: list[Paths] = []
    for batch in batches:
        rows = batch.to_pydict()
        made: dict[str, list] = {n: [] for n in out.names}
        for part, key, kind, row, host, path, rule, verdict in zip(
                *(rows[c] for c in ("part", "key", "kind", "id", "host", "path", "rule", "verdict"))):
            if part != here:
                here, stack = part, []
            while stack and not key.startswith(stack[-1].key):
                stack.pop()
            if kind == 0:
                if not stack or stack[-1].key != key:
                    stack.append(Paths(key))
                stack[-1].add(path, rule, verdict)
                continue
            best = max((fit for fit in (paths.longest(path) for paths in stack) if fit), default=(0, None, default))
            for name, value in zip(out.names, (row, host, path, best[1], best[2])):
                made[name].append(value)
        yield pa.RecordBatch.from_pydict(made, schema=out)


def judge_urls(pages: DataFrame, rules: DataFrame, key: str = "page_id", default: str = "allow") -> DataFrame:
    """For each row of ``pages`` (``key``, url): ``key``, host, path, rule (host
    and path of the longest that fits, else null) and verdict.

    ``rules`` has host, path and verdict (allow or block).
    """
    spark = pages.sparkSession
    host, path = url_parts(F.col("url"))
    kind = pages.schema[key].dataType.simpleString()
    urls = (pages.select(F.col(key).alias("id"), host.alias("host"), path.alias("path"),
                         F.xxhash64(F.col(key), F.col("url")).alias("salt"))
            .withColumn("key", host_key(F.col("host"))))
    ranges = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    bounds = bounds_of(urls.select("key", "salt"), ranges)

    rules = (rules.groupBy("host", "path").agg(F.max("verdict").alias("verdict"))  # "block" is the larger
             .withColumn("key", host_key(F.col("host"))).withColumn("rule", F.concat("host", "path")))

    def deal_urls(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = [bisect_right(bounds, k) for k in zip(b.column("key").to_pylist(), b.column("salt").to_pylist())]
            yield b.append_column(pa.field("part", pa.int32()), pa.array(at, pa.int32()))

    def deal_rules(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            first, last = [], []
            for k in b.column("key").to_pylist():
                first.append(bisect_right(bounds, (k, LOWEST)))
                last.append(bisect_left(bounds, (k[:-1] + b"\x01", LOWEST)) if k else len(bounds))
            b = b.append_column(pa.field("first", pa.int32()), pa.array(first, pa.int32()))
            yield b.append_column(pa.field("last", pa.int32()), pa.array(last, pa.int32()))

    def wider(df: DataFrame, *names: str) -> T.StructType:
        return T.StructType([*df.schema.fields, *(T.StructField(n, T.IntegerType()) for n in names)])

    urls = urls.mapInArrow(deal_urls, wider(urls, "part"))
    rules = rules.mapInArrow(deal_rules, wider(rules, "first", "last"))
    columns = ["part", "key", "kind", "salt", "id", "host", "path", "rule", "verdict"]
    none = F.lit(None)
    every = rules.select(F.explode(F.sequence("first", "last")).alias("part"), "key", F.lit(0).alias("kind"),
                         F.lit(LOWEST).alias("salt"), none.cast(kind).alias("id"), "host", "path", "rule",
                         "verdict").unionByName(
        urls.select("part", "key", F.lit(1).alias("kind"), "salt", "id", "host", "path",
                    none.cast("string").alias("rule"), none.cast("string").alias("verdict")))
    arrow_id = pa.schema([("id", {"bigint": pa.int64(), "int": pa.int32()}.get(kind, pa.string()))]).field(0).type
    out = pa.schema([(key, arrow_id), ("host", pa.string()), ("path", pa.string()), ("rule", pa.string()),
                     ("verdict", pa.string())])
    return (every.select(*columns).repartition(ranges, "part").sortWithinPartitions("part", "key", "kind", "salt", "path")
            .mapInArrow(lambda batches: sweep(batches, default, out),
                        f"`{key}` {kind}, host string, path string, rule string, verdict string"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page against the fixed rules."""
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    return judge_urls(read_table(spark, sf_dir, "pages").select("page_id", "url"), rules)


OP10_SQL = r"""
WITH parts AS (
  SELECT page_id, url,
         coalesce(translate(regexp_extract(url, '^(?s:.*?)://([^/?#]*)([^?#]*)', 1),
                            'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(url, '^(?s:.*?)://([^/?#]*)([^?#]*)', 2), '') AS path
  FROM pages),
rules(h, p, v) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'),
                          ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
fits AS (
  SELECT DISTINCT host, path, h || p AS rule, v
  FROM (SELECT DISTINCT host, path FROM parts) JOIN rules
    ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)),
best AS (SELECT host, path, max_by(rule, length(rule)) AS rule, max_by(v, length(rule)) AS verdict FROM fits GROUP BY host, path)
SELECT page_id, parts.host, parts.path, best.rule, coalesce(best.verdict, 'allow') AS verdict
FROM parts LEFT JOIN best USING (host, path)
"""
