"""Secret scans with a battery of randomness tests; DataFrame functions only.

Known forms (``assign``, ``access``, ``hex``) are found by pattern. Any other
run of 16 and more characters of common encodings is a candidate, kind
``random``: its encoding is inferred from its characters, and three tests
judge it.

* Chi-squared uniformity over the encoding's alphabet. Under the hypothesis
  "written by a person" the statistic's mean and variance follow from the
  length and the letter frequencies of writing; a secret lies far below.
* Runs: how often the class (lower, upper, digit, mark) changes between
  neighbours. Writing changes seldom, secrets often.
* Serial correlation of neighbouring characters, in size: a uniform source has
  none, patterns such as sequences have much.

The three are combined (Stouffer) into one conservative p-value for each
candidate; one whose chi-squared statistic lies far above a uniform source's,
as of repeated patterns, is none at any p-value. Over all
candidates of the table, the Benjamini-Hochberg rule holds the share of false
discoveries under ``rate``, apart for every encoding and length class
(doublings), since short strings can't be told apart as long ones can.

Scale: two passes over the texts, no shuffle of them. The first counts
candidates by encoding, length class and p-value step; there are at most 4
encodings x 32 length classes x ``STEPS`` steps, whatever the input, and the
thresholds of the second pass (at most 128) go into its plan as literals.

Defined results: a null text is as an empty one: no spans. Positions are code
points, ends exclusive. Repeated rows count as often as they occur. An empty
table has no thresholds and no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strike_analytics.llm.common import free_names, read_table

#: The kinds, in order, with their patterns.
PATTERNS = {
    "assign": r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    "access": r"AKIA[A-Z0-9]{16,}",
    "hex": r"[0-9a-f]{24,}",
}
KINDS = [*PATTERNS, "random"]
ASSIGNED = 6

CANDIDATE = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}={0,2}"

#: Encoding -> size of its alphabet, and of the letters of writing in it the
#: sums of the squares and cubes of the frequencies.
ENCODINGS = {"hex": (16, 0.13, 0.025), "HEX": (16, 0.13, 0.025), "base32": (32, 0.075, 0.008), "base64": (64, 0.065, 0.0055)}

#: How often neighbours differ in class in writing; how far (in standard
#: deviations) a uniform source may lie from its mean; steps of p-values.
CHANGES, FAR, STEPS, STEP = 0.15, 4.0, 4000, 0.05
#: The serial correlation of patterns, in size.
SERIAL = 0.3


#: Values that ``running`` adds up one by one; blocks of them are added up again.
BLOCK = 256


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def running(values: Column, add) -> Column:
    """The running results of ``add`` over an array: block by block, so that the
    work is in proportion to the array and not to its square."""
    def plain(part: Column) -> Column:
        step = lambda done, x: F.concat(done, F.array(F.when(F.size(done) == 0, x).otherwise(add(F.element_at(done, F.greatest(F.size(done), F.lit(1))), x))))
        return F.aggregate(part, F.array().cast("array<int>"), step)

    def whole(parts: Column) -> Column:
        return let(plain(F.transform(parts, lambda p: F.element_at(p, -1))), lambda totals: F.flatten(F.transform(
            parts, lambda p, k: F.when(k == 0, p).otherwise(F.transform(p, lambda x: add(F.get(totals, k - 1), x))))))

    starts = F.sequence(F.lit(0), F.size(values) - 1, F.lit(BLOCK))
    return F.when(F.size(values) > 0, let(F.transform(starts, lambda s: plain(F.slice(values, s + 1, F.lit(BLOCK)))), whole)).otherwise(
        F.array().cast("array<int>"))


def matches(text: Column, pattern: str, kind: int) -> Column:
    """[{start, end, kind, match}] of the leftmost matches that don't overlap.

    The texts between the matches and the matches alternate; their lengths
    add up to the positions.
    """
    span = "struct<start:int,end:int,kind:int,match:string>"

    def placed(found: Column) -> Column:
        # split() and regexp_extract_all() find the same matches.
        between = F.split(text, pattern, -1)
        sizes = F.zip_with(F.slice(between, F.lit(1), F.size(found)), found, lambda b, f: F.char_length(b) + F.char_length(f))
        return let(sizes, lambda sizes: F.zip_with(found, running(sizes, lambda x, y: x + y), lambda f, end: F.struct(
            (end - F.char_length(f)).alias("start"), end.alias("end"), F.lit(kind).alias("kind"), f.alias("match"))))

    # Most texts have no match; only for the others the rest is computed.
    return F.when(text.rlike(pattern), let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), placed)).otherwise(
        F.array().cast(f"array<{span}>"))


def base_spans(text: Column) -> Column:
    """All spans of known forms, by start, then kind."""
    assign, access, hexes = (matches(text, p, k) for k, p in enumerate(PATTERNS.values()))
    long_enough = F.filter(assign, lambda s: F.char_length(
        F.regexp_extract(s["match"], PATTERNS["assign"], 1)) >= ASSIGNED)
    order = F.transform(F.concat(long_enough, access, hexes), lambda s: F.struct(s["start"], s["kind"], s["end"]))
    return F.array_sort(order)


def encoding(token: Column) -> Column:
    """The smallest alphabet that has all characters; null for numbers."""
    body = F.regexp_replace(token, "=+$", "")
    return (F.when(body.rlike("^[0-9]+$"), None).when(body.rlike("^[0-9a-f]+$"), "hex").when(body.rlike("^[0-9A-F]+$"), "HEX")
            .when(body.rlike("^[A-Z2-7]+$"), "base32").otherwise("base64"))


def _parameter(name: Column, place: int) -> Column:
    out = F.lit(None).cast("double")
    for e, values in ENCODINGS.items():
        out = F.when(name == e, F.lit(float(values[place]))).otherwise(out)
    return out


def surprise(token: Column, name: Column) -> Column:
    """-ln of the p-value against "written by a person", by the battery; 0 if
    the token is not like a uniform source either."""
    body = F.regexp_replace(token, "=+$", "")
    chars = F.split(body, "")
    n = F.char_length(body).cast("double")
    size, s2, s3 = (_parameter(name, i) for i in range(3))

    squares = F.aggregate(F.array_distinct(chars), F.lit(0.0),
                          lambda total, c: total + F.pow(F.size(F.filter(chars, lambda x: x == c)).cast("double"), 2))
    chi = size * squares / n - n
    mean = size * (1 + (n - 1) * s2) - n
    deviation = size / n * F.sqrt(4 * n * (n - 1) * (n - 2) * (s3 - s2 * s2) + 2 * n * (n - 1) * (s2 - 2 * s3 + s2 * s2))
    z_chi = (mean - chi) / deviation
    z_uniform = (chi - (size - 1)) / F.sqrt(2 * (size - 1))

    lower, upper, digits, marks = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "+/_-"
    classes = F.translate(body, lower + upper + digits + marks, "a" * 26 + "A" * 26 + "0" * 10 + "+" * 4)
    changes = F.char_length(F.regexp_replace(classes, r"(.)\1+", "$1")) - 1
    z_runs = (changes - 0.5 - CHANGES * (n - 1)) / F.sqrt((n - 1) * CHANGES * (1 - CHANGES))

    # From sums alone: a mean within the lambdas would be computed anew for every character.
    codes = F.transform(chars, lambda c: F.ascii(c).cast("double"))
    total = lambda values: F.aggregate(values, F.lit(0.0), lambda a, x: a + x)
    length = F.char_length(body) - 1
    products = F.zip_with(F.slice(codes, 1, length), F.slice(codes, 2, length), lambda a, b: a * b)
    centre = total(codes) / n
    spread = total(F.transform(codes, lambda c: c * c)) - n * centre * centre
    ends = F.ascii(F.substring(body, 1, 1)) + F.ascii(F.substring(body, -1, 1))
    together = total(products) - centre * (2 * n * centre - ends) + (n - 1) * centre * centre
    serial = F.when(spread > 1e-6, F.least(F.abs(together / spread), F.lit(1.0))).otherwise(F.lit(1.0))
    z_serial = (SERIAL - serial) * F.sqrt(n)

    z = (z_chi + z_runs + z_serial) / math.sqrt(3)
    uniform = F.abs(z_uniform) <= FAR
    # exp(-z^2 / 2) / 2 is an upper bound of the normal tail.
    return F.when(uniform & (z > 0), z * z / 2 + math.log(2)).otherwise(F.lit(0.0))


def candidates(text: Column) -> Column:
    """[{start, end, encoding, length, step}] of each candidate; length and step
    are its length class and the floor of its surprise in steps."""
    found = matches(text, CANDIDATE, KINDS.index("random"))
    named = F.transform(found, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"),
                                                  s["match"].alias("match"), encoding(s["match"]).alias("encoding")))
    return F.transform(F.filter(named, lambda s: s["encoding"].isNotNull()), lambda s: F.struct(
        s["start"].alias("start"), s["end"].alias("end"), s["encoding"].alias("encoding"),
        F.floor(F.log2((s["end"] - s["start"]).cast("double"))).cast("int").alias("length"),
        F.least(F.floor(surprise(s["match"], s["encoding"]) / STEP), F.lit(STEPS)).cast("int").alias("step")))


def thresholds(docs: DataFrame, rate: float) -> dict[tuple[str, int], int]:
    """(encoding, length class) -> least step that is a discovery under Benjamini-Hochberg."""
    counts = (docs.select(F.inline(candidates(F.col("text")))).groupBy("encoding", "length", "step")
              .agg(F.count("*").alias("n")))
    group = Window.partitionBy("encoding", "length")
    rows = (counts.withColumn("all", F.sum("n").over(group))
            .withColumn("found", F.sum("n").over(group.orderBy(F.desc("step"))))
            .where(F.exp(-F.col("step") * STEP) <= rate * F.col("found") / F.col("all"))
            .groupBy("encoding", "length").agg(F.min("step").alias("least")).collect())  # 128 rows at most
    return {(r["encoding"], r["length"]): r["least"] for r in rows}


def spans(text: Column, least: dict[tuple[str, int], int]) -> tuple[Column, Column]:
    """Spans {start, kind, end} of known forms, and all spans with the discoveries beside them."""
    text = F.coalesce(text, F.lit(""))
    base = base_spans(text)
    limit = F.lit(STEPS + 1)
    random = F.transform(
        F.filter(candidates(text), lambda c: c["step"] >= _limit(c, least, limit)),
        lambda c: F.struct(c["start"].alias("start"), F.lit(KINDS.index("random")).alias("kind"), c["end"].alias("end")))
    return base, random


def _limit(c: Column, least: dict[tuple[str, int], int], otherwise: Column) -> Column:
    out = otherwise
    for (name, length), step in sorted(least.items()):
        out = F.when((c["encoding"] == name) & (c["length"] == length), F.lit(step)).otherwise(out)
    return out


def apart(random: Column, base: Column) -> Column:
    """The spans of ``random``, which don't overlap one another, that overlap no
    span of ``base``. In the order of starts, one of ``base`` overlaps if it
    ends behind the start, or comes next and starts before the end."""
    known = len(PATTERNS)

    def clear(all_: Column) -> Column:
        ends = running(F.transform(all_, lambda s: F.when(s["kind"] < known, s["end"]).otherwise(F.lit(0))), F.greatest)
        return let(ends, lambda ends: F.filter(all_, lambda s, k: (s["kind"] == known) & (F.get(ends, k) <= s["start"])
                                               & F.coalesce(F.get(all_, k + 1)["start"] >= s["end"], F.lit(True))))

    return F.when(F.size(random) == 0, random).when(F.size(base) == 0, random).otherwise(
        let(F.array_sort(F.concat(base, random)), clear))


def with_spans(docs: DataFrame, rate: float, base: str = "base", every: str = "every") -> DataFrame:
    """``docs`` with two arrays of {start, kind, end}: known forms, and all spans."""
    known, random = spans(F.col("text"), thresholds(docs, rate))
    free, = free_names(docs.withColumns({base: known, every: known}), "random")
    found = docs.withColumn(base, known).withColumn(free, random)
    return found.withColumn(every, F.array_sort(F.concat(base, apart(F.col(free), F.col(base))))).drop(free)


def spelled(found: str) -> Column:
    kind = lambda k: F.element_at(F.array(*map(F.lit, KINDS)), k + 1)
    return F.array_join(F.transform(found, lambda s: F.concat_ws(
        ":", kind(s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def op7_secret_scan(spark: SparkSession, sf_dir: str, rate: float = 0.01) -> DataFrame:
    """Every document's spans."""
    found = with_spans(read_table(spark, sf_dir, "documents").select("doc_id", "text"), rate)
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return found.select("doc_id", *[count(k).alias(f"n_{name}") for k, name in enumerate(PATTERNS)],
                        F.sha2(spelled("base"), 256).alias("base_sha256"), spelled("every").alias("spans"))


def redact_secrets(docs: DataFrame, rate: float = 0.01, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every span of a secret replaced by ``mark`` (overlapping
    spans by one); n_chars follows. Other rows and columns stay as they are."""
    base, every = free_names(docs, "base", "every")
    found = with_spans(docs, rate, base, every)

    def rebuilt(ends: Column) -> Column:
        """What lies between the spans, joined by the mark. In UTF-32 a place is found without counting characters."""
        before = lambda k: F.when(k == 0, F.lit(0)).otherwise(F.get(ends, k - 1))
        first = F.filter(F.transform(every, lambda s, k: F.struct(before(k).alias("from"), s["start"].alias("to"))), lambda g: g["from"] <= g["to"])
        last = F.struct(F.element_at(ends, -1).alias("from"), F.char_length("text").alias("to"))
        gaps = F.concat(first, F.array(last))
        return let(F.encode("text", "UTF-32"), lambda data: F.array_join(F.transform(gaps, lambda g: F.decode(
            F.substring(data, 4 * g["from"] + 1, 4 * (g["to"] - g["from"])), "UTF-32")), mark))

    some = F.size(every) > 0
    text = let(running(F.transform(every, lambda s: s["end"]), F.greatest), rebuilt)
    found = found.withColumn("text", F.when(some, text).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        found = found.withColumn("n_chars", F.when(some, F.char_length("text")).otherwise(F.col("n_chars")).cast(kind))
    return found.select(*docs.columns)
