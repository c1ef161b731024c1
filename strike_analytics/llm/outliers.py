"""Quality rules and robust multivariate outliers; DataFrame functions only.

Every text gets simple counts and a vector of five transformed statistics:
ln words, ln mean word length, ln(1 + 20 x symbols a word), the share of
repeated lines and the share of words in repeated windows. Texts that pass the
base rules are then judged by their Mahalanobis distance from the minimum
covariance determinant estimate of their language and source.

The estimate is found by concentration steps from two deterministic starts
(medians with quartile ranges; all rows), each step keeping the share
``SUBSET`` of a group's rows with the smallest distances; of the two results
the one with the smaller determinant is taken. Steps go on until no group's
determinant falls any further. A step is one aggregate: rows are summed by
group and step of ln distance, and the subset is the run of lowest steps that
holds the share (so it may hold more, by the rows of its last step), and no
group's rows are ever sorted or gathered. The final estimate is that of the
subset, without reweighting. The vectors are
integers in units of 1/4096 and their sums exact, whatever the order of rows.

As in the regularised form of the estimator, a fixed variance (``FLOOR``) is
added to each component, since some are zero for nearly all texts, and a
group's moments are joined with ``PRIOR`` rows' worth of its language's
estimate, so that small groups are judged as their language is.

Scale: the texts are read once, without a shuffle. What follows works on a
table of twelve numbers a document; a hot group costs each task one row for
each step of distance. Estimates meet the rows by a join on the group whose
two sides are dealt out, so that Spark can split a hot one.

Defined results: a null or empty text has no words and fails the base rules;
null languages and sources are groups like others; a group without a text that
passes has no estimate and needs none; repeated rows count each.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strike_analytics.llm.common import free_names, read_table, written

#: White space, symbols, and the base rules' limits.
SPACE = r"[\x20\x09-\x0D]+"
NO_SYMBOL = r"[^#*$%&|<>]+"
RUN, LEAST_WORDS, REPEATED_PERCENT = 5, 10, 20

UNIT = 4096
P = 5
#: Variances added to the components; the share that a subset keeps; rows'
#: worth of the language's estimate; steps of distance a unit of its logarithm.
FLOOR = (0.05, 0.01, 0.04, 0.0225, 0.0064)
SUBSET, PRIOR, FINE = 0.6, 50, 16
#: A determinant has settled when a step lowers its logarithm by no more.
SETTLED = 1e-3
PAIRS = [(i, j) for i in range(P) for j in range(i, P)]


def text_counts(docs: DataFrame, carry: list[str]) -> DataFrame:
    """``carry``, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed (and n_lines)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    text_, words_, lines_, windows_, placed_ = free_names(docs.select(*carry), "text", "words", "lines", "windows", "placed")
    df = docs.select(*carry, text.alias(text_))
    df = df.select(
        *carry,
        F.filter(F.split(text_, SPACE), lambda w: w != "").alias(words_),
        F.filter(F.split(text_, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias(lines_),
        F.char_length(F.regexp_replace(text_, SPACE, "")).alias("word_chars"),
        F.char_length(F.regexp_replace(text_, NO_SYMBOL, "")).alias("n_symbols"))
    windows = F.transform(F.sequence(F.lit(0), F.size(words_) - RUN),
                          lambda i: F.xxhash64(*[F.get(words_, i + k) for k in range(RUN)]))
    df = df.select(*carry, F.size(words_).alias("n_words"), "word_chars", "n_symbols",
                   F.size(lines_).alias("n_lines"),
                   (F.size(lines_) - F.size(F.array_distinct(lines_))).alias("n_dup_lines"),
                   F.when(F.size(words_) >= RUN, windows).otherwise(F.array().cast("array<bigint>")).alias(windows_))
    # Most texts repeat no window; the places are only sorted for the others.
    placed = F.sort_array(F.transform(windows_, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    df = df.withColumn(placed_, F.when(F.size(F.array_distinct(windows_)) < F.size(windows_), placed))
    same = lambda x, k: F.coalesce(F.get(placed_, k)["h"] == x["h"], F.lit(False))
    again = F.filter(placed_, lambda x, k: same(x, k - 1) | same(x, k + 1))
    starts = F.sort_array(F.transform(again, lambda x: x["i"]))
    covered = F.aggregate(starts, F.struct(F.lit(-RUN).alias("last"), F.lit(0).alias("n")), lambda s, i: F.struct(
        i.alias("last"), (s["n"] + F.least(F.lit(RUN), i - s["last"])).alias("n")), lambda s: s["n"])
    df = df.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)))
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return df.select(*carry, *[F.col(c).cast("long").alias(c) for c in counts], F.col("n_lines").cast("long").alias("n_lines")) \
        .withColumn("base_failed", (F.col("n_words") < LEAST_WORDS)
                    | (100 * F.col("n_repeat_words") > REPEATED_PERCENT * F.col("n_words")))


def statistics() -> list[Column]:
    """The vector, in units of 1/UNIT."""
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    lines = F.greatest(F.col("n_lines"), F.lit(1))
    values = [F.log(n), F.log(F.greatest(F.col("word_chars"), F.lit(1)) / n), F.log1p(20 * F.col("n_symbols") / n),
              F.col("n_dup_lines") / lines, F.col("n_repeat_words") / n]
    return [F.round(v * UNIT).cast("long").alias(f"q{i}") for i, v in enumerate(values)]


def chi2_cdf(x: float, df: int) -> float:
    term = total = (x / 2) ** (df / 2) * math.exp(-x / 2) / math.gamma(df / 2 + 1)
    k = 1
    while term > 1e-17 * total:
        term *= x / (df + 2 * k)
        total += term
        k += 1
    return total


def chi2_quantile(p: float, df: int) -> float:
    low, high = 0.0, 400.0
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if chi2_cdf(mid, df) < p else (low, mid)
    return low


def moments() -> list[Column]:
    sums = [F.sum(f"q{i}").alias(f"s{i}") for i in range(P)]
    return [F.count("*").alias("n"), *sums, *[F.sum(F.col(f"q{i}") * F.col(f"q{j}")).alias(f"s{i}{j}") for i, j in PAIRS]]


def estimates(sums: DataFrame, keys: list[str], prior: DataFrame | None, factor: float) -> DataFrame:
    """From moments: means m*, covariances c*, and the inverse w* and log
    determinant of the regularised covariance. ``prior`` has m* and c* by the key "outer"."""
    means = {f"m{i}": F.col(f"s{i}") / F.col("n") / UNIT for i in range(P)}
    df = sums.withColumns(means)
    df = df.withColumns({f"c{i}{j}": F.lit(factor) * (F.col(f"s{i}{j}") / F.col("n") / (UNIT * UNIT)
                                                      - F.col(f"m{i}") * F.col(f"m{j}")) for i, j in PAIRS})
    if prior is not None:
        outer = prior.select("outer", *[F.col(f"m{i}").alias(f"pm{i}") for i in range(P)],
                             *[F.col(f"c{i}{j}").alias(f"pc{i}{j}") for i, j in PAIRS])
        share = F.lit(float(PRIOR)) / (F.col("n") + PRIOR)
        df = df.join(outer, "outer").withColumn("share", share)
        mixed = {f"c{i}{j}": (1 - F.col("share")) * F.col(f"c{i}{j}") + F.col("share") * F.col(f"pc{i}{j}")
                 + F.col("share") * (1 - F.col("share")) * (F.col(f"m{i}") - F.col(f"pm{i}")) * (F.col(f"m{j}") - F.col(f"pm{j}"))
                 for i, j in PAIRS}
        df = df.withColumns(mixed).withColumns({f"m{i}": (1 - F.col("share")) * F.col(f"m{i}") + F.col("share") * F.col(f"pm{i}")
                                                for i in range(P)})
    return inverted(df, keys)


def inverted(df: DataFrame, keys: list[str]) -> DataFrame:
    """``df`` (m*, c*) with w* and logdet, by Gauss-Jordan elimination on c* plus FLOOR.

    The matrix is one array and a pivot one step of a fold: as named columns,
    the entries of all pivots are more code than a generated method may have."""
    matrix = F.array(*[F.col(f"c{min(i, j)}{max(i, j)}") + (FLOOR[i] if i == j else 0.0) for i in range(P) for j in range(P)])

    def pivot(state: Column, k: Column) -> Column:
        a = lambda i, j: F.get(state["a"], i * P + j)

        def entry(x: Column, at: Column) -> Column:
            i, j = F.floor(at / P).cast("int"), at % P
            return (F.when((i == k) & (j == k), 1 / x).when(i == k, x / a(k, k)).when(j == k, -x / a(k, k))
                    .otherwise(x - a(i, k) * a(k, j) / a(k, k)))

        return F.struct((state["logdet"] + F.log(a(k, k))).alias("logdet"), F.transform(state["a"], entry).alias("a"))

    solved = F.aggregate(F.array(*map(F.lit, range(P))), F.struct(F.lit(0.0).alias("logdet"), matrix.alias("a")), pivot)
    df = df.withColumn("solved", solved)
    return df.select(*keys, F.col("solved.logdet").alias("logdet"), *[f"m{i}" for i in range(P)], *[f"c{i}{j}" for i, j in PAIRS],
                     *[F.get("solved.a", F.lit(i * P + j)).alias(f"w{i}{j}") for i, j in PAIRS])


def distance() -> Column:
    """The squared Mahalanobis distance of q* by m* and w*."""
    e = [F.col(f"q{i}") / UNIT - F.col(f"m{i}") for i in range(P)]
    return sum(((1 if i == j else 2) * F.col(f"w{i}{j}") * e[i] * e[j] for i, j in PAIRS), F.lit(0.0))


def mcd(vectors: DataFrame, group: str, outer: str | None, prior: DataFrame | None, steps: int | None, name: str) -> DataFrame:
    """(group, m*, c*, w*) of the regularised MCD estimate for every value of
    ``group``; after ``steps`` steps, or else when each determinant has settled."""
    alpha = chi2_quantile(SUBSET, P)
    factor = SUBSET / chi2_cdf(alpha, P + 2)  # makes the subset's covariance consistent for normal data
    rows = vectors.select(F.col(group).alias("group"), F.col(outer or group).alias("outer"), *[f"q{i}" for i in range(P)])
    keys = ["group", "outer", "start"]
    first = written(rows.groupBy("group", "outer").agg(*moments(), *[
        F.array(*[F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY q{i})") for p in (0.25, 0.5, 0.75)]).alias(f"u{i}")
        for i in range(P)]), name)  # exact: of few different values
    everything = estimates(first.withColumn("start", F.lit(0)), keys, prior, 1.0)
    spread = {f"c{i}{j}": F.pow((F.get(f"u{i}", F.lit(2)) - F.get(f"u{i}", F.lit(0))) / UNIT / 1.349, 2) if i == j else F.lit(0.0)
              for i, j in PAIRS}
    middle = inverted(first.withColumn("start", F.lit(1)).withColumns({f"m{i}": F.get(f"u{i}", F.lit(1)) / UNIT for i in range(P)})
                      .withColumns(spread), keys)
    state = written(everything.unionByName(middle).withColumn("open", F.lit(True)), name)
    low = Window.partitionBy("group", "outer", "start").orderBy("at")
    done = 0
    while done < steps if steps is not None else not done or state.where("open").limit(1).count():
        # Written: partial counts meet by (group, start, step) before the steps of a group do.
        near = written(rows.join(state.where("open").drop("outer", "open"), "group")
                       .withColumn("at", F.floor(F.log(F.greatest(distance(), F.lit(1e-6))) * FINE).cast("int"))
                       .groupBy(*keys, "at").agg(*moments()), name)
        subset = (near.withColumn("before", F.sum("n").over(low) - F.col("n"))
                  .withColumn("all", F.sum("n").over(Window.partitionBy(*keys)))
                  .where(F.col("before") < F.ceil(SUBSET * F.col("all"))))
        sums = subset.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in near.columns if c not in (*keys, "at")])
        moved = estimates(sums, keys, prior, factor)
        if steps is not None or not done:  # what came before the first step is no estimate of a subset yet
            state = written(moved.withColumn("open", F.lit(True)), name)
        else:
            # A step that lowers the determinant no further is the last one; the better estimate stays.
            old = state.select("group", "start", F.col("logdet").alias("old"))
            better = moved.join(old, ["group", "start"]).where(F.col("logdet") < F.col("old") - SETTLED).drop("old").select(*moved.columns)
            stay = state.join(better.select("group", "start"), ["group", "start"], "left_anti").select(*moved.columns)
            state = written(better.withColumn("open", F.lit(True)).unionByName(stay.withColumn("open", F.lit(False))), name)
        done += 1
    state = state.drop("open")
    best = Window.partitionBy("group").orderBy("logdet", "start")
    return written(state.withColumn("rank", F.row_number().over(best)).where("rank = 1").drop("rank", "start"), name)


def key(*columns: str) -> Column:
    """One string for the values; null differs from any text."""
    parts = [F.coalesce(F.concat(F.lit("+"), F.regexp_replace(F.col(c).cast("string"), "\0", "\0\0")), F.lit("-")) for c in columns]
    return F.concat_ws("\0,", *parts)


def judge(docs: DataFrame, tail: float = 1e-5) -> DataFrame:
    """For each row of ``docs`` (doc_id, text, lang, source): doc_id, the counts,
    base_failed, distance (squared; null if base_failed) and kept: not failed,
    and the distance within the chi-squared quantile at 1 - ``tail``."""
    counts = text_counts(docs, ["doc_id", "lang", "source"])
    table = written(counts.select("*", key("lang").alias("by_lang"), key("lang", "source").alias("by_both"), *statistics())
                    .drop("lang", "source"), "quality-rows")
    passed = table.where(~F.col("base_failed"))
    outer = mcd(passed, "by_lang", None, None, None, "quality-lang")
    inner = mcd(passed, "by_both", "by_lang", outer, None, "quality-both")
    limit = chi2_quantile(1 - tail, P)
    found = table.join(inner.withColumnRenamed("group", "by_both").drop("outer"), "by_both", "left")
    return (found.withColumn("distance", F.when(~F.col("base_failed"), distance()))
            .withColumn("kept", F.coalesce(F.col("distance") <= limit, F.lit(False)))
            .select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
                    "distance"))


def op2_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's counts and verdict."""
    return judge(read_table(spark, sf_dir, "documents"))
