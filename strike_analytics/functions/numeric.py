"""Numeric column helpers: Python-exact rounding and zero-guarded percentages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Below this a value rounds to 0 at 0..2 decimals, and above ``_BIG`` a double
# has no fractional digits; between the two the exact path below is safe in
# 64-bit integers (shift <= 61, mantissa * 100 < 2**62).
_TINY = 0.004
_BIG = 1e15


def py_round(d: Column, digits: int) -> Column:
    """Python's ``round(d, digits)`` (= ``format(d, '.Nf')``) for d >= 0, digits <= 2.

    Python rounds the exact binary value of the double half-to-even; Spark's
    ``round``/``bround`` round its shortest decimal text instead, which
    differs whenever that text ends in 5 at the cut. Here ``d`` is split as
    ``m / 2**sh`` with an integer ``m`` (a power-of-two scaling, so exact), and
    ``m * 10**digits / 2**sh`` is rounded with integer shifts.
    """
    if not 0 <= digits <= 2:
        raise ValueError("digits must be 0, 1 or 2")
    scale = 10 ** digits
    sh = (F.lit(53) - F.floor(F.log2(d))).cast("int")
    m = (d * F.pow(F.lit(2.0), sh)).cast("long")
    num = m * F.lit(scale)
    q = F.call_function("shiftright", num, sh)
    r = num - F.call_function("shiftleft", q, sh)
    half = F.call_function("shiftleft", F.lit(1).cast("long"), sh - 1)
    up = F.when(r > half, 1).when(r < half, 0).when(q % 2 == 1, 1).otherwise(0)
    exact = (q + up).cast("double") / F.lit(float(scale))
    return (F.when(d.isNull(), F.lit(None).cast("double"))
             .when(d < _TINY, F.lit(0.0))
             .when(d >= _BIG, d)
             .otherwise(exact))


def py_round_sql(expr: str, digits: int) -> str:
    """The same rounding as SQL text (DuckDB dialect), for oracle queries."""
    scale = 10 ** digits
    sh = f"(53 - CAST(floor(log2({expr})) AS INTEGER))"
    num = f"(CAST(({expr}) * pow(2.0, {sh}) AS BIGINT) * {scale})"
    q = f"({num} >> {sh})"
    r = f"({num} - ({q} << {sh}))"
    half = f"(CAST(1 AS BIGINT) << ({sh} - 1))"
    up = f"(CASE WHEN {r} > {half} THEN 1 WHEN {r} < {half} THEN 0 WHEN {q} % 2 = 1 THEN 1 ELSE 0 END)"
    return (f"(CASE WHEN ({expr}) IS NULL THEN NULL WHEN ({expr}) < {_TINY} THEN 0.0 "
            f"WHEN ({expr}) >= {_BIG:.0f} THEN ({expr}) "
            f"ELSE CAST({q} + {up} AS DOUBLE) / {float(scale)} END)")


def pct(num: Column, den: Column, digits: int) -> Column:
    """``round(num / den * 100, digits)`` as Python computes it; 0.0 when den is 0.

    The guard comes first because ANSI mode raises on division by zero.
    """
    ratio = num.cast("double") / den.cast("double") * F.lit(100.0)
    return F.when(F.coalesce(den, F.lit(0)) > 0, py_round(ratio, digits)).otherwise(F.lit(0.0))


def pct_sql(num: str, den: str, digits: int) -> str:
    ratio = f"(CAST({num} AS DOUBLE) / CAST({den} AS DOUBLE) * 100.0)"
    return f"(CASE WHEN coalesce({den}, 0) > 0 THEN {py_round_sql(ratio, digits)} ELSE 0.0 END)"
