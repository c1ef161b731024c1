"""Plan-shaping helpers.

``fence`` keeps Catalyst from inlining an expensive projection into later
filters. ``PushPredicateThroughNonJoin`` substitutes every alias a filter
references by its defining expression; above a multi-stage decode that copies
the whole decode chain into the filter once per reference (and evaluates it
again after the filter). A one-element ``inline`` is a Generate node: filters
on its output stay above it, so each decoded column is computed once per row.
It stays inside whole-stage codegen and adds no shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fence(df: DataFrame) -> DataFrame:
    return df.select(F.inline(F.array(F.struct(*[F.col(c) for c in df.columns]))))
