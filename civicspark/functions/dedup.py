"""Keeping one row of those with the same key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latest(df: DataFrame, keys: list[str], at: str) -> DataFrame:
    """Of the rows with the same keys the one with the largest ``at``; nulls come first.

    Ties are broken by the other columns, so the result doesn't depend on row
    order.  The choice is made by an aggregate, which combines before the
    shuffle.
    """
    rest = [c for c in df.columns if c not in keys]
    best = F.max(F.struct(F.col(at).alias("__at"), *[F.col(c).alias(c) for c in rest])).alias("__best")
    return df.groupBy(*keys).agg(best).select(*keys, *[F.col(f"__best.{c}").alias(c) for c in rest]).select(*df.columns)
