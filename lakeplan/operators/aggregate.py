"""Grouped and global aggregation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def aggregate(df: DataFrame, by: Sequence[Column | str], having: Column | None = None, **aggregates: Column) -> DataFrame:
    """GROUP BY any expressions, with HAVING on the results; nulls form a group of their own."""
    out = df.groupBy(*by).agg(*(a.alias(n) for n, a in aggregates.items()))
    return out if having is None else out.filter(having)


def global_aggregate(df: DataFrame, having: Column | None = None, **aggregates: Column) -> DataFrame:
    """One row, also for no input: counts are 0 and the others null."""
    out = df.agg(*(a.alias(n) for n, a in aggregates.items()))
    return out if having is None else out.filter(having)


def distinct_aggregate(name: str, column: str) -> Column:
    """COUNT, SUM, AVG, MIN or MAX over distinct values."""
    if name not in ("count", "sum", "avg", "min", "max"):
        raise ValueError(f"no such aggregate: {name}")
    return F.expr(f"{name}(DISTINCT `{column}`)")
