"""Order, limit, top-k and distinct."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame


def order(df: DataFrame, *keys: Column | str) -> DataFrame:
    """Total order; nulls first ascending and last descending. Give a tiebreaker: Spark's sort isn't stable."""
    return df.orderBy(*keys)


def top_k(df: DataFrame, k: int, *keys: Column | str) -> DataFrame:
    """First k rows of an order: a per-task top-k and one merge, not a full sort."""
    return df.orderBy(*keys).limit(k)


def page(df: DataFrame, limit: int, offset: int, *keys: Column | str) -> DataFrame:
    return df.orderBy(*keys).offset(offset).limit(limit)


def distinct(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    return (df.select(*columns) if columns else df).distinct()
