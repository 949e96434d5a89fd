"""Filters and predicates with three-valued logic."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def where(df: DataFrame, *conditions: Column) -> DataFrame:
    """Rows for which all conditions hold; unknown counts as false."""
    for c in conditions:
        df = df.filter(c)
    return df


def between(c: Column, low, high, negated: bool = False) -> Column:
    out = (c >= low) & (c <= high)
    return ~out if negated else out


def in_list(c: Column, values: Sequence) -> Column:
    """Unknown if nothing matches and the list has a null."""
    return c.isin(*values)


def not_in_list(c: Column, values: Sequence) -> Column:
    return ~c.isin(*values)


def is_null(c: Column, negated: bool = False) -> Column:
    return c.isNotNull() if negated else c.isNull()


def bloom_semi(df: DataFrame, keys: DataFrame, column: str) -> DataFrame:
    """Rows whose key occurs in ``keys``; a semi join that Spark may turn into a runtime filter of the scan."""
    return df.join(keys.select(column).distinct(), column, "left_semi")


def case(*branches: tuple[Column, Column], otherwise: Column | None = None) -> Column:
    """Searched CASE."""
    out = F.when(*branches[0])
    for condition, value in branches[1:]:
        out = out.when(condition, value)
    return out if otherwise is None else out.otherwise(otherwise)
