"""Projection, star expansion and renaming."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame


def project(df: DataFrame, **columns: Column | str) -> DataFrame:
    """Named output columns, in order."""
    return df.select(*((df[c] if isinstance(c, str) else c).alias(name) for name, c in columns.items()))


def project_all(df: DataFrame) -> DataFrame:
    return df.select("*")


def qualify(df: DataFrame, alias: str) -> DataFrame:
    """The relation under another name, so that its columns can be told from another use of it."""
    return df.alias(alias)
