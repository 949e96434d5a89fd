"""Scans, literal rows and the one-row source."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession


def scan(spark: SparkSession, path: str, columns: Sequence[str] | None = None, where: Column | None = None) -> DataFrame:
    """Parquet scan; the filter and the columns reach the reader (PushedFilters, ReadSchema)."""
    df = spark.read.parquet(path)
    if where is not None:
        df = df.filter(where)
    return df.select(*columns) if columns else df


def constant(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """VALUES: literal rows of a declared schema, in one local relation."""
    return spark.createDataFrame(rows, schema)


def one_row(spark: SparkSession, *columns: Column) -> DataFrame:
    """SELECT without FROM."""
    return spark.range(1).select(*columns)
