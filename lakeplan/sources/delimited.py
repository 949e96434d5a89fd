"""Pipe-delimited .tbl files, whose lines end with a delimiter."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..types import schema as make_schema


def read_tbl(spark: SparkSession, path: str, columns: list[tuple[str, str]]) -> DataFrame:
    """Typed read of (name, SQL type) columns; a field that can't be read as its type is an error."""
    wanted = make_schema(columns)
    padded = T.StructType([*wanted.fields, T.StructField("__end", T.StringType())])
    return spark.read.csv(path, sep="|", schema=padded, mode="FAILFAST", enforceSchema=True).select(*(f"`{f.name}`" for f in wanted))
