"""Named queries: a DataFrame function and, where there is one, the same query in standard SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """The Parquet tables of a folder as attributes."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


def plan(oracle: str | None = None):
    """Register a function of Tables under its own name."""

    def add(fn: Callable[[Tables], DataFrame]):
        QUERIES[fn.__name__] = lambda spark, folder: fn(Tables(spark, folder))
        if oracle:
            ORACLES[fn.__name__] = oracle
        return fn

    return add


def exact(expression: str, scale: int = 4) -> str:
    """SQL of ``functions.exact_sum``."""
    return f"CAST(SUM(CAST({expression} AS DECIMAL(18,{scale}))) AS DOUBLE)"
