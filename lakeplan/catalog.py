"""Named tables: folders of Parquet files and versioned tables, visible to SQL as views."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .operators.dml import Table, VersionedStore
from .stats import table_stats


class Catalog:
    """``data``: folder with <name>.parquet tables, read only; ``root``: folder of tables that statements may change."""

    def __init__(self, spark: SparkSession, root: str | None = None, data: str | None = None):
        self.spark, self.data = spark, data
        self.store = VersionedStore(spark, root) if root else None
        self._stats: dict[str, dict] = {}
        self.functions: dict[str, int] = {}

    def analyze(self, name: str) -> dict:
        """Compute and keep a table's statistics: beside a versioned table, in this catalog for a read-only one."""
        out = table_stats(self.read(name))
        if self.store and self.store.exists(name):
            self.store.keep_stats(name, out)
        else:
            self._stats[name] = out
        return out

    def stats(self, name: str) -> dict | None:
        """The statistics that the last ANALYZE kept, if the table has not changed since."""
        return self.store.stats(name) if self.store and self.store.exists(name) else self._stats.get(name)

    def register(self, name: str, fn: Callable, returns: str) -> None:
        """Make a function over Arrow arrays callable from SQL; ``functions`` lists names and numbers of arguments."""
        self.functions[name] = fn.__code__.co_argcount
        self.spark.udf.register(name, F.arrow_udf(fn, returns))

    def external(self) -> list[str]:
        return sorted(n[:-8] for n in os.listdir(self.data) if n.endswith(".parquet")) if self.data else []

    def tables(self) -> list[str]:
        return sorted({*self.external(), *(self.store.tables() if self.store else [])})

    def create(self, name: str, schema: T.StructType) -> Table:
        if not self.store:
            raise ValueError("this catalog has no folder for tables")
        if name in self.external():
            from .operators.dml import ConflictError

            raise ConflictError(f"table exists: {name}")
        return self.store.create(name, schema)

    def drop(self, name: str) -> None:
        if not self.store:
            raise KeyError(f"no such table: {name}")
        self.store.drop(name)
        self.spark.catalog.dropTempView(name)

    def table(self, name: str) -> Table:
        """A table that statements may change."""
        if not self.store:
            raise KeyError(f"no such table: {name}")
        return self.store.table(name)

    def read(self, name: str) -> DataFrame:
        if self.store and self.store.exists(name):
            return self.store.table(name).read()
        if name in self.external():
            return self.spark.read.parquet(f"{self.data}/{name}.parquet")
        raise KeyError(f"no such table: {name}")

    def publish(self, names=None) -> None:
        """Make the current version of tables visible to spark.sql."""
        for name in names if names is not None else self.tables():
            self.read(name).createOrReplaceTempView(name)
