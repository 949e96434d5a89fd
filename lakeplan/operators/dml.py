"""Copy-on-write tables on Parquet: snapshot reads, atomic commits, no row store.

A version is a manifest that lists segment folders. A commit writes new segments
and then creates the next manifest under a name that must not exist yet, so a
reader keeps the version it opened. Where the file system's rename refuses a
target that exists (as HDFS does), two writers can't both succeed; on local disks
and object stores a table needs one writer at a time. An insert adds a segment;
update and delete rewrite only segments that hold matching rows; ``cluster``
sorts a table by columns, so that Parquet's statistics let reads skip files.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


class ConflictError(ValueError):
    """The table exists already, or another writer committed first."""


class VersionedStore:
    """A folder of versioned tables on any Hadoop file system."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def _write(self, path: str, text: str) -> None:
        """Create a file under a name that must be free, in one step for readers."""
        tmp = self._path(f"{path}.{uuid.uuid4().hex}")
        out = self._fs.create(tmp, True)
        out.write(bytearray(text.encode()))
        out.close()
        target = self._path(path)
        if self._fs.exists(target) or not self._fs.rename(tmp, target):
            self._fs.delete(tmp, False)
            raise ConflictError(f"another writer committed {path}")

    def _read(self, path: str) -> str:
        stream = self._fs.open(self._path(path))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def tables(self) -> list[str]:
        root = self._path(self.root)
        found = [s.getPath().getName() for s in self._fs.listStatus(root)] if self._fs.exists(root) else []
        return sorted(n for n in found if self.exists(n))

    def versions(self, name: str) -> list[int]:
        at = self._path(f"{self.root}/{name}/_versions")
        if not self._fs.exists(at):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(at)]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def exists(self, name: str) -> bool:
        return bool(self.versions(name))

    def create(self, name: str, schema: T.StructType) -> Table:
        if self.exists(name):
            raise ConflictError(f"table exists: {name}")
        self.commit(name, 0, schema, [])
        return Table(self, name)

    def drop(self, name: str) -> None:
        if not self.exists(name):
            raise KeyError(f"no such table: {name}")
        self._fs.delete(self._path(f"{self.root}/{name}"), True)

    def table(self, name: str) -> Table:
        if not self.exists(name):
            raise KeyError(f"no such table: {name}")
        return Table(self, name)

    def commit(self, name: str, version: int, schema: T.StructType, segments: list[str]) -> None:
        self._fs.mkdirs(self._path(f"{self.root}/{name}/_versions"))
        self._write(f"{self.root}/{name}/_versions/{version:08d}.json", json.dumps({"schema": schema.jsonValue(), "segments": segments}))

    def keep_stats(self, name: str, stats: dict) -> None:
        """Statistics of the present version; those of older versions stay with these."""
        path = f"{self.root}/{name}/_stats/{self.versions(name)[-1]:08d}.json"
        if self._fs.exists(self._path(path)):
            self._fs.delete(self._path(path), False)
        self._fs.mkdirs(self._path(f"{self.root}/{name}/_stats"))
        self._write(path, json.dumps(stats))

    def stats(self, name: str) -> dict | None:
        """Kept statistics of the present version."""
        path = f"{self.root}/{name}/_stats/{self.versions(name)[-1]:08d}.json"
        return json.loads(self._read(path)) if self._fs.exists(self._path(path)) else None

    def manifest(self, name: str, version: int) -> tuple[T.StructType, list[str]]:
        m = json.loads(self._read(f"{self.root}/{name}/_versions/{version:08d}.json"))
        return T.StructType.fromJson(m["schema"]), m["segments"]


class Table:
    """One table of a store."""

    def __init__(self, store: VersionedStore, name: str):
        self.store, self.name = store, name

    @property
    def version(self) -> int:
        return self.store.versions(self.name)[-1]

    @property
    def schema(self) -> T.StructType:
        return self.store.manifest(self.name, self.version)[0]

    def _open(self, schema: T.StructType, segments: list[str]) -> DataFrame:
        spark = self.store.spark
        if not segments:
            return spark.createDataFrame([], schema)
        return spark.read.schema(schema).parquet(*(f"{self.store.root}/{self.name}/{s}" for s in segments))

    def read(self, version: int | None = None) -> DataFrame:
        """The latest rows, or those of an older version."""
        return self._open(*self.store.manifest(self.name, self.version if version is None else version))

    def _segment(self, df: DataFrame) -> str:
        name = f"segment-{uuid.uuid4().hex}"
        df.write.parquet(f"{self.store.root}/{self.name}/{name}")
        return name

    def _affected(self, tag: str, n: int) -> DataFrame:
        return self.store.spark.createDataFrame([(tag, n)], "tag string, affected long")

    def insert(self, rows: DataFrame, columns: list[str] | None = None) -> DataFrame:
        """Append; with a column list the others become null. Values are cast to the table's types."""
        version = self.version
        schema, segments = self.store.manifest(self.name, version)
        columns = columns or schema.fieldNames()
        if len(columns) != len(rows.columns):
            raise ValueError(f"{len(columns)} columns, {len(rows.columns)} values")
        known = {f.name.lower() for f in schema}
        if len({c.lower() for c in columns}) < len(columns) or not {c.lower() for c in columns} <= known:
            raise ValueError(f"bad column list: {columns}")
        at = {c.lower(): i for i, c in enumerate(columns)}
        rows = rows.toDF(*(f"c{i}" for i in range(len(columns))))
        out = rows.select(*((F.col(f"c{at[f.name.lower()]}") if f.name.lower() in at else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema))
        segment = self._segment(out)
        n = self._open(schema, [segment]).count()
        self.store.commit(self.name, version + 1, schema, [*segments, segment])
        return self._affected("insert", n)

    def _rewrite(self, tag: str, where: Column | None, change) -> DataFrame:
        version = self.version
        schema, segments = self.store.manifest(self.name, version)
        hit = F.lit(True) if where is None else F.coalesce(where, F.lit(False))
        kept, total = [], 0
        if segments:
            rows = self._open(schema, segments)
            of = F.regexp_extract(F.input_file_name(), r"(segment-[0-9a-f]{32})", 1)
            counts = {r.s: r.n for r in rows.filter(hit).groupBy(of.alias("s")).agg(F.count("*").alias("n")).collect()}
            total = sum(counts.values())
            kept = [s for s in segments if s not in counts]
            touched = [s for s in segments if s in counts]
            if touched:
                kept.append(self._segment(change(self._open(schema, touched), hit, schema)))
        if total:
            self.store.commit(self.name, version + 1, schema, kept)
        return self._affected(tag, total)

    def update(self, values: dict[str, Column], where: Column | None = None) -> DataFrame:
        """SET expressions see the old row; rows for which ``where`` is unknown stay."""
        low = {k.lower(): v for k, v in values.items()}
        if missing := set(low) - {f.name.lower() for f in self.schema}:
            raise ValueError(f"no such column: {sorted(missing)}")
        return self._rewrite("update", where, lambda df, hit, schema: df.select(*((F.when(hit, low[f.name.lower()].cast(f.dataType)).otherwise(F.col(f"`{f.name}`")) if f.name.lower() in low else F.col(f"`{f.name}`")).alias(f.name) for f in schema)))

    def cluster(self, columns: list[str]) -> DataFrame:
        """Rewrite the rows in ranges of the columns, each sorted; what an index is for elsewhere."""
        known = {f.name.lower(): f.name for f in self.schema}
        if missing := [c for c in columns if c.lower() not in known]:
            raise ValueError(f"no such column: {missing}")
        version = self.version
        schema, segments = self.store.manifest(self.name, version)
        if segments:
            keys = [F.col(f"`{known[c.lower()]}`") for c in columns]
            segment = self._segment(self._open(schema, segments).repartitionByRange(*keys).sortWithinPartitions(*keys))
            self.store.commit(self.name, version + 1, schema, [segment])
        return self._affected("cluster", 0)

    def delete(self, where: Column | None = None) -> DataFrame:
        return self._rewrite("delete", where, lambda df, hit, schema: df.filter(~hit))
