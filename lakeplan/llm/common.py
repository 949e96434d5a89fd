"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import shared_dir

#: Bytes of text that a kernel works on at once; bounds a Python worker's memory at any document count, and keeps its arrays in the caches.
SLICE_BYTES = 512 << 10


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package where it isn't installed but its folder is visible to them."""
    spark.sparkContext.environment.setdefault("PYTHONPATH", str(Path(__file__).resolve().parents[2]))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_scratch: list[list[str]] = []


def written(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: lineage ends there and the rows survive lost executors.

    The table stays until ``discard`` or the end of the ``scratch`` block around it.
    """
    spark = df.sparkSession
    ship(spark)
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    if _scratch:
        _scratch[-1].append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def _remove(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def discard(*tables: DataFrame) -> None:
    """Remove written tables that nothing reads any more."""
    for t in tables:
        _remove(t.sparkSession, t.written_to)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Remove what operators wrote inside the block at its end; their results must be written or collected by then."""
    _scratch.append([])
    try:
        yield
    finally:
        for path in _scratch.pop():
            _remove(spark, path)


def plan_bytes(df: DataFrame) -> int | None:
    """Catalyst's size estimate of df (file sizes for scans); None where it has none."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return size if size < 1 << 55 else None


def buckets(df: DataFrame, bytes_each: int = 8 << 20) -> int:
    """Number of hash buckets for state made from df: grows with its size, never below the session's shuffle partitions."""
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = plan_bytes(df)
    return max(least, 1 if size is None else -(-size // bytes_each))


def slices(batch: pa.RecordBatch, text: str, most: int = SLICE_BYTES, rows: int = 65_000) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows with about ``most`` bytes of text; a longer text is a run of its own."""
    import numpy as np

    if not batch.num_rows:
        return
    import pyarrow.compute as pc

    size = np.cumsum(pc.fill_null(pc.binary_length(batch[text]), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        base = size[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(size, base + most, "right")))
        end = min(end, at + rows, batch.num_rows)
        yield batch.slice(at, end - at)
        at = end


def documents_only(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, text) of the rows that have an id; null text counts as empty. Other columns, whatever their names, are left out."""
    ship(docs.sparkSession)
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text")).filter("doc_id is not null")


#: Rows, and bytes of compressed Parquet, that a join may broadcast; beyond them, both sides are shuffled.
BROADCAST_IDS = 1_000_000
BROADCAST_BYTES = 16 << 20


def join_ids(docs: DataFrame, ids: DataFrame, how: str, key: Column) -> DataFrame:
    """left_semi or left_anti of docs and a written table ids (doc_id); only a counted, bounded table is broadcast.

    Null keys match nothing, so an anti join keeps them.
    """
    return docs.join(light(ids.select(F.struct("doc_id").alias("__ids"))), key == F.col("__ids.doc_id"), how)


def light(df: DataFrame, weight: Column | None = None) -> DataFrame:
    """A written table: broadcast in joins if its counted rows (and the sum of ``weight``, its rows' variable part) and its files are within BROADCAST_IDS and BROADCAST_BYTES."""
    size = plan_bytes(df)
    if size is None or size > BROADCAST_BYTES:
        return df
    most = df.agg(F.count("*") if weight is None else F.greatest(F.count("*"), F.coalesce(F.sum(weight), F.lit(0)))).first()[0]
    return F.broadcast(df) if most <= BROADCAST_IDS else df
