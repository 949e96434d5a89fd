"""Session settings the engine expects."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.cbo.enabled": "true",
    "spark.sql.cbo.joinReorder.enabled": "true",
    "spark.sql.optimizer.runtime.bloomFilter.enabled": "true",
}


def session(master: str | None = None, partitions: int | None = None, **more: str) -> SparkSession:
    """A session with SETTINGS; partitions: the initial shuffle partitions, which AQE merges as data allow."""
    builder = SparkSession.builder.appName("lakeplan")
    if master:
        builder = builder.master(master)
    conf = SETTINGS | ({"spark.sql.shuffle.partitions": str(partitions)} if partitions else {}) | more
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
