"""EXPLAIN and EXPLAIN ANALYZE as rows."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame


def explain(df: DataFrame, mode: str = "formatted") -> DataFrame:
    """line_no, plan: the plan's text."""
    spark = df.sparkSession
    kind = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString(mode)
    text = df._jdf.queryExecution().explainString(kind)
    return spark.createDataFrame(list(enumerate(text.rstrip().split("\n"))), "line_no int, plan string")


def _walk(node, depth: int, out: list) -> None:
    name = node.nodeName()
    if name in ("AdaptiveSparkPlan",):
        return _walk(node.executedPlan(), depth, out)
    metrics = node.metrics()

    def value(key):
        got = metrics.get(key)
        return got.get().value() if got.isDefined() else None

    out.append((len(out), depth, name, value("numOutputRows"), value("spillSize"), value("dataSize")))
    if name.endswith("QueryStage"):
        return _walk(node.plan(), depth, out)
    children = node.children()
    for i in range(children.size()):
        _walk(children.apply(i), depth + 1, out)


def explain_analyze(df: DataFrame) -> DataFrame:
    """Run the query; step, depth, operator, rows, spill_bytes, data_bytes of each operator and the total time in row -1."""
    spark = df.sparkSession
    query = df._jdf.queryExecution()
    began = time.perf_counter()
    n = query.toRdd().count()
    took = time.perf_counter() - began
    rows: list = []
    _walk(query.executedPlan(), 0, rows)
    head = (-1, 0, f"total {took * 1000:.0f} ms", n, None, None)
    return spark.createDataFrame([head, *rows], "step int, depth int, operator string, rows long, spill_bytes long, data_bytes long")
