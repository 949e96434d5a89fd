"""Connected components of a pair table, and matches counted inside them, for near-duplicate joins."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, light, written

#: Edges (16 bytes each) that one task labels at once; more are labelled in rounds of joins.
ONE_TASK = 1_000_000


def _label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, label) of the (u, v) rows of one task."""
    parts = [(b["u"].to_numpy(), b["v"].to_numpy()) for b in batches if b.num_rows]
    if not parts:
        return
    nodes, at = np.unique(np.concatenate([x for p in zip(*parts) for x in p]), return_inverse=True)
    u, v = at.reshape(2, -1)
    label = np.arange(len(nodes))
    while True:
        low = label.copy()
        least = np.minimum(label[u], label[v])
        for x in (u, v, label[u], label[v]):  # a node's present label learns of the lower one too
            np.minimum.at(low, x, least)
        while (low != low[low]).any():
            low = low[low]
        if (low == label).all():
            break
        label = low
    yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[label])], names=["node", "label"])


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, label): every node that an edge names, and the lowest node of its component.

    Up to ONE_TASK edges are labelled by one task. Beyond, each round takes the
    lowest label among a node and its neighbours and then that label's own label,
    so the rounds needed grow with the logarithm of a chain's length; each round
    is a written table: lost executors cost no lineage.
    """
    one = written(edges.select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v")).filter("u != v").distinct(), "edges")
    if one.count() <= ONE_TASK:
        return written(one.coalesce(1).mapInArrow(_label, "node long, label long"), "labels")
    both = written(one.union(one.select("v", "u")), "edges")
    labels = written(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("node"), F.least("u", "m").alias("label")), "labels")
    while True:
        seen = both.join(labels, both.v == labels.node).groupBy("u").agg(F.min("label").alias("m"))
        low = labels.join(seen, labels.node == seen.u).select("node", F.col("label").alias("old"), F.least("label", "m").alias("label"))
        up = labels.select(F.col("node").alias("label"), F.col("label").alias("up"))
        new = written(low.join(up, "label", "left").select("node", "old", F.least("label", F.coalesce("up", "label")).alias("label")), "labels")
        discard(labels)
        labels = new
        if not labels.filter("label != old").limit(1).count():
            discard(one, both)
            return labels.select("node", "label")


def sorted_rows(rows: pa.Table, by: list[str]) -> pa.Table:
    """Rows by the columns, nulls first, in one chunk."""
    import pyarrow.compute as pc

    return rows.take(pc.sort_indices(rows, [(c, "ascending") for c in by], null_placement="at_start")).combine_chunks()


def runs(rows: pa.Table, by: list[str]) -> Iterator[tuple[int, int]]:
    """(from, to) of the runs of sorted rows that are equal in the columns."""
    if len(rows):
        new = np.ones(len(rows), bool)
        cols = [rows[c].to_numpy() for c in by]
        new[1:] = np.any([c[1:] != c[:-1] for c in cols], axis=0)
        first = np.flatnonzero(new)
        yield from zip(first.tolist(), np.append(first[1:], len(rows)).tolist())


def class_matches(items: DataFrame, members: DataFrame, similar: Callable[[pa.Table, tuple[int, int], tuple[int, int]], np.ndarray], block: int, block_bytes: int, rows_a_task: int) -> DataFrame:
    """(node, n): for each of the members (node, label, weight), the weights of the others of its label that match, summed.

    items are (node, bytes, ...) with what ``similar(rows, one, two)`` needs to tell
    which of the rows one[0]:one[1] match which of two[0]:two[1]. A label's items
    fall into blocks; each two of its blocks are compared in one task, so a label
    of any size is spread, and only counts leave the tasks.
    """
    sized = members.join(items.select("node", "bytes"), "node")
    blocks = sized.groupBy("label").agg(F.count("*").alias("k"), F.sum("bytes").alias("bytes")).filter("k > 1")
    blocks = written(blocks.select("label", F.greatest(F.ceil(F.col("k") / block), F.ceil(F.col("bytes") / block_bytes)).cast("int").alias("blocks"), "k"), "blocks")
    rows = blocks.agg(F.sum(F.col("k") * F.col("blocks"))).first()[0] or 0
    jobs = max(int(items.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-int(rows) // rows_a_task))
    placed = members.join(light(blocks.drop("k")), "label").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    placed = written(placed.select("node", "weight", "label", "blocks", "block"), "placed")
    met = items.drop("bytes").join(light(placed), "node").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = met.withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")}).drop("blocks", "other").withColumn("job", F.pmod(F.xxhash64("label", "i", "j"), F.lit(jobs)))

    def run(key, rows):
        rows, out = sorted_rows(rows, ["label", "i", "j", "block"]), []
        for i, j in runs(rows, ["label", "i", "j"]):
            sides = [(i + a, i + b) for a, b in runs(rows.slice(i, j - i), ["block"])]
            if len(sides) == 1 and rows["i"][i] != rows["j"][i]:
                continue  # the other block is empty
            hit = similar(rows, sides[0], sides[-1])
            if len(sides) == 1:
                np.fill_diagonal(hit, False)
            for (a, b), (c, d), h in ((sides[0], sides[-1], hit), (sides[-1], sides[0], hit.T))[: len(sides)]:
                out.append((rows["node"].slice(a, b - a).to_numpy(), h @ rows["weight"].slice(c, d - c).to_numpy()))
        node, n = (np.concatenate(c) for c in zip(*out)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        return pa.table([pa.array(node[n > 0]), pa.array(n[n > 0])], names=["node", "n"])

    return met.groupBy("job").applyInArrow(run, "node long, n long").groupBy("node").agg(F.sum("n").alias("n"))
