"""Joins. Strategies are left to the planner and AQE; hints exist for callers who know better."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame

HINTS = ("broadcast", "shuffle_hash", "merge", "shuffle_replicate_nl")

#: Rows of a block in ``block_join``, and the most blocks of a side, beyond which blocks grow.
BLOCK_ROWS, MOST_BLOCKS = 4096, 100


def _on(left: DataFrame, right: DataFrame, pairs: Sequence[tuple[str, str]], residual: Column | None) -> Column:
    out = [left[a] == right[b] for a, b in pairs]
    return reduce(lambda x, y: x & y, [*out, residual] if residual is not None else out)


def _hinted(df: DataFrame, hint: str | None) -> DataFrame:
    if hint and hint not in HINTS:
        raise ValueError(f"unknown join hint: {hint}")
    return df.hint(hint) if hint else df


def equi_join(left: DataFrame, right: DataFrame, pairs: Sequence[tuple[str, str]], residual: Column | None = None, hint: str | None = None) -> DataFrame:
    """Inner join on key pairs, with a further condition if given; null keys never match."""
    return left.join(_hinted(right, hint), _on(left, right, pairs, residual), "inner")


def left_join(left: DataFrame, right: DataFrame, pairs: Sequence[tuple[str, str]], residual: Column | None = None, hint: str | None = None) -> DataFrame:
    """Left outer join; the residual belongs to ON, so rows that fail it are null-extended."""
    return left.join(_hinted(right, hint), _on(left, right, pairs, residual), "left")


def theta_join(left: DataFrame, right: DataFrame, condition: Column, how: str = "inner") -> DataFrame:
    """Join on any condition; without an equality Spark compares all pairs, so keep one side small or use ``block_join``."""
    return left.join(right, condition, how)


def block_join(left: DataFrame, right: DataFrame, condition: Column, rows: int = BLOCK_ROWS) -> DataFrame:
    """Inner join of two large sides on a condition without any equality: all pairs are compared, block by block.

    Each side is counted and dealt out evenly into blocks of about that many rows; every
    block meets every block of the other side in an equi join on the two block numbers.
    There are as many tasks as pairs of blocks, whatever the number of files, and a task
    holds the right rows of a few pairs. A side is shuffled MOST_BLOCKS times at most.
    """
    from pyspark.sql import functions as F

    n, m = (min(max(1, -(-df.count() // rows)), MOST_BLOCKS) for df in (left, right))
    numbers = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    # Spark sorts rows before it deals them out, so a task that is run again gives each row the same block.
    a = left.repartition(n).withColumn("__left", F.spark_partition_id()).withColumn("__right", numbers(m)).repartition(n * m, "__left", "__right")
    b = right.repartition(m).withColumn("__right_of", F.spark_partition_id()).withColumn("__left_of", numbers(n)).repartition(n * m, "__left_of", "__right_of")
    met = (F.col("__left") == F.col("__left_of")) & (F.col("__right") == F.col("__right_of"))
    return a.join(b.hint("shuffle_hash"), met & condition).drop("__left", "__right", "__left_of", "__right_of")


def cross(left: DataFrame, right: DataFrame) -> DataFrame:
    return left.crossJoin(right)


def semi(left: DataFrame, right: DataFrame, on: Column) -> DataFrame:
    """EXISTS and IN (subquery)."""
    return left.join(right, on, "left_semi")


def anti(left: DataFrame, right: DataFrame, on: Column) -> DataFrame:
    """NOT EXISTS: rows of null keys stay."""
    return left.join(right, on, "left_anti")


def null_aware_anti(left: DataFrame, right: DataFrame, column: str, other: str) -> DataFrame:
    """NOT IN (subquery): nothing qualifies if the subquery has a null, and null keys don't unless it is empty.

    Two aggregates of one row decide the null cases, so the join itself stays an
    equi join at any size instead of a nested loop over a broadcast side.
    """
    from pyspark.sql import functions as F

    facts = right.agg(F.count("*").alias("__n"), F.count(F.when(F.col(other).isNull(), 1)).alias("__nulls"))
    kept = left.join(right.select(F.col(other).alias("__key")).dropna().distinct(), left[column] == F.col("__key"), "left_anti")
    return kept.join(F.broadcast(facts), (F.col("__n") == 0) | ((F.col("__nulls") == 0) & F.col(column).isNotNull())).drop("__n", "__nulls")  # one row


def multiway(start: DataFrame, *steps: tuple[DataFrame, Sequence[tuple[str, str]]]) -> DataFrame:
    """Chain of inner equi joins; the optimiser may reorder them."""
    for right, pairs in steps:
        start = equi_join(start, right, pairs)
    return start
