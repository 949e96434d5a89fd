"""ANALYZE: table statistics as DataFrames."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKETS = 16
TOP = 5
NEAR = 2e-4  # twice the rank error of a sketched quantile


def table_stats(df: DataFrame, buckets: int = BUCKETS, k: int = TOP) -> dict:
    """What ANALYZE keeps: rows, and of each column its nulls, distinct values, least and greatest values, equi-depth bounds and most common values.

    One scan for all columns but the common values, which take an aggregate each.
    """
    facts = {r.column_name: r.asDict() for r in column_stats(df).collect()}
    ordered = [c for c, t in df.dtypes if t in ("tinyint", "smallint", "int", "bigint", "float", "double", "date") or t.startswith("decimal")]
    number = lambda c: F.unix_date(f"`{c}`") if dict(df.dtypes)[c] == "date" else F.col(f"`{c}`")
    bounds = df.agg(*(F.percentile_approx(number(c).cast("double"), [(i + 1) / buckets for i in range(buckets)], 10_000).alias(f"b{i}") for i, c in enumerate(ordered))).first() if ordered else []
    columns = {}
    for c in df.columns:
        f = facts[c]
        columns[c] = {x: f[x] for x in ("null_count", "distinct_count", "min_value", "max_value")}
        columns[c]["histogram"] = list(bounds[ordered.index(c)] or []) if c in ordered else []
        columns[c]["most_common"] = [[r.value, r.frequency] for r in most_common(df, c, k).collect()]
    return {"rows": next((f["row_count"] for f in facts.values()), 0), "columns": columns}


def share_below(stats: dict, column: str, value: float) -> float:
    """Estimated share of the table's rows whose column is below the value, from the kept bounds."""
    c, rows = stats["columns"][column], stats["rows"]
    if not rows or not c["histogram"]:
        return 0.0
    return (rows - c["null_count"]) / rows * sum(b < value for b in c["histogram"]) / len(c["histogram"])


def share_equal(stats: dict, column: str, value) -> float:
    """Estimated share of rows that have the value: known if it is common, else spread evenly over the other distinct values."""
    c, rows = stats["columns"][column], stats["rows"]
    common = dict(map(tuple, c["most_common"]))
    if str(value) in common:
        return common[str(value)] / rows
    rest = rows - c["null_count"] - sum(common.values())
    return max(rest, 0) / max(c["distinct_count"] - len(common), 1) / rows if rows else 0.0


def column_stats(df: DataFrame, exact: bool = False) -> DataFrame:
    """column_name, row_count, null_count, distinct_count, min_value, max_value of each column, in one scan.

    distinct_count is a sketch within two per cent unless exact; exact counts
    cost an exchange for each column.
    """
    count = F.count_distinct if exact else lambda c: F.approx_count_distinct(c, 0.02)
    parts = [F.struct(F.lit(c).alias("column_name"), F.count("*").alias("row_count"), F.count(F.when(F.col(f"`{c}`").isNull(), 1)).alias("null_count"), count(F.col(f"`{c}`")).cast("long").alias("distinct_count"), F.min(f"`{c}`").cast("string").alias("min_value"), F.max(f"`{c}`").cast("string").alias("max_value")).alias(f"s{i}") for i, c in enumerate(df.columns)]
    return df.agg(*parts).select(F.inline(F.array(*(f"s{i}" for i in range(len(parts))))))


def histogram(df: DataFrame, column: str, buckets: int = BUCKETS) -> DataFrame:
    """Upper bounds of equi-depth buckets of a numeric or date column: bucket, upper.

    Exact: bucket b ends at the least value that, with all lower ones, makes up
    (b + 1) / buckets of the values. Sketched quantiles either side of each
    bound only cut the values into ranges. These are counted, and of the ranges
    that hold a bound the values are grouped and ranked. NaN is the greatest.
    Three scans, the first two when called.
    """
    c = F.col(f"`{column}`")
    if dict(df.dtypes)[column] == "date":
        c = F.unix_date(c)
    rows = df.select(c.cast("double").alias("v")).filter("v IS NOT NULL")
    shares = [min(max((i + 1) / buckets + e, 0.0), 1.0) for i in range(buckets) for e in (-NEAR, NEAR)]
    cuts = sorted({x for x in rows.agg(F.percentile_approx("v", shares, 10_000)).first()[0] or [] if x == x})
    rows = rows.select("v", _place(F.col("v"), cuts).alias("range"))
    counts = dict(rows.groupBy("range").count().collect())
    total, seen, before = sum(counts.values()), 0, {}
    for r in sorted(counts):
        if seen * buckets // total < (seen + counts[r]) * buckets // total:
            before[r] = seen
        seen += counts[r]
    start = F.create_map(*(F.lit(x) for r in (before or {0: 0}).items() for x in r))
    upto = F.sum("n").over(Window.partitionBy("range").orderBy("v")) + start[F.col("range")]
    ranked = rows.filter(F.col("range").isin(*before)).groupBy("range", "v").agg(F.count("*").alias("n")).select("v", "n", upto.alias("upto"))
    ends = ranked.selectExpr("v", f"CAST((upto - n) * {buckets} DIV {max(total, 1)} AS INT) AS lo", f"CAST(upto * {buckets} DIV {max(total, 1)} AS INT) AS hi").filter("lo < hi")
    return ends.select(F.explode(F.sequence("lo", F.col("hi") - 1)).alias("bucket"), F.col("v").alias("upper")).orderBy("bucket")


def _place(v: Column, cuts: list[float], first: int = 0) -> Column:
    """Number of the range a value lies in: even between two cuts, odd on one."""
    if not cuts:
        return F.lit(2 * first)
    m = len(cuts) // 2
    return F.when(v < cuts[m], _place(v, cuts[:m], first)).when(v == cuts[m], 2 * (first + m) + 1).otherwise(_place(v, cuts[m + 1 :], first + m + 1))


def most_common(df: DataFrame, column: str, k: int = TOP) -> DataFrame:
    """value, frequency of the k most frequent values; ties by value."""
    return df.groupBy(F.col(f"`{column}`").cast("string").alias("value")).agg(F.count("*").alias("frequency")).filter("value is not null").orderBy(F.desc("frequency"), "value").limit(k)


def extremes(df: DataFrame, column: str, k: int = TOP) -> DataFrame:
    """The k lowest and k highest distinct values: side, value."""
    d = df.select(F.col(f"`{column}`").alias("v")).dropna().distinct()
    pick = lambda side, order: d.orderBy(order).limit(k).select(F.lit(side).alias("side"), F.col("v").cast("string").alias("value"))
    return pick("low", F.asc("v")).union(pick("high", F.desc("v")))


def selectivity(df: DataFrame, *conditions) -> DataFrame:
    """Share of rows that meet all the conditions: selectivity."""
    both = reduce(lambda a, b: a & b, conditions)
    return df.agg(F.try_divide(F.count(F.when(both, 1)), F.count("*")).alias("selectivity"))
