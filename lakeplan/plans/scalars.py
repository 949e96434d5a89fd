"""Scalar expressions and functions."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import bit_and, bit_or, bit_xor, concat, concat_skip_nulls, date_shift, day_of, int_div, month_of, not_null_or, safe_div, safe_mod, substr, year_of
from ..operators.filters import case
from .registry import Tables, plan


@plan("SELECT l_orderkey, l_linenumber, l_quantity + l_tax AS plus, l_quantity - l_linenumber AS minus, l_linenumber * l_linenumber AS times, l_partkey * CAST(1.5 AS DOUBLE) AS mixed, l_partkey // 7 AS whole, CASE WHEN l_linenumber > 1 THEN l_quantity / (l_linenumber - 1) END AS ratio FROM lineitem")
def fn_arith(t: Tables) -> DataFrame:
    n = F.col("l_linenumber")
    return t.lineitem.select("l_orderkey", n, (F.col("l_quantity") + F.col("l_tax")).alias("plus"), (F.col("l_quantity") - n).alias("minus"), (n * n).alias("times"), (F.col("l_partkey") * 1.5).alias("mixed"), int_div("l_partkey", F.lit(7)).alias("whole"), safe_div("l_quantity", n - 1).alias("ratio"))


@plan("SELECT o_orderkey, (o_orderkey - 500) % 7 AS rest, CASE WHEN o_custkey % 5 > 0 THEN o_orderkey % (o_custkey % 5) END AS maybe, o_totalprice % 100 AS cents FROM orders")
def fn_mod(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", safe_mod(F.col("o_orderkey") - 500, F.lit(7)).alias("rest"), safe_mod("o_orderkey", F.col("o_custkey") % 5).alias("maybe"), safe_mod("o_totalprice", F.lit(100.0)).alias("cents"))


@plan("SELECT c_custkey, -c_acctbal AS debt, -(c_custkey + 1) AS below, NOT (c_acctbal > 0) AS owes FROM customer")
def fn_unary(t: Tables) -> DataFrame:
    return t.customer.select("c_custkey", (-F.col("c_acctbal")).alias("debt"), (-(F.col("c_custkey") + 1)).alias("below"), (~(F.col("c_acctbal") > 0)).alias("owes"))


@plan("SELECT p_partkey, p_partkey & 12 AS a, p_partkey | 12 AS o, xor(p_partkey, 12) AS x FROM part")
def fn_bits(t: Tables) -> DataFrame:
    k = F.lit(12).cast("long")
    return t.part.select("p_partkey", bit_and("p_partkey", k).alias("a"), bit_or("p_partkey", k).alias("o"), bit_xor("p_partkey", k).alias("x"))


@plan("SELECT p_partkey, CASE WHEN p_size < 10 THEN 'small' WHEN p_size < 30 THEN 'middle' ELSE 'large' END AS class, CASE WHEN p_size > 45 THEN p_size END AS huge FROM part")
def fn_case(t: Tables) -> DataFrame:
    s = F.col("p_size")
    return t.part.select("p_partkey", case((s < 10, F.lit("small")), (s < 30, F.lit("middle")), otherwise=F.lit("large")).alias("class"), case((s > 45, s)).alias("huge"))


@plan("SELECT p_partkey, COALESCE(CASE WHEN p_size > 25 THEN p_name END, CASE WHEN p_size > 10 THEN p_brand END, 'none') AS label FROM part")
def fn_coalesce(t: Tables) -> DataFrame:
    s = F.col("p_size")
    return t.part.select("p_partkey", not_null_or(F.when(s > 25, F.col("p_name")), F.when(s > 10, F.col("p_brand")), F.lit("none")).alias("label"))


@plan("SELECT p_partkey, p_name || '/' || p_brand AS joined, p_name || CASE WHEN p_size > 25 THEN p_type END AS strict, concat(p_name, CASE WHEN p_size > 25 THEN p_type END) AS loose FROM part")
def fn_concat(t: Tables) -> DataFrame:
    maybe = F.when(F.col("p_size") > 25, F.col("p_type"))
    return t.part.select("p_partkey", concat("p_name", F.lit("/"), "p_brand").alias("joined"), concat("p_name", maybe).alias("strict"), concat_skip_nulls("p_name", maybe).alias("loose"))


@plan("SELECT p_partkey, substr(p_name, 1, 3) AS a, substr(p_name, 1, 2) AS zero, substr(p_name, 4) AS rest, substr(p_name, 500, 2) AS past, substr(p_name, greatest(p_size - 10, 1), p_size % 5) AS moved FROM part")
def fn_substr(t: Tables) -> DataFrame:
    s = F.col("p_size")
    return t.part.select("p_partkey", substr("p_name", 1, 3).alias("a"), substr("p_name", 0, 2).alias("zero"), substr("p_name", 4).alias("rest"), substr("p_name", 500, 2).alias("past"), substr("p_name", s - 10, s % 5).alias("moved"))


@plan("SELECT o_orderkey, CAST(EXTRACT(YEAR FROM o_orderdate) AS BIGINT) AS y, CAST(EXTRACT(MONTH FROM o_orderdate) AS BIGINT) AS m, CAST(EXTRACT(DAY FROM o_orderdate) AS BIGINT) AS d FROM orders")
def fn_extract(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", year_of("o_orderdate").alias("y"), month_of("o_orderdate").alias("m"), day_of("o_orderdate").alias("d"))


@plan("SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) + INTERVAL 3 DAY AS DATE) AS later, CAST(CAST(o_orderdate AS DATE) - INTERVAL 1 MONTH AS DATE) AS before, CAST(CAST(o_orderdate AS DATE) + INTERVAL 1 YEAR AS DATE) AS next_year, DATE '2024-02-29' AS leap FROM orders")
def fn_date_shift(t: Tables) -> DataFrame:
    d = "o_orderdate"
    return t.orders.select("o_orderkey", date_shift(d, 3, "day").alias("later"), date_shift(d, -1, "month").alias("before"), date_shift(d, 1, "year").alias("next_year"), date_shift(F.lit(date(2024, 1, 31)), 1, "month").alias("leap"))


@plan("SELECT c_custkey, CAST(42 AS BIGINT) AS i, CAST(1.25 AS DOUBLE) AS f, 'it''s' AS s, FALSE AS b, DATE '1999-12-31' AS d, CAST(NULL AS VARCHAR) AS nothing FROM customer")
def fn_literals(t: Tables) -> DataFrame:
    return t.customer.select("c_custkey", F.lit(42).cast("long").alias("i"), F.lit(1.25).alias("f"), F.lit("it's").alias("s"), F.lit(False).alias("b"), F.lit(date(1999, 12, 31)).alias("d"), F.lit(None).cast("string").alias("nothing"))


_NULLS = "FROM (VALUES (TRUE, NULL), (FALSE, NULL), (NULL, NULL), (TRUE, FALSE), (TRUE, TRUE)) v(a, b)"


@plan(f"SELECT a, b, a AND b AS both_, a OR b AS either, NOT b AS none, a <> b AS differ, a IS NULL AS lost {_NULLS}")
def fn_three_valued(t: Tables) -> DataFrame:
    from ..functions import xor
    from ..operators import constant

    df = constant(t.spark, [(True, None), (False, None), (None, None), (True, False), (True, True)], "a boolean, b boolean")
    a, b = F.col("a"), F.col("b")
    return df.select(a, b, (a & b).alias("both_"), (a | b).alias("either"), (~b).alias("none"), xor(a, b).alias("differ"), a.isNull().alias("lost"))
