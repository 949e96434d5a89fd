"""Scans, projections, filters, joins, subqueries, aggregates, order and distinct."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import date_shift, exact_avg, exact_sum, like, year_of
from ..operators import aggregate, anti, between, block_join, constant, cross, distinct, distinct_aggregate, equi_join, global_aggregate, in_list, is_null, left_join, multiway, not_in_list, null_aware_anti, one_row, order, page, project, project_all, qualify, scan, semi, theta_join, top_k, where
from .registry import Tables, exact, plan

# Scans and projections


@plan("SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) AS net FROM lineitem")
def scan_project(t: Tables) -> DataFrame:
    return project(t.lineitem, l_orderkey="l_orderkey", l_linenumber="l_linenumber", net=F.col("l_extendedprice") * (1 - F.col("l_discount")))


@plan("SELECT * FROM nation")
def scan_star(t: Tables) -> DataFrame:
    return project_all(t.nation)


@plan("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice >= 400000")
def scan_pushed(t: Tables) -> DataFrame:
    return scan(t.spark, f"{t.folder}/orders.parquet", ["o_orderkey", "o_totalprice"], F.col("o_totalprice") >= 400000)


@plan("SELECT o_orderkey, o_custkey FROM orders WHERE o_totalprice BETWEEN 100000 AND 200000 AND o_orderstatus = 'F'")
def scan_range(t: Tables) -> DataFrame:
    return where(t.orders, between(F.col("o_totalprice"), 100000, 200000), F.col("o_orderstatus") == "F").select("o_orderkey", "o_custkey")


@plan("SELECT l_orderkey, l_partkey, l_quantity FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size = 7)")
def scan_key_set(t: Tables) -> DataFrame:
    small = t.part.filter(F.col("p_size") == 7)
    return semi(t.lineitem.select("l_orderkey", "l_partkey", "l_quantity"), small, F.col("l_partkey") == F.col("p_partkey"))


@plan("SELECT CAST(k AS BIGINT) AS key, name, CAST(s AS DOUBLE) AS score FROM (VALUES (7, 'maple', 0.5), (4, 'birch', 8.25), (9, NULL, -3.0), (4, '', NULL)) v(k, name, s)")
def values_rows(t: Tables) -> DataFrame:
    return constant(t.spark, [(7, "maple", 0.5), (4, "birch", 8.25), (9, None, -3.0), (4, "", None)], "key long, name string, score double")


@plan("SELECT CAST(3 AS BIGINT) AS three, 'x' AS letter, CAST(NULL AS BIGINT) AS nothing, TRUE AS yes")
def select_no_from(t: Tables) -> DataFrame:
    return one_row(t.spark, (F.lit(1) + 2).cast("long").alias("three"), F.lit("x").alias("letter"), F.lit(None).cast("long").alias("nothing"), F.lit(True).alias("yes"))


@plan("SELECT o_custkey, n FROM (SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY o_custkey) d WHERE n > 10")
def derived_table(t: Tables) -> DataFrame:
    return aggregate(t.orders, ["o_custkey"], n=F.count("*")).filter(F.col("n") > 10)


@plan(f"WITH big AS (SELECT * FROM orders WHERE o_totalprice > 300000), per AS (SELECT o_custkey, COUNT(*) AS n, {exact('o_totalprice')} AS total FROM big GROUP BY 1) SELECT c_name, n, total FROM per JOIN customer ON c_custkey = o_custkey")
def cte(t: Tables) -> DataFrame:
    big = t.orders.filter(F.col("o_totalprice") > 300000)
    per = aggregate(big, ["o_custkey"], n=F.count("*"), total=exact_sum("o_totalprice"))
    return equi_join(per, t.customer, [("o_custkey", "c_custkey")]).select("c_name", "n", "total")


@plan(f"WITH y AS (SELECT CAST(YEAR(o_orderdate) AS BIGINT) AS year, {exact('o_totalprice')} AS total FROM orders GROUP BY 1) SELECT b.year, b.total - a.total AS growth FROM y a JOIN y b ON b.year = a.year + 1")
def cte_reused(t: Tables) -> DataFrame:
    y = aggregate(t.orders, [year_of("o_orderdate").alias("year")], total=exact_sum("o_totalprice"))
    a, b = qualify(y, "a"), qualify(y, "b")
    return theta_join(a, b, F.col("b.year") == F.col("a.year") + 1).select("b.year", (F.col("b.total") - F.col("a.total")).alias("growth"))


# Filters and predicates


@plan("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity >= 45 AND l_discount < 0.05 AND l_returnflag <> 'N' AND l_linenumber <= 3 AND l_tax > 0.01 AND l_linestatus = 'F'")
def filter_compare(t: Tables) -> DataFrame:
    return where(t.lineitem, F.col("l_quantity") >= 45, F.col("l_discount") < 0.05, F.col("l_returnflag") != "N", F.col("l_linenumber") <= 3, F.col("l_tax") > 0.01, F.col("l_linestatus") == "F").select("l_orderkey", "l_linenumber")


@plan("SELECT o_orderkey FROM orders WHERE NOT (o_orderstatus = 'F' OR o_totalprice < 100000) AND (o_orderpriority = '1-URGENT' OR o_totalprice > 400000)")
def filter_bool(t: Tables) -> DataFrame:
    return where(t.orders, ~((F.col("o_orderstatus") == "F") | (F.col("o_totalprice") < 100000)), (F.col("o_orderpriority") == "1-URGENT") | (F.col("o_totalprice") > 400000)).select("o_orderkey")


@plan("SELECT p_partkey, p_size FROM part WHERE p_size BETWEEN 10 AND 20 AND p_retailprice NOT BETWEEN 910 AND 950")
def filter_between(t: Tables) -> DataFrame:
    return where(t.part, between(F.col("p_size"), 10, 20), between(F.col("p_retailprice"), 910, 950, negated=True)).select("p_partkey", "p_size")


@plan("SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderpriority IN ('1-URGENT', '5-LOW')")
def filter_in(t: Tables) -> DataFrame:
    return where(t.orders, in_list(F.col("o_orderpriority"), ["1-URGENT", "5-LOW"])).select("o_orderkey", "o_orderpriority")


@plan("SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment NOT IN ('BUILDING', 'MACHINERY')")
def filter_not_in(t: Tables) -> DataFrame:
    return where(t.customer, not_in_list(F.col("c_mktsegment"), ["BUILDING", "MACHINERY"])).select("c_custkey", "c_mktsegment")


@plan("SELECT c_custkey, o_orderkey IS NULL AS idle FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 490000 WHERE o_orderkey IS NULL OR o_orderstatus IS NOT NULL")
def filter_null(t: Tables) -> DataFrame:
    rows = left_join(t.customer, t.orders.filter(F.col("o_totalprice") > 490000), [("c_custkey", "o_custkey")])
    return rows.filter(is_null(F.col("o_orderkey")) | is_null(F.col("o_orderstatus"), negated=True)).select("c_custkey", is_null(F.col("o_orderkey")).alias("idle"))


@plan("SELECT p_partkey, p_name FROM part WHERE p_name LIKE '%ring%' AND p_name LIKE '_e%'")
def filter_like(t: Tables) -> DataFrame:
    return where(t.part, like("p_name", "%ring%"), like("p_name", "_e%")).select("p_partkey", "p_name")


@plan("SELECT p_partkey, p_type FROM part WHERE p_type NOT LIKE 'PROMO%' AND p_name NOT LIKE '%t'")
def filter_not_like(t: Tables) -> DataFrame:
    return where(t.part, ~like("p_type", "PROMO%"), ~like("p_name", "%t")).select("p_partkey", "p_type")


@plan("SELECT o_orderkey, CAST(o_orderdate AS DATE) AS o_orderdate FROM orders WHERE o_orderdate >= DATE '1997-06-01' AND o_orderdate < DATE '1997-09-01'")
def filter_date_range(t: Tables) -> DataFrame:
    first = F.lit(date(1997, 6, 1))
    return where(t.orders, F.col("o_orderdate") >= first, F.col("o_orderdate") < date_shift(first, 3, "month")).select("o_orderkey", F.to_date("o_orderdate").alias("o_orderdate"))


@plan("SELECT c_custkey FROM customer WHERE (c_acctbal > 5000) <> (c_nationkey < 10)")
def filter_xor(t: Tables) -> DataFrame:
    from ..functions import xor

    return where(t.customer, xor(F.col("c_acctbal") > 5000, F.col("c_nationkey") < 10)).select("c_custkey")


@plan("SELECT n_nationkey FROM nation WHERE n_regionkey <> 0")
def filter_truthy(t: Tables) -> DataFrame:
    from ..functions import truthy

    return where(t.nation, truthy("n_regionkey", "int")).select("n_nationkey")


# Joins and subqueries


@plan("SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey")
def join_inner(t: Tables) -> DataFrame:
    return equi_join(t.orders, t.customer, [("o_custkey", "c_custkey")]).select("o_orderkey", "c_name")


@plan("SELECT a.l_orderkey, a.l_linenumber, b.m FROM lineitem a JOIN (SELECT l_orderkey, l_returnflag, MAX(l_quantity) AS m FROM lineitem GROUP BY ALL) b ON a.l_orderkey = b.l_orderkey AND a.l_returnflag = b.l_returnflag AND a.l_quantity = b.m")
def join_multi_key(t: Tables) -> DataFrame:
    most = t.lineitem.groupBy(F.col("l_orderkey").alias("k"), F.col("l_returnflag").alias("f")).agg(F.max("l_quantity").alias("m"))
    return equi_join(t.lineitem, most, [("l_orderkey", "k"), ("l_returnflag", "f"), ("l_quantity", "m")]).select("l_orderkey", "l_linenumber", "m")


@plan("SELECT o_orderkey, l_linenumber FROM orders JOIN lineitem ON o_orderkey = l_orderkey AND l_extendedprice > o_totalprice / 2")
def join_residual(t: Tables) -> DataFrame:
    return equi_join(t.orders, t.lineitem, [("o_orderkey", "l_orderkey")], F.col("l_extendedprice") > F.col("o_totalprice") / 2).select("o_orderkey", "l_linenumber")


@plan("SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey")
def join_left(t: Tables) -> DataFrame:
    return left_join(t.customer, t.orders, [("c_custkey", "o_custkey")]).select("c_custkey", "o_orderkey")


@plan("SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > c_acctbal * 45")
def join_left_on_filter(t: Tables) -> DataFrame:
    return left_join(t.customer, t.orders, [("c_custkey", "o_custkey")], F.col("o_totalprice") > F.col("c_acctbal") * 45).select("c_custkey", "o_orderkey")


@plan("SELECT a.s_suppkey AS low, b.s_suppkey AS high FROM supplier a JOIN supplier b ON a.s_acctbal < b.s_acctbal AND a.s_nationkey <> b.s_nationkey")
def join_theta(t: Tables) -> DataFrame:
    a, b = qualify(t.supplier, "a"), qualify(t.supplier, "b")
    return block_join(a, b, (F.col("a.s_acctbal") < F.col("b.s_acctbal")) & (F.col("a.s_nationkey") != F.col("b.s_nationkey"))).select(F.col("a.s_suppkey").alias("low"), F.col("b.s_suppkey").alias("high"))


@plan("SELECT r_name, n_name FROM region CROSS JOIN nation")
def join_cross(t: Tables) -> DataFrame:
    return cross(t.region, t.nation).select("r_name", "n_name")


@plan("SELECT a.n_name AS one, b.n_name AS two FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
def join_self(t: Tables) -> DataFrame:
    a, b = qualify(t.nation, "a"), qualify(t.nation, "b")
    return theta_join(a, b, (F.col("a.n_regionkey") == F.col("b.n_regionkey")) & (F.col("a.n_nationkey") < F.col("b.n_nationkey"))).select(F.col("a.n_name").alias("one"), F.col("b.n_name").alias("two"))


@plan("SELECT l_orderkey, l_linenumber, r_name FROM lineitem, orders, customer, nation, region WHERE l_orderkey = o_orderkey AND o_custkey = c_custkey AND c_nationkey = n_nationkey AND n_regionkey = r_regionkey")
def join_multiway(t: Tables) -> DataFrame:
    return multiway(t.lineitem, (t.orders, [("l_orderkey", "o_orderkey")]), (t.customer, [("o_custkey", "c_custkey")]), (t.nation, [("c_nationkey", "n_nationkey")]), (t.region, [("n_regionkey", "r_regionkey")])).select("l_orderkey", "l_linenumber", "r_name")


@plan("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')")
def semi_exists(t: Tables) -> DataFrame:
    return semi(t.customer, t.orders.filter(F.col("o_orderpriority") == "1-URGENT"), F.col("o_custkey") == F.col("c_custkey")).select("c_custkey")


@plan("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 250000)")
def anti_not_exists(t: Tables) -> DataFrame:
    return anti(t.customer, t.orders.filter(F.col("o_totalprice") > 250000), F.col("o_custkey") == F.col("c_custkey")).select("c_custkey")


@plan("SELECT o_orderkey FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING COUNT(*) > 7)")
def semi_in_subquery(t: Tables) -> DataFrame:
    many = aggregate(t.lineitem, ["l_orderkey"], having=F.col("n") > 7, n=F.count("*"))
    return semi(t.orders, many, F.col("o_orderkey") == F.col("l_orderkey")).select("o_orderkey")


@plan("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def anti_not_in(t: Tables) -> DataFrame:
    return null_aware_anti(t.customer, t.orders.filter(F.col("o_orderpriority") == "1-URGENT"), "c_custkey", "o_custkey").select("c_custkey")


@plan("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT CASE WHEN o_totalprice > 1100 THEN o_custkey END FROM orders)")
def anti_not_in_nulls(t: Tables) -> DataFrame:
    keys = t.orders.select(F.when(F.col("o_totalprice") > 1100, F.col("o_custkey")).alias("k"))
    return null_aware_anti(t.customer, keys, "c_custkey", "k").select("c_custkey")


@plan(f"SELECT c_custkey FROM customer WHERE c_acctbal > (SELECT {exact('c_acctbal')} / COUNT(*) FROM customer)")
def scalar_subquery(t: Tables) -> DataFrame:
    mean = global_aggregate(t.customer, mean=exact_avg("c_acctbal"))
    return theta_join(t.customer, mean, F.col("c_acctbal") > F.col("mean")).select("c_custkey")


@plan("SELECT l_orderkey, l_linenumber FROM lineitem a WHERE l_quantity = (SELECT MAX(l_quantity) FROM lineitem b WHERE b.l_partkey = a.l_partkey)")
def scalar_subquery_correlated(t: Tables) -> DataFrame:
    most = aggregate(t.lineitem, [F.col("l_partkey").alias("k")], m=F.max("l_quantity"))
    return equi_join(t.lineitem, most, [("l_partkey", "k"), ("l_quantity", "m")]).select("l_orderkey", "l_linenumber")


# Aggregates


@plan(f"SELECT COUNT(*) AS n, COUNT(l_tax) AS n_tax, {exact('l_quantity')} AS total, {exact('l_tax')} / COUNT(l_tax) AS mean, MIN(l_returnflag) AS low, MAX(CAST(l_shipdate AS DATE)) AS latest FROM lineitem")
def agg_global(t: Tables) -> DataFrame:
    return global_aggregate(t.lineitem, n=F.count("*"), n_tax=F.count("l_tax"), total=exact_sum("l_quantity"), mean=exact_avg("l_tax"), low=F.min("l_returnflag"), latest=F.max(F.to_date("l_shipdate")))


@plan("SELECT COUNT(*) AS n, CAST(SUM(o_custkey) AS BIGINT) AS total, AVG(o_totalprice) AS mean, MIN(o_totalprice) AS low FROM orders WHERE o_totalprice < 0")
def agg_global_empty(t: Tables) -> DataFrame:
    return global_aggregate(t.orders.filter(F.col("o_totalprice") < 0), n=F.count("*"), total=F.sum("o_custkey"), mean=F.avg("o_totalprice"), low=F.min("o_totalprice"))


@plan(f"SELECT l_returnflag, l_linestatus, COUNT(*) AS n, {exact('l_extendedprice')} AS total, MIN(l_quantity) AS low, MAX(l_quantity) AS high FROM lineitem GROUP BY ALL")
def agg_group(t: Tables) -> DataFrame:
    return aggregate(t.lineitem, ["l_returnflag", "l_linestatus"], n=F.count("*"), total=exact_sum("l_extendedprice"), low=F.min("l_quantity"), high=F.max("l_quantity"))


@plan("SELECT CAST(YEAR(l_shipdate) AS BIGINT) AS year, l_linenumber % 2 AS odd, CAST(SUM(l_partkey) AS BIGINT) AS total FROM lineitem GROUP BY 1, 2")
def agg_group_expr(t: Tables) -> DataFrame:
    return aggregate(t.lineitem, [year_of("l_shipdate").alias("year"), (F.col("l_linenumber") % 2).alias("odd")], total=F.sum("l_partkey"))


@plan("SELECT l_returnflag, COUNT(DISTINCT l_suppkey) AS suppliers, CAST(SUM(DISTINCT l_linenumber) AS BIGINT) AS total, AVG(DISTINCT l_linenumber) AS mean, MIN(DISTINCT l_tax) AS low, MAX(DISTINCT l_tax) AS high FROM lineitem GROUP BY 1")
def agg_distinct(t: Tables) -> DataFrame:
    return aggregate(t.lineitem, ["l_returnflag"], suppliers=distinct_aggregate("count", "l_suppkey"), total=distinct_aggregate("sum", "l_linenumber"), mean=distinct_aggregate("avg", "l_linenumber"), low=distinct_aggregate("min", "l_tax"), high=distinct_aggregate("max", "l_tax"))


@plan(f"SELECT o_custkey, {exact('o_totalprice')} AS total FROM orders GROUP BY 1 HAVING COUNT(*) >= 12 AND MIN(o_totalprice) < 50000")
def agg_having(t: Tables) -> DataFrame:
    return aggregate(t.orders, ["o_custkey"], having=(F.col("n") >= 12) & (F.col("low") < 50000), total=exact_sum("o_totalprice"), n=F.count("*"), low=F.min("o_totalprice")).select("o_custkey", "total")


@plan("SELECT CAST(SUM(o_custkey) AS BIGINT) AS total FROM orders HAVING COUNT(*) > 0")
def agg_having_global(t: Tables) -> DataFrame:
    return global_aggregate(t.orders, having=F.col("n") > 0, total=F.sum("o_custkey"), n=F.count("*")).select("total")


@plan("SELECT o_orderstatus, CAST(SUM(CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 1 ELSE 0 END) AS BIGINT) AS urgent, COUNT(CASE WHEN o_totalprice > 250000 THEN 1 END) AS dear FROM orders GROUP BY 1")
def agg_case(t: Tables) -> DataFrame:
    return aggregate(t.orders, ["o_orderstatus"], urgent=F.sum(F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), 1).otherwise(0)), dear=F.count(F.when(F.col("o_totalprice") > 250000, 1)))


@plan(f"SELECT l_linestatus, CAST(100 AS DOUBLE) * {exact('l_discount')} / {exact('l_quantity')} AS share, -COUNT(*) AS minus FROM lineitem GROUP BY 1")
def agg_nested_expr(t: Tables) -> DataFrame:
    return aggregate(t.lineitem, ["l_linestatus"], share=F.lit(100.0) * exact_sum("l_discount") / exact_sum("l_quantity"), minus=-F.count("*"))


# Order, limits and distinct


@plan("SELECT DISTINCT l_returnflag, l_linestatus, l_linenumber FROM lineitem")
def distinct_rows(t: Tables) -> DataFrame:
    return distinct(t.lineitem, ["l_returnflag", "l_linestatus", "l_linenumber"])


@plan("SELECT o_orderkey, o_orderpriority, o_totalprice FROM orders ORDER BY o_orderpriority, o_totalprice DESC, o_orderkey")
def sort_multi(t: Tables) -> DataFrame:
    return order(t.orders.select("o_orderkey", "o_orderpriority", "o_totalprice"), "o_orderpriority", F.desc("o_totalprice"), "o_orderkey")


@plan("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def topk(t: Tables) -> DataFrame:
    return top_k(t.orders.select("o_orderkey", "o_totalprice"), 25, F.desc("o_totalprice"), "o_orderkey")


@plan("SELECT c_custkey FROM customer ORDER BY c_acctbal, c_custkey LIMIT 20 OFFSET 30")
def limit_offset(t: Tables) -> DataFrame:
    return page(t.customer, 20, 30, "c_acctbal", "c_custkey").select("c_custkey")
