"""The 22 TPC-H shapes over the tables at hand.

Columns that the tables lack are replaced: supply offers are line items grouped
by part and supplier, a returned item stands for a late one, and the market
segment for the country code. Money is summed exactly, so results don't depend on
the order of rows or partitions.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import exact_avg, exact_sum, like, substr, year_of
from ..operators import anti, left_join, multiway, semi, top_k, where
from .registry import Tables, exact, plan

VOLUME = "l_extendedprice * (1 - l_discount)"


def day(text: str):
    return F.lit(date.fromisoformat(text))


def volume():
    return F.col("l_extendedprice") * (1 - F.col("l_discount"))


def since(column: str, first: str, end: str):
    return (F.col(column) >= day(first)) & (F.col(column) < day(end))


def offers(t: Tables) -> DataFrame:
    """What each supplier offers of each part."""
    cost = F.min("l_extendedprice").alias("ps_supplycost")
    return t.lineitem.groupBy(F.col("l_partkey").alias("ps_partkey"), F.col("l_suppkey").alias("ps_suppkey")).agg(F.sum("l_quantity").alias("ps_availqty"), cost)


OFFERS = "ps AS (SELECT l_partkey AS ps_partkey, l_suppkey AS ps_suppkey, SUM(l_quantity) AS ps_availqty, MIN(l_extendedprice) AS ps_supplycost FROM lineitem GROUP BY ALL)"


@plan(f"""
SELECT l_returnflag, l_linestatus, SUM(l_quantity) AS sum_qty, {exact("l_extendedprice")} AS sum_base_price, {exact(VOLUME)} AS sum_disc_price,
  {exact(VOLUME + " * (1 + l_tax)", 6)} AS sum_charge, {exact("l_quantity")} / COUNT(*) AS avg_qty, {exact("l_extendedprice")} / COUNT(*) AS avg_price,
  {exact("l_discount")} / COUNT(*) AS avg_disc, COUNT(*) AS count_order
FROM lineitem WHERE l_shipdate <= DATE '1998-12-01' - INTERVAL 74 DAY GROUP BY ALL""")
def tpch_q01(t: Tables) -> DataFrame:
    lines = t.lineitem.filter(F.col("l_shipdate") <= day("1998-12-01") - F.expr("INTERVAL '74' DAY"))
    return lines.groupBy("l_returnflag", "l_linestatus").agg(
        F.sum("l_quantity").alias("sum_qty"),
        exact_sum("l_extendedprice").alias("sum_base_price"),
        exact_sum(volume()).alias("sum_disc_price"),
        exact_sum(volume() * (1 + F.col("l_tax")), 6).alias("sum_charge"),
        exact_avg("l_quantity").alias("avg_qty"),
        exact_avg("l_extendedprice").alias("avg_price"),
        exact_avg("l_discount").alias("avg_disc"),
        F.count("*").alias("count_order"),
    )


@plan(f"""
WITH {OFFERS}, offer AS (
  SELECT * FROM ps JOIN supplier ON ps_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'MIDDLE EAST')
SELECT s_acctbal, s_name, n_name, p_partkey, p_brand FROM offer JOIN part ON p_partkey = ps_partkey
WHERE p_size = 19 AND p_type LIKE '%ARD' AND ps_supplycost = (SELECT MIN(o.ps_supplycost) FROM offer o WHERE o.ps_partkey = p_partkey)
ORDER BY s_acctbal DESC, n_name, s_name, p_partkey LIMIT 100""")
def tpch_q02(t: Tables) -> DataFrame:
    parts = where(t.part, F.col("p_size") == 19, like("p_type", "%ARD"))
    region = t.region.filter(F.col("r_name") == "MIDDLE EAST")
    wanted = semi(offers(t), parts, F.col("ps_partkey") == F.col("p_partkey"))
    offer = multiway(wanted, (t.supplier, [("ps_suppkey", "s_suppkey")]), (t.nation, [("s_nationkey", "n_nationkey")]), (region, [("n_regionkey", "r_regionkey")]))
    cheapest = offer.groupBy(F.col("ps_partkey").alias("k")).agg(F.min("ps_supplycost").alias("least"))
    best = offer.join(cheapest, (F.col("ps_partkey") == F.col("k")) & (F.col("ps_supplycost") == F.col("least")))
    rows = best.join(parts, F.col("ps_partkey") == F.col("p_partkey")).select("s_acctbal", "s_name", "n_name", "p_partkey", "p_brand")
    return top_k(rows, 100, F.desc("s_acctbal"), "n_name", "s_name", "p_partkey")


@plan(f"""
SELECT l_orderkey, {exact(VOLUME)} AS revenue, CAST(o_orderdate AS DATE) AS o_orderdate
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
WHERE c_mktsegment = 'FURNITURE' AND o_orderdate < DATE '1998-03-29' AND l_shipdate > DATE '1998-03-29'
GROUP BY l_orderkey, o_orderdate ORDER BY revenue DESC, o_orderdate, l_orderkey LIMIT 10""")
def tpch_q03(t: Tables) -> DataFrame:
    cut = day("1998-03-29")
    buyers = t.customer.filter(F.col("c_mktsegment") == "FURNITURE")
    open_ = multiway(t.orders.filter(F.col("o_orderdate") < cut), (buyers, [("o_custkey", "c_custkey")]), (t.lineitem.filter(F.col("l_shipdate") > cut), [("o_orderkey", "l_orderkey")]))
    rows = open_.groupBy("l_orderkey", F.to_date("o_orderdate").alias("o_orderdate")).agg(exact_sum(volume()).alias("revenue"))
    return top_k(rows, 10, F.desc("revenue"), "o_orderdate", "l_orderkey")


@plan("""
SELECT o_orderpriority, COUNT(*) AS order_count FROM orders
WHERE o_orderdate >= DATE '1997-06-01' AND o_orderdate < DATE '1997-09-01' AND o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')
GROUP BY o_orderpriority""")
def tpch_q04(t: Tables) -> DataFrame:
    placed = t.orders.filter(since("o_orderdate", "1997-06-01", "1997-09-01"))
    late = t.lineitem.filter(F.col("l_returnflag") == "R")
    return semi(placed, late, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("o_orderpriority").agg(F.count("*").alias("order_count"))


@plan(f"""
SELECT n_name, {exact(VOLUME)} AS revenue
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey AND s_nationkey = c_nationkey
  JOIN nation ON n_nationkey = s_nationkey JOIN region ON n_regionkey = r_regionkey
WHERE r_name = 'AFRICA' AND YEAR(o_orderdate) = 1996 GROUP BY n_name""")
def tpch_q05(t: Tables) -> DataFrame:
    placed = t.orders.filter(since("o_orderdate", "1996-01-01", "1997-01-01"))
    home = multiway(t.supplier, (t.nation, [("s_nationkey", "n_nationkey")]), (t.region.filter(F.col("r_name") == "AFRICA"), [("n_regionkey", "r_regionkey")]))
    rows = multiway(t.lineitem, (placed, [("l_orderkey", "o_orderkey")]), (t.customer, [("o_custkey", "c_custkey")]), (home, [("l_suppkey", "s_suppkey"), ("c_nationkey", "s_nationkey")]))
    return rows.groupBy("n_name").agg(exact_sum(volume()).alias("revenue"))


@plan(f"""
SELECT {exact("l_extendedprice * l_discount")} AS revenue FROM lineitem
WHERE YEAR(l_shipdate) = 1997 AND l_discount BETWEEN CAST(0.065 AS DOUBLE) AND CAST(0.095 AS DOUBLE) AND l_quantity < 25""")
def tpch_q06(t: Tables) -> DataFrame:
    lines = where(t.lineitem, since("l_shipdate", "1997-01-01", "1998-01-01"), F.col("l_discount").between(0.065, 0.095), F.col("l_quantity") < 25)
    return lines.agg(exact_sum(F.col("l_extendedprice") * F.col("l_discount")).alias("revenue"))


@plan(f"""
SELECT a.n_name AS supp_nation, b.n_name AS cust_nation, CAST(YEAR(l_shipdate) AS BIGINT) AS l_year, {exact(VOLUME)} AS revenue
FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
  JOIN nation a ON s_nationkey = a.n_nationkey JOIN nation b ON c_nationkey = b.n_nationkey
WHERE (a.n_name, b.n_name) IN (('NATION_1', 'NATION_2'), ('NATION_2', 'NATION_1')) AND CAST(l_shipdate AS DATE) BETWEEN DATE '1996-01-01' AND DATE '1997-12-31'
GROUP BY ALL""")
def tpch_q07(t: Tables) -> DataFrame:
    two = t.nation.filter(F.col("n_name").isin("NATION_1", "NATION_2"))
    sold = t.supplier.join(two.select(F.col("n_nationkey").alias("sn"), F.col("n_name").alias("supp_nation")), F.col("s_nationkey") == F.col("sn"))
    bought = t.customer.join(two.select(F.col("n_nationkey").alias("cn"), F.col("n_name").alias("cust_nation")), F.col("c_nationkey") == F.col("cn"))
    lines = t.lineitem.filter(since("l_shipdate", "1996-01-01", "1998-01-01"))
    rows = multiway(lines, (sold, [("l_suppkey", "s_suppkey")]), (t.orders, [("l_orderkey", "o_orderkey")]), (bought, [("o_custkey", "c_custkey")]))
    return rows.filter(F.col("supp_nation") != F.col("cust_nation")).groupBy("supp_nation", "cust_nation", year_of("l_shipdate").alias("l_year")).agg(exact_sum(volume()).alias("revenue"))


@plan(f"""
SELECT CAST(YEAR(o_orderdate) AS BIGINT) AS o_year, {exact("CASE WHEN b.n_name = 'NATION_5' THEN " + VOLUME + " ELSE 0 END")} / {exact(VOLUME)} AS mkt_share
FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
  JOIN nation a ON c_nationkey = a.n_nationkey JOIN region ON a.n_regionkey = r_regionkey JOIN nation b ON s_nationkey = b.n_nationkey
WHERE r_name = 'AMERICA' AND p_type = 'STANDARD' AND CAST(o_orderdate AS DATE) BETWEEN DATE '1995-01-01' AND DATE '1998-12-31' GROUP BY ALL""")
def tpch_q08(t: Tables) -> DataFrame:
    placed = t.orders.filter(since("o_orderdate", "1995-01-01", "1999-01-01"))
    market = multiway(t.customer, (t.nation, [("c_nationkey", "n_nationkey")]), (t.region.filter(F.col("r_name") == "AMERICA"), [("n_regionkey", "r_regionkey")])).select("c_custkey")
    sold = multiway(t.supplier, (t.nation, [("s_nationkey", "n_nationkey")])).select("s_suppkey", F.col("n_name").alias("nation"))
    rows = multiway(t.lineitem, (t.part.filter(F.col("p_type") == "STANDARD"), [("l_partkey", "p_partkey")]), (placed, [("l_orderkey", "o_orderkey")]), (market, [("o_custkey", "c_custkey")]), (sold, [("l_suppkey", "s_suppkey")]))
    own = exact_sum(F.when(F.col("nation") == "NATION_5", volume()).otherwise(0.0))
    return rows.groupBy(year_of("o_orderdate").alias("o_year")).agg((own / exact_sum(volume())).alias("mkt_share"))


@plan(f"""
SELECT n_name AS nation, CAST(YEAR(o_orderdate) AS BIGINT) AS o_year, {exact(VOLUME)} AS sum_profit
FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey JOIN orders ON l_orderkey = o_orderkey JOIN nation ON s_nationkey = n_nationkey
WHERE p_name LIKE '%ring%' GROUP BY ALL""")
def tpch_q09(t: Tables) -> DataFrame:
    rows = multiway(t.lineitem, (t.part.filter(like("p_name", "%ring%")), [("l_partkey", "p_partkey")]), (t.supplier, [("l_suppkey", "s_suppkey")]), (t.orders, [("l_orderkey", "o_orderkey")]), (t.nation, [("s_nationkey", "n_nationkey")]))
    return rows.groupBy(F.col("n_name").alias("nation"), year_of("o_orderdate").alias("o_year")).agg(exact_sum(volume()).alias("sum_profit"))


@plan(f"""
SELECT c_custkey, c_name, {exact(VOLUME)} AS revenue, c_acctbal, n_name
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
WHERE l_returnflag = 'R' AND o_orderdate >= DATE '1996-02-01' AND o_orderdate < DATE '1996-05-01'
GROUP BY c_custkey, c_name, c_acctbal, n_name ORDER BY revenue DESC, c_custkey LIMIT 20""")
def tpch_q10(t: Tables) -> DataFrame:
    placed = t.orders.filter(since("o_orderdate", "1996-02-01", "1996-05-01"))
    spent = multiway(t.lineitem.filter(F.col("l_returnflag") == "R"), (placed, [("l_orderkey", "o_orderkey")])).groupBy("o_custkey").agg(exact_sum(volume()).alias("revenue"))
    rows = multiway(spent, (t.customer, [("o_custkey", "c_custkey")]), (t.nation, [("c_nationkey", "n_nationkey")]))
    return top_k(rows.select("c_custkey", "c_name", "revenue", "c_acctbal", "n_name"), 20, F.desc("revenue"), "c_custkey")


@plan(f"""
WITH {OFFERS}, mine AS (SELECT ps_partkey, {exact("ps_supplycost * ps_availqty")} AS value FROM ps JOIN supplier ON ps_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey WHERE n_name = 'NATION_5' GROUP BY ps_partkey)
SELECT ps_partkey, value FROM mine WHERE value > (SELECT {exact("value")} * CAST(0.0001 AS DOUBLE) FROM mine)""")
def tpch_q11(t: Tables) -> DataFrame:
    mine = multiway(offers(t), (t.supplier, [("ps_suppkey", "s_suppkey")]), (t.nation.filter(F.col("n_name") == "NATION_5"), [("s_nationkey", "n_nationkey")]))
    value = mine.groupBy("ps_partkey").agg(exact_sum(F.col("ps_supplycost") * F.col("ps_availqty")).alias("value"))
    least = value.agg((exact_sum("value") * 0.0001).alias("least"))
    return value.crossJoin(least).filter(F.col("value") > F.col("least")).select("ps_partkey", "value")


@plan("""
SELECT l_returnflag, CAST(COUNT(*) FILTER (o_orderpriority IN ('1-URGENT', '2-HIGH')) AS BIGINT) AS high_line_count, CAST(COUNT(*) FILTER (o_orderpriority NOT IN ('1-URGENT', '2-HIGH')) AS BIGINT) AS low_line_count
FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_returnflag IN ('A', 'R') AND YEAR(l_shipdate) = 1997 GROUP BY l_returnflag""")
def tpch_q12(t: Tables) -> DataFrame:
    lines = where(t.lineitem, F.col("l_returnflag").isin("A", "R"), since("l_shipdate", "1997-01-01", "1998-01-01"))
    high = F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")
    return multiway(lines, (t.orders, [("l_orderkey", "o_orderkey")])).groupBy("l_returnflag").agg(F.sum(F.when(high, 1).otherwise(0)).alias("high_line_count"), F.sum(F.when(~high, 1).otherwise(0)).alias("low_line_count"))


@plan("""
WITH per AS (SELECT c_custkey, COUNT(o_orderkey) AS c_count FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND NOT contains(o_orderpriority, 'URGENT') GROUP BY c_custkey)
SELECT c_count, COUNT(*) AS custdist FROM per GROUP BY c_count""")
def tpch_q13(t: Tables) -> DataFrame:
    calm = t.orders.filter(~like("o_orderpriority", "%URGENT%"))
    per = left_join(t.customer, calm, [("c_custkey", "o_custkey")]).groupBy("c_custkey").agg(F.count("o_orderkey").alias("c_count"))
    return per.groupBy("c_count").agg(F.count("*").alias("custdist"))


@plan(f"""
SELECT CAST(100 AS DOUBLE) * {exact("CASE WHEN starts_with(p_type, 'PROMO') THEN " + VOLUME + " ELSE 0 END")} / {exact(VOLUME)} AS promo_revenue
FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_shipdate >= DATE '1996-03-01' AND l_shipdate < DATE '1996-04-01'""")
def tpch_q14(t: Tables) -> DataFrame:
    rows = multiway(t.lineitem.filter(since("l_shipdate", "1996-03-01", "1996-04-01")), (t.part, [("l_partkey", "p_partkey")]))
    promo = exact_sum(F.when(like("p_type", "PROMO%"), volume()).otherwise(0.0))
    return rows.agg((F.lit(100.0) * promo / exact_sum(volume())).alias("promo_revenue"))


@plan(f"""
WITH sold AS (SELECT l_suppkey, {exact(VOLUME)} AS total_revenue FROM lineitem WHERE l_shipdate >= DATE '1997-05-01' AND l_shipdate < DATE '1997-08-01' GROUP BY l_suppkey)
SELECT s_suppkey, s_name, total_revenue FROM sold JOIN supplier ON s_suppkey = l_suppkey WHERE total_revenue >= ALL (SELECT total_revenue FROM sold)""")
def tpch_q15(t: Tables) -> DataFrame:
    sold = t.lineitem.filter(since("l_shipdate", "1997-05-01", "1997-08-01")).groupBy("l_suppkey").agg(exact_sum(volume()).alias("total_revenue"))
    # suppliers of equal revenue share a row, so one aggregate finds the greatest revenue and all who have it
    best = sold.groupBy("total_revenue").agg(F.collect_list("l_suppkey").alias("who")).agg(F.max(F.struct("total_revenue", "who")).alias("b"))
    return multiway(best.select(F.col("b.total_revenue"), F.explode("b.who").alias("l_suppkey")), (t.supplier, [("l_suppkey", "s_suppkey")])).select("s_suppkey", "s_name", "total_revenue")


@plan(f"""
WITH {OFFERS}
SELECT p_brand, p_type, p_size, COUNT(DISTINCT ps_suppkey) AS supplier_cnt FROM ps JOIN part ON ps_partkey = p_partkey
WHERE p_brand <> 'Brand#13' AND NOT starts_with(p_type, 'LARGE') AND p_size IN (5, 11, 20, 25, 27, 37, 39, 47) AND ps_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 0)
GROUP BY ALL""")
def tpch_q16(t: Tables) -> DataFrame:
    parts = where(t.part, F.col("p_brand") != "Brand#13", ~like("p_type", "LARGE%"), F.col("p_size").isin(5, 11, 20, 25, 27, 37, 39, 47))
    bad = t.supplier.filter(F.col("s_acctbal") < 0)
    rows = anti(multiway(offers(t), (parts, [("ps_partkey", "p_partkey")])), bad, F.col("ps_suppkey") == F.col("s_suppkey"))
    return rows.groupBy("p_brand", "p_type", "p_size").agg(F.count_distinct("ps_suppkey").alias("supplier_cnt"))


@plan(f"""
WITH mean AS (SELECT l_partkey AS k, CAST(0.2 AS DOUBLE) * {exact("l_quantity")} / COUNT(*) AS few FROM lineitem GROUP BY l_partkey)
SELECT {exact("l_extendedprice")} / CAST(7 AS DOUBLE) AS avg_yearly FROM lineitem JOIN part ON l_partkey = p_partkey JOIN mean ON k = l_partkey WHERE p_brand = 'Brand#8' AND l_quantity < few""")
def tpch_q17(t: Tables) -> DataFrame:
    lines = multiway(t.lineitem, (t.part.filter(F.col("p_brand") == "Brand#8"), [("l_partkey", "p_partkey")])).select("l_partkey", "l_quantity", "l_extendedprice")
    few = lines.groupBy(F.col("l_partkey").alias("k")).agg((F.lit(0.2) * exact_sum("l_quantity") / F.count("*")).alias("few"))
    return lines.join(few, (F.col("l_partkey") == F.col("k")) & (F.col("l_quantity") < F.col("few"))).agg((exact_sum("l_extendedprice") / 7.0).alias("avg_yearly"))


@plan("""
WITH big AS (SELECT l_orderkey, SUM(l_quantity) AS sum_qty FROM lineitem GROUP BY l_orderkey HAVING SUM(l_quantity) > 230)
SELECT c_name, c_custkey, o_orderkey, CAST(o_orderdate AS DATE) AS o_orderdate, o_totalprice, sum_qty FROM big JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey
ORDER BY o_totalprice DESC, o_orderdate, o_orderkey LIMIT 100""")
def tpch_q18(t: Tables) -> DataFrame:
    big = t.lineitem.groupBy("l_orderkey").agg(F.sum("l_quantity").alias("sum_qty")).filter(F.col("sum_qty") > 230)
    rows = multiway(big, (t.orders, [("l_orderkey", "o_orderkey")]), (t.customer, [("o_custkey", "c_custkey")]))
    return top_k(rows.select("c_name", "c_custkey", "o_orderkey", F.to_date("o_orderdate").alias("o_orderdate"), "o_totalprice", "sum_qty"), 100, F.desc("o_totalprice"), "o_orderdate", "o_orderkey")


_Q19 = (("Brand#8", 5, 5), ("Brand#11", 15, 10), ("Brand#21", 29, 15))


@plan(f"""
SELECT {exact(VOLUME)} AS revenue FROM lineitem JOIN part ON l_partkey = p_partkey
WHERE {" OR ".join(f"p_brand = '{b}' AND p_size BETWEEN 1 AND {s} AND l_quantity BETWEEN {q} AND {q + 10}" for b, q, s in _Q19)}""")
def tpch_q19(t: Tables) -> DataFrame:
    either = F.lit(False)
    for brand, quantity, size in _Q19:
        either = either | ((F.col("p_brand") == brand) & F.col("p_size").between(1, size) & F.col("l_quantity").between(quantity, quantity + 10))
    return multiway(t.lineitem, (t.part, [("l_partkey", "p_partkey")])).filter(either).agg(exact_sum(volume()).alias("revenue"))


@plan(f"""
WITH {OFFERS}, sold AS (SELECT l_partkey, l_suppkey, SUM(l_quantity) / 2 AS half FROM lineitem WHERE YEAR(l_shipdate) = 1997 GROUP BY ALL)
SELECT s_name FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_name = 'NATION_5' AND s_suppkey IN (
  SELECT ps_suppkey FROM ps JOIN sold ON ps_partkey = l_partkey AND ps_suppkey = l_suppkey JOIN part ON p_partkey = ps_partkey WHERE starts_with(p_name, 'old') AND ps_availqty > half)""")
def tpch_q20(t: Tables) -> DataFrame:
    old = t.part.filter(like("p_name", "old%"))
    half = t.lineitem.filter(since("l_shipdate", "1997-01-01", "1998-01-01")).groupBy("l_partkey", "l_suppkey").agg((F.sum("l_quantity") / 2).alias("half"))
    stocked = semi(offers(t), old, F.col("ps_partkey") == F.col("p_partkey")).join(half, (F.col("ps_partkey") == F.col("l_partkey")) & (F.col("ps_suppkey") == F.col("l_suppkey")) & (F.col("ps_availqty") > F.col("half")))
    home = multiway(t.supplier, (t.nation.filter(F.col("n_name") == "NATION_5"), [("s_nationkey", "n_nationkey")]))
    return semi(home, stocked, F.col("s_suppkey") == F.col("ps_suppkey")).select("s_name")


@plan("""
WITH per AS (SELECT l_orderkey, COUNT(DISTINCT l_suppkey) AS suppliers, COUNT(DISTINCT CASE WHEN l_returnflag = 'R' THEN l_suppkey END) AS late FROM lineitem GROUP BY l_orderkey)
SELECT s_name, COUNT(*) AS numwait FROM lineitem JOIN per USING (l_orderkey) JOIN orders ON o_orderkey = l_orderkey JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey
WHERE suppliers > 1 AND late = 1 AND l_returnflag = 'R' AND o_orderstatus = 'F' AND n_name = 'NATION_5'
GROUP BY s_name ORDER BY numwait DESC, s_name LIMIT 100""")
def tpch_q21(t: Tables) -> DataFrame:
    # min and max tell one supplier from several without a distinct count, so one exchange serves both conditions
    late = F.when(F.col("l_returnflag") == "R", F.col("l_suppkey"))
    per = t.lineitem.groupBy("l_orderkey").agg(F.min("l_suppkey").alias("a"), F.max("l_suppkey").alias("b"), F.min(late).alias("late"), F.max(late).alias("last"), F.count(late).alias("n"))
    alone = per.filter("a != b and late = last").select("l_orderkey", F.col("late").alias("l_suppkey"), "n")
    rows = multiway(alone, (t.orders.filter(F.col("o_orderstatus") == "F"), [("l_orderkey", "o_orderkey")]), (t.supplier, [("l_suppkey", "s_suppkey")]), (t.nation.filter(F.col("n_name") == "NATION_5"), [("s_nationkey", "n_nationkey")]))
    return top_k(rows.groupBy("s_name").agg(F.sum("n").alias("numwait")), 100, F.desc("numwait"), "s_name")


@plan(f"""
WITH c AS (SELECT substr(c_mktsegment, 1, 2) AS cntrycode, c_acctbal, c_custkey FROM customer WHERE left(c_mktsegment, 2) IN ('AU', 'BU', 'FU'))
SELECT cntrycode, COUNT(*) AS numcust, {exact("c_acctbal")} AS totacctbal FROM c
WHERE c_acctbal > (SELECT {exact("c_acctbal")} / COUNT(*) FROM c WHERE c_acctbal > 0) AND c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')
GROUP BY cntrycode""")
def tpch_q22(t: Tables) -> DataFrame:
    c = t.customer.select(substr("c_mktsegment", 1, 2).alias("cntrycode"), "c_acctbal", "c_custkey").filter(F.col("cntrycode").isin("AU", "BU", "FU"))
    mean = c.filter(F.col("c_acctbal") > 0).agg(exact_avg("c_acctbal").alias("mean"))
    rich = c.join(mean, F.col("c_acctbal") > F.col("mean"))
    idle = anti(rich, t.orders.filter(F.col("o_orderpriority") == "1-URGENT"), F.col("c_custkey") == F.col("o_custkey"))
    return idle.groupBy("cntrycode").agg(F.count("*").alias("numcust"), exact_sum("c_acctbal").alias("totacctbal"))
