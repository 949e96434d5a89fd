"""Statements that change tables, the TPC-C read shapes, statistics and plan reports.

A statement runs against a copy of the table in the shared folder; the query is the table after it.
"""

from __future__ import annotations

import uuid
from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..explain import explain, explain_analyze
from ..functions import exact_sum
from ..operators import Table, VersionedStore, equi_join, semi
from ..shared import shared_dir
from ..sources.delimited import read_tbl
from ..sql_engine import SqlEngine
from ..stats import column_stats, histogram, most_common
from ..streaming import windowed_counts
from .registry import Tables, exact, plan


def copied(t: Tables, name: str) -> Table:
    rows = getattr(t, name)
    table = VersionedStore(t.spark, f"{shared_dir(t.spark)}/statements-{uuid.uuid4().hex}").create(name, rows.schema)
    table.insert(rows)
    return table


@plan("SELECT * FROM nation UNION ALL SELECT * FROM (VALUES (CAST(100 AS INT), 'NEW', CAST(NULL AS INT)), (101, 'NEWER', NULL)) v")
def dml_insert(t: Tables) -> DataFrame:
    table = copied(t, "nation")
    table.insert(t.spark.createDataFrame([("NEW", 100), ("NEWER", 101)], "name string, key long"), ["n_name", "n_nationkey"])
    return table.read()


@plan("SELECT * FROM region UNION ALL SELECT n_nationkey + 100, n_name FROM nation WHERE n_regionkey = 2")
def dml_insert_select(t: Tables) -> DataFrame:
    table = copied(t, "region")
    table.insert(t.nation.filter("n_regionkey = 2").select(F.col("n_nationkey") + 100, "n_name"))
    return table.read()


@plan("SELECT c_custkey, c_name, c_nationkey, CASE WHEN c_mktsegment = 'BUILDING' THEN c_acctbal + 10 ELSE c_acctbal END AS c_acctbal, c_mktsegment FROM customer")
def dml_update(t: Tables) -> DataFrame:
    table = copied(t, "customer")
    table.update({"c_acctbal": F.col("c_acctbal") + 10}, F.col("c_mktsegment") == "BUILDING")
    return table.read()


@plan("SELECT p_partkey, p_name, p_brand, p_type, CAST(CASE WHEN p_size >= 10 THEN p_size - 5 ELSE p_size + 86 END AS INT) AS p_size, p_retailprice + 5 AS p_retailprice FROM part")
def dml_update_case(t: Tables) -> DataFrame:
    table = copied(t, "part")
    size = F.col("p_size")
    table.update({"p_size": F.when(size >= 10, size - 5).otherwise(size + 86), "p_retailprice": F.col("p_retailprice") + 5})
    return table.read()


@plan("SELECT * FROM supplier WHERE NOT coalesce(s_acctbal < 1000 OR s_nationkey IN (3, 4), FALSE)")
def dml_delete(t: Tables) -> DataFrame:
    table = copied(t, "supplier")
    table.delete((F.col("s_acctbal") < 1000) | F.col("s_nationkey").isin(3, 4))
    return table.read()


@plan("SELECT 'delete' AS tag, COUNT(*) AS affected FROM supplier WHERE s_acctbal < 1000")
def dml_affected(t: Tables) -> DataFrame:
    return copied(t, "supplier").delete(F.col("s_acctbal") < 1000)


@plan("SELECT CAST(1 AS BIGINT) AS id, CAST('b' AS VARCHAR) AS name, CAST(2.5 AS DOUBLE) AS score, DATE '2024-03-01' AS day UNION ALL SELECT 3, NULL, 7, NULL")
def ddl_script(t: Tables) -> DataFrame:
    """CREATE, INSERT, UPDATE, DELETE and SELECT as SQL text."""
    engine = SqlEngine(t.spark, f"{shared_dir(t.spark)}/script-{uuid.uuid4().hex}")
    return engine.script("""
        CREATE TABLE notes (id INT64, name STRING(8), score NUMERIC, day DATE);
        INSERT INTO notes VALUES (1, 'a', 2, '2024-02-29'), (2, 'x;y', 4, NULL); -- a semicolon in a literal
        INSERT INTO notes (score, id) VALUES (7, 3);
        UPDATE notes SET name = 'b', score = score + 0.5, day = DATE_ADD(day, INTERVAL 1 DAY) WHERE id = 1;
        DELETE FROM notes WHERE name LIKE 'x;%';
        SELECT * FROM notes;
    """)[-1]


@plan("SELECT c_custkey, CAST(arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS BIGINT) AS latest FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey")
def tpcc_order_status(t: Tables) -> DataFrame:
    rows = equi_join(t.orders, t.customer, [("o_custkey", "c_custkey")])
    return rows.groupBy("c_custkey").agg(F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("latest"))


@plan("SELECT COUNT(DISTINCT p_partkey) AS low_stock FROM part WHERE p_size < 20 AND p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_shipdate >= DATE '2000-01-01')")
def tpcc_stock_level(t: Tables) -> DataFrame:
    recent = t.lineitem.filter(F.col("l_shipdate") >= F.lit(date(2000, 1, 1)))
    return semi(t.part.filter(F.col("p_size") < 20), recent, F.col("l_partkey") == F.col("p_partkey")).agg(F.count_distinct("p_partkey").alias("low_stock"))


@plan(f"SELECT o_custkey, MIN(o_orderkey) AS oldest, {exact('l_extendedprice')} AS amount FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderstatus = 'O' GROUP BY o_custkey")
def tpcc_delivery_amount(t: Tables) -> DataFrame:
    rows = equi_join(t.lineitem, t.orders.filter(F.col("o_orderstatus") == "O"), [("l_orderkey", "o_orderkey")])
    return rows.groupBy("o_custkey").agg(F.min("o_orderkey").alias("oldest"), exact_sum("l_extendedprice").alias("amount"))


def _stats(column: str) -> str:
    return f"SELECT '{column}' AS column_name, COUNT(*) AS row_count, COUNT(*) - COUNT({column}) AS null_count, COUNT(DISTINCT {column}) AS distinct_count, CAST(MIN({column}) AS VARCHAR) AS min_value, CAST(MAX({column}) AS VARCHAR) AS max_value FROM orders"


@plan(" UNION ALL ".join(map(_stats, ("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"))))
def analyze_stats(t: Tables) -> DataFrame:
    return column_stats(t.orders.select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"), exact=True)


@plan("SELECT CAST(o_custkey AS VARCHAR) AS value, COUNT(*) AS frequency FROM orders GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5")
def analyze_common(t: Tables) -> DataFrame:
    return most_common(t.orders, "o_custkey")


@plan("""
WITH o AS (SELECT o_custkey AS v, row_number() OVER (ORDER BY o_custkey) AS r, COUNT(*) OVER () AS n FROM orders WHERE o_custkey IS NOT NULL)
SELECT CAST(b - 1 AS INT) AS bucket, CAST(MIN(v) AS DOUBLE) AS upper FROM o, range(1, 17) AS x(b) WHERE r >= b / 16.0 * n GROUP BY b""")
def analyze_histogram(t: Tables) -> DataFrame:
    return histogram(t.orders, "o_custkey")


@plan("SELECT 'analyze' AS command, 'nation' AS \"table\", COUNT(*) AS rows FROM nation UNION ALL SELECT 'analyze', 'orders', COUNT(*) FROM orders")
def analyze_statement(t: Tables) -> DataFrame:
    return SqlEngine(t.spark, data=t.folder).execute("ANALYZE TABLE nation, orders")


@plan()
def explain_plan(t: Tables) -> DataFrame:
    return explain(equi_join(t.orders, t.customer, [("o_custkey", "c_custkey")]).groupBy("c_name").count())


@plan()
def explain_analyze_plan(t: Tables) -> DataFrame:
    return explain_analyze(equi_join(t.orders, t.customer, [("o_custkey", "c_custkey")]).groupBy("c_name").count())


@plan("SELECT date_trunc('hour', ts) AS window_start, event_type AS key, COUNT(*) AS events, CAST(SUM(CAST(value AS DECIMAL(18,4))) AS DOUBLE) AS total FROM events GROUP BY ALL")
def windowed_events(t: Tables) -> DataFrame:
    """The streaming aggregate over a table."""
    out = windowed_counts(t.events)
    return out.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@plan("SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate >= DATE '1995-01-31' + INTERVAL 1 MONTH AND o_orderdate < DATE '1996-02-29' - INTERVAL 1 YEAR + INTERVAL 90 DAY")
def sql_text_dates(t: Tables) -> DataFrame:
    """Dates and intervals as SQL text through the dialect."""
    return SqlEngine(t.spark, data=t.folder).execute("SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate >= DATE '1995-01-31' + INTERVAL 1 MONTH AND o_orderdate < DATE '1996-02-29' - INTERVAL 1 YEAR + INTERVAL 90 DAY")


@plan("SELECT n_name || '!' AS loud, CASE n_regionkey WHEN 0 THEN 'none' WHEN 1 THEN 'one' ELSE 'more' END AS region, CAST(CASE WHEN n_nationkey IN (2, 5) THEN 8 ELSE 3 END AS BIGINT) AS n FROM nation")
def sql_text_case(t: Tables) -> DataFrame:
    """Simple CASE, string + literal and number + number as SQL text."""
    return SqlEngine(t.spark, data=t.folder).execute("SELECT n_name + '!' AS loud, CASE n_regionkey WHEN 0 THEN 'none' WHEN 1 THEN 'one' ELSE 'more' END AS region, CAST(CASE WHEN n_nationkey IN (2, 5) THEN 5 + 3 ELSE 3 END AS BIGINT) AS n FROM nation;")


@plan("SELECT c_custkey, c_name FROM customer WHERE c_nationkey = 7 AND c_acctbal > 1000")
def sql_text_parameters(t: Tables) -> DataFrame:
    return SqlEngine(t.spark, data=t.folder).execute("SELECT c_custkey, c_name FROM customer WHERE c_nationkey = :nation AND c_acctbal > :least", {"nation": 7, "least": 1000})


@plan("SELECT n_regionkey, COUNT(*) AS nations FROM nation WHERE n_nationkey BETWEEN 3 AND 20 GROUP BY n_regionkey")
def ddl_index(t: Tables) -> DataFrame:
    """A table that CREATE INDEX has clustered gives the same rows."""
    engine = SqlEngine(t.spark, f"{shared_dir(t.spark)}/script-{uuid.uuid4().hex}", t.folder)
    return engine.script("""
        CREATE TABLE land (n_nationkey INT64, n_regionkey INT64);
        INSERT INTO land SELECT n_nationkey, n_regionkey FROM nation;
        CREATE INDEX land_key ON land (n_nationkey);
        SELECT CAST(n_regionkey AS INT) AS n_regionkey, COUNT(*) AS nations FROM land WHERE n_nationkey BETWEEN 3 AND 20 GROUP BY n_regionkey;
    """)[-1]


@plan("SELECT 'kept' AS name")
def ddl_drop(t: Tables) -> DataFrame:
    """The tables that are left after a DROP."""
    engine = SqlEngine(t.spark, f"{shared_dir(t.spark)}/script-{uuid.uuid4().hex}")
    engine.script("CREATE TABLE kept (k INT64); CREATE TABLE gone (k INT64); DROP TABLE gone")
    return t.spark.createDataFrame([(n,) for n in engine.catalog.tables()], "name string")


@plan("SELECT CAST(r_regionkey AS BIGINT) AS r_regionkey, r_name FROM region")
def tbl_loader(t: Tables) -> DataFrame:
    """Pipe-delimited lines with a closing delimiter, written and loaded with types."""
    path = f"{shared_dir(t.spark)}/region-{uuid.uuid4().hex}.tbl"
    t.region.select(F.concat_ws("|", F.col("r_regionkey").cast("string"), "r_name", F.lit(""))).write.text(path)
    return read_tbl(t.spark, path, [("r_regionkey", "INT64"), ("r_name", "STRING")])
