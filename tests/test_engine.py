"""Statements, dialect, tables, statistics and reports, with literal results."""

from __future__ import annotations

import datetime
import subprocess
import sys
from datetime import date
from pathlib import Path

import pyarrow as pa
import pyarrow.compute as pc
import pytest
from pyspark.errors import ParseException
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakeplan import types
from lakeplan.dialect import DialectError, split_statements, to_spark
from lakeplan.explain import explain, explain_analyze
from lakeplan.functions import int_div, like, safe_div, safe_mod, substr
from lakeplan.operators import VersionedStore, block_join, null_aware_anti, qualify
from lakeplan.operators.dml import ConflictError
from lakeplan.sources import read_tbl
from lakeplan.sql_engine import SqlEngine
from lakeplan.stats import column_stats, extremes, histogram, most_common, selectivity


def rows(df):
    return [tuple(r) for r in df.collect()]


@pytest.fixture
def engine(spark, tmp_path):
    e = SqlEngine(spark, str(tmp_path / "tables"))
    e.execute("CREATE TABLE samples (key INT64, name VARCHAR(10), score NUMERIC);")
    e.execute("INSERT INTO samples VALUES (0, 'maple', 1.2), (3, 'birch', 12.2), (1, 'cedar', 4.9), (2, 'aspen', 4.14)")
    yield e
    e.execute("DROP TABLE samples")


GOLDEN = [
    ("SELECT -key, -score FROM samples WHERE key = 1 OR key = 2 ORDER BY key", [(-1, -4.9), (-2, -4.14)]),
    ("SELECT key FROM samples WHERE NOT (key = 1) OR key = 2 ORDER BY key", [(0,), (2,), (3,)]),
    ("SELECT -COUNT(*) FROM samples", [(-4,)]),
    ("SELECT CASE WHEN COUNT(*) > 0 THEN 1 ELSE 0 END FROM samples", [(1,)]),
    ("SELECT DATE_ADD('2026-01-01', INTERVAL 3 DAY)", [(datetime.date(2026, 1, 4),)]),
    ("SELECT DATE_SUB(DATE '2024-03-31', INTERVAL 1 month)", [(datetime.date(2024, 2, 29),)]),
    ("SELECT EXTRACT(YEAR FROM '2026-08-21'), EXTRACT(MONTH FROM '2026-08-21'), EXTRACT(DAY FROM '2026-08-21')", [(2026, 8, 21)]),
    ("SELECT (SELECT key FROM samples WHERE key > 100)", [(None,)]),
    ("SELECT COUNT(*) FROM samples WHERE key IN (SELECT key FROM samples ORDER BY key)", [(4,)]),
    ("SELECT SUBSTR(name, 0, 2), SUBSTRING(name, 3), SUBSTR(name, 9, 2) FROM samples WHERE key = 0", [("ma", "ple", "")]),
    ("SELECT name + '!' FROM samples WHERE key = 3", [("birch!",)]),
    ("SELECT 'a\\b' LIKE 'a\\b', 'a\\b' LIKE 'a_b', 'it''s'", [(True, True, "it's")]),
    ("SELECT a.key FROM samples a, samples AS b WHERE a.key = b.key + 1 AND b.name LIKE '%e%' ORDER BY 1", [(1,), (2,), (3,)]),
    ("SELECT a.key, b.key FROM samples a LEFT OUTER JOIN samples b ON a.key = b.key AND b.score > 10 ORDER BY 1", [(0, None), (1, None), (2, None), (3, 3)]),
    ("WITH t AS (SELECT key % 2 AS odd, SUM(score) AS s FROM samples GROUP BY odd) SELECT odd FROM t WHERE s > 6 ORDER BY odd", [(1,)]),
    ("SELECT key FROM samples s WHERE EXISTS (SELECT * FROM samples t WHERE t.key > s.key AND t.score < s.score) ORDER BY key DESC LIMIT 1 OFFSET 0", [(1,)]),
    ("SELECT DISTINCT key > 1 AS big FROM samples ORDER BY big", [(False,), (True,)]),
    ("SELECT COALESCE(NULL, name), CONCAT(name, NULL) FROM samples WHERE key = 2", [("aspen", None)]),
    ("SELECT NULL IN (1, 2), 3 IN (1, NULL), 1 IN (1, NULL), NOT NULL", [(None, None, True, None)]),
    ("SELECT SUM(key) FROM samples WHERE key >= 1 AND key < 3 HAVING SUM(key) > 0", [(3,)]),
]


@pytest.mark.parametrize("sql,want", GOLDEN, ids=[g[0][:40] for g in GOLDEN])
def test_select(engine, sql, want):
    assert rows(engine.execute(sql)) == want


@pytest.mark.parametrize("sql", ["", "CREATE INDEX i ON t", "ALTER TABLE t ADD c INT", "SELECT DATE_ADD('2026-01-01', INTERVAL 3 HOUR)", "SELECT SUBSTR('a')", "SELECT ~~(", "INSERT INTO samples SET key = 1", "INSERT INTO samples VALUES (1)", "UPDATE samples SET key + 1", "DELETE samples"])
def test_rejected(engine, sql):
    with pytest.raises((DialectError, ValueError, ParseException)):
        engine.execute(sql)


def test_aggregates_skip_nulls(spark, tmp_path):
    e = SqlEngine(spark, str(tmp_path))
    e.script("CREATE TABLE metrics (g STRING, v DOUBLE); CREATE TABLE empty_metrics (v DOUBLE)")
    e.execute("INSERT INTO metrics VALUES ('A', 1.0), ('A', 2.0), ('A', 2.0), ('A', NULL), ('B', NULL)")
    got = rows(e.execute("SELECT g, COUNT(*), COUNT(v), SUM(v), AVG(v), MIN(v), MAX(v), COUNT(DISTINCT v) FROM metrics GROUP BY g ORDER BY g"))
    assert got == [("A", 4, 3, 5.0, 5 / 3, 1.0, 2.0, 2), ("B", 1, 0, None, None, None, None, 0)]
    assert rows(e.execute("SELECT COUNT(*), SUM(v), AVG(v), MIN(v), MAX(v) FROM empty_metrics")) == [(0, None, None, None, None)]


def test_order_entry_round_trip(spark, tmp_path):
    e = SqlEngine(spark, str(tmp_path))
    e.script("""
        CREATE TABLE stock (i INT64, w INT64, quantity INT64, ytd NUMERIC, PRIMARY KEY (i));
        CREATE TABLE line (o INT64, n INT64, i INT64, amount NUMERIC, done TIMESTAMP);
        INSERT INTO stock VALUES (1, 1, 15, 0.0), (2, 1, 8, 0.0);
        INSERT INTO line (o, n, i, amount) VALUES (100, 1, 1, 17.5), (100, 2, 2, 25);
    """)
    changed = rows(e.execute("UPDATE stock SET quantity = CASE WHEN quantity >= 10 THEN quantity - 5 ELSE quantity + 86 END, ytd = ytd + 5 WHERE w = 1 AND i = 1"))
    assert changed == [("update", 1)]
    assert rows(e.execute("SELECT quantity, ytd FROM stock ORDER BY i")) == [(10, 5.0), (8, 0.0)]
    assert rows(e.execute("SELECT SUM(amount) FROM line WHERE o = 100")) == [(42.5,)]
    assert rows(e.execute("SELECT COUNT(DISTINCT i) FROM stock WHERE quantity < 20 AND i IN (SELECT i FROM line)")) == [(2,)]
    assert rows(e.execute("UPDATE line SET done = CURRENT_TIMESTAMP() WHERE n = 1")) == [("update", 1)]
    assert rows(e.execute("DELETE FROM line WHERE done IS NULL")) == [("delete", 1)]
    assert rows(e.execute("SELECT n FROM line")) == [(1,)]
    assert rows(e.execute("INSERT INTO line SELECT o + 1, n, i, amount, done FROM line")) == [("insert", 1)]
    assert rows(e.execute("DELETE FROM line")) == [("delete", 2)]


def test_snapshots_and_conflicts(spark, tmp_path):
    store = VersionedStore(spark, str(tmp_path))
    schema = types.schema([("a", "INT"), ("b", "STRING")])
    t = store.create("t", schema)
    with pytest.raises(ConflictError):
        store.create("t", schema)
    t.insert(spark.createDataFrame([(1, "x"), (2, None)], "a long, b string"))
    before = t.read()
    t.update({"b": F.lit("y")}, F.col("b") == "x")
    t.delete(F.col("b") == "nothing")
    assert t.version == 2 and sorted(rows(before)) == [(1, "x"), (2, None)] and sorted(rows(t.read())) == [(1, "y"), (2, None)]
    assert sorted(rows(t.read(1))) == [(1, "x"), (2, None)]
    with pytest.raises(ConflictError):
        store.commit("t", 2, schema, [])
    with pytest.raises(ValueError):
        t.update({"z": F.lit(1)})
    with pytest.raises(ValueError):
        t.insert(spark.createDataFrame([(1, "x")], "a long, b string"), ["a", "A"])
    store.drop("t")
    assert store.tables() == []
    with pytest.raises(KeyError):
        store.table("t")


def test_types():
    assert types.sql_type("varchar(20)") == T.StringType() and types.sql_type("NUMERIC") == T.DoubleType()
    for bad in types.REJECTED:
        with pytest.raises(ValueError):
            types.sql_type(bad)
    with pytest.raises(ValueError):
        types.schema([("a", "INT"), ("A", "INT")])


def test_statements_are_split_outside_literals_and_comments():
    assert list(split_statements("SELECT 'a;b'; -- c;d\n/* ; */ SELECT 2;;")) == ["SELECT 'a;b'", "-- c;d\n/* ; */ SELECT 2"]


@pytest.mark.parametrize("text", ["SELECT 'it''s' FROM t WHERE a LIKE '%\\x%'", "SELECT a.b, -1e3 FROM \"t\"", "select substr(f(a, b), 2)"])
def test_rewritten_statements_parse(spark, text):
    spark._jsparkSession.sessionState().sqlParser().parsePlan(to_spark(text))


def test_division(spark):
    df = spark.createDataFrame([(7, 2), (-7, 2), (7, 0), (None, 1)], "a long, b long")
    assert rows(df.select(int_div("a", "b"), safe_div("a", "b"), safe_mod("a", "b"))) == [(3, 3.5, 1), (-3, -3.5, -1), (None, None, None), (None, None, None)]


@pytest.mark.parametrize("pattern,want", [("%b%", ["ab", "b", "a\\b", "b%"]), ("b%", ["b", "b%"]), ("%b", ["ab", "b", "a\\b"]), ("_b", ["ab"]), ("a\\b", ["a\\b"]), ("%", ["ab", "b", "a\\b", "", "b%"]), ("", [""])])
def test_like_has_no_escape(spark, pattern, want):
    df = spark.createDataFrame([("ab",), ("b",), ("a\\b",), ("",), (None,), ("b%",)], "s string")
    assert [r.s for r in df.filter(like("s", pattern)).collect()] == want


def test_substr(spark):
    df = spark.createDataFrame([("häuser",), ("",), (None,)], "s string")
    assert rows(df.select(substr("s", -3, 2), substr("s", 2), substr("s", 2, -1), substr("s", 99))) == [("hä", "äuser", "", ""), ("", "", "", ""), (None,) * 4]


@pytest.mark.parametrize("keys,want", [([1, 2], [3]), ([1, None], []), ([], [1, 3, None]), ([None], [])])
def test_not_in(spark, keys, want):
    left = spark.createDataFrame([(1,), (3,), (None,)], "a long")
    right = spark.createDataFrame([(k,) for k in keys], "b long")
    assert [r.a for r in null_aware_anti(left, right, "a", "b").collect()] == want
    sql = [r.a for r in left.join(right, (left.a == right.b) | (left.a == right.b).isNull(), "left_anti").collect()]
    assert sorted(map(str, sql)) == sorted(map(str, want))


@pytest.mark.parametrize(("n", "m", "size"), [(0, 5, 4), (5, 0, 4), (1, 1, 4), (40, 9, 4), (9, 40, 4), (120, 2, 1)])
def test_block_join(spark, n, m, size):
    """Each pair once, with nulls, NaN, ties and repeated rows; more blocks wanted than there may be in the last case."""
    value = lambda k: None if k % 7 == 3 else float("nan") if k % 11 == 5 else float(k % 6)
    left, right = ([(k // 2, value(k // 2)) for k in range(c)] for c in (n, m))
    a, b = (qualify(spark.createDataFrame(x, "k int, v double"), name) for x, name in ((left, "a"), (right, "b")))
    got = block_join(a, b, (F.col("a.v") < F.col("b.v")) & (F.col("a.k") != F.col("b.k")), size)
    assert got.columns == ["k", "v", "k", "v"]
    less = lambda x, y: None not in (x, y) and x == x and (y != y or x < y)
    assert sorted(rows(got.select("a.k", "b.k"))) == sorted((k, j) for k, x in left for j, y in right if less(x, y) and k != j)


def test_block_join_of_a_table_with_itself(spark):
    t = spark.range(50)
    got = block_join(qualify(t, "a"), qualify(t, "b"), F.col("a.id") < F.col("b.id"), 8)
    assert sorted(rows(got.select("a.id", "b.id"))) == [(i, j) for i in range(50) for j in range(i + 1, 50)]


def test_theta_join_shares_its_pairs(spark, tmp_path):
    """One small file, many pairs: several tasks return them, all of them, and no side is sent to all tasks."""
    import duckdb

    from lakeplan import plans

    duckdb.sql(f"COPY (SELECT k AS s_suppkey, CAST(k % 25 AS INT) AS s_nationkey, CAST(k * 7919 % 1009 AS DOUBLE) AS s_acctbal FROM range(12000) r(k)) TO '{tmp_path}/supplier.parquet'")
    got = plans.QUERIES["join_theta"](spark, str(tmp_path))
    assert "NestedLoop" not in _text(got) and "Cartesian" not in _text(got)
    parts = got.groupBy(F.spark_partition_id()).agg(F.count("*"), F.sum("low"), F.sum("high")).collect()
    want = duckdb.sql(f"WITH supplier AS (FROM '{tmp_path}/supplier.parquet') SELECT COUNT(*), SUM(low), SUM(high) FROM ({plans.ORACLES['join_theta']})").fetchall()[0]
    assert tuple(sum(p[k] for p in parts) for k in (1, 2, 3)) == want
    assert len(parts) > 2 and max(p[1] for p in parts) < 0.7 * want[0]


def test_statistics(spark):
    df = spark.createDataFrame([(i % 10, None if i % 4 == 0 else "x") for i in range(400)], "a long, b string")
    assert sorted(rows(column_stats(df, exact=True))) == [("a", 400, 0, 10, "0", "9"), ("b", 400, 100, 1, "x", "x")]
    assert dict(rows(histogram(df, "a", 5))) == {0: 1.0, 1: 3.0, 2: 5.0, 3: 7.0, 4: 9.0}
    assert rows(most_common(df, "b")) == [("x", 300)]
    assert rows(extremes(df, "a", 2)) == [("low", "0"), ("low", "1"), ("high", "9"), ("high", "8")]
    assert rows(selectivity(df, F.col("a") < 5, F.col("b").isNull())) == [(0.15,)]
    empty = df.limit(0)
    assert rows(selectivity(empty, F.col("a") < 5)) == [(None,)] and rows(column_stats(empty))[0] == ("a", 0, 0, 0, None, None)


HASHED = "pmod(xxhash64(id), 1000000)"
ODD = "CASE WHEN id % 50 = 0 THEN DOUBLE('NaN') WHEN id % 51 = 0 THEN DOUBLE('Infinity') WHEN id % 3 = 0 THEN -0.0D WHEN id % 4 = 0 THEN NULL ELSE id / 7 - 900 END"


@pytest.mark.parametrize("value,n,buckets", [(HASHED, 20000, 16), (HASHED, 20000, 7), (HASHED, 5, 16), (ODD, 20000, 16), (ODD, 0, 16), ("CAST(NULL AS INT)", 9, 16), ("IF(id % 3 = 0, 7, pmod(hash(id), 90000))", 20000, 16), ("DATE_FROM_UNIX_DATE(pmod(hash(id), 30000) - 9000)", 20000, 16)])
def test_histogram_is_exact(spark, value, n, buckets):
    """Bound b is the value at rank (b + 1) / buckets of all values but nulls, NaN last."""
    df = spark.range(n).selectExpr(f"{value} AS a").repartition(4)
    number = "UNIX_DATE(a)" if value.startswith("DATE") else "a"
    have = sorted((float(r.a) for r in df.filter("a IS NOT NULL").selectExpr(f"{number} AS a").collect()), key=lambda x: (x != x, x))
    want = [(b, have[-(-(b + 1) * len(have) // buckets) - 1]) for b in range(buckets)] if have else []
    plain = lambda pairs: [(b, str(x + 0.0)) for b, x in pairs]
    assert plain(rows(histogram(df, "a", buckets))) == plain(want)


def test_tbl_files(spark, tmp_path):
    (tmp_path / "t.tbl").write_text("1|a b|2.5|1998-01-02|\n2||-1|1998-02-03|\n")
    got = read_tbl(spark, str(tmp_path / "t.tbl"), [("k", "INT"), ("s", "STRING"), ("v", "NUMERIC"), ("d", "DATE")])
    assert rows(got) == [(1, "a b", 2.5, datetime.date(1998, 1, 2)), (2, None, -1.0, datetime.date(1998, 2, 3))]
    (tmp_path / "bad.tbl").write_text("x|\n")
    with pytest.raises(Exception, match="MALFORMED"):
        read_tbl(spark, str(tmp_path / "bad.tbl"), [("k", "INT")]).collect()


def _text(df) -> str:
    return "\n".join(r.plan for r in explain(df).collect())


def test_plan_shapes(spark, data):
    from lakeplan import plans

    q = lambda name: _text(plans.QUERIES[name](spark, data))
    assert "LeftSemi" in q("semi_exists") and "LeftAnti" in q("anti_not_in") and "NestedLoop" not in q("semi_exists")
    assert "TakeOrderedAndProject" in q("topk") and "TakeOrderedAndProject" in q("tpch_q03")
    assert "GreaterThanOrEqual(o_totalprice,400000.0)" in q("scan_pushed")
    one = q("tpch_q06")
    assert "ReadSchema: struct<l_quantity:double,l_extendedprice:double,l_discount:double,l_shipdate:timestamp_ntz>" in one
    assert one.count("Exchange") <= 4 and "LessThan(l_quantity,25.0)" in one
    assert "Cartesian" not in "".join(q(f"tpch_q{i:02d}") for i in (2, 3, 5, 7, 8, 9, 10, 18, 20, 21))


def test_explain_analyze(spark, data):
    got = explain_analyze(spark.read.parquet(f"{data}/nation.parquet").groupBy("n_regionkey").count()).collect()
    assert got[0].step == -1 and got[0].rows == 5 and any("Aggregate" in r.operator for r in got)


def test_hints_and_partitions_change_no_result(spark, data):
    from lakeplan.operators import equi_join

    orders, customer = (spark.read.parquet(f"{data}/{n}.parquet") for n in ("orders", "customer"))
    want = None
    for hint in (None, "broadcast", "shuffle_hash", "merge"):
        got = sorted(rows(equi_join(orders, customer, [("o_custkey", "c_custkey")], hint=hint).groupBy("c_nationkey").count()))
        assert want in (None, got)
        want = got
    with pytest.raises(ValueError):
        equi_join(orders, customer, [("o_custkey", "c_custkey")], hint="fastest")


def test_stream(spark, data, tmp_path):
    from lakeplan.streaming import windowed_counts

    schema = spark.read.parquet(f"{data}/events.parquet").schema
    (tmp_path / "in").mkdir()
    (tmp_path / "in/events.parquet").symlink_to(f"{data}/events.parquet")
    stream = windowed_counts(spark.readStream.schema(schema).parquet(str(tmp_path / "in")))
    query = stream.writeStream.format("memory").queryName("counted").outputMode("complete").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    total = spark.table("counted").agg(F.sum("events")).first()[0]
    assert total == spark.read.parquet(f"{data}/events.parquet").count()


def test_command_line(tmp_path):
    run = subprocess.run([sys.executable, "-m", "lakeplan", "--tables", str(tmp_path / "t"), "--master", "local[1]"], input="CREATE TABLE a (x INT); INSERT INTO a VALUES (1), (NULL); SELECT x FROM a ORDER BY x;", capture_output=True, text=True, cwd=Path(__file__).parents[1], timeout=180)
    assert run.stdout.splitlines()[-3:] == ["x", "NULL", "1"], run.stderr[-2000:]


@pytest.mark.parametrize("sql,want", [("SELECT DATE '2024-01-01' + INTERVAL 1 DAY", date(2024, 1, 2)), ("SELECT DATE '2024-01-31' + INTERVAL 1 MONTH", date(2024, 2, 29)), ("SELECT 'a' + 'b'", "ab"), ("SELECT 'a' + 'b' + 'c'", "abc"), ("SELECT CAST('5' + 3 AS BIGINT)", 8), ("SELECT CAST(3 + '5' AS BIGINT)", 8), ("SELECT 1 + 2", 3)])
def test_plus(spark, sql, want):
    from lakeplan.sql_engine import SqlEngine

    assert SqlEngine(spark).execute(sql).first()[0] == want


def test_analyze_keeps_statistics(spark, tmp_path, data):
    from lakeplan.sql_engine import SqlEngine
    from lakeplan.stats import share_below, share_equal

    e = SqlEngine(spark, str(tmp_path / "t"), data)
    e.execute("CREATE TABLE s (k INT64, v STRING, d DATE)")
    assert e.catalog.stats("s") is None
    e.execute("INSERT INTO s VALUES " + ", ".join(f"({i}, '{'abc'[i % 3]}', DATE '2024-01-{i + 1:02d}')" for i in range(30)) + ", (NULL, NULL, NULL)")
    assert [tuple(r) for r in e.execute("ANALYZE s").collect()] == [("analyze", "s", 31)]
    stats = SqlEngine(spark, str(tmp_path / "t")).catalog.stats("s")
    k = stats["columns"]["k"]
    assert (k["null_count"], k["distinct_count"], k["min_value"], k["max_value"], len(k["histogram"])) == (1, 30, "0", "29", 16)
    assert stats["columns"]["v"]["most_common"] == [["a", 10], ["b", 10], ["c", 10]] and stats["columns"]["d"]["histogram"]
    assert abs(share_below(stats, "k", 15) - 15 / 31) < 0.07 and share_equal(stats, "v", "a") == 10 / 31 and abs(share_equal(stats, "k", 29) - 1 / 31) < 1e-9
    e.execute("DELETE FROM s WHERE k = 3")
    assert e.catalog.stats("s") is None
    e.execute("ANALYZE TABLE nation")
    assert e.catalog.stats("nation")["rows"] == 25


def test_clustered_tables_prune(spark, tmp_path):
    from lakeplan.sql_engine import SqlEngine

    e = SqlEngine(spark, str(tmp_path / "t"))
    e.execute("CREATE TABLE s (k INT64, v STRING)")
    e.catalog.table("s").insert(spark.range(1000).selectExpr("(id * 37) % 1000", "'x'").repartition(4))
    before = sorted(map(tuple, e.execute("SELECT * FROM s").collect()))
    e.execute("CREATE INDEX s_k ON s (k)")
    assert sorted(map(tuple, e.execute("SELECT * FROM s").collect())) == before
    parts = e.execute("SELECT k FROM s").selectExpr("k", "input_file_name() f").groupBy("f").agg({"k": "min"}).toDF("f", "lo").orderBy("lo").collect()
    assert len(parts) >= 1 and e.catalog.table("s").version == 2
    with pytest.raises(ValueError):
        e.catalog.table("s").cluster(["nope"])


def test_registered_functions(spark):
    from lakeplan.sql_engine import SqlEngine

    def twice(x: pa.Array) -> pa.Array:
        return pc.multiply(x, 2)

    e = SqlEngine(spark)
    e.catalog.register("twice", twice, "bigint")
    assert e.catalog.functions == {"twice": 1} and e.execute("SELECT twice(CAST(21 AS BIGINT))").first()[0] == 42
