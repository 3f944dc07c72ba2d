"""The engine: statements, names, corner cases of SQL, plans, and the catalog."""

import datetime

import pytest
from pyspark.sql import types as T

from sparkloom.catalog import Catalog, TableBuilder, column, ddl
from sparkloom.engine import Engine
from sparkloom.errors import CatalogError, QueryError, SchemaError
from sparkloom.operators.joins import JoinStrategy
from sparkloom.plans.sketch import sketch_tables


@pytest.fixture(scope="module")
def engine(spark):
    e = Engine(spark)
    people = T.StructType([column("id", T.IntegerType(), primary_key=True), column("name", T.StringType()), column("age", T.IntegerType()), column("pay", T.DoubleType()), column("born", T.DateType()), column("ok", T.BooleanType())])
    d = datetime.date
    rows = [(1, "Ann", 30, 10.5, d(1990, 1, 1), True), (2, "Bob", None, 20.0, d(1985, 5, 5), False), (3, "Cy", 25, None, d(2000, 2, 29), None), (4, None, 41, 24.0, None, True), (5, "Eve", 30, 7.25, d(1990, 1, 1), False)]
    e.catalog.add("people", TableBuilder(people).insert_rows(rows).build(spark))
    towns = T.StructType([column("id", T.LongType()), column("town", T.StringType())])
    e.catalog.add("towns", TableBuilder(towns).insert_rows([(1, "X"), (1, "Y"), (3, "Z"), (None, "N"), (9, "Q")]).build(spark))
    return e


def ids(engine, where):
    return sorted(r[0] for r in engine.execute(f"SELECT id FROM people WHERE {where}").collect())


@pytest.mark.parametrize(
    ("where", "expected"),
    [
        ("age = 30", [1, 5]), ("age != 30", [3, 4]), ("30 <= age", [1, 4, 5]), ("pay < 24", [1, 2, 5]), ("pay >= 24", [4]), ("name <= 'C'", [1, 2]), ("name > 'Bobby'", [3, 5]),
        ("name >= 'A'", [1, 2, 3, 5]), ("born = DATE '1990-01-01'", [1, 5]), ("born > DATE '1989-12-31' AND ok", [1]), ("ok OR age = 25", [1, 3, 4]), ("NOT ok", [2, 5]),
        ("NULL OR age = 25", [3]), ("NOT (NULL AND age = 25)", [1, 4, 5]), ("age BETWEEN 25 AND 30", [1, 3, 5]), ("id IN (2, 4, 8)", [2, 4]), ("age IS NULL", [2]), ("name LIKE '%b%'", [2]),
        ("1 = 2", []), ("1 = 1", [1, 2, 3, 4, 5]), ("age + 1 > 30 AND age * 2 < 80", [1, 5]), ("age / 4 = 7.5", [1, 5]), ("age % 5 = 0 AND pay - 0.5 = 10", [1]), ("-age < -40", [4]), ("name || 'x' = 'Annx'", [1]),
    ],
)
def test_predicates(engine, where, expected):
    assert ids(engine, where) == expected


def test_null_keys_never_match_and_duplicates_do(engine):
    got = engine.execute("SELECT p.id, town FROM people AS p JOIN towns AS t ON p.id = t.id").collect()
    assert sorted(map(tuple, got)) == [(1, "X"), (1, "Y"), (3, "Z")]


def test_outer_joins_are_outer(engine):
    assert engine.execute("SELECT * FROM people AS p LEFT JOIN towns AS t ON p.id = t.id").count() == 6
    assert engine.execute("SELECT * FROM people AS p FULL JOIN towns AS t ON p.id = t.id").count() == 8


def test_self_join_string_keys_and_three_table_predicates(engine):
    assert engine.execute("SELECT a.id FROM people a JOIN people b ON a.name = b.name").count() == 4
    got = engine.execute("SELECT a.id FROM people a, people b, towns t WHERE a.id = b.id AND a.id = t.id AND a.age + b.age > t.id + 50").collect()
    assert sorted(r[0] for r in got) == [1, 1]


def test_grouping_is_not_dropped(engine):
    got = engine.execute("SELECT age, count(*) AS n FROM people GROUP BY age HAVING count(*) > 1").collect()
    assert [tuple(r) for r in got] == [(30, 2)]
    assert engine.execute("SELECT DISTINCT ok FROM people").count() == 3
    assert engine.execute("SELECT id FROM people UNION SELECT id FROM towns").count() == 7


def test_order_limit_offset(engine):
    got = [r[0] for r in engine.execute("SELECT id FROM people ORDER BY age DESC NULLS LAST, pay LIMIT 2 OFFSET 1").collect()]
    assert got == [5, 1]


def test_division_by_zero_raises(engine):
    with pytest.raises(Exception, match="DIVIDE_BY_ZERO"):
        engine.execute("SELECT id / (id - id) AS x FROM people").collect()


@pytest.mark.parametrize("sql", ["DROP TABLE people", "INSERT INTO people VALUES (1)", "SELECT 1; SELECT 2", "SELEC 1", "SELECT nope FROM people", "SELECT id FROM people a JOIN towns b ON a.id = b.id", "SELECT * FROM missing"])
def test_refused(engine, sql):
    with pytest.raises(QueryError):
        engine.execute(sql)


def test_semicolons_in_literals_are_text(engine):
    assert engine.execute("SELECT 'a;b' AS x -- c;d\n;").first()[0] == "a;b"


def test_star_names_are_told_apart(engine):
    assert engine.execute("SELECT * FROM people AS p JOIN towns AS t ON p.id = t.id").columns == ["p_id", "name", "age", "pay", "born", "ok", "t_id", "town"]


def test_statistics(engine):
    out, stats = engine.run("SELECT id FROM people WHERE age = 30")
    assert stats.rows == 2 and stats.planning_s >= 0 and stats.execution_s > 0
    out.unpersist()


@pytest.mark.parametrize(("name", "node"), [("hash", "ShuffledHashJoin"), ("hj", "ShuffledHashJoin"), ("sort-merge", "SortMergeJoin"), ("smj", "SortMergeJoin"), ("broadcast", "BroadcastHashJoin")])
def test_join_strategies(spark, small, name, node):
    e = Engine(spark, name)
    for t in ("orders", "customer"):
        spark.read.parquet(f"{small}/{t}.parquet").createOrReplaceTempView(t)
    plan = e.explain("SELECT o_orderkey, c_name FROM orders AS o JOIN customer AS c ON o_custkey = c_custkey WHERE c_acctbal > 0").detailed
    assert node in plan


def test_unknown_strategy():
    with pytest.raises(ValueError):
        JoinStrategy.parse("nested")


def test_plans_push_down_and_prune(spark, small):
    spark.read.parquet(f"{small}/lineitem.parquet").createOrReplaceTempView("lineitem")
    shown = Engine(spark).explain("SELECT l_extendedprice FROM lineitem WHERE l_quantity < 24.0 ORDER BY l_extendedprice LIMIT 5")
    assert "PushedFilters: [IsNotNull(l_quantity), LessThan(l_quantity,24.0)]" in shown.detailed
    assert "ReadSchema: struct<l_quantity:double,l_extendedprice:double>" in shown.detailed
    assert "TakeOrderedAndProject" in shown.detailed
    assert shown.dot.startswith("digraph") and "->" in shown.dot and "Filter" in shown.text


def test_sketched_tables_let_plans_be_shown(spark):
    sql = "SELECT u.name, i.total_price FROM sk_users AS u JOIN sk_items AS i ON u.user_id = i.user_id WHERE i.is_open AND u.age > 3"
    assert sketch_tables(spark, sql) == ["sk_users", "sk_items"]
    assert Engine(spark).execute(sql).schema["total_price"].dataType == T.DoubleType()
    assert sketch_tables(spark, "SELECT * FROM sk_other") == ["sk_other"]
    assert len(spark.table("sk_other").columns) == 5


def test_catalog(spark):
    c = Catalog(spark)
    schema = T.StructType([column("a", T.LongType(), unique=True)])
    assert c.create("cat_t", schema) and not c.create("CAT_T", schema)
    assert c.row_count("cat_t") == 0 and c.names() == ["cat_t"] and c.find("none") is None
    with pytest.raises(CatalogError):
        c.table("none")
    c.clear()
    assert c.names() == [] and not spark.catalog.tableExists("cat_t")


def test_builder_and_ddl(spark):
    schema = T.StructType([column("a", T.LongType(), primary_key=True), column("b", T.StringType(), unique=True), column("c", T.DoubleType(), nullable=False)])
    with pytest.raises(SchemaError):
        TableBuilder(schema).insert_row((1, "x"))
    assert [ddl(f) for f in schema] == ["a BIGINT NOT NULL PRIMARY KEY", "b STRING UNIQUE", "c DOUBLE NOT NULL"]


def test_nulls_come_last_unless_asked_otherwise(spark):
    from sparkloom.engine import nulls_last

    engine = Engine(spark)
    spark.createDataFrame([(1, 2), (2, None), (3, 1)], "id int, x int").createOrReplaceTempView("with_nulls")
    ids = lambda sql: [r["id"] for r in engine.execute(sql).collect()]
    assert ids("SELECT id, x FROM with_nulls ORDER BY x") == [3, 1, 2]
    assert ids("SELECT id, x FROM with_nulls ORDER BY x DESC") == [1, 3, 2]
    assert ids("SELECT id, x FROM with_nulls ORDER BY x NULLS FIRST, id LIMIT 2") == [2, 3]
    assert ids("SELECT id, x FROM with_nulls ORDER BY coalesce(x, NULL), 'a, b' ASC LIMIT 2") == [3, 1]
    assert [r["n"] for r in engine.execute("SELECT id, row_number() OVER (ORDER BY x) AS n FROM with_nulls ORDER BY id").collect()] == [2, 3, 1]
    assert nulls_last("SELECT percentile_cont(0.5) WITHIN GROUP (ORDER BY x) FROM t") == "SELECT percentile_cont(0.5) WITHIN GROUP (ORDER BY x) FROM t"
    assert nulls_last("SELECT 'ORDER BY x' FROM t ORDER BY a, b DESC LIMIT 1") == "SELECT 'ORDER BY x' FROM t ORDER BY a NULLS LAST, b DESC LIMIT 1"


def test_queries_are_recorded_and_results_released(spark):
    engine = Engine(spark)
    engine.catalog.add("seen_once", spark.range(3).toDF("id"))
    out, _ = engine.run("SELECT * FROM seen_once")
    assert out.storageLevel.useMemory and engine.access.queries == 1 and engine.access.touched == {"seen_once": 1}
    engine.release()
    assert not out.storageLevel.useMemory
    engine.catalog.clear()


@pytest.mark.parametrize(
    ("sql", "hints"),
    [
        ("SELECT * FROM a JOIN b ON a.x = b.x", ["MERGE(a, b)"]),
        ("SELECT * FROM s.a AS p, b q WHERE p.x = q.x ORDER BY 1", ["MERGE(p, q)"]),
        ("SELECT x FROM (SELECT c.x FROM c LEFT SEMI JOIN d USING (x)) t CROSS JOIN a", ["MERGE(t, a)", "MERGE(c, d)"]),
        ("WITH w AS (SELECT * FROM a, b) SELECT extract(YEAR FROM y), x IS DISTINCT FROM z FROM w NATURAL JOIN c", ["MERGE(a, b)", "MERGE(w, c)"]),
        ("SELECT 'FROM a, b' FROM a WHERE x IN (SELECT x FROM b, c GROUP BY x, y)", ["MERGE(b, c)"]),
        ("SELECT 1 AS n UNION ALL SELECT x FROM a, b", ["MERGE(a, b)"]),
        ("SELECT /*+ BROADCAST(a) */ * FROM a, b", ["BROADCAST(a)"]),
        ("SELECT 1", []),
    ],
)
def test_hints_at_every_depth(sql, hints):
    import re

    assert re.findall(r"/\*\+ (.*?) \*/", JoinStrategy.SORT_MERGE.hinted(sql)) == hints


def test_strategy_reaches_joins_within_subqueries(spark, engine):
    sql = "SELECT count(*) AS n FROM (SELECT p.id FROM people p JOIN towns t ON p.id = t.id) j JOIN towns u ON j.id = u.id"
    merged = Engine(spark, "sort_merge").explain(sql).detailed
    assert "SortMergeJoin" in merged and "BroadcastHashJoin" not in merged
    hashed = Engine(spark, "hash").explain(sql).detailed
    assert "ShuffledHashJoin" in hashed and "BroadcastHashJoin" not in hashed
    assert engine.execute(sql).collect() == Engine(spark, "sort_merge").execute(sql).collect()


def test_profiler_adds_up_scopes(spark, engine):
    e = Engine(spark)
    e.run("SELECT 1 AS x")
    assert not e.profiler.scopes
    e.profiler.enabled = True
    for _ in range(2):
        e.run("SELECT id FROM people")
    with pytest.raises(QueryError):
        e.run("SELECT nothing FROM people")
    e.release()
    assert {p: s.calls for p, s in e.profiler.scopes.items()} == {"run": 3, "run/plan": 3, "run/execute": 2}
    assert e.profiler.scopes["run"].seconds >= e.profiler.scopes["run/execute"].seconds > 0
    assert len(e.profiler.report().splitlines()) == 3
    assert spark.sparkContext.getLocalProperty("spark.job.description") is None
    e.profiler.reset()
    assert e.profiler.report() == ""


def test_bench_arguments_and_export(tmp_path):
    import json

    import bench

    args = bench.arguments(["--queries", "q01", "q06", "--runs", "2", "--output", "x.csv"])
    assert (args.names, args.operators, args.runs) == (["q01", "q06"], [], 2)
    assert bench.arguments([]).names == list(bench.HEADLINE)
    for wrong in (["--queries", "no_such"], ["--runs", "0"], ["--output", "x.txt"]):
        with pytest.raises(SystemExit):
            bench.arguments(wrong)
    times = {"q01": [0.5, 0.25]}
    bench.export(str(tmp_path / "t.csv"), times)
    assert (tmp_path / "t.csv").read_text().split() == ["query,run,seconds", "q01,1,0.5", "q01,2,0.25"]
    bench.export(str(tmp_path / "t.json"), times)
    assert json.loads((tmp_path / "t.json").read_text())[1] == {"query": "q01", "run": 2, "seconds": 0.25}
