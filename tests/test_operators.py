"""Operators, type rules, sources and sinks."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom.errors import SourceError, TypeRuleError
from sparkloom.functions import type_rules as R
from sparkloom.operators import joins, relational
from sparkloom.sources import tables

SCHEMA = T.StructType([T.StructField("k", T.LongType()), T.StructField("name", T.StringType()), T.StructField("day", T.DateType()), T.StructField("x", T.DoubleType())])


def test_tbl_reader(spark, tmp_path):
    (tmp_path / "t.tbl").write_bytes(b"1| Ann |1990-01-02|1.5|\r\n\n2|B b|1991-03-04|2|\n3||| |\n")
    got = sorted(map(tuple, tables.read_tbl(spark, str(tmp_path / "t.tbl"), SCHEMA).collect()))
    assert [(r[0], r[1], str(r[2]), r[3]) for r in got] == [(1, "Ann", "1990-01-02", 1.5), (2, "B b", "1991-03-04", 2.0), (3, "", "None", None)]


@pytest.mark.parametrize("line", ["x|a|1990-01-01|1|", "1|a|1990-01-01|", "1|a|1990-13-01|1|", "1|a|1990-01-01|1|2|"])
def test_tbl_errors_name_the_line(spark, tmp_path, line):
    (tmp_path / "t.tbl").write_text(f"1|a|1990-01-01|1|\n{line}\n")
    with pytest.raises(Exception, match="t.tbl"):
        tables.read_tbl(spark, str(tmp_path / "t.tbl"), SCHEMA).collect()


def test_load_all_checks_counts(spark, small):
    assert set(tables.load_all(spark, small, {"region": 5})) == set(tables.TABLES)
    with pytest.raises(SourceError):
        tables.load_all(spark, small, {"region": 6})


def test_pair_file_feeds_a_general_join(spark, tmp_path):
    (tmp_path / "p.txt").write_text("3 2\n\n1 a\n1 b\n2 c\n1 x\n3 y\n")
    one, two = tables.read_pairs(spark, str(tmp_path / "p.txt"))
    got = sorted(map(tuple, joins.general_join(one, two).collect()))
    assert got == [(1, "a", 1, "x"), (1, "b", 1, "x")]
    sizes = {r["key"]: (r["m0"], r["m1"], r["pairs"]) for r in joins.group_sizes(one, two, "key").collect()}
    assert sizes == {1: (2, 1, 2), 2: (1, 0, 0), 3: (0, 1, 0)}
    (tmp_path / "q.txt").write_text("3 3\n\n1 a\n")
    with pytest.raises(SourceError):
        tables.read_pairs(spark, str(tmp_path / "q.txt"))


@pytest.mark.parametrize("form", ["parquet", "json", "csv", "orc"])
def test_sinks(spark, tmp_path, form):
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "k long, s string")
    tables.write_rows(rows, str(tmp_path / "out"), form)
    assert sorted(map(tuple, spark.read.schema(rows.schema).format(form).load(str(tmp_path / "out")).collect())) == [(1, "a"), (2, "b")]


def test_row_ids_over_several_files(spark, tmp_path):
    spark.range(100).repartition(3).write.parquet(str(tmp_path / "t"))
    got = relational.with_row_id(spark.read.parquet(str(tmp_path / "t"))).select(f"`{relational.ROW_ID}`")
    assert sorted(r[0] for r in got.collect()) == list(range(100))


def test_group_totals_both_ways(spark):
    rows = spark.createDataFrame([(1, 2.0, 1.0), (1, 3.0, 2.0), (1, 5.0, 6.0), (2, 7.0, 1.0), (None, 1.0, 1.0)], "k int, v double, o double")
    got = [tuple(r) for r in relational.sum_avg_by_key(rows, "k", "v", "o").collect()]
    assert got == [(1, 10.0, 3.0), (2, 7.0, 1.0), (None, 1.0, 1.0)]
    per_row = relational.with_group_totals(rows, "k", "v", "o").collect()
    assert sorted((str(r["k"]), r["v"], r["total"], r["mean"]) for r in per_row) == [("1", 2.0, 10.0, 3.0), ("1", 3.0, 10.0, 3.0), ("1", 5.0, 10.0, 3.0), ("2", 7.0, 7.0, 1.0), ("None", 1.0, 1.0, 1.0)]


@pytest.mark.parametrize("n", [0, 1, 2, 3, 5, 8, 9])
def test_padding(spark, n):
    out = relational.pad_to_power_of_two(spark.range(n))
    total = out.count()
    assert total == (0 if n == 0 else 1 << (n - 1).bit_length())
    assert sorted(r[0] for r in out.where(~F.col("is_dummy")).collect()) == list(range(n))


def test_expand_constants_sort_page_shuffle(spark):
    rows = spark.createDataFrame([("a", 2), ("b", 0), ("c", None), ("d", 1)], "s string, m int")
    assert sorted((r["s"], r["copy"]) for r in relational.expand(rows, "m").collect()) == [("a", 0), ("a", 1), ("d", 0)]
    assert relational.constants(rows, [1, "x"]).columns == ["col_0", "col_1"]
    ordered = relational.sort_rows(rows, [("m", False)])
    assert [r["s"] for r in ordered.collect()] == ["a", "d", "b", "c"]
    assert [r["s"] for r in relational.page(ordered, 2, 1).collect()] == ["d", "b"]
    assert sorted(r["s"] for r in relational.shuffled(rows, 3).collect()) == ["a", "b", "c", "d"]
    log = relational.AccessLog()
    log.record("a", "b")
    log.record("a")
    assert log.queries == 2 and log.touched == {"a": 2, "b": 1}


def test_type_rules():
    i, b, d, s, day, ts = T.IntegerType(), T.LongType(), T.DoubleType(), T.StringType(), T.DateType(), T.TimestampType()
    assert R.arithmetic_result("+", i, b) == b and R.arithmetic_result("*", b, d) == d
    assert R.arithmetic_result("/", i, i) == d
    assert R.arithmetic_result("%", i, b) == b and R.arithmetic_result("%", i, i) == i
    for op, x, y in (("%", d, i), ("+", s, i), ("^", i, i)):
        with pytest.raises(TypeRuleError):
            R.arithmetic_result(op, x, y)
    assert R.conversion(i, d) is R.Conversion.VALID and R.conversion(d, i) is R.Conversion.WITH_LOSS
    assert R.conversion(s, i) is R.Conversion.RUNTIME_CHECK and R.conversion(day, i) is R.Conversion.INVALID
    assert R.widens(i, b) and not R.widens(b, i) and R.widens(day, ts)
    assert R.comparable(i, d) and R.comparable(T.VarcharType(3), s) and not R.comparable(i, day)
    with pytest.raises(TypeRuleError):
        R.rank(T.BinaryType())


def test_hash_join_is_built_on_the_smaller_side(spark, small):
    from sparkloom.operators.joins import JoinStrategy, equi_join
    from sparkloom.sources.tables import read_parquet

    few, many = read_parquet(spark, small, "customer"), read_parquet(spark, small, "orders")
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "BuildLeft" in plan(equi_join(few, many, [("c_custkey", "o_custkey")], strategy=JoinStrategy.HASH))
    assert "BuildRight" in plan(equi_join(many, few, [("o_custkey", "c_custkey")], strategy=JoinStrategy.HASH))


def test_first_bad_line_is_named(spark, tmp_path):
    from pyspark.sql import types as T

    from sparkloom.errors import SourceError
    from sparkloom.sources import tables

    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("name", T.StringType())])
    (tmp_path / "good.tbl").write_text("1|a|\n\n2|b\n")
    (tmp_path / "bad.tbl").write_text("1|a|\n\n2|b|\nx|c|\n4|d|e|\n")
    load = lambda name: tables.load_all(spark, f"file://{tmp_path}", names=(name,), schemas={name: schema})
    assert load("good")["good"].count() == 2
    with pytest.raises(SourceError, match=r"bad\.tbl:4: x\|c"):
        load("bad")
    assert [r["line"] for r in tables.bad_lines(spark, f"file://{tmp_path}/bad.tbl", schema).orderBy("line").collect()] == [4, 5]


def test_folders_must_be_shared_on_a_cluster():
    from sparkloom.errors import SourceError
    from sparkloom.sources.tables import scratch

    class Session:
        def __init__(self, **conf):
            self.conf = conf

    assert scratch(Session(**{"spark.master": "yarn", "spark.checkpoint.dir": "hdfs://x/"})).startswith("hdfs://x/")
    assert scratch(Session(**{"spark.master": "local[4]"})).startswith("file://")
    for master in ("yarn", "spark://host:7077", "local-cluster[2,1,1024]"):
        with pytest.raises(SourceError):
            scratch(Session(**{"spark.master": master}))


@pytest.mark.parametrize("kind", ["string", "double", "long"])
def test_large_groups_of_a_general_join_are_dealt_out(spark, monkeypatch, kind):
    """One key's pairs are made by several tasks, and none is lost: equal rows, null data and keys, a key of one side."""
    for name, n in (("HEAVY", 1000), ("TASK_PAIRS", 20_000), ("BLOCKS", (8, 32))):
        monkeypatch.setattr(joins, name, n, raising=False)
    value = lambda i: {"string": f"v{i}", "double": -0.0 if i % 2 else 0.0, "long": i}[kind]
    one = [(1, value(i % 250)) for i in range(300)] + [(1, None)] * 3 + [(2, value(i)) for i in range(5)] + [(None, value(1)), (3, value(1))] + [(5, value(7))] * 2000
    two = [(1, value(i)) for i in range(400)] + [(2, value(i)) for i in range(7)] + [(None, value(1)), (4, None), (5, None)]
    a, b = (spark.createDataFrame(rows, f"key long, data {kind}").coalesce(1) for rows in (one, two))
    got = joins.general_join(a, b)
    expected = sorted(repr((k, x, k, y)) for k, x in one for j, y in two if k is not None and k == j)
    rows = got.withColumn("task", F.spark_partition_id()).collect()
    assert got.columns == ["key1", "data1", "key2", "data2"] and sorted(repr(tuple(r)[:4]) for r in rows) == expected
    tasks = [sum(r["task"] == t for r in rows) for t in {r["task"] for r in rows}]
    assert max(tasks) < len(rows) / 2


def test_row_ids_do_not_bring_a_file_to_one_task(spark, small):
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        plan = relational.with_row_id(tables.read_parquet(spark, small, "orders"))._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_lines_are_split_into_values_once(spark, tmp_path):
    (tmp_path / "t.tbl").write_text("1|a|1990-01-01|1|\n2|b|1990-01-01|2\n3|c|1990-01-01||\n4|d|1990-01-01|\n5|e|1990-01-01|x\n")
    bad = tables.bad_lines(spark, str(tmp_path / "t.tbl"), SCHEMA)
    assert bad._jdf.queryExecution().optimizedPlan().toString().count("split(") <= 2
    assert sorted(r["line"] for r in bad.collect()) == [4, 5]  # the third ends in an empty value


def test_pair_files_are_read_in_splits(spark, tmp_path):
    (tmp_path / "p.txt").write_bytes(b"200 100\r\n\r\n" + b"".join(b"%d a b%d\r\n" % (i % 7, i) for i in range(200)) + b"\n" + b"".join(b"%d c%d\n" % (i % 5, i) for i in range(99)) + b"-1 last")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
    try:
        with pytest.raises(SourceError):  # a blank line between the tables counts as a place
            tables.read_pairs(spark, str(tmp_path / "p.txt"))
        (tmp_path / "p.txt").write_bytes((tmp_path / "p.txt").read_bytes().replace(b"\n\n0", b"\n0"))
        one, two = tables.read_pairs(spark, str(tmp_path / "p.txt"))
        assert one.rdd.getNumPartitions() > 1
        assert sorted(map(tuple, one.collect())) == sorted((i % 7, f"a b{i}") for i in range(200))
        assert sorted(map(tuple, two.collect())) == sorted([(i % 5, f"c{i}") for i in range(99)] + [(-1, "last")])
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
