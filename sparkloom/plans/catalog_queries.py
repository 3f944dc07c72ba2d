"""One registered query for each operator and whole query, and its DuckDB form."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom.catalog import TableBuilder, column
from sparkloom.engine import Engine
from sparkloom.operators import joins, relational
from sparkloom.operators.joins import JoinStrategy
from sparkloom.plans.templates import AGGREGATES, JOINS
from sparkloom.sources import tables
from sparkloom.streaming import events

Query = Callable[[SparkSession, str], DataFrame]
NAMES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return tables.read_parquet(spark, sf_dir, name)


def run_sql(sql: str, strategy: JoinStrategy | None = None) -> Query:
    """A query that reads the tables it names."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        engine = Engine(spark, strategy)
        for name in NAMES:
            if re.search(rf"\b{name}\b", sql):
                table(spark, sf_dir, name).createOrReplaceTempView(name)
        return engine.execute(sql)

    return run


#: Queries whose text Spark and DuckDB share.
SHARED: dict[str, str] = {
    **JOINS,
    **AGGREGATES,
    "p1_projection": "SELECT o_orderpriority, o_orderkey FROM orders",
    "p2_star": "SELECT * FROM nation, region WHERE n_regionkey = r_regionkey",
    "p3_constants": "SELECT 1 AS col_0, 'x' AS col_1, CAST(2.5 AS DOUBLE) AS col_2, n_nationkey FROM nation",
    "p5_expressions": "SELECT l_orderkey, l_linenumber, l_quantity + 1 AS q, l_linenumber % 2 AS odd, -l_linenumber AS minus, upper(l_returnflag) || '-' || l_linestatus AS flags FROM lineitem",
    "f1_filter": "SELECT c_custkey, c_name FROM customer WHERE c_acctbal > 5000",
    "f2_post_join_filter": "SELECT c_custkey, s_suppkey FROM customer, orders, lineitem, supplier WHERE c_custkey = o_custkey AND o_orderkey = l_orderkey AND l_suppkey = s_suppkey AND c_nationkey = s_nationkey",
    "f3_equal": "SELECT p_partkey FROM part WHERE p_size = 15",
    "f3_not_equal": "SELECT p_partkey FROM part WHERE p_size != 15",
    "f3_less": "SELECT p_partkey FROM part WHERE p_retailprice < 1200",
    "f3_less_equal": "SELECT p_partkey FROM part WHERE p_name <= 'n'",
    "f3_greater": "SELECT p_partkey FROM part WHERE 20 < p_size",
    "f3_greater_equal": "SELECT p_partkey FROM part WHERE p_brand >= 'Brand#23'",
    "f4_and_or_not": "SELECT p_partkey, CAST(p_size > 10 AND NULL AS INT) AS a, CAST(p_size > 10 OR NULL AS INT) AS o, CAST(NOT (p_size > 10) AS INT) AS n FROM part WHERE (p_size > 40 OR p_type = 'PROMO') AND NOT p_brand = 'Brand#12'",
    "f4_null_or_true": "SELECT count(*) AS n FROM nation WHERE NULL OR n_nationkey >= 0",
    "f5_between": "SELECT l_orderkey, l_quantity FROM lineitem WHERE l_quantity BETWEEN 10 AND 20",
    "f6_in": "SELECT p_partkey FROM part WHERE p_size IN (1, 5, 9) AND p_type IN ('SMALL', 'PROMO')",
    "f7_like": "SELECT c_custkey FROM customer WHERE c_mktsegment LIKE '%U%' AND c_mktsegment NOT LIKE 'B%'",
    "f8_ilike": "SELECT c_custkey FROM customer WHERE c_mktsegment ILIKE '%u%' AND c_mktsegment NOT ILIKE 'b%'",
    "f8_nulls_last": "SELECT c_custkey, x FROM (SELECT c_custkey, CASE WHEN c_custkey % 3 > 0 THEN c_nationkey END AS x FROM customer) AS t ORDER BY x, c_custkey LIMIT 100 OFFSET 80",
    "f8_null_case_exists": "SELECT n_name, CASE WHEN n_regionkey IS NULL THEN 'none' WHEN n_regionkey > 2 THEN 'high' ELSE 'low' END AS part FROM nation WHERE EXISTS (SELECT 1 FROM customer WHERE c_nationkey = n_nationkey)",
    "f9_literals": "SELECT o_orderkey FROM orders WHERE o_orderdate = DATE '1997-03-01' OR TRUE AND o_totalprice < -1 OR o_orderstatus = 'F' AND o_totalprice > 400000.5",
    "f9_no_column": "SELECT n_name FROM nation WHERE 1 = 2",
    "j4_join_on": "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey",
    "j5_comma_join": "SELECT s_name, n_name FROM supplier, nation WHERE s_nationkey = n_nationkey AND n_regionkey = 1",
    "j6_multi_way": "SELECT l_orderkey, c_name, n_name, r_name FROM lineitem, orders, customer, nation, region WHERE l_orderkey = o_orderkey AND o_custkey = c_custkey AND c_nationkey = n_nationkey AND n_regionkey = r_regionkey AND l_quantity > 45",
    "j6_aliases": "SELECT a.n_name AS one, b.n_name AS two FROM nation AS a JOIN nation AS b ON a.n_regionkey = b.n_regionkey WHERE a.n_nationkey < b.n_nationkey",
    "j_left": "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 300000",
    "j_right": "SELECT c_custkey, o_orderkey FROM orders RIGHT JOIN customer ON c_custkey = o_custkey AND o_totalprice > 300000",
    "j_full": "SELECT s_suppkey, c_custkey FROM supplier FULL JOIN customer ON s_suppkey = c_custkey AND c_nationkey = s_nationkey",
    "j_anti": "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)",
    "o1_sort": "SELECT o_orderkey, o_totalprice, o_orderstatus FROM orders ORDER BY o_orderstatus DESC, o_totalprice, o_orderkey",
    "o3_limit_offset": "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 25 OFFSET 50",
    "o4_top_k": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10",
    "u1_set_operations": "SELECT n_regionkey AS k FROM nation UNION SELECT r_regionkey FROM region EXCEPT SELECT s_nationkey FROM supplier WHERE s_nationkey > 2",
    "u2_distinct_having": "SELECT DISTINCT c_mktsegment, count(*) AS n FROM customer GROUP BY c_mktsegment HAVING count(*) > 10",
    "u3_rollup": "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)",
    "w1_window": "SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS nth FROM orders",
    "n1_arithmetic": "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity * 2 + 1 > 90 AND l_extendedprice / l_quantity < 2000 AND l_orderkey % 3 = 1",
    "n1_power": "SELECT p_partkey, CAST(power(p_size, 2) AS BIGINT) AS square FROM part WHERE power(p_size, 2) > 400",
    "n2_dates": "SELECT o_orderkey FROM orders WHERE o_orderdate >= DATE '1996-02-29' AND o_orderdate < DATE '1996-03-02'",
}


def _cents(name: str) -> F.Column:
    """A money column as whole cents: sums of it are exact in any order."""
    return F.round(F.col(name) * 100).cast("long")


def s1_row_id(spark, d):
    return relational.with_row_id(table(spark, d, "orders")).select("o_orderkey", F.col(f"`{relational.ROW_ID}`").alias("row_id"))


def s1_mask(spark, d):
    rows = relational.scan_with_mask(table(spark, d, "part"), F.col("p_size") > 25)
    return rows.select("p_partkey", F.col(f"`{relational.MASK}`").alias("mask"))


def s2_tbl(spark, d):
    rows, path = table(spark, d, "customer"), tables.scratch(spark)
    tables.write_tbl(rows, path)
    return tables.read_tbl(spark, path, rows.schema)


def s3_load_all(spark, d):
    loaded = tables.load_all(spark, d)
    out = None
    for name, df in loaded.items():
        one = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n")
        out = one if out is None else out.unionByName(one)
    return out


def s4_insert(spark, d):
    schema = T.StructType([column("id", T.LongType(), primary_key=True), column("name", T.StringType()), column("price", T.DoubleType())])
    return TableBuilder(schema).insert_row((1, "a", 1.5)).insert_rows([(2, "b", None), (3, None, 2.5)]).build(spark)


def s6_pairs(spark, d):
    supplier, customer = table(spark, d, "supplier"), table(spark, d, "customer")
    path = tables.scratch(spark)
    tables.write_pairs(_keyed(supplier, "s_nationkey", "s_name"), _keyed(customer, "c_nationkey", "c_name"), path)
    return joins.general_join(*tables.read_pairs(spark, path))


def s3_load_tbl(spark, d):
    folder, schemas = tables.scratch(spark), {}
    for name in tables.TABLES:
        rows = table(spark, d, name)
        tables.write_tbl(rows, f"{folder}/{name}.tbl")
        schemas[name] = rows.schema
    loaded = tables.load_all(spark, folder, schemas=schemas)
    return loaded["orders"].join(loaded["customer"], F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "o_orderdate", "c_name")


def _sink(form: str) -> Query:
    def run(spark, d):
        rows, path = table(spark, d, "supplier"), tables.scratch(spark)
        tables.write_rows(rows, path, form)
        return spark.read.schema(rows.schema).format(form).load(path)

    return run


def _keyed(df: DataFrame, key: str, data: str) -> DataFrame:
    return df.select(F.col(key).cast("long").alias("key"), F.col(data).alias("data"))


def _orders_of_customers(strategy: JoinStrategy) -> Query:
    def run(spark, d):
        out = joins.equi_join(table(spark, d, "customer"), table(spark, d, "orders"), [("c_custkey", "o_custkey")], strategy=strategy)
        return out.select("c_custkey", "c_name", "o_orderkey")

    return run


def j7_foreign_key(spark, d):
    out = joins.foreign_key_join(table(spark, d, "orders"), table(spark, d, "lineitem"), "o_orderkey", "l_orderkey")
    return out.select("l_orderkey", "l_extendedprice", "o_orderkey", "o_custkey")


def j8_general(spark, d):
    return joins.general_join(_keyed(table(spark, d, "supplier"), "s_nationkey", "s_suppkey"), _keyed(table(spark, d, "customer"), "c_nationkey", "c_custkey"))


def j9_string_payload(spark, d):
    return joins.general_join(_keyed(table(spark, d, "supplier"), "s_nationkey", "s_name"), _keyed(table(spark, d, "customer"), "c_nationkey", "c_name"))


def j11_edges(spark, d):
    edges = table(spark, d, "orders").select(F.col("o_custkey").alias("key"), F.col("o_orderkey").alias("data"))
    return joins.general_join(edges, edges)


def _visits(spark, d) -> DataFrame:
    return table(spark, d, "lineitem").where(F.col("l_shipdate") >= F.lit("1998-01-01").cast("date"))


def j12_visits(spark, d):
    out = joins.foreign_key_join(table(spark, d, "part"), _visits(spark, d), "p_partkey", "l_partkey")
    return out.select("l_suppkey", "l_extendedprice", "p_partkey", "p_size")


def a1_sum(spark, d):
    return relational.sum_by_key(table(spark, d, "lineitem").withColumn("cents", _cents("l_extendedprice")), "l_partkey", "cents")


def a2_sum_avg(spark, d):
    rows = table(spark, d, "lineitem").withColumn("cents", _cents("l_extendedprice"))
    return relational.sum_avg_by_key(rows, "l_suppkey", "cents", "l_linenumber")


def a2_per_row(spark, d):
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_suppkey", "l_linenumber", _cents("l_extendedprice").alias("cents"))
    return relational.with_group_totals(rows, "l_suppkey", "cents", "l_linenumber")


def a4_two_levels(spark, d):
    rows = table(spark, d, "events").withColumn("cents", _cents("value"))
    salted = rows.groupBy("event_type", F.pmod(F.xxhash64("event_id"), F.lit(16)).alias("salt")).agg(F.sum("cents").alias("part"))
    return salted.groupBy("event_type").agg(F.sum("part").alias("total"))


def a5_group_sizes(spark, d):
    return joins.group_sizes(_keyed(table(spark, d, "supplier"), "s_nationkey", "s_suppkey"), _keyed(table(spark, d, "customer"), "c_nationkey", "c_custkey"), "key")


def m1_late(spark, d):
    orders = relational.with_row_id(table(spark, d, "orders"), "o_row")
    parts = relational.with_row_id(table(spark, d, "customer"), "c_row")
    narrow = orders.select("o_row", "o_custkey").join(parts.select("c_row", "c_custkey"), F.col("o_custkey") == F.col("c_custkey")).select("o_row", "c_row")
    out = relational.late_materialized(narrow, {"o_row": orders.select("o_row", "o_orderkey"), "c_row": parts.select("c_row", "c_name")})
    return out.select("o_row", "c_row", "o_orderkey", "c_name")


def m4_padded(spark, d):
    out = relational.pad_to_power_of_two(table(spark, d, "supplier").select("s_suppkey"))
    return out.groupBy("is_dummy").agg(F.count("*").alias("n"), F.count("s_suppkey").alias("keys"))


def m7_expand(spark, d):
    return relational.expand(table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"), "l_linenumber")


def bdb1(spark, d):
    return relational.compact(table(spark, d, "events").select("user_id", "event_id"), F.col("user_id") > 88)


def bdb2(spark, d):
    return relational.sum_by_key(table(spark, d, "events").withColumn("cents", _cents("value")), "user_id", "cents")


def bdb3(spark, d):
    rows = j12_visits(spark, d).withColumn("cents", _cents("l_extendedprice"))
    return relational.sum_avg_by_key(rows, "l_suppkey", "cents", "p_size")


def st_events(spark, d):
    rows = events.run_once(events.hourly(events.event_stream(spark, f"{d}/events.parquet")), tables.scratch(spark))
    return spark.read.schema("hour timestamp, event_type string, n bigint, cents bigint").parquet(rows).withColumn("hour", F.unix_timestamp("hour"))


CENTS = "CAST(round({} * 100) AS BIGINT)"
PRICE = CENTS.format("l_extendedprice")
VISITS = "SELECT l_suppkey, l_extendedprice, p_partkey, p_size FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_shipdate >= DATE '1998-01-01'"
GENERAL = "SELECT s_nationkey::BIGINT AS key1, {} AS data1, c_nationkey::BIGINT AS key2, {} AS data2 FROM supplier JOIN customer ON s_nationkey = c_nationkey"
ORDERS_OF = "SELECT c_custkey, c_name, o_orderkey FROM customer JOIN orders ON c_custkey = o_custkey"
FOREIGN = "SELECT l_orderkey, l_extendedprice, o_orderkey, o_custkey FROM orders JOIN lineitem ON o_orderkey = l_orderkey"
SUM_AVG = "SELECT l_suppkey, sum({c})::BIGINT AS total, avg({o}) AS mean FROM ({t}) GROUP BY l_suppkey"

BUILT: dict[str, tuple[Query, str | None]] = {
    "s1_row_id": (s1_row_id, "SELECT o_orderkey, row_number() OVER () - 1 AS row_id FROM orders"),
    "s1_mask": (s1_mask, "SELECT p_partkey, p_size > 25 AS mask FROM part"),
    "s2_tbl": (s2_tbl, "SELECT * FROM customer"),
    "s3_load_all": (s3_load_all, " UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS n FROM {t}" for t in tables.TABLES)),
    "s3_load_tbl": (s3_load_tbl, "SELECT o_orderkey, o_orderdate, c_name FROM orders JOIN customer ON o_custkey = c_custkey"),
    "s4_insert": (s4_insert, "SELECT * FROM (VALUES (1::BIGINT, 'a', 1.5::DOUBLE), (2, 'b', NULL), (3, NULL, 2.5)) AS t(id, name, price)"),
    "s5_parquet": (lambda spark, d: table(spark, d, "events"), "SELECT * FROM events"),
    "s6_pairs": (s6_pairs, GENERAL.format("s_name", "c_name")),
    "s7_json": (_sink("json"), "SELECT * FROM supplier"),
    "s7_csv": (_sink("csv"), "SELECT * FROM supplier"),
    "p4_names": (run_sql("SELECT a.n_name, b.n_name FROM nation AS a JOIN nation AS b ON a.n_nationkey = b.n_regionkey"), "SELECT a.n_name AS a_n_name, b.n_name AS b_n_name FROM nation AS a JOIN nation AS b ON a.n_nationkey = b.n_regionkey"),
    "j1_hash_join": (_orders_of_customers(JoinStrategy.HASH), ORDERS_OF),
    "j2_sort_merge_join": (_orders_of_customers(JoinStrategy.SORT_MERGE), ORDERS_OF),
    "j3_strategy": (run_sql(JOINS["q12"], JoinStrategy.parse("smj")), JOINS["q12"]),
    "j7_foreign_key": (j7_foreign_key, FOREIGN),
    "j8_general": (j8_general, GENERAL.format("s_suppkey", "c_custkey")),
    "j9_string_payload": (j9_string_payload, GENERAL.format("s_name", "c_name")),
    "j10_foreign_key_twin": (run_sql(FOREIGN, JoinStrategy.SORT_MERGE), FOREIGN),
    "j11_edges": (j11_edges, "SELECT a.o_custkey AS key1, a.o_orderkey AS data1, b.o_custkey AS key2, b.o_orderkey AS data2 FROM orders AS a JOIN orders AS b ON a.o_custkey = b.o_custkey"),
    "j12_visits": (j12_visits, VISITS),
    "a1_sum": (a1_sum, f"SELECT l_partkey, sum({PRICE})::BIGINT AS total FROM lineitem GROUP BY l_partkey"),
    "a2_sum_avg": (a2_sum_avg, SUM_AVG.format(c=PRICE, o="l_linenumber", t="SELECT * FROM lineitem")),
    "a2_per_row": (a2_per_row, f"SELECT l_orderkey, l_suppkey, l_linenumber, {PRICE} AS cents, sum({PRICE}) OVER w::BIGINT AS total, avg(l_linenumber) OVER w AS mean FROM lineitem WINDOW w AS (PARTITION BY l_suppkey)"),
    "a3_sum_avg_twin": (run_sql("SELECT l_suppkey, sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS total, avg(l_linenumber) AS mean FROM lineitem GROUP BY l_suppkey ORDER BY total DESC, l_suppkey"), SUM_AVG.format(c=PRICE, o="l_linenumber", t="SELECT * FROM lineitem")),
    "a4_two_levels": (a4_two_levels, f"SELECT event_type, sum({CENTS.format('value')})::BIGINT AS total FROM events GROUP BY event_type"),
    "a5_group_sizes": (a5_group_sizes, "SELECT coalesce(a.k, b.k)::BIGINT AS key, coalesce(m0, 0) AS m0, coalesce(m1, 0) AS m1, coalesce(m0, 0) * coalesce(m1, 0) AS pairs FROM (SELECT s_nationkey AS k, count(*) AS m0 FROM supplier GROUP BY 1) AS a FULL JOIN (SELECT c_nationkey AS k, count(*) AS m1 FROM customer GROUP BY 1) AS b ON a.k = b.k"),
    "j_semi": (lambda spark, d: table(spark, d, "customer").select("c_custkey").join(table(spark, d, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_semi"), "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)"),
    "o2_order_by_output": (lambda spark, d: relational.sort_rows(table(spark, d, "supplier").select("s_name", "s_acctbal"), [("s_acctbal", False), ("s_name", True)]), "SELECT s_name, s_acctbal FROM supplier"),
    "o3_offset_alone": (lambda spark, d: relational.page(relational.sort_rows(table(spark, d, "customer").select("c_custkey"), [("c_custkey", True)]), offset=100), "SELECT c_custkey FROM customer ORDER BY c_custkey OFFSET 100"),
    "o5_sort_sums": (lambda spark, d: relational.sort_rows(a1_sum(spark, d), [("total", False), ("l_partkey", True)]), f"SELECT l_partkey, sum({PRICE})::BIGINT AS total FROM lineitem GROUP BY l_partkey"),
    "o6_first_20": (lambda spark, d: relational.page(relational.sort_rows(a1_sum(spark, d), [("total", False), ("l_partkey", True)]), 20), f"SELECT l_partkey, sum({PRICE})::BIGINT AS total FROM lineitem GROUP BY l_partkey ORDER BY total DESC, l_partkey LIMIT 20"),
    "m1_late_materialization": (m1_late, "SELECT o_row, c_row, o_orderkey, c_name FROM (SELECT *, row_number() OVER () - 1 AS o_row FROM orders) JOIN (SELECT *, row_number() OVER () - 1 AS c_row FROM customer) ON o_custkey = c_custkey"),
    "m2_shuffle": (lambda spark, d: relational.shuffled(table(spark, d, "customer"), 7), "SELECT * FROM customer"),
    "m4_padding": (m4_padded, "SELECT unnest([false, true]) AS is_dummy, unnest([n, pow(2, ceil(log2(n)))::BIGINT - n]) AS n, unnest([n, 0]) AS keys FROM (SELECT count(*) AS n FROM supplier)"),
    "m6_compaction": (lambda spark, d: relational.compact(relational.scan_with_mask(table(spark, d, "customer"), F.col("c_acctbal") < 0)), "SELECT * FROM customer WHERE c_acctbal < 0"),
    "m7_expand": (m7_expand, "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, unnest(range(l_linenumber)) AS copy FROM lineitem"),
    "bdb1_filter": (bdb1, "SELECT user_id, event_id FROM events WHERE user_id > 88"),
    "bdb2_sum": (bdb2, f"SELECT user_id, sum({CENTS.format('value')})::BIGINT AS total FROM events GROUP BY user_id"),
    "bdb3_join_sum": (bdb3, SUM_AVG.format(c=PRICE, o="p_size", t=VISITS)),
    "x_event_stream": (st_events, f"SELECT epoch(h)::BIGINT AS hour, event_type, count(*) AS n, sum({CENTS.format('value')})::BIGINT AS cents FROM (SELECT *, date_trunc('hour', ts) AS h FROM events) WHERE h + INTERVAL 2 HOUR <= (SELECT max(ts) FROM events) GROUP BY h, event_type"),
}


def queries() -> dict[str, Query]:
    return {name: run_sql(sql) for name, sql in SHARED.items()} | {name: q for name, (q, _) in BUILT.items()}


def oracle_sql() -> dict[str, str]:
    return SHARED | {name: sql for name, (_, sql) in BUILT.items() if sql is not None}
