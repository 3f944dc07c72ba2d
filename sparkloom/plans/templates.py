"""Whole queries: the select-project-join forms over the tables at hand, and forms that aggregate.

Where the tables lack a column of the official query, or their dates its window,
the query is adapted; limits have a total order, so that results are exact.
"""

from __future__ import annotations

REVENUE = "l_extendedprice * (1 - l_discount)"
#: The same without rounding, so that sums don't depend on their order.
EXACT = "CAST(l_extendedprice AS DECIMAL(12,2)) * (1 - CAST(l_discount AS DECIMAL(12,2)))"
DAY = "CAST(o_orderdate AS DATE) AS o_orderdate"

JOINS = {
    "q01": "SELECT l_returnflag, l_linestatus, l_quantity, l_extendedprice, l_discount, l_tax FROM lineitem WHERE l_shipdate <= DATE '1998-09-02'",
    "q03": f"SELECT l_orderkey, l_extendedprice, l_discount, {DAY} FROM customer, orders, lineitem WHERE c_mktsegment = 'BUILDING' AND c_custkey = o_custkey AND l_orderkey = o_orderkey AND orders.o_orderdate < DATE '1995-03-15' AND l_shipdate > DATE '1995-03-15' ORDER BY orders.o_orderdate, l_orderkey, l_partkey, l_suppkey, l_linenumber LIMIT 10",
    "q04": "SELECT o_orderpriority FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE o_orderdate >= DATE '1996-07-01' AND o_orderdate < DATE '1996-10-01' AND o_orderdate < l_shipdate ORDER BY o_orderpriority",
    "q05": "SELECT n_name, l_extendedprice, l_discount FROM customer, orders, lineitem, supplier, nation, region WHERE c_custkey = o_custkey AND l_orderkey = o_orderkey AND l_suppkey = s_suppkey AND c_nationkey = s_nationkey AND s_nationkey = n_nationkey AND n_regionkey = r_regionkey AND r_name = 'ASIA' AND o_orderdate >= DATE '1997-01-01' AND o_orderdate < DATE '1998-01-01'",
    "q06": "SELECT l_extendedprice, l_discount FROM lineitem WHERE l_shipdate >= DATE '1997-01-01' AND l_shipdate < DATE '1998-01-01' AND l_discount BETWEEN 0.05 AND 0.07 AND l_quantity < 24.0",
    "q10": "SELECT c_custkey, c_name, l_extendedprice, l_discount, c_acctbal, n_name FROM nation, customer, orders, lineitem WHERE c_nationkey = n_nationkey AND o_custkey = c_custkey AND l_orderkey = o_orderkey AND o_orderdate >= DATE '1996-10-01' AND o_orderdate < DATE '1997-01-01' AND l_returnflag = 'R' ORDER BY c_custkey, l_orderkey, l_partkey, l_suppkey, l_linenumber LIMIT 20",
    "q12": "SELECT l_returnflag, o_orderpriority FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE (l_returnflag = 'A' OR l_returnflag = 'R') AND o_orderdate < l_shipdate AND l_shipdate >= DATE '1997-01-01' AND l_shipdate < DATE '1998-01-01' ORDER BY l_returnflag",
    "q14": "SELECT p_type, l_extendedprice, l_discount FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_shipdate >= DATE '1995-09-01' AND l_shipdate < DATE '1995-10-01'",
    "q15": "SELECT s_suppkey, s_name, l_extendedprice, l_discount FROM supplier JOIN lineitem ON s_suppkey = l_suppkey ORDER BY s_suppkey",
    "q17": "SELECT l_extendedprice FROM lineitem JOIN part ON p_partkey = l_partkey WHERE p_brand = 'Brand#23'",
    "q18": f"SELECT c_name, c_custkey, o_orderkey, {DAY}, o_totalprice, l_quantity FROM customer, orders, lineitem WHERE o_custkey = c_custkey AND l_orderkey = o_orderkey ORDER BY o_totalprice DESC, orders.o_orderdate, o_orderkey, l_partkey, l_suppkey, l_linenumber LIMIT 100",
    "q19": "SELECT l_extendedprice, l_discount FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_brand = 'Brand#12' AND p_type IN ('SMALL', 'PROMO') AND l_quantity >= 1.0 AND l_quantity <= 11.0 AND p_size BETWEEN 1 AND 5",
}

AGGREGATES = {
    "q01_agg": f"SELECT l_returnflag, l_linestatus, CAST(sum(CAST(l_quantity AS DECIMAL(12,2))) AS DOUBLE) AS sum_qty, CAST(sum(CAST(l_extendedprice AS DECIMAL(12,2))) AS DOUBLE) AS sum_base_price, CAST(sum({EXACT}) AS DOUBLE) AS sum_disc_price, count(*) AS count_order FROM lineitem WHERE l_shipdate <= DATE '1998-09-02' GROUP BY l_returnflag, l_linestatus ORDER BY l_returnflag, l_linestatus",
    "q03_agg": f"SELECT l_orderkey, CAST(sum({EXACT}) AS DOUBLE) AS revenue, {DAY} FROM customer, orders, lineitem WHERE c_mktsegment = 'BUILDING' AND c_custkey = o_custkey AND l_orderkey = o_orderkey AND orders.o_orderdate < DATE '1995-03-15' AND l_shipdate > DATE '1995-03-15' GROUP BY l_orderkey, orders.o_orderdate ORDER BY revenue DESC, o_orderdate, l_orderkey LIMIT 20",
    "q04_agg": "SELECT o_orderpriority, count(*) AS order_count FROM orders WHERE o_orderdate >= DATE '1996-07-01' AND o_orderdate < DATE '1996-10-01' AND EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND o_orderdate < l_shipdate) GROUP BY o_orderpriority ORDER BY o_orderpriority",
    "q05_agg": f"SELECT n_name, CAST(sum({EXACT}) AS DOUBLE) AS revenue FROM customer, orders, lineitem, supplier, nation, region WHERE c_custkey = o_custkey AND l_orderkey = o_orderkey AND l_suppkey = s_suppkey AND c_nationkey = s_nationkey AND s_nationkey = n_nationkey AND n_regionkey = r_regionkey AND r_name = 'ASIA' AND o_orderdate >= DATE '1997-01-01' AND o_orderdate < DATE '1998-01-01' GROUP BY n_name ORDER BY revenue DESC, n_name",
    "q06_agg": "SELECT CAST(sum(CAST(l_extendedprice AS DECIMAL(12,2)) * CAST(l_discount AS DECIMAL(12,2))) AS DOUBLE) AS revenue FROM lineitem WHERE l_shipdate >= DATE '1997-01-01' AND l_shipdate < DATE '1998-01-01' AND l_discount BETWEEN 0.05 AND 0.07 AND l_quantity < 24.0",
    "q06_products": "SELECT CAST(CAST(l_extendedprice AS DECIMAL(12,2)) * CAST(l_discount AS DECIMAL(12,2)) AS DOUBLE) AS product FROM lineitem WHERE l_shipdate >= DATE '1997-01-01' AND l_shipdate < DATE '1998-01-01' AND l_discount BETWEEN 0.05 AND 0.07 AND l_quantity < 24.0",
    "q10_agg": f"SELECT c_custkey, c_name, CAST(sum({EXACT}) AS DOUBLE) AS revenue, c_acctbal, n_name FROM nation, customer, orders, lineitem WHERE c_nationkey = n_nationkey AND o_custkey = c_custkey AND l_orderkey = o_orderkey AND o_orderdate >= DATE '1996-10-01' AND o_orderdate < DATE '1997-01-01' AND l_returnflag = 'R' GROUP BY c_custkey, c_name, c_acctbal, n_name ORDER BY revenue DESC, c_custkey LIMIT 20",
    "q12_agg": "SELECT l_returnflag, sum(CASE WHEN o_orderpriority = '1-URGENT' OR o_orderpriority = '2-HIGH' THEN 1 ELSE 0 END) AS high_line_count, count(*) AS line_count FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE l_returnflag IN ('A', 'R') AND o_orderdate < l_shipdate AND l_shipdate >= DATE '1997-01-01' AND l_shipdate < DATE '1998-01-01' GROUP BY l_returnflag ORDER BY l_returnflag",
    "q14_agg": f"SELECT CAST(sum(CASE WHEN p_type LIKE 'PROMO%' THEN {EXACT} ELSE 0 END) AS DOUBLE) AS promo, CAST(sum({EXACT}) AS DOUBLE) AS total FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_shipdate >= DATE '1995-09-01' AND l_shipdate < DATE '1995-10-01'",
    "q15_agg": f"WITH revenue AS (SELECT l_suppkey, CAST(sum({EXACT}) AS DOUBLE) AS total_revenue FROM lineitem GROUP BY l_suppkey) SELECT s_suppkey, s_name, total_revenue FROM supplier JOIN revenue ON s_suppkey = l_suppkey WHERE total_revenue = (SELECT max(total_revenue) FROM revenue) ORDER BY s_suppkey",
    "q17_agg": "SELECT CAST(sum(CAST(l_extendedprice AS DECIMAL(12,2))) AS DOUBLE) AS total FROM lineitem JOIN part ON p_partkey = l_partkey JOIN (SELECT l_partkey AS k, 0.2 * avg(l_quantity) AS least FROM lineitem GROUP BY l_partkey) AS a ON k = p_partkey WHERE p_brand = 'Brand#23' AND l_quantity < least",
    "q18_agg": f"SELECT c_name, c_custkey, o_orderkey, {DAY}, o_totalprice, CAST(sum(l_quantity) AS BIGINT) AS quantity FROM customer, orders, lineitem WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING sum(l_quantity) > 200) AND c_custkey = o_custkey AND o_orderkey = l_orderkey GROUP BY c_name, c_custkey, o_orderkey, orders.o_orderdate, o_totalprice ORDER BY o_totalprice DESC, o_orderdate, o_orderkey LIMIT 100",
    "q19_agg": f"SELECT CAST(sum({EXACT}) AS DOUBLE) AS revenue FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_brand = 'Brand#12' AND p_type IN ('SMALL', 'PROMO') AND l_quantity BETWEEN 1 AND 11 AND p_size BETWEEN 1 AND 5 OR p_brand = 'Brand#23' AND p_type IN ('MEDIUM', 'ECONOMY') AND l_partkey = p_partkey AND l_quantity BETWEEN 10 AND 20 AND p_size BETWEEN 1 AND 10",
}
