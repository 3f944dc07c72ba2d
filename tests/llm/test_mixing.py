"""Mixing: against SQL, the schedules' inverses, and odd rows."""

import math

import pytest
from pyspark.sql import functions as F

from sparkloom.llm import mixing


def test_query_matches_duckdb(spark, small, duck, same):
    got = mixing.op9_mixture(spark, small).toPandas()
    same(got, duck.execute(mixing.SQL).df())


@pytest.mark.parametrize("schedule", [*mixing.CURRICULUM, mixing.Schedule(((0, 0.0), (0.25, 4.0), (0.25001, 1.0), (1, 0.5)))])
def test_time_of_inverts_the_integral(spark, schedule):
    rows = spark.range(0, 101).select((F.col("id") / 100).alias("y")).select("y", schedule.time_of(F.col("y")).alias("t")).collect()

    def area(t):
        total = 0.0
        for t0, length, w0, w1, _ in schedule.pieces():
            x = min(max(t - t0, 0), length)
            total += w0 * x + (w1 - w0) / (2 * length) * x * x
        return total

    for r in rows:
        assert math.isclose(area(r["t"]), r["y"] * schedule.weight, abs_tol=1e-6)


def test_targets_fill_up_to_their_bounds(spark):
    sizes = [("a", 10), ("b", 1000), ("c", 30), (None, 500)]
    got = {r["source"]: r["target"] for r in mixing.source_targets(spark.createDataFrame(sizes, "source string, size long"), mixing.Mix()).collect()}
    left, weights, out = 1.5 * 1540, {"a": 3, "b": 1, "c": 2, None: 3}, {}
    while True:  # as the rule says it: reshare the excess until none is above
        level = left / sum(w for s, w in weights.items() if s not in out)
        over = [s for s, w in weights.items() if s not in out and w * level > 2 * dict(sizes)[s]]
        if not over:
            break
        for s in over:
            out[s] = 2.0 * dict(sizes)[s]
            left -= out[s]
    out |= {s: w * level for s, w in weights.items() if s not in out}
    assert got == pytest.approx(out)


def test_odd_rows(odd, clashing, nothing):
    plan = mixing.plan_mixture(odd)
    rows = plan.collect()
    assert len(rows) == 12
    for r in rows:
        assert 0 <= r["taken"] <= 2 * r["size"] and len(r["positions"]) == (r["taken"] > 0) + (r["taken"] > r["size"])
        assert all(0 <= p <= 1 for p in r["positions"])
    for source in {r["source"] for r in rows}:
        own = [r for r in rows if r["source"] == source]
        assert sum(r["taken"] for r in own) == math.floor(own[0]["target"])
    key = lambda r: (str(r["doc_id"]), r["size"], str(r["source"]), r["taken"])
    assert sorted(map(key, mixing.plan_mixture(clashing).collect())) == sorted(map(key, rows))
    order = mixing.training_order(plan).collect()
    assert [r["position"] for r in order] == sorted(p for r in rows for p in r["positions"])
    assert mixing.plan_mixture(nothing).count() == 0


def test_rows_of_one_key_are_spread(spark):
    docs = spark.createDataFrame([(None, f"w {i}", "s") for i in range(400)] + [(7, f"v {i}", "s") for i in range(400)], "doc_id long, text string, source string")
    plan = mixing.plan_mixture(docs, mixing.Mix(digits=1))
    row = plan.agg({"taken": "sum", "target": "max"}).collect()[0]
    assert plan.count() == 800 and row["sum(taken)"] == int(row["max(target)"]) == 800 * 2 * 3 // 2
