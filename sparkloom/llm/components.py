"""Connected components of a graph given as an edge table, by contraction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import written


def components(edges: DataFrame, label: str = "components") -> DataFrame:
    """(node, root) of every node that has an edge to another; edges: (a, b).

    In the first round a node picks the neighbour (itself included) that has most
    neighbours, so that stars end there; in each later one that whose hash for the
    round is smallest. Every edge is mapped by these picks. A component stays
    connected and keeps its nodes' picks as a chain; as the order of hashes is new
    in each round, a constant share of the nodes goes, whatever the graph's shape.
    Minima are aggregated partially, and joins have an exchange directly below each
    side, so that a hub's edges can be split. Nulls and loops are no edges.
    """
    live = written(edges.where("a <> b").select("a", "b").distinct(), label)
    picks: list[DataFrame] = []
    while not live.isEmpty():
        both = live.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(live.select(F.col("b").alias("u"), F.col("a").alias("v")))
        degree = F.lit(0).cast("long")
        if not picks:
            degrees = written(both.groupBy("u").agg(F.count(F.lit(1)).alias("n")), label)
            both = both.join(degrees.select(F.col("u").alias("v"), "n"), "v")
            degree = F.col("n")

        def ranked(name: str, n: Column) -> Column:
            return F.struct((-n).alias("d"), F.xxhash64(F.col(name), F.lit(len(picks))).alias("r"), F.col(name).alias("v"))

        best = both.groupBy("u").agg(F.min(ranked("v", degree)).alias("m"))
        if not picks:
            best = best.join(degrees, "u")
        own = ranked("u", degree)
        pick = written(best.select(F.col("u").alias("node"), F.least(F.col("m"), own)["v"].alias("to")), label)
        picks.append(pick)
        half = live.join(pick, live["a"] == pick["node"]).select(F.col("to").alias("x"), F.col("b"))
        half = half.join(pick, half["b"] == pick["node"]).select("x", F.col("to").alias("y")).where("x <> y")
        live = written(half.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), label)
    if not picks:
        return live.select(F.col("a").alias("node"), F.col("b").alias("root"))
    out = picks[-1].withColumnRenamed("to", "root")
    for pick in reversed(picks[:-1]):
        later = out.withColumnRenamed("node", "to").withColumnRenamed("root", "r")
        out = pick.join(later, "to", "left").select("node", F.coalesce("r", "to").alias("root"))
        out = written(out, label)
    return out
