"""Sharding: balance, whole groups, gapless slots, odd rows."""

import zlib

from pyspark.sql import functions as F

from sparkloom.llm import sharding
from sparkloom.llm.sharding import Shards


def checked(rows, shards=8):
    sizes = [sum(r["size"] for r in rows if r["shard"] == s) for s in range(shards)]
    for s in range(shards):
        own = sorted(r["slot"] for r in rows if r["shard"] == s)
        assert own == list(range(len(own)))
    assert all(0 <= r["shard"] < shards for r in rows)
    return sizes


def test_query(spark, small):
    rows = sharding.op7_sharding(spark, small).collect()
    docs = {r["doc_id"]: (r["text"] or "").encode() for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    assert {r["doc_id"]: (r["size"], r["text_crc32"]) for r in rows} == {d: (len(t) + 1, zlib.crc32(t)) for d, t in docs.items()}
    sizes = checked(rows)
    assert max(sizes) - min(sizes) <= 2 * max(len(t) + 1 for t in docs.values())
    again = {r["doc_id"]: (r["shard"], r["slot"]) for r in sharding.op7_sharding(spark, small).collect()}
    assert again == {r["doc_id"]: (r["shard"], r["slot"]) for r in rows}


def test_groups_stay_together_and_a_hot_one_is_split(spark):
    rows = [(i, f"group {i % 40} " + "x" * 50) for i in range(200)] + [(1000 + i, "hot " + "y" * 50) for i in range(300)] + [(2000 + i, f"single {i} " + "z" * (i % 90)) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = sharding.assign_shards(docs, Shards(cells=16, cell_rows=32)).cache()
    sizes = checked(out.collect())
    assert max(sizes) <= 1.02 * min(sizes)
    seen = sharding.cut_links(out).first()
    assert seen["links"] == 41 and seen["cut"] <= 6  # the hot one, and few at the edges
    start = sum(r["n"] > 1 for r in docs.groupBy("text").agg(F.countDistinct(F.pmod(F.xxhash64("doc_id"), F.lit(8))).alias("n")).collect())
    assert seen["cut"] < start / 4


def test_given_links(spark):
    docs = spark.createDataFrame([(i, f"text {i}", i // 5) for i in range(100)], "doc_id long, text string, site int")
    out = sharding.assign_shards(docs, Shards(count=4), link=F.xxhash64("site"))
    checked(out.collect(), 4)
    assert sharding.cut_links(out).first()["cut"] <= 7  # one for each of four shards evened out, and at three edges of the fill


def test_odd_rows(odd, clashing, nothing):
    for docs in (odd, clashing):
        rows = sharding.assign_shards(docs, Shards(count=3)).collect()
        assert len(rows) == 12
        checked(rows, 3)
        assert sorted(r["size"] for r in rows)[:3] == [1, 1, 1]
    assert sharding.assign_shards(nothing).count() == 0
