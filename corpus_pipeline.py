"""A training corpus from documents, stage by stage.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
as Parquet to the shared folder and read again as the next stage's documents. All
but the last return the columns of ``docs``. Within the pipeline a row is known by
128 bits of a hash of its doc_id and text, so that rows whose doc_id is null or stands
several times are told apart; rows equal in both are dealt with alike.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm import decontam, langid, minhash, mixing, sharding, simhash
from sparkloom.llm.common import read_table, small, written

#: Language identification rejects what it doesn't know, or knows with a lower probability.
LEAST_SCORE = 0.3

ROW = "_pipeline_row"


def _with_row(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.concat(F.lit("="), F.col("text")), F.lit(""))
    return docs.withColumn(ROW, F.unhex(F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), text))))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known. A null, empty or letterless text goes; a null lang gets the prediction.
    Without any labelled text there is nothing to learn from, and all documents with a letter stay."""
    model = langid.fit(docs)
    if model is None:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    known = langid.predict(docs, model, label="_pipeline_lang", score="_pipeline_score")
    known = known.where((F.col("_pipeline_lang") != langid.UNKNOWN) & (F.col("_pipeline_score") >= LEAST_SCORE))
    return known.withColumn("lang", F.coalesce("lang", "_pipeline_lang")).select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group, that with the smallest doc_id. Documents are linked by SimHash fingerprints over
    five-word shingles, and, as these miss most pairs with some edits, by a similarity of those shingles of 0.8 or more.

    Only what goes is joined to the texts: the rows that a smaller one stands for, and rows that stand several times."""
    rows = _with_row(docs)
    key = F.struct(F.coalesce(F.col("doc_id"), F.lit(2**63 - 1)).alias("id"), F.col(ROW).alias("row"), F.xxhash64("text").alias("t"))
    linked = written(simhash.near_duplicates(rows.withColumn("_pipeline_key", key), simhash.SimHash(words=5), key="_pipeline_key"), "pipeline-linked")
    groups = linked.select("_pipeline_key.t", F.col("component.row").alias("c"))
    found = minhash.joined(rows.select(F.xxhash64("text").alias("t"), F.col(ROW).alias("r"), "text"), groups)
    first = linked.where(F.col("_pipeline_key") == F.col("component"))
    kept = first.groupBy(F.col("_pipeline_key.row").alias(ROW)).agg(F.count(F.lit(1)).alias("_pipeline_n"), F.min("_pipeline_key").alias("_pipeline_key"))
    merged = written(found.join(kept, found["node"] == kept[ROW]).select("root", "_pipeline_key"), "pipeline-merged")
    later = merged.join(merged.groupBy("root").agg(F.min("_pipeline_key").alias("_pipeline_first")), "root").where(F.col("_pipeline_key") != F.col("_pipeline_first"))
    gone = linked.where(F.col("_pipeline_key") != F.col("component")).select(F.col("_pipeline_key.row").alias(ROW))
    gone = written(gone.unionByName(later.select(F.col("_pipeline_key.row").alias(ROW))).distinct(), "pipeline-gone")
    twins = written(kept.where("_pipeline_n > 1").select(ROW).join(gone, ROW, "left_anti"), "pipeline-twins")
    out = rows.join(small(gone), ROW, "left_anti")
    if not twins.isEmpty():
        some = small(twins)
        out = out.join(some, ROW, "left_anti").unionByName(out.join(some, ROW, "left_semi").dropDuplicates([ROW]))
    return out.select(docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no copy of a benchmark item."""
    hits = decontam.with_hits(docs, read_table(spark, sf_dir, "benchmark"), out="_pipeline_hits")
    return hits.where(F.size("_pipeline_hits") == 0).select(docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources passes over it; a pass that the target cuts off takes the whole document."""
    rows = _with_row(docs)
    plan = mixing.plan_mixture(rows, key=ROW)
    passes = plan.groupBy(ROW).agg(F.ceil(F.sum(F.size("positions")) / F.count(F.lit(1))).cast("int").alias("_pipeline_n"))
    passes = written(passes.where("_pipeline_n > 0"), "pipeline-passes")
    out = rows.join(passes.hint("shuffle_hash"), ROW)
    return out.withColumn("_pipeline_pass", F.explode(F.sequence(F.lit(1), F.col("_pipeline_n")))).select(docs.columns)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where every row goes: doc_id, size, text_crc32, shard, slot."""
    return sharding.assign_shards(docs).drop("link")


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("decontaminate", decontaminate),
    ("mix_sources", mix_sources),
    ("shard", shard),
]

#: Training a network, hashing with seeds and alignment aren't SQL; tests hold each stage against a
#: brute-force version on what the one before kept, and run() against the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
