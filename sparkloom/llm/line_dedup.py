"""Remove boilerplate lines: those that many distinct sites have.

A HyperLogLog sketch of the sites is built per line hash and merged by
aggregation. Lines whose estimate is far from the threshold are decided by it;
lines near the threshold get exact distinct counts. DataFrame functions only.

Defined cases: a null text has no lines and stays null; blank lines are never
boilerplate; a null site counts for nothing; repeated rows are cleaned alike;
an empty table gives an empty result. All columns of the input are passed on;
internal columns bear the prefix ``_ld_``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import read_table, written


@dataclass(frozen=True)
class Spread:
    """min_sites: distinct sites from which a line is boilerplate. lg_k: the sketch
    has 2 ** lg_k registers, a relative error of 1.04 / sqrt(2 ** lg_k). band: the
    errors around the threshold within which lines are counted exactly. max_listed:
    up to so many boilerplate hashes become a set inside the expression, and texts
    are not shuffled; beyond, hits are joined to the texts. Both give the same."""

    min_sites: int = 5
    lg_k: int = 10
    band: float = 6.0
    max_listed: int = 50_000

    def bounds(self) -> tuple[float, float]:
        error = self.band * 1.04 / 2 ** (self.lg_k / 2)
        return self.min_sites * (1 - error) - 1, self.min_sites * (1 + error) + 1


def _lines(docs: DataFrame, *keep: str) -> DataFrame:
    """(keep, _ld_at, _ld_h) of every line that is not blank; h: 64-bit hash of the trimmed line."""
    rows = docs.select(*keep, F.posexplode(F.split(F.col("_ld_text"), "\n", -1)).alias("_ld_at", "_ld_line"))
    trimmed = F.trim(F.col("_ld_line"), F.lit(" \t\r"))
    return rows.where(F.length(trimmed) > 0).select(*keep, "_ld_at", F.xxhash64(trimmed).alias("_ld_h"))


def boilerplate_hashes(lines: DataFrame, spread: Spread) -> DataFrame:
    """Line hashes (_ld_h) that at least ``min_sites`` distinct sites have."""
    low, high = spread.bounds()
    sketch = lines.groupBy("_ld_h").agg(F.hll_sketch_agg("_ld_site", F.lit(spread.lg_k)).alias("_ld_sketch"))
    spreads = written(sketch.select("_ld_h", F.hll_sketch_estimate("_ld_sketch").alias("_ld_n")).where(F.col("_ld_n") >= low), "line-spread")
    sure = spreads.where(F.col("_ld_n") > high).select("_ld_h")
    near = spreads.where(F.col("_ld_n") <= high).select("_ld_h")
    pairs = lines.where(F.col("_ld_site").isNotNull()).groupBy("_ld_h", "_ld_site").agg(F.lit(1).alias("_ld_one"))
    exact = pairs.join(near, "_ld_h", "left_semi").groupBy("_ld_h").agg(F.sum("_ld_one").alias("_ld_sites"))
    return sure.unionByName(exact.where(F.col("_ld_sites") >= spread.min_sites).select("_ld_h"))


def remove_boilerplate(docs: DataFrame, spread: Spread | None = None, text: str = "text", site: str = "source") -> DataFrame:
    """``docs`` with cleaned text, and n_lines and n_removed beside it.

    A document's identity here is the hash of its text: equal texts lose the same
    lines, so removal is worked out once for each distinct text, and a hot text
    brings its lines once.
    """
    spread = spread or Spread()
    base = docs.withColumn("_ld_text", F.col(text)).withColumn("_ld_site", F.col(site).cast("string")).withColumn("_ld_id", F.xxhash64("_ld_text"))
    lines = _lines(base, "_ld_site")
    bad = written(boilerplate_hashes(lines, spread), "line-bad")
    base = base.withColumn("_ld_parts", F.split(F.col("_ld_text"), "\n", -1))
    known = bad.limit(spread.max_listed + 1).count() <= spread.max_listed
    if known:
        listed = [r[0] for r in bad.collect()]
        own = F.transform("_ld_parts", lambda x: (F.length(F.trim(x, F.lit(" \t\r"))) > 0) & F.xxhash64(F.trim(x, F.lit(" \t\r"))).isin(listed)) if listed else F.transform("_ld_parts", lambda x: F.lit(False))
        base = base.withColumn("_ld_gone", own)
        kept = F.array_join(F.filter("_ld_parts", lambda x, i: ~F.get("_ld_gone", i)), "\n")
        out = base.withColumn(text, F.when(F.exists("_ld_gone", lambda x: x), kept).otherwise(F.col("_ld_text")))
        removed = F.size(F.filter("_ld_gone", lambda x: x))
    else:
        hits = _lines(base, "_ld_id").join(bad, "_ld_h", "left_semi")
        hits = written(hits.groupBy("_ld_id").agg(F.collect_set("_ld_at").alias("_ld_gone")), "line-hits")
        base = base.join(hits.hint("shuffle_hash"), "_ld_id", "left")
        at = F.array_except(F.sequence(F.lit(0), F.size("_ld_parts") - 1), F.col("_ld_gone"))
        kept = F.array_join(F.transform(at, lambda i: F.get(F.col("_ld_parts"), i)), "\n")
        out = base.withColumn(text, F.when(F.col("_ld_gone").isNull(), F.col("_ld_text")).otherwise(kept))
        removed = F.size("_ld_gone")
    n = F.when(F.col("_ld_text").isNull(), F.lit(0)).otherwise(F.size("_ld_parts")).cast("long")
    out = out.withColumn("n_lines", n).withColumn("n_removed", F.coalesce(removed, F.lit(0)).cast("long"))
    return out.drop("_ld_text", "_ld_site", "_ld_id", "_ld_gone", "_ld_parts")


def op8_line_dedup(spark, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    out = remove_boilerplate(docs)
    text = F.coalesce("text", F.lit(""))
    return out.select("doc_id", "n_lines", "n_removed", F.length(text).cast("long").alias("n_kept_chars"), F.sha2(text, 256).alias("kept_sha256"))


SQL = r"""
WITH l AS (SELECT doc_id, source, unnest(parts) AS line, generate_subscripts(parts, 1) AS pos
  FROM (SELECT doc_id, source, string_split(text, chr(10)) AS parts FROM documents WHERE text IS NOT NULL)),
bad AS (SELECT trim(line, ' ' || chr(9) || chr(13)) AS line FROM l WHERE trim(line, ' ' || chr(9) || chr(13)) <> '' GROUP BY 1 HAVING count(DISTINCT source) >= 5),
m AS (SELECT l.*, bad.line IS NOT NULL AS gone FROM l LEFT JOIN bad ON trim(l.line, ' ' || chr(9) || chr(13)) = bad.line),
k AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_removed, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '') AS kept FROM m GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_removed, 0)::BIGINT AS n_removed, length(coalesce(kept, ''))::BIGINT AS n_kept_chars, sha256(coalesce(kept, '')) AS kept_sha256
FROM documents d LEFT JOIN k USING (doc_id)
"""
