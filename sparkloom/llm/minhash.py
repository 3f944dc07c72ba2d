"""Texts whose sets of shingles are similar: MinHash bands, then the real Jaccard similarity.

Each text has ``bands`` hashes of ``rows`` minima each. Two texts of similarity s
share one with probability 1 - (1 - s ** rows) ** bands, 0.99993 at 0.8 with the
defaults and more above; every pair that is linked has been compared shingle by
shingle. Texts that are in one group already aren't compared. The others are first
compared with one text of each band they are in, which joins large groups without
a pair for every two of their members. Of the pairs that still share a band and lie
in different groups, those are compared which may be similar at all: shingles that no
other such text has are in no intersection, which bounds the similarity of two texts
from above, and of their 120 minima ``agreeing`` must be equal, which texts of
similarity 0.8 miss with probability 10 ** -6. This goes pair by pair only in bands of
up to ``few`` texts. The texts of larger ones are all compared with their most typical
one, that with the least share of shingles no other text has. The shingles in which
each differs from it then tell which pairs can be similar: all but those that are both
similar to it have a number of differences in common that follows from their sizes, and
are looked up by the rarest of them.

Defined cases: a null text or one without words is similar to nothing; a text of
fewer words than a shingle is one shingle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.llm.common import small, travels, written
from sparkloom.llm.components import components

travels(__name__)

M = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class MinHash:
    """words: of a shingle. least: similarity of linked texts. bands, rows, agreeing, few: as above."""

    words: int = 5
    least: float = 0.8
    bands: int = 24
    rows: int = 5
    agreeing: int = 74
    few: int = 32
    seed: int = 7


def shingles(text: bytes, words: int) -> np.ndarray:
    """The distinct shingles as sorted 64-bit hashes."""
    ws = text.lower().split()
    if not ws:
        return np.zeros(0, np.uint64)
    single = np.fromiter(map(xxhash.xxh64_intdigest, ws), np.uint64, len(ws))
    count = max(1, len(ws) - words + 1)
    out = np.zeros(count, np.uint64)
    for k in range(min(words, len(ws))):
        out = out * np.uint64(0x9E3779B97F4A7C15) + single[k : k + count]
    for shift in (32, 29):
        out = (out ^ (out >> np.uint64(shift))) * np.uint64(0xBF58476D1CE4E5B9)
    return np.unique(out ^ (out >> np.uint64(32)))


def minima(of: np.ndarray, spec: MinHash) -> np.ndarray:
    """The least value of each of bands * rows hashes, of a text's shingles."""
    factors, least = _factors(spec)[0], np.full(spec.bands * spec.rows, 2**64 - 1, np.uint64)
    for at in range(0, len(of), 512):
        least = np.minimum(least, (of[at : at + 512, None] * factors).min(axis=0))
    return least ^ (least >> np.uint64(31))


def _factors(spec: MinHash) -> np.ndarray:
    return np.random.default_rng(spec.seed).integers(0, 2**63, (2, spec.bands * spec.rows), np.uint64) * np.uint64(2) + np.uint64(1)


def band_hashes(of: np.ndarray, spec: MinHash) -> np.ndarray:
    """One 64-bit hash for each band, of a text's minima."""
    mixed = (of * _factors(spec)[1]).reshape(spec.bands, spec.rows).sum(axis=1, dtype=np.uint64)
    return (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Of two sets given as sorted arrays of distinct values."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / max(1, len(a) + len(b) - both)


def _banded(texts: DataFrame, spec: MinHash) -> DataFrame:
    """(t, n, bands, least) of each distinct t with words; n: its distinct shingles, least: 8 bits of each minimum."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                sets = [shingles(t, spec.words) if t else () for t in batch.column(1).cast(pa.large_binary()).to_pylist()]
                some = np.flatnonzero([len(s) for s in sets])
                least = [minima(sets[i], spec) for i in some]
                bands = pa.array([band_hashes(x, spec).view(np.int64) for x in least], pa.list_(pa.int64()))
                bits = pa.array([(x * M >> np.uint64(56)).astype(np.uint8).view(np.int8) for x in least], pa.list_(pa.int8()))
                ids = batch.column(0).take(pa.array(some, pa.int64()))
                yield pa.RecordBatch.from_arrays([ids, pa.array([len(sets[i]) for i in some], pa.int64()), bands, bits], names=["t", "n", "bands", "least"])

    return texts.select("t", "text").mapInArrow(made, "t long, n long, bands array<long>, least array<tinyint>")


def _held(asked: DataFrame, texts: DataFrame) -> DataFrame:
    """(t, text) of the texts asked for."""
    # One row for each text, chosen by its numbers alone, so that texts are neither sorted nor aggregated.
    chosen = written(texts.groupBy("t").agg(F.min("r").alias("r")).join(asked, "t", "left_semi"), "chosen")
    return written(texts.join(small(chosen), ["t", "r"], "left_semi").select("t", "text"), "compared")


def _similar(pairs: DataFrame, held: DataFrame, spec: MinHash) -> DataFrame:
    """Those of ``pairs``, (t, u, c, d), whose texts' similarity is at least ``least``, as (a, b): their groups c and d."""
    kind = pairs.schema["c"].dataType.simpleString()

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                x, y = (batch.column(k).cast(pa.large_binary()).to_pylist() for k in ("x", "y"))
                near = pa.array([jaccard(shingles(p, spec.words), shingles(q, spec.words)) >= spec.least for p, q in zip(x, y, strict=True)], pa.bool_())
                yield batch.select(["a", "b"]).filter(near)

    both = pairs.join(held.withColumnRenamed("text", "x"), "t").join(held.select(F.col("t").alias("u"), F.col("text").alias("y")), "u")
    return both.select(F.col("c").alias("a"), F.col("d").alias("b"), "x", "y").mapInArrow(compare, f"a {kind}, b {kind}")


def _alone(held: DataFrame, spec: MinHash) -> DataFrame:
    """(t, alone): the shingles a text shares with no other one of ``held``, where there are any."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                sets = [shingles(t, spec.words) for t in batch.column(1).cast(pa.large_binary()).to_pylist()]
                ids = np.repeat(batch.column(0).to_numpy(zero_copy_only=False), [len(s) for s in sets])
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(np.concatenate(sets).view(np.int64))], names=["t", "s"])

    each = held.mapInArrow(made, "t long, s long").groupBy("s").agg(F.count(F.lit(1)).alias("n"), F.min("t").alias("t"))
    return each.where("n = 1").groupBy("t").agg(F.collect_list("s").alias("alone"))


def _differences(pairs: DataFrame, held: DataFrame, alone: DataFrame, spec: MinHash) -> DataFrame:
    """For each of ``pairs``, (t, u, c, old, d), the shingles e that one of both texts has: a row each, after one without e.

    Those that are alone have no row. With how many there are in all (apart), the shingles n of t and m of u, and
    whether both are similar (near).
    """
    names = ["t", "u", "c", "old", "d"]
    kinds = [pairs.schema[k].dataType.simpleString() for k in names[2:]]

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                x, y = ([shingles(t, spec.words) for t in batch.column(k).cast(pa.large_binary()).to_pylist()] for k in ("x", "y"))
                apart = [np.setxor1d(p, q, assume_unique=True) for p, q in zip(x, y, strict=True)]
                size = np.array([len(e) for e in apart])
                lone = (np.array(a or (), np.int64).view(np.uint64) for a in batch.column("alone").to_pylist())
                apart = [np.setdiff1d(e, a, assume_unique=True) for e, a in zip(apart, lone, strict=True)]
                rows = np.array([len(e) + 1 for e in apart])
                row, none = np.repeat(np.arange(len(x)), rows), np.zeros(rows.sum(), bool)
                none[np.cumsum(rows) - rows] = True
                e = np.zeros(len(row), np.uint64)
                e[~none] = np.concatenate(apart)
                near = np.array([jaccard(p, q) >= spec.least for p, q in zip(x, y, strict=True)])
                kept = [batch.column(k).take(pa.array(row)) for k in names]
                numbers = [pa.array(v[row]) for v in (size, np.array([len(p) for p in x]), np.array([len(q) for q in y]), near)]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(e.view(np.int64), mask=none), *numbers], names=[*names, "e", "apart", "n", "m", "near"])

    both = pairs.join(held.select(F.col("t").alias("u"), F.col("text").alias("y")), "u").join(held.withColumnRenamed("text", "x"), "t").join(alone, "t", "left")
    return both.select(*names, "x", "y", "alone").mapInArrow(made, "t long, u long, c {}, old {}, d {}, e long, apart long, n long, m long, near boolean".format(*kinds))


def _overlapping(apart: DataFrame, spec: MinHash) -> DataFrame:
    """The pairs (t, u, c, d) of texts that may be similar by what sets them apart from one text, u of ``apart``.

    Two texts differ in what only one of their sets of differences holds. So similar texts, unless both are similar
    to u, have so many differences in common, and meet in the first of them, the rarest first, with enough to follow.
    """
    share = (1 - spec.least) / (1 + spec.least)  # of the shingles of two similar texts those that one of them has, at most
    ranked = apart.withColumn("times", F.count(F.lit(1)).over(Window.partitionBy("u", "e"))).where("times > 1")
    ranked = ranked.withColumn("place", F.row_number().over(Window.partitionBy("u", "t").orderBy("times", "e"))).withColumn("left", F.count(F.lit(1)).over(Window.partitionBy("u", "t")) - F.col("place") + 1)
    common = F.col("apart") + F.when(F.col("near"), F.col("m") - F.col("n")).otherwise(-F.col("m") - F.col("n")) * share
    ranked = written(ranked.where(2 * F.col("left") >= common - 1e-6).select("u", "e", "t", "c", "old", "near", "left", (F.col("apart") - F.col("n") * share).alias("over")), "ranked")
    other = ranked.select("u", "e", *(F.col(k).alias(f"{k}2") for k in ("t", "c", "old", "near", "left", "over")))
    meet = (F.col("t") < F.col("t2")) & (F.col("c") != F.col("c2")) & ~(F.col("near") & F.col("near2"))
    meet &= 2 * F.least("left", "left2") >= F.col("over") + F.col("over2") - 1e-6
    return ranked.join(other, ["u", "e"]).where(meet).select("t", F.col("t2").alias("u"), F.col("old").alias("c"), F.col("old2").alias("d"))


def joined(texts: DataFrame, groups: DataFrame, spec: MinHash | None = None) -> DataFrame:
    """(node, root) of the groups that similar texts join to others; texts: (t, r, text), t the text's hash, r the row's; groups: (t, c), the group c of each t."""
    spec = spec or MinHash()
    signed = written(_banded(texts, spec), "bands")
    banded = written(signed.select("t", "n", "bands").dropDuplicates(["t"]).join(groups.dropDuplicates(["t"]), "t").select("t", "n", "c", F.explode("bands").alias("h")), "banded")

    def reaches(both: Column, all_: Column) -> Column:
        """Whether two texts with so many shingles in common, of so many of each together, are similar enough."""
        return both >= (all_ - both) * (spec.least - 1e-9)

    def shared(rows: DataFrame) -> DataFrame:
        """The bands in which texts of several groups lie, each with one of its texts."""
        one = F.min(F.struct(F.xxhash64("t", "h").alias("r"), F.col("t").alias("u"), F.col("n").alias("m"), F.col("c").alias("d"))).alias("o")
        return rows.groupBy("h").agg(F.min("c").alias("least"), F.max("c").alias("most"), one).where("least <> most")

    hubs = written(shared(banded).select("h", "o.u", "o.m", "o.d"), "hubs")
    first = banded.join(hubs, "h").where((F.col("c") != F.col("d")) & reaches(F.least("n", "m"), F.col("n") + F.col("m")))
    swap = F.col("t") < F.col("u")
    first = written(first.select(F.least("t", "u").alias("t"), F.greatest("t", "u").alias("u"), F.when(swap, F.col("c")).otherwise(F.col("d")).alias("c"), F.when(swap, F.col("d")).otherwise(F.col("c")).alias("d")).distinct(), "first-pairs")
    links = written(_similar(first, _held(first.select(F.explode(F.array("t", "u")).alias("t")).distinct(), texts), spec), "first-links")
    found = components(links, "joined")
    now = banded.join(found, banded["c"] == found["node"], "left").select("t", "n", F.coalesce("root", "c").alias("c"), F.col("c").alias("old"), "h")
    now = written(now, "regrouped")
    rest = written(now.join(shared(now).select("h"), "h", "left_semi"), "rest")
    asked = written(rest.select("t").distinct(), "asked")
    held = _held(asked, texts)
    alone = written(_alone(held, spec), "alone")
    about = signed.join(asked, "t", "left_semi").dropDuplicates(["t"]).join(alone.select("t", F.size("alone").alias("alone")), "t", "left")
    about = written(about.select("t", "bands", "least", (F.col("n") - F.coalesce("alone", F.lit(0))).alias("most")), "about")
    rest = written(rest.join(about, "t").where(F.col("most") >= F.col("n") * (spec.least - 1e-9)), "rest")
    typical = F.min(F.struct((1 - F.col("most") / F.col("n")).alias("odd"), F.xxhash64("t").alias("r"), F.col("t").alias("u"), F.col("n").alias("m"), F.col("old").alias("d"))).alias("o")
    sizes = rest.groupBy("h").agg(F.count(F.lit(1)).alias("rows"), F.min("c").alias("from"), F.max("c").alias("to"), typical).where(F.col("from") != F.col("to"))
    sizes = written(sizes.select("h", "rows", "o.u", "o.m", "o.d"), "sizes")
    few = rest.join(sizes.where(F.col("rows") <= spec.few).select("h"), "h", "left_semi")
    other = few.select(F.col("t").alias("u"), F.col("n").alias("m"), F.col("c").alias("e"), F.col("old").alias("d"), "h", F.col("bands").alias("bands2"), F.col("least").alias("least2"), F.col("most").alias("most2"))
    near = (F.col("t") < F.col("u")) & (F.col("c") != F.col("e")) & reaches(F.least("most", "most2"), F.col("n") + F.col("m"))
    near &= F.aggregate(F.zip_with("least", "least2", lambda x, y: (x == y).cast("int")), F.lit(0), lambda x, y: x + y) >= spec.agreeing
    near &= F.array_min(F.array_intersect("bands", "bands2")) == F.col("h")  # a pair meets in one of its bands only
    second = few.join(other, "h").where(near).select("t", "u", F.col("old").alias("c"), "d")
    many = rest.select("t", "c", "old", "h").join(sizes.where(F.col("rows") > spec.few).select("h", "u", "d"), "h").where(F.col("t") != F.col("u"))
    apart = written(_differences(written(many.select("t", "u", "c", "old", "d").distinct(), "members"), held, alone, spec), "differences")
    links = links.unionByName(apart.where("e is null and near").select(F.col("old").alias("a"), F.col("d").alias("b")))
    second = second.unionByName(_overlapping(apart.where("e is not null"), spec)).dropDuplicates(["t", "u"])
    second = written(second.join(first.select("t", "u"), ["t", "u"], "left_anti"), "second-pairs")
    return components(links.unionByName(written(_similar(second, held, spec), "second-links")), "joined")
