"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints that differ in at most 2 h bits have a value in the middle, at
most h bits from both. So every distinct fingerprint stands for all variants
within h bits, variants are dealt out by their own hash, and fingerprints that
share a variant are linked; the triangle inequality makes each such pair true,
and the pair is checked all the same.

For a radius of 4 a fingerprint has 2,081 variants. They are not written out:
the hash that deals them out is linear over GF(2), so a bucket's task, given the
fingerprints, makes just those variants that belong to its bucket. A fingerprint
goes to a bucket once, not once per variant. With up to ``held`` fingerprints a
few buckets do, each of which every fingerprint reaches; beyond, the number of
buckets grows until a bucket's share of the fingerprints is below ``held``, and
what is shuffled approaches one copy per variant.

Defined cases: a null or empty text has fingerprint zero; texts of fewer words
than a shingle have one shingle; documents of equal fingerprints, repeated rows
included, are linked; a null doc_id belongs to its component and is its id only
if no other is there; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import read_table, travels, written
from sparkloom.llm.components import components

travels(__name__)


@dataclass(frozen=True)
class SimHash:
    """words: of a shingle. radius: differing bits of linked fingerprints, an even
    number. buckets: the fewest, a power of two. held: fingerprints that one
    bucket's task holds at most. variants: those that it makes at a time."""

    words: int = 4
    radius: int = 4
    buckets: int = 32
    held: int = 16_000_000
    variants: int = 4_000_000
    seed: int = 42


def fingerprint(text: bytes, words: int, seed: int) -> int:
    """64 bits; each is 1 if it is set in over half of the shingles' XXH64."""
    ws = text.lower().split()
    if not ws:
        return 0
    joined = b" ".join(ws)
    ends = list(accumulate(len(w) + 1 for w in ws))
    digest = xxhash.xxh64_intdigest
    if len(ws) <= words:
        return digest(joined, seed)
    view = memoryview(joined)
    starts = [0, *ends]
    total, count = np.zeros(64, np.int64), len(ws) - words + 1
    for at in range(0, count, 1 << 16):
        upto = min(count, at + (1 << 16))
        hashes = [digest(view[a : b - 1], seed) for a, b in zip(starts[at:upto], ends[at + words - 1 : upto + words - 1], strict=True)]
        bits = np.unpackbits(np.array(hashes, np.uint64).view(np.uint8), bitorder="little").reshape(-1, 64)
        total += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(total * 2 > count, bitorder="little").view(np.uint64)[0])


def with_fingerprint(docs: DataFrame, spec: SimHash, text: str = "text", out: str = "fingerprint") -> DataFrame:
    """``docs`` with the fingerprint of each whole text, as a long of the same 64 bits."""

    def made(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            values = (fingerprint(t, spec.words, spec.seed) if t else 0 for t in batch.cast(pa.large_binary()).to_pylist())
            yield pa.array(np.fromiter(values, np.uint64, len(batch)).view(np.int64))

    made.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return docs.withColumn(out, F.arrow_udf(made, "long")(F.col(text)))


class Dealing:
    """The variants' masks and the linear hash that deals variants into 2 ** bits cells."""

    def __init__(self, radius: int, bits: int, seed: int):
        if radius % 2:
            raise ValueError("the radius must be even")
        self.masks = np.array([sum(1 << b for b in c) for k in range(radius // 2 + 1) for c in combinations(range(64), k)], np.uint64)
        self.rows = np.random.default_rng(seed).integers(0, 2**64, 40, np.uint64)  # the first rows stay the same for any number of bits
        self.bits = bits
        self.cells = self.cell(self.masks)

    def cell(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x), np.int64)
        for j in range(self.bits):
            out |= (np.bitwise_count(x & self.rows[j]) & 1).astype(np.int64) << j
        return out


def deal_bits(n: int, spec: SimHash) -> int:
    """Bits of the bucket's number: the fewest with which no bucket gets more than ``held`` fingerprints."""
    bits = spec.buckets.bit_length() - 1
    while bits < 36 and n * len(np.unique(Dealing(spec.radius, bits, spec.seed).cells)) / 2**bits > spec.held:
        bits += 1
    return bits


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest node of each node's component; edges a[i]-b[i] among n nodes."""
    label = np.arange(n)
    while len(a):
        x, y = label[a], label[b]
        some = x != y
        a, b, x, y = a[some], b[some], x[some], y[some]
        if not len(a):
            break
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while True:
            up = label[label]
            if np.array_equal(up, label):
                break
            label = up
    return label


def tops(label: np.ndarray, nodes: np.ndarray) -> np.ndarray:
    """The tree's root of each of ``nodes``; label: every node's parent, roots are their own."""
    while True:
        up = label[nodes]
        if np.array_equal(up, nodes):
            return nodes
        nodes = up


def bucket_links(values: np.ndarray, bucket: int, bits: int, spec: SimHash) -> tuple[np.ndarray, np.ndarray]:
    """(child, root): a spanning forest of the fingerprints that share variants of this bucket, each with its tree's smallest."""
    values = np.unique(values)
    extra = 0
    whole = len(Dealing(spec.radius, 0, spec.seed).masks)
    while extra < 20 and len(values) * whole / 2 ** (bits + extra) > spec.variants:
        extra += 1
    deal = Dealing(spec.radius, bits + extra, spec.seed)
    cell = deal.cell(values)
    order = np.argsort(cell, kind="stable")
    held = values[order]
    start = np.searchsorted(cell[order], np.arange(2 ** (bits + extra) + 1))
    label = np.arange(len(held))
    for part in range(2**extra):
        into = bucket | part << bits
        source = into ^ deal.cells
        lo, hi = start[source], start[source + 1]
        some = np.flatnonzero(hi > lo)
        if not len(some):
            continue
        made = np.concatenate([held[lo[j] : hi[j]] ^ deal.masks[j] for j in some])
        ordered = np.sort(made)
        twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
        del ordered
        if not len(twice):
            continue
        mix = np.uint64(0x9E3779B97F4A7C15)
        seen = np.zeros(1 << 22, bool)
        seen[(twice * mix) >> np.uint64(42)] = True
        at = np.flatnonzero(seen[(made * mix) >> np.uint64(42)])
        made = made[at]
        where = np.minimum(np.searchsorted(twice, made), len(twice) - 1)
        real = twice[where] == made
        at, where = at[real], where[real]
        offset = np.concatenate([[0], np.cumsum(hi[some] - lo[some])])
        j = np.searchsorted(offset, at, side="right") - 1
        node = lo[some][j] + at - offset[j]
        first = np.full(len(twice), len(held))
        np.minimum.at(first, where, node)
        a, b = first[where], node
        near = np.bitwise_count(held[a] ^ held[b]) <= spec.radius
        a, b = a[near], b[near]
        a, b = tops(label, a), tops(label, b)
        touched, places = np.unique(np.concatenate([a, b]), return_inverse=True)
        label[touched] = touched[forest(len(touched), places[: len(a)], places[len(a) :])]
    label = tops(label, label)
    # The smallest value is mostly the same one in all buckets, so that their trees fall into one star.
    least = held.copy()
    np.minimum.at(least, label, held)
    root = least[label]
    child = np.flatnonzero(held != root)
    return held[child], root[child]


def links(values: DataFrame, spec: SimHash, column: str = "fingerprint") -> DataFrame:
    """Edges (a, b) whose components are those of all links; values: distinct fingerprints.

    Each bucket gives a spanning forest of what is linked within it, each fingerprint
    with its tree's smallest, so that a large group gives no more edges than
    it has members; an edge's two need not be linked directly.
    """
    bits = deal_bits(values.count(), spec)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d = Dealing(spec.radius, bits, spec.seed)
        reached = np.zeros(2**bits, bool)
        reached[d.cells] = True
        held: list[np.ndarray] = []

        def flush() -> Iterator[pa.RecordBatch]:
            if not held:
                return
            x = np.concatenate(held)
            held.clear()
            cell = None if reached.all() else d.cell(x)
            for b in range(2**bits):
                own = x if cell is None else x[reached[cell ^ b]]
                if len(own):
                    yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([own.tobytes()], pa.binary())], names=["bucket", "packed"])

        for batch in batches:
            held.append(batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64))
            if sum(map(len, held)) >= 1 << 16:
                yield from flush()
        yield from flush()

    def meet(key: tuple, table: pa.Table) -> pa.Table:
        x = np.concatenate([np.frombuffer(b.as_buffer(), np.uint64) for chunk in table.column("packed").chunks for b in chunk])
        a, b = bucket_links(x, key[0].as_py(), bits, spec)
        return pa.table({"a": pa.array(a.view(np.int64)), "b": pa.array(b.view(np.int64))})

    dealt = values.select(F.col(column)).mapInArrow(deal, "bucket int, packed binary")
    return dealt.groupBy("bucket").applyInArrow(meet, "a long, b long")


def near_duplicates(docs: DataFrame, spec: SimHash | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, fingerprint, component): component is the smallest key that links lead to."""
    spec = spec or SimHash()
    prints = written(with_fingerprint(docs.select(key, text), spec, text).select(F.col(key).alias("_id"), "fingerprint"), "prints")
    classes = written(prints.groupBy("fingerprint").agg(F.min("_id").alias("_first")), "classes")
    found = components(written(links(classes.select("fingerprint"), spec), "links"), "linked")
    rooted = classes.join(found, classes["fingerprint"] == found["node"], "left").select("fingerprint", "_first", F.coalesce("root", "fingerprint").alias("_root"))
    smallest = rooted.groupBy("_root").agg(F.min("_first").alias("component"))
    named = written(rooted.select("fingerprint", "_root").join(smallest, "_root").select(F.col("fingerprint").alias("_f"), "component"), "named")
    return prints.join(named, F.col("fingerprint") == F.col("_f")).select(F.col("_id").alias(key), "fingerprint", "component")


def op3_simhash(spark, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    out = near_duplicates(docs, SimHash())
    return out.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))
