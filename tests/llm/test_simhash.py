"""SimHash: fingerprints and components against brute force."""

import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from sparkloom.llm import simhash
from sparkloom.llm.components import components
from sparkloom.llm.simhash import Dealing, SimHash


def slow_fingerprint(text, words):
    ws = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not ws:
        return 0
    shingles = [" ".join(ws[i : i + words]) for i in range(max(1, len(ws) - words + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(shingles))


def slow_components(ids, values, radius):
    ids, values = list(ids), np.array(values, np.uint64)
    root = list(range(len(ids)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(ids)):
        for j in np.flatnonzero(np.bitwise_count(values[i] ^ values[:i]) <= radius):
            root[find(i)] = find(int(j))
    found = [find(i) for i in range(len(ids))]
    least = {}
    for k, i in zip(found, ids, strict=True):
        least[k] = min(x for x in (least.get(k), i) if x is not None) if least.get(k) is not None or i is not None else None
    return [least[k] for k in found]


def test_query_against_brute_force(spark, small):
    got = {r["doc_id"]: r for r in simhash.op3_simhash(spark, small).collect()}
    docs = spark.read.parquet(f"{small}/documents.parquet").orderBy("doc_id").collect()
    values = [slow_fingerprint(d["text"], 4) for d in docs]
    expected = slow_components([d["doc_id"] for d in docs], values, 4)
    assert len(got) == len(docs)
    for d, v, c in zip(docs, values, expected, strict=True):
        assert (got[d["doc_id"]]["fingerprint"], got[d["doc_id"]]["component_id"]) == (f"{v:016x}", c)
    assert len(set(expected)) < len(docs)


@pytest.mark.parametrize("spec", [SimHash(), SimHash(variants=5000), SimHash(held=20, buckets=4), SimHash(radius=2)])
def test_links_of_planted_values(spark, spec):
    rng = np.random.default_rng(3)
    values = [int(x) for x in rng.integers(0, 2**64, 60, np.uint64)]
    for v in values[:20]:  # chains of steps at, and just beyond, the radius
        for step in range(4):
            flips = rng.choice(64, spec.radius + (step == 2), replace=False)
            v ^= sum(1 << int(b) for b in flips)
            values.append(v)
    values = sorted(set(values))
    rows = spark.createDataFrame([(int(np.uint64(v).view(np.int64)),) for v in values], "fingerprint long")
    pairs = [(int(r["a"]) % 2**64, int(r["b"]) % 2**64) for r in simhash.links(rows, spec).collect()]
    root = {v: v for v in values}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        root[find(a)] = find(b)
    expected = slow_components(range(len(values)), values, spec.radius)
    assert len({find(v) for v in values}) == len(set(expected))
    by = {}
    for v, c in zip(values, expected, strict=True):
        assert by.setdefault(c, find(v)) == find(v)


def test_dealing_is_linear_and_masks_are_whole():
    d = Dealing(4, 9, 42)
    assert len(d.masks) == 2081 and len(set(d.masks.tolist())) == 2081
    x = np.random.default_rng(0).integers(0, 2**64, 500, np.uint64)
    assert (d.cell(x ^ d.masks[:500]) == d.cell(x) ^ d.cells[:500]).all()
    with pytest.raises(ValueError):
        Dealing(3, 5, 42)


def test_one_large_group_of_near_copies(spark):
    """All within two bits of one value: linked through it without a row for each pair."""
    centre = 0x0123456789ABCDEF
    values = [centre ^ (1 << a) ^ (1 << b) for a in range(64) for b in range(a)] + [centre]
    rows = spark.createDataFrame([(int(np.uint64(v).view(np.int64)),) for v in values], "fingerprint long")
    found = simhash.links(rows, SimHash())
    assert found.count() <= len(values) * SimHash().buckets
    assert components(found).select("root").distinct().count() == 1


def test_components_of_odd_graphs(spark):
    path = [(i, i + 1) for i in range(1000, 1200)]
    star = [(5, i) for i in range(6, 90)] + [(7, 8), (9, 6)]
    rows = [*path, *star, (300, 300), (400, 401), (401, 400), (None, 3)]
    got = components(spark.createDataFrame(rows, "a long, b long")).collect()
    parts = {}
    for r in got:
        parts.setdefault(r["root"], set()).add(r["node"])
    assert sorted(map(sorted, parts.values())) == [[*range(5, 90)], [400, 401], [*range(1000, 1201)]]
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_odd_rows(odd, clashing, nothing, odd_rows):
    for docs in (odd, clashing):
        rows = [(r["doc_id"], r["fingerprint"] % 2**64, r["component"]) for r in simhash.near_duplicates(docs).collect()]
        values = [slow_fingerprint(r[1], 4) for r in odd_rows]
        expected = list(zip([r[0] for r in odd_rows], values, slow_components([r[0] for r in odd_rows], values, 4), strict=True))
        assert sorted(rows, key=str) == sorted(expected, key=str)
    assert simhash.near_duplicates(nothing).select(F.col("component")).count() == 0


def test_trees_are_the_same_whatever_the_number_of_parts():
    rng = np.random.default_rng(5)
    chain = np.bitwise_xor.accumulate(np.uint64(1) << rng.permutation(64).astype(np.uint64)[:40])
    near = rng.integers(0, 2**63, 60, np.uint64)
    values = np.concatenate([chain, near, near ^ np.uint64(0b1011), near ^ np.uint64(1 << 60), rng.integers(0, 2**63, 200, np.uint64)])
    groups = []
    for variants in (10_000_000, 40_000, 2_000):
        a, b = (np.concatenate(x) for x in zip(*(simhash.bucket_links(values, k, 2, simhash.SimHash(variants=variants)) for k in range(4)), strict=True))
        known = np.unique(values)
        label = simhash.forest(len(known), np.searchsorted(known, a), np.searchsorted(known, b))
        groups.append(known[label].tolist())
    assert groups[0] == groups[1] == groups[2]
    known = np.unique(values)
    pairs = np.argwhere(np.bitwise_count(known[:, None] ^ known[None, :]) <= 4)
    assert groups[0] == known[simhash.forest(len(known), pairs[:, 0], pairs[:, 1])].tolist()
    label = np.array([0, 0, 1, 3, 2])
    assert simhash.tops(label, np.array([4, 3, 2])).tolist() == [0, 3, 0]
