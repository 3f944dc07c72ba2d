"""Nearest neighbours: recall against brute force, the graph, odd rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.llm import ann
from sparkloom.llm.ann import Lists, nearest


def brute(rows, asked, k):
    usable = [(i, np.array(v)) for i, v in rows if i is not None and v is not None and None not in v and np.isfinite(np.array(v, float)).all() and np.any(v)]
    usable = list({(i, tuple(v)): (i, v) for i, v in usable}.values())
    out = {}
    for i, v in usable:
        if asked(i):
            near = sorted((float(np.sqrt(((w - v) ** 2).sum())), j) for j, w in usable if j != i)[:k]
            out[i] = [(j, d) for d, j in near]
    return out


def found(df, key="vec_id"):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((r[key], r["score"]))
        assert r["rank"] == len(out[r["query_id"]])
    return out


def recall(got, expected):
    return sum(len({j for j, _ in got.get(q, [])} & {j for j, _ in near}) for q, near in expected.items()) / max(1, sum(map(len, expected.values())))


def test_query_recall(spark, small):
    got = found(ann.op1_ann(spark, small))
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{small}/embeddings.parquet").collect()]
    expected = brute(rows, lambda i: i % 100 == 0, 10)
    assert set(got) == set(expected) and all(len(x) == 10 for x in got.values())
    assert recall(got, expected) >= 0.95


@pytest.mark.parametrize("spec", [Lists(list_size=20), Lists(list_size=20, block=16), Lists(list_size=40, sample_rows=200)])
def test_recall_of_many_lists(spark, spec):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(30, 16))
    rows = [(i, (centres[i % 30] + 0.6 * rng.normal(size=16)).tolist()) for i in range(1500)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = found(nearest(vectors, F.col("vec_id") % 25 == 0, 10, spec))
    expected = brute(rows, lambda i: i % 25 == 0, 10)
    assert recall(got, expected) >= 0.9
    truth = dict(rows)
    for q, near in got.items():
        for j, d in near:
            assert d == float(np.sqrt(((np.array(truth[j]) - np.array(truth[q])) ** 2).sum()))


def test_graph_finds_near_centroids():
    rng = np.random.default_rng(0)
    c = rng.normal(size=(600, 12)).astype(np.float32)
    graph = ann.Graph(c, *ann.centroid_graph(c, 16))
    x = rng.normal(size=(200, 12))
    ids, far = graph.search(x, 48)
    exact = ((x[:, None] - c[None]) ** 2).sum(axis=2).argsort(axis=1)[:, :10]
    assert np.mean([len(set(a) & set(b[:10])) / 10 for a, b in zip(exact, ids, strict=True)]) > 0.95
    assert (np.diff(far, axis=1) >= -1e-5).all()


def test_lists_are_balanced():
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(size=(4000, 8)) * 0.05, rng.normal(size=(1000, 8))]).astype(np.float32)
    c = ann.balanced_centroids(x, 50, Lists())
    size = np.bincount(ann._nearest(x, c), minlength=50)
    assert size.max() <= 5 * len(x) / 50


def test_equal_vectors_and_odd_rows(spark):
    same = [1.0, 2.0, 2.0]
    rows = [(i, same) for i in range(0, 40)] + [(100, [1.0, 2.0, 2.5]), (101, None), (102, [0.0, 0.0, 0.0]), (103, [1.0, None, 2.0]), (104, [float("nan"), 1.0, 1.0]), (105, [float("inf"), 0.0, 0.0]), (106, [1.0, 2.0]), (None, same), (107, [-1.0, 0.0, 0.5]), (107, [-1.0, 0.0, 0.5])]
    vectors = spark.createDataFrame([(i, v, 1, "x", 2) for i, v in rows], "vec_id long, embedding array<double>, _v int, _id string, score int")
    got = found(nearest(vectors, F.col("vec_id") % 10 == 0, 10))
    expected = brute([r for r in rows if r[0] != 106], lambda i: i % 10 == 0, 10)
    assert got == expected and [j for j, _ in got[0]] == list(range(1, 11))
    few = spark.createDataFrame([(10, [1.0]), (20, [3.0]), (30, [-1.0])], "vec_id long, embedding array<float>")
    assert found(nearest(few, F.col("vec_id") == 10)) == {10: [(20, 2.0), (30, 2.0)]}
    assert nearest(few.limit(0), F.col("vec_id") == 10).count() == 0


@pytest.mark.parametrize("beam", [64, 1])
def test_families_that_draw_centroids_get_all_rows(spark, beam):
    """Vectors with a centroid to themselves: their lists hold fewer than k, at a distance of almost 0."""
    rng = np.random.default_rng(4)
    x = [v for v in rng.normal(size=(800, 8))] + [c + 1e-4 * rng.normal(size=8) for c in 30 * rng.normal(size=(20, 8)) for _ in range(4)]
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = found(nearest(vectors, F.col("vec_id") >= 800, 10, Lists(list_size=10, beam=beam, beam_share=0.01)))
    expected = brute(rows, lambda i: i >= 800, 10)
    assert set(got) == set(expected) and all(len(near) == 10 for near in got.values())
    assert beam == 1 or recall(got, expected) >= 0.9


def test_one_id_for_several_vectors(spark):
    """Each vector of an id is a query of its own, and the others of that id are its neighbours like all rows."""
    rows = [(100, [1.0, 2.0]), (100, [5.0, 5.0]), (1, [1.0, 2.1]), (2, [1.0, 2.2]), (1, [5.0, 5.5])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    expected = []
    for i, v in rows:
        if i == 100:
            near = sorted((float(np.sqrt(((np.array(w) - v) ** 2).sum())), j) for j, w in rows if (j, w) != (i, v))[:3]
            expected += [(100, rank, j, d) for rank, (d, j) in enumerate(near, 1)]
    for _ in range(2):
        got = nearest(vectors.repartition(3), F.col("vec_id") == 100, 3).collect()
        assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got) == sorted(expected)
