"""Approximate nearest neighbours by balanced posting lists.

Centroids are fitted on a bounded sample and split until their lists are of
like size. Every vector goes to the list of its nearest centroid and, near a
boundary, to those of others almost as near. A search finds centroids through a
graph that is held in memory, takes the lists whose centroids are not much
farther than the nearest that hold k + 1 vectors together (all lists are looked
through where those found hold fewer), and measures exact distances within them.

Equal vectors are searched and listed once, with their smallest ids: of a
query's nearest, no more than k + 1 of a group of equal vectors can matter.
Long lists, and lists that many queries take, are cut into blocks by a hash.

Defined cases: vectors that are null, zero, of another length than most, or hold
null or non-finite components take no part; ties go to the smaller id; repeated
rows (equal id and vector) count once; a null id takes no part; with fewer
candidates than k all are returned; an empty table gives an empty result. Only
the two named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.llm.common import read_table, travels, written

travels(__name__)


@dataclass(frozen=True)
class Lists:
    """list_size: vectors that a list should have, as long as there are at most
    max_lists. sample_rows, sample_mb: bounds on what centroids are fitted on (by
    hash order of the ids). replicate: a vector goes to all lists whose centroids
    are at most this times as far as the nearest, up to ``copies``. probe: a search
    takes the lists whose centroids are at most this times as far as the nearest
    that hold k + 1 vectors together.
    beam: candidates kept in a search of the graph, for a
    query at least beam_share of all lists, so that recall doesn't fall as lists grow
    in number: in data without clusters the nearest are spread over a share of the
    lists that doesn't shrink. degree: of the graph. block:
    rows of a list, or queries of it, that meet in one task."""

    list_size: int = 128
    max_lists: int = 4096
    sample_rows: int = 65_536
    sample_mb: int = 64
    replicate: float = 1.1
    copies: int = 4
    probe: float = 1.4
    beam: int = 64
    beam_share: float = 0.16
    degree: int = 24
    block: int = 4096
    rounds: int = 6
    seed: int = 11


def _squares(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(axis=1)[:, None] - 2 * (x @ c.T) + (c * c).sum(axis=1)[None, :], 0)


def _nearest(x: np.ndarray, c: np.ndarray, step: int = 4096) -> np.ndarray:
    return np.concatenate([_squares(x[i : i + step], c).argmin(axis=1) for i in range(0, len(x), step)])


def balanced_centroids(x: np.ndarray, count: int, spec: Lists) -> np.ndarray:
    """Lloyd's iterations; after each, the centroids of the smallest lists move into the largest ones."""
    rng = np.random.default_rng(spec.seed)
    c = x[rng.permutation(len(x))[:count]].astype(np.float32)
    for turn in range(spec.rounds):
        own = _nearest(x, c)
        size = np.bincount(own, minlength=len(c))
        order = np.argsort(own, kind="stable")
        bounds = np.searchsorted(own[order], np.arange(len(c) + 1))
        for k in np.flatnonzero(size):
            c[k] = x[order[bounds[k] : bounds[k + 1]]].mean(axis=0)
        if turn + 1 < spec.rounds:
            large = [k for k in np.argsort(-size, kind="stable") if size[k] > 2 * len(x) / len(c)]
            small = [k for k in np.argsort(size, kind="stable") if size[k] < 0.3 * len(x) / len(c)]
            for into, frm in zip(large, small, strict=False):
                c[frm] = x[order[bounds[into] + int(rng.integers(size[into]))]]
    return c


def centroid_graph(c: np.ndarray, degree: int) -> tuple[np.ndarray, np.ndarray]:
    """(neighbours, entries): a directed graph, each centroid to near ones that no
    nearer neighbour covers, filled up with the nearest; entries spread over all."""
    n = len(c)
    if n == 1:
        return np.zeros((1, 1), np.int32), np.zeros(1, np.int32)
    wide = min(n - 1, 3 * degree)
    out = np.empty((n, min(degree, n - 1)), np.int32)
    for i in range(n):
        d = _squares(c[i : i + 1], c)[0]
        d[i] = np.inf
        near = np.argpartition(d, wide - 1)[:wide]
        near = near[np.argsort(d[near], kind="stable")]
        between = _squares(c[near], c[near])
        kept: list[int] = []
        for j in range(wide):
            if len(kept) == out.shape[1]:
                break
            if not kept or (between[j, kept] > d[near[j]]).all():
                kept.append(j)
        rest = [j for j in range(wide) if j not in set(kept)]
        out[i] = near[(kept + rest)[: out.shape[1]]]
    entries = [0]
    far = _squares(c[:1], c)[0]
    while len(entries) < min(n, 2 * int(np.sqrt(n)) + 1):
        entries.append(int(far.argmax()))
        far = np.minimum(far, _squares(c[entries[-1]][None], c)[0])
    return out, np.array(entries, np.int32)


class Graph:
    """Best-first search, for many vectors at once."""

    def __init__(self, c: np.ndarray, neighbours: np.ndarray, entries: np.ndarray):
        self.c, self.neighbours, self.entries = c, neighbours, entries
        self.norm = (c * c).sum(axis=1)

    def search(self, x: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """(centroids, distances), nearest first, -1 and inf where there are no more."""
        x = x.astype(np.float32)
        q, beam = len(x), min(beam, len(self.c))
        rows, norm = np.arange(q)[:, None], (x * x).sum(axis=1)
        d = norm[:, None] - 2 * (x @ self.c[self.entries].T) + self.norm[self.entries][None, :]
        take = min(beam, len(self.entries))
        best = np.argpartition(d, take - 1, axis=1)[:, :take]
        ids = np.full((q, beam), -1, np.int32)
        far = np.full((q, beam), np.inf, np.float32)
        ids[:, :take], far[:, :take] = self.entries[best], np.take_along_axis(d, best, axis=1)
        done = ids < 0
        seen = np.zeros((q, len(self.c)), bool)
        seen[:, self.entries] = True
        active = np.arange(q)
        while len(active):
            open_far = np.where(done[active], np.inf, far[active])
            pick = open_far.argmin(axis=1)
            some = np.isfinite(open_far[np.arange(len(active)), pick])
            active, pick = active[some], pick[some]
            if not len(active):
                break
            done[active, pick] = True
            near = self.neighbours[ids[active, pick]]
            new = ~seen[active[:, None], near]
            seen[active[:, None], near] = True
            dn = norm[active][:, None] - 2 * np.einsum("qd,qkd->qk", x[active], self.c[near]) + self.norm[near]
            dn = np.where(new, dn, np.inf)
            all_far = np.concatenate([far[active], dn], axis=1)
            all_ids = np.concatenate([ids[active], near], axis=1)
            all_done = np.concatenate([done[active], ~new], axis=1)
            keep = np.argpartition(all_far, beam - 1, axis=1)[:, :beam]
            far[active] = np.take_along_axis(all_far, keep, axis=1)
            ids[active] = np.take_along_axis(all_ids, keep, axis=1)
            done[active] = np.take_along_axis(all_done, keep, axis=1)
        order = np.lexsort((ids, far), axis=1)
        far = np.take_along_axis(far, order, axis=1)
        ids = np.where(np.isfinite(far), np.take_along_axis(ids, order, axis=1), -1)
        exact = np.sqrt(np.maximum(((x[:, None, :] - self.c[ids]) ** 2).sum(axis=2), 0))
        return ids, np.where(ids < 0, np.inf, exact)


def usable(v: str) -> Column:
    """Whether a vector takes part."""
    finite = F.forall(F.col(v), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(F.col(v).isNotNull() & finite & F.exists(F.col(v), lambda x: x != 0), F.lit(False))


def _matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False)).reshape(len(column), -1)


def fit(vectors: DataFrame, n: int, dim: int, spec: Lists) -> Graph:
    """Centroids and their graph from a sample of at most sample_rows and sample_mb, the smallest hashes of the ids."""
    rows = max(1, min(spec.sample_rows, spec.sample_mb * (1 << 20) // (8 * dim)))
    sample = vectors.select("_v", F.xxhash64("_id").alias("h"), "_id").orderBy("h", "_id").limit(rows).select("_v").toArrow()
    x = _matrix(sample.column(0).combine_chunks()).astype(np.float32)
    count = max(1, min(-(-n // spec.list_size), spec.max_lists, len(x)))
    c = balanced_centroids(x, count, spec)
    return Graph(c, *centroid_graph(c, spec.degree))


def _listed(rows: DataFrame, graph: Graph, ratio: float, beam: int, most: int, own: np.ndarray | None = None, need: int = 0) -> DataFrame:
    """``rows``, which have a column _v, once for each list within the ratio, up to ``most``. With ``own``, the number
    of vectors to which each list is the nearest, the ratio is to the nearest lists that hold ``need`` of them together."""
    schema = rows.select(F.lit(0).alias("_list"), F.lit(True).alias("_near"), "*").schema

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                x = _matrix(batch.column("_v"))
                ids, far = graph.search(x, beam)
                ids, far = ids[:, :most], far[:, :most]
                within = far[:, 0] if own is None else enough(ids, far)
                if own is not None and (short := np.flatnonzero(np.isinf(within))).size:
                    every = np.sqrt(_squares(x[short], graph.c))
                    order = every.argsort(axis=1, kind="stable")
                    pad = ((0, 0), (0, len(graph.c) - ids.shape[1]))
                    ids, far = np.pad(ids, pad, constant_values=-1), np.pad(far, pad, constant_values=np.inf)
                    ids[short], far[short] = order, np.take_along_axis(every, order, axis=1)
                    within[short] = enough(ids[short], far[short])
                r, k = np.nonzero((ids >= 0) & (far <= np.maximum(within[:, None] * ratio, 1e-6)))
                taken = batch.take(pa.array(r))
                yield pa.RecordBatch.from_arrays([pa.array(ids[r, k], pa.int32()), pa.array(k == 0), *taken.columns], names=["_list", "_near", *batch.schema.names])

    def enough(ids: np.ndarray, far: np.ndarray) -> np.ndarray:
        """The distance within which lists hold ``need`` vectors, infinite where they don't."""
        held = np.cumsum(np.where(ids >= 0, own[ids], 0), axis=1) >= need
        return np.where(held[:, -1], far[np.arange(len(far)), held.argmax(axis=1)], np.inf)

    return rows.mapInArrow(listed, schema)


def nearest(vectors: DataFrame, queries: Column, k: int = 10, spec: Lists | None = None, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, key, score): the k rows nearest to each row for which ``queries`` holds, itself left out."""
    spec = spec or Lists()
    rows = vectors.select(F.col(key).cast("long").alias("_id"), F.col(vector).cast("array<double>").alias("_v"), F.coalesce(queries, F.lit(False)).alias("_q"))
    rows = written(rows.where(usable("_v") & F.col("_id").isNotNull()).withColumn("_h", F.xxhash64("_v")), "vectors")
    sizes = rows.groupBy(F.size("_v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    empty = "query_id long, rank int, _key long, score double"
    if sizes is None:
        return vectors.sparkSession.createDataFrame([], empty).withColumnRenamed("_key", key)
    dim = sizes["d"]
    rows = rows.where(F.size("_v") == dim)

    # Equal vectors are one class, known by a number of its own, as ids may stand for several vectors. k + 1 of its ids are enough for any query.
    order = Window.partitionBy("_h", "_v").orderBy("_id")
    first = rows.select("_id", "_h", "_v").dropDuplicates(["_id", "_h", "_v"]).withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= k + 1)
    classes = first.groupBy("_h", "_v").agg(F.sort_array(F.collect_list("_id")).alias("_ids")).withColumn("_id", F.get("_ids", F.lit(0)))
    classes = written(classes.withColumn("_c", F.monotonically_increasing_id()), "classes")
    distinct = classes.select("_c", "_id", "_ids", "_v")
    graph = fit(distinct, distinct.count(), dim, spec)
    postings = written(_listed(distinct, graph, spec.replicate, spec.beam, spec.copies), "postings")
    members = rows.where("_q").select(F.col("_id").alias("query_id"), "_h", "_v").distinct()
    members = written(members.join(classes.select("_h", "_v", F.col("_c").alias("_query")), ["_h", "_v"]).select("query_id", "_query"), "members")
    asked = distinct.join(members.select(F.col("_query").alias("_c")).distinct(), "_c", "left_semi").select(F.col("_c").alias("_query"), "_v")
    beam = max(spec.beam, int(np.ceil(spec.beam_share * len(graph.c))))
    own = np.zeros(len(graph.c), np.int64)
    for r in postings.where("_near").groupBy("_list").count().collect():
        own[r["_list"]] = r["count"]
    probes = written(_listed(asked, graph, spec.probe, beam, beam, own, k + 1), "probes")

    # One row per list, of which there are at most max_lists: small enough to broadcast at any size of the input.
    parts = lambda df, name: df.groupBy("_list").agg(F.ceil(F.count(F.lit(1)) / spec.block).cast("int").alias(name))
    cuts = F.broadcast(parts(postings, "_rows").join(parts(probes, "_asks"), "_list"))
    left = postings.join(cuts, "_list").withColumn("_part", F.pmod(F.xxhash64("_c"), F.col("_rows")).cast("int")).withColumn("_ask", F.explode(F.sequence(F.lit(0), F.col("_asks") - 1)))
    right = probes.join(cuts, "_list").withColumn("_ask", F.pmod(F.xxhash64("_query"), F.col("_asks")).cast("int")).withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_rows") - 1)))
    left, right = left.select("_list", "_part", "_ask", "_c", "_id", "_ids", "_v"), right.select("_list", "_part", "_ask", "_query", "_v")

    def meet(a: pa.Table, b: pa.Table) -> pa.Table:
        out: dict[str, list] = {"_query": [], "_c": [], "_id": [], "_ids": [], "score": []}
        if a.num_rows and b.num_rows:
            x, ids, lists = _matrix(a.column("_v").combine_chunks()), a.column("_id").to_numpy(), a.column("_ids").combine_chunks()
            own = a.column("_c").to_numpy()
            y, asks = _matrix(b.column("_v").combine_chunks()), b.column("_query").to_numpy()
            for q, v in zip(asks.tolist(), y, strict=True):
                d = np.sqrt(((x - v) ** 2).sum(axis=1))
                best = np.lexsort((ids, d))[: k + 1] if len(d) <= 4 * k else _smallest(d, ids, k + 1)
                out["_query"] += [q] * len(best)
                out["_c"] += own[best].tolist()
                out["_id"] += ids[best].tolist()
                out["_ids"] += lists.take(pa.array(best)).to_pylist()
                out["score"] += d[best].tolist()
        return pa.table(out, schema=pa.schema([("_query", pa.int64()), ("_c", pa.int64()), ("_id", pa.int64()), ("_ids", pa.list_(pa.int64())), ("score", pa.float64())]))

    by = ["_list", "_part", "_ask"]
    found = left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(meet, "_query long, _c long, _id long, _ids array<long>, score double")
    found = found.dropDuplicates(["_query", "_c"])
    order = Window.partitionBy("_query").orderBy("score", "_id", "_c")
    found = found.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= k + 1)
    found = found.select("_query", "score", "_c", F.explode("_ids").alias("_id")).groupBy("_query").agg(F.slice(F.sort_array(F.collect_list(F.struct("score", "_id", "_c"))), 1, k + 1).alias("_near"))
    out = members.join(written(found, "found"), "_query")
    itself = lambda n: (n["_id"] == F.col("query_id")) & (n["_c"] == F.col("_query"))
    near = F.slice(F.filter("_near", lambda n: ~itself(n)), 1, k)
    out = out.select("query_id", F.posexplode(near).alias("_r", "_n"))
    return out.select("query_id", (F.col("_r") + 1).cast("int").alias("rank"), F.col("_n._id").alias(key), F.col("_n.score").alias("score"))


def _smallest(d: np.ndarray, ids: np.ndarray, m: int) -> np.ndarray:
    """The m smallest by (distance, id), ties at the edge included before they are cut."""
    edge = np.partition(d, m - 1)[m - 1]
    some = np.flatnonzero(d <= edge)
    return some[np.lexsort((ids[some], d[some]))[:m]]


def op1_ann(spark, sf_dir: str) -> DataFrame:
    return nearest(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, 10, Lists())
