"""Shards of even size that keep linked documents together: balanced label propagation.

Every document starts in a shard given by a hash. In each round a document looks
at the shards of those that it is linked to and asks to move to the shard that
holds most of them, by size; quotas keep each shard's linked documents within
its capacity. Documents without links, and what exceeds a capacity, then fill
the shards up evenly, so that sizes differ by less than a document.

A link is a key that documents share; documents with equal keys are linked. A
link too large for a shard is cut into parts that fit, as it must be somewhere.

Defined cases: a null text has no bytes, and the checksum of the empty text;
null texts are linked like equal texts; a null doc_id is dealt by the hash of an
empty string; repeated rows are documents of their own; an empty table gives an
empty result. Columns of the input other than the named ones are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.llm.common import read_table, written


@dataclass(frozen=True)
class Shards:
    """count: shards. rounds: of propagation, at most. slack: share
    of its room by which moves may overfill a shard, until it is evened out at the end. grain: a link larger than a
    shard's capacity / grain is cut into parts of about that size. cells: hash cells,
    within each of which running sums and slots are worked out by a task of its own.
    cell_rows: rows from which a link is dealt over cells of its own."""

    count: int = 8
    rounds: int = 5
    slack: float = 0.25
    grain: int = 16
    cells: int = 1024
    cell_rows: int = 64


def _best(k: int, salt: Column) -> Column:
    """The shard with the largest of the sizes w0..; equal sizes are told apart by a hash, not by number."""
    weights = F.array(*[F.struct(F.coalesce(F.col(f"w{i}"), F.lit(0)).alias("w"), F.xxhash64(salt, F.lit(i)).alias("h"), F.lit(i).alias("s")) for i in range(k)])
    return F.array_max(weights)["s"]


def propagate(nodes: DataFrame, links: DataFrame, room: float, spec: Shards) -> DataFrame:
    """(node, shard) of the nodes that have links; nodes: (node, size, shard), links: (node, link).
    room: the size up to which a shard takes linked nodes.

    A round sums sizes for each link and shard (partially aggregated, so a large link
    is no hot key), joins the sums to the link's nodes, and adds them up for each
    node. Requests for a shard are granted, link by link in the order of a hash, in
    the share that its room allows; only the shards' sizes and requests, count
    squared numbers, come to the driver.
    """
    k = spec.count
    linked = nodes.join(links.select("node").distinct(), "node", "left_semi")
    sums = links.join(nodes, "node").groupBy("link").agg(F.sum("size").alias("_all"))
    parts = F.greatest(F.lit(1), F.ceil(F.col("_all") * spec.grain / F.lit(max(room, 1.0)))).cast("long")
    cut = F.when(F.col("_all") > room, F.pmod(F.xxhash64("node"), parts)).otherwise(F.lit(0))
    links = written(links.join(written(sums, "shard-links"), "link").select("node", F.xxhash64("link", cut).alias("link")), "shard-parts")
    state = written(linked.select("node", "size", "shard"), "shard-state")
    for turn in range(spec.rounds):
        own = links.join(state, "node")
        per = own.groupBy("link").agg(*[F.sum(F.when(F.col("shard") == i, F.col("size"))).alias(f"w{i}") for i in range(k)])
        per = written(per, "shard-sums")
        seen = links.join(per, "link").groupBy("node").agg(*[F.sum(f"w{i}").alias(f"w{i}") for i in range(k)], F.min("link").alias("link"))
        wanted = seen.select("node", "link", _best(k, F.col("link")).alias("to"))
        asked = written(state.join(wanted, "node"), "shard-asked")
        flows = asked.groupBy("shard", "to").agg(F.sum("size").alias("n")).collect()
        load, into, flow = [0] * k, [0] * k, [[0] * k for _ in range(k)]
        for f in flows:
            load[f["shard"]] += f["n"]
            if f["shard"] != f["to"]:
                into[f["to"]] += f["n"]
                flow[f["shard"]][f["to"]] = f["n"]
        if not any(into):
            break
        share = [1.0] * k
        for _ in range(64):  # what leaves a shard makes room in it
            left = [sum(n * s for n, s in zip(flow[i], share, strict=True)) for i in range(k)]
            share = [min(1.0, max(0.0, room * (1 + spec.slack) - load[i] + left[i]) / into[i]) if into[i] else 0.0 for i in range(k)]
        granted = F.element_at(F.array(*[F.lit(s) for s in share]), F.col("to") + 1)
        chance = F.pmod(F.xxhash64("link", F.lit(turn)), F.lit(1 << 40)) / F.lit(float(1 << 40))
        state = written(asked.select("node", "size", F.when(chance < granted, F.col("to")).otherwise(F.col("shard")).alias("shard")), "shard-state")
    return state.select("node", "shard")


def _running(rows: DataFrame, by: list[str], order: list[str], value: Column, cells: int, name: str) -> DataFrame:
    """``rows`` with the sum of ``value`` over earlier rows of the same ``by``.

    Rows are in the order of _cell (a column of rows) and then ``order``: sums of
    whole cells are added up first, and each cell is then worked through alone.
    """
    at = Window.partitionBy(*by, "_cell").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    ahead = Window.partitionBy(*by).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy(*by, "_cell").agg(F.sum(value).alias("_sum"))
    sums = sums.withColumn("_ahead", F.coalesce(F.sum("_sum").over(ahead), F.lit(0))).drop("_sum")
    inside = rows.withColumn("_inside", F.coalesce(F.sum(value).over(at), F.lit(0)))
    return inside.join(sums, [*by, "_cell"]).withColumn(name, F.col("_ahead") + F.col("_inside")).drop("_ahead", "_inside")


def _filled(rows: DataFrame, needs: list[float], spec: Shards) -> DataFrame | None:
    """``rows`` dealt to shards in proportion to their needs: a row goes where the middle of its stretch of the running sum falls."""
    amount, lacking = rows.agg(F.sum("size")).first()[0], sum(needs)
    if amount is None:
        return None
    shares = [n / lacking for n in needs] if lacking else [1 / spec.count] * spec.count
    rows = _running(rows.withColumn("_one", F.lit(1)), ["_one"], ["link", "node"], F.col("size"), spec.cells, "_before")
    middle, edge, to = F.col("_before") + F.col("size") / 2, float(amount), None
    for i in reversed(range(spec.count)):
        if shares[i] or to is None and i == 0:
            to = F.lit(i) if to is None else F.when(middle < F.lit(edge), F.lit(i)).otherwise(to)
        edge -= shares[i] * amount
    return written(rows.withColumn("shard", to.cast("int")).drop("_before", "_cell", "_one"), "shard-filled")


def assign_shards(docs: DataFrame, spec: Shards | None = None, key: str = "doc_id", text: str = "text", link: Column | None = None) -> DataFrame:
    """(key, size, text_crc32, link, shard, slot) of every row, sizes near equal; link: by
    default a hash of the text, so that documents of equal text are linked."""
    spec = spec or Shards()
    k = spec.count
    link = F.xxhash64(F.col(text)) if link is None else link
    content = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(key).alias("_key"), (F.octet_length(content).cast("long") + 1).alias("size"), F.crc32(content).alias("text_crc32"), link.alias("link"))
    # Equal rows are told apart by nothing: they are one node that is as large as all of them, with n copies.
    rows = rows.withColumn("node", F.xxhash64(F.coalesce(F.col("_key").cast("string"), F.lit("")), "size", "text_crc32", "link"))
    rows = written(rows, "shard-rows")
    total, n = rows.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count(F.lit(1))).first()
    cell_rows = max(spec.cell_rows, n // 65_536)  # so that cells stay few beside rows
    several = written(rows.groupBy("link").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1"), "shard-several")
    # Running sums go through hash cells of links; a link with many rows has sub-cells of its own, in which its nodes follow each other.
    large = written(several.where(F.col("_n") > cell_rows).select("link", F.ceil(F.col("_n") / cell_rows).cast("int").alias("_subs")), "shard-large")

    def with_cells(some: DataFrame) -> DataFrame:
        sub = F.pmod(F.xxhash64("node", F.lit("cell")), F.coalesce("_subs", F.lit(1))).cast("int")
        cell = F.pmod(F.xxhash64("link"), F.lit(spec.cells)).cast("int")
        return some.join(large, "link", "left").withColumn("_cell", F.struct(cell.alias("c"), sub.alias("s"))).drop("_subs")

    tied = written(rows.join(several.select("link"), "link", "left_semi").groupBy("node", "link").agg(F.sum("size").alias("size")), "shard-tied")
    nodes = tied.select("node", "size", F.pmod(F.xxhash64("node", F.lit("start")), F.lit(k)).cast("int").alias("shard"))
    room = total / k
    placed = propagate(nodes, tied.select("node", "link"), room, spec) if total else nodes.select("node", "shard")
    placed = written(tied.join(placed, "node").select("node", "size", "link", "shard"), "shard-placed")

    # What exceeds a shard's room is released, whole links at a time as far as they fit; it and the unlinked rows fill up.
    placed = _running(with_cells(placed), ["shard"], ["link", "node"], F.col("size"), spec.cells, "_before")
    fixed = written(placed.where(F.col("_before") + F.col("size") <= room).select("node", "shard", "size"), "shard-fixed")
    filled = {r["shard"]: r["n"] for r in fixed.groupBy("shard").agg(F.sum("size").alias("n")).collect()}
    needs = [max(0.0, room - filled.get(i, 0)) for i in range(k)]
    kept = rows.join(fixed.select(F.col("node").alias("_node"), "shard"), F.col("node") == F.col("_node"), "left").drop("_node")
    kept = written(kept, "shard-kept")
    free = kept.where(F.col("shard").isNull()).drop("shard")
    parts = [kept.where(F.col("shard").isNotNull())]
    # Large rows first, in proportion to what each shard lacks; small ones then make up the differences.
    for some in (free.where(F.col("size") > room / 256), free.where(F.col("size") <= room / 256)):
        filled = _filled(with_cells(some), needs, spec)
        if filled is not None:
            parts.append(filled)
            for r in filled.groupBy("shard").agg(F.sum("size").alias("n")).collect():
                needs[r["shard"]] = max(0.0, needs[r["shard"]] - r["n"])
    cells = F.pmod(F.xxhash64("node", F.lit("slot")), F.lit(spec.cells)).cast("int")
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    out = written(out, "shard-all").withColumn("_cell", cells).withColumn("_row", F.lit(1).cast("long"))
    out = _running(out, ["shard"], ["_key", "node"], F.col("_row"), spec.cells, "slot")
    return out.select(F.col("_key").alias(key), "size", "text_crc32", "link", "shard", F.col("slot").cast("long").alias("slot"))


def cut_links(assigned: DataFrame) -> DataFrame:
    """(links, cut): links that several documents share, and how many of them lie in more than one shard."""
    per = assigned.groupBy("link", "shard").agg(F.count(F.lit(1)).alias("n")).groupBy("link").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("s")).where("n > 1")
    return per.agg(F.count(F.lit(1)).alias("links"), F.sum((F.col("s") > 1).cast("long")).alias("cut"))


def op7_sharding(spark, sf_dir: str) -> DataFrame:
    out = assign_shards(read_table(spark, sf_dir, "documents"), Shards())
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
