"""Mix sources to target weights along a time-varying curriculum.

Every source has a schedule of weights over training time 0..1. Its integral
is the source's weight; water filling turns weights into token targets with a
bound on repetition; inverting the source's cumulative demand gives every
document its position in training. DataFrame functions only.

Defined cases: null texts have size 0; a null source is a source of its own
and comes last; repeated rows are documents of their own; an empty table gives
an empty plan; documents of size 0 take nothing and have no position; a null
doc_id sorts first among equal hashes. Columns other than the three named ones
are not read, so clashing names cannot matter.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.llm.common import read_table, tokens, written


@dataclass(frozen=True)
class Schedule:
    """A piecewise linear weight over training time, as (time, weight) knots from 0 to 1."""

    knots: tuple[tuple[float, float], ...]

    def pieces(self) -> list[tuple[float, float, float, float, float]]:
        """(start, length, weight at start, weight at end, integral before) of every piece."""
        out, before = [], 0.0
        for (t0, w0), (t1, w1) in zip(self.knots, self.knots[1:], strict=False):
            out.append((t0, t1 - t0, w0, w1, before))
            before += (w0 + w1) / 2 * (t1 - t0)
        return out

    @property
    def weight(self) -> float:
        t0, length, w0, w1, before = self.pieces()[-1]
        return before + (w0 + w1) / 2 * length

    def time_of(self, share: Column) -> Column:
        """The time by which ``share`` (0..1) of the source's whole demand has been met."""
        area, out = share * F.lit(self.weight), None
        for t0, length, w0, w1, before in self.pieces():
            rest = F.greatest(area - F.lit(before), F.lit(0.0))
            root = F.sqrt(F.greatest(F.lit(w0 * w0) + rest * F.lit(2 * (w1 - w0) / length), F.lit(0.0)))
            at = F.lit(t0) + F.when(rest > 0, F.least(rest * 2 / (F.lit(w0) + root), F.lit(length))).otherwise(F.lit(0.0))
            out = at if out is None else F.when(area >= F.lit(before), at).otherwise(out)
        return out


#: Weights 3, 1, 2: falling, constant and rising over training.
CURRICULUM = (Schedule(((0.0, 4.5), (1.0, 1.5))), Schedule(((0.0, 1.0), (1.0, 1.0))), Schedule(((0.0, 1.0), (0.5, 2.0), (1.0, 3.0))))


@dataclass(frozen=True)
class Mix:
    """schedules: given to the sources in code point order, repeating. share: the
    mix's tokens against all tokens. repeats: the most often that a source is taken.
    digits: hexadecimal digits of the hash that deal a source into buckets, so that
    a hot source's running sums are spread over 16 ** digits tasks."""

    schedules: tuple[Schedule, ...] = field(default=CURRICULUM)
    share: float = 1.5
    repeats: int = 2
    digits: int = 3


def _pick(schedules, what) -> Column:
    out = F.lit(None).cast("double")
    for k, s in enumerate(schedules):
        out = F.when(F.col("schedule") == k, what(s)).otherwise(out)
    return out


def source_targets(sizes: DataFrame, mix: Mix) -> DataFrame:
    """(source, source_size, schedule, target) from rows of (source, size).

    One row per source after a partial aggregation; the windows below see those
    rows only. Source i, in ascending order of bound / weight, is at its bound if
    sharing what the earlier ones leave by weight would exceed it; the share per
    weight grows as long as sources are at their bounds and shrinks after, so its
    maximum is the level at which all others stand.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    per = per.withColumn("schedule", (F.row_number().over(by_name) - 1) % len(mix.schedules))
    per = per.withColumn("_w", _pick(mix.schedules, lambda s: F.lit(s.weight)))
    per = per.withColumn("_bound", F.col("source_size").cast("double") * mix.repeats)
    order = Window.orderBy((F.col("_bound") / F.col("_w")).asc(), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(0, Window.unboundedFollowing)
    whole = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    per = per.withColumn("_all", F.sum("source_size").over(whole).cast("double") * mix.share)
    per = per.withColumn("_left", F.col("_all") - F.coalesce(F.sum("_bound").over(before), F.lit(0.0)))
    per = per.withColumn("_level", F.col("_left") / F.sum("_w").over(after))
    per = per.withColumn("_level", F.max("_level").over(whole))
    return per.select("source", "source_size", "schedule", F.least("_bound", F.col("_level") * F.col("_w")).alias("target"))


def plan_mixture(docs: DataFrame, mix: Mix | None = None, text: str = "text", key: str = "doc_id") -> DataFrame:
    """What the mix takes of every document, and when.

    Returns the key, source, size, source_size, target, taken and positions, the
    training position (0..1) at which each pass over the document starts. A source
    is read in the order of a hash of key and text, so that rows of one key are spread too, again from its start if its target
    exceeds its size, and the last document taken is cut at the target.
    """
    mix = mix or Mix()
    narrow = docs.select(F.col(key).alias("_id"), "source", tokens(text).alias("size"), F.md5(F.concat(F.coalesce(F.col(key).cast("string"), F.lit("")), F.lit(" "), F.coalesce(F.col(text), F.lit("")))).alias("_h"))
    own = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit(""))  # not null, so that one exchange serves window and join
    narrow = written(narrow.withColumn("_k", own).withColumn("_b", F.substring("_h", 1, mix.digits)), "mix")
    targets = source_targets(narrow, mix).withColumn("_k", own).drop("source")
    cells = narrow.groupBy("_k", "_b").agg(F.sum("size").alias("_cell"))
    ahead = Window.partitionBy("_k").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("_ahead", F.coalesce(F.sum("_cell").over(ahead), F.lit(0))).drop("_cell").join(targets, "_k")
    inside = Window.partitionBy("_k", "_b").orderBy("_h", "_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    rows = narrow.withColumn("_own", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(cells, ["_k", "_b"])
    rows = rows.withColumn("_before", F.col("_ahead") + F.col("_own"))
    rows = rows.withColumn("_cut", F.floor("target").cast("long"))
    taken, starts = F.lit(0).cast("long"), []
    for p in range(mix.repeats):
        at = F.col("_before") + F.col("source_size") * p
        taken = taken + F.least(F.col("size"), F.greatest(F.lit(0).cast("long"), F.col("_cut") - at))
        share = at.cast("double") / F.col("target")
        starts.append(F.when((F.col("_cut") > at) & (F.col("size") > 0), _pick(mix.schedules, lambda s, share=share: s.time_of(share))))
    rows = rows.withColumn("taken", taken).withColumn("positions", F.array_compact(F.array(*starts)))
    return rows.select(F.col("_id").alias(key), "source", "size", "source_size", "target", "taken", "positions")


def training_order(plan: DataFrame) -> DataFrame:
    """One row per pass over a document, range-sorted by position."""
    rows = plan.select("doc_id", "source", "size", F.posexplode("positions").alias("pass", "position"))
    return rows.orderBy("position", "doc_id", "pass")


def op9_mixture(spark, sf_dir: str) -> DataFrame:
    plan = plan_mixture(read_table(spark, sf_dir, "documents"))
    first = plan.select("doc_id", "size", "source_size", "target", "taken", F.size("positions").cast("long").alias("passes"), F.get("positions", F.lit(0)).alias("position"))
    return first.orderBy("position", "doc_id")


SQL = r"""
WITH d AS (SELECT doc_id, source, md5(coalesce(doc_id::VARCHAR, '') || ' ' || coalesce(text, '')) AS h, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
per AS (SELECT source, sum(size)::BIGINT AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS k FROM d GROUP BY source),
wt AS (SELECT *, CASE k WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS w, source_size::DOUBLE * 2 AS bound, sum(source_size) OVER ()::DOUBLE * 1.5::DOUBLE AS total FROM per),
lv AS (SELECT *, (total - coalesce(sum(bound) OVER (ORDER BY bound / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(w) OVER (ORDER BY bound / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lev FROM wt),
tg AS (SELECT source, source_size, k, least(bound, max(lev) OVER () * w) AS target FROM lv),
o AS (SELECT d.*, coalesce(sum(size) OVER (PARTITION BY source ORDER BY h, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM d),
j AS (SELECT o.doc_id, o.size, tg.source_size, tg.target, tg.k, o.before, floor(tg.target)::BIGINT AS cut FROM o JOIN tg ON o.source IS NOT DISTINCT FROM tg.source),
p AS (SELECT *, least(size, greatest(0, cut - before))::BIGINT AS a, least(size, greatest(0, cut - before - source_size))::BIGINT AS b, CASE WHEN cut > before AND size > 0 THEN before::DOUBLE / target END AS y FROM j)
SELECT doc_id, size, source_size, target, a + b AS taken, ((a > 0)::INT + (b > 0)::INT)::BIGINT AS passes,
CASE k WHEN 0 THEN 0.0::DOUBLE + CASE WHEN y * 3 > 0 THEN least(y * 3 * 2 / (4.5::DOUBLE + sqrt(4.5::DOUBLE * 4.5::DOUBLE + y * 3 * (-6.0::DOUBLE))), 1.0) ELSE 0.0 * y END
WHEN 1 THEN CASE WHEN y > 0 THEN least(y * 2 / (1.0::DOUBLE + sqrt(1.0::DOUBLE + y * 0)), 1.0) ELSE 0.0 * y END
ELSE CASE WHEN y * 2 >= 0.75 THEN 0.5::DOUBLE + CASE WHEN y * 2 - 0.75 > 0 THEN least((y * 2 - 0.75) * 2 / (2.0::DOUBLE + sqrt(4.0::DOUBLE + (y * 2 - 0.75) * 4)), 0.5) ELSE 0.0 * y END
ELSE CASE WHEN y > 0 THEN least(y * 2 * 2 / (1.0::DOUBLE + sqrt(1.0::DOUBLE + y * 2 * 4)), 0.5) ELSE 0.0 * y END END END AS position
FROM p
"""
