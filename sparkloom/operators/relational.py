"""Aggregation by key, sorting, row ids, padding and other operators over one table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ROW_ID = "$_rowid"
MASK = "$_mask"


def scan_with_mask(table: DataFrame, predicate: Column | None = None) -> DataFrame:
    """All rows, with the predicate's outcome as a column; null counts as false."""
    return table.withColumn(MASK, F.lit(True) if predicate is None else F.coalesce(predicate, F.lit(False)))


def compact(table: DataFrame, predicate: Column | None = None) -> DataFrame:
    """The rows for which the predicate, or else the mask, holds."""
    return table.where(F.col(MASK)).drop(MASK) if predicate is None else table.where(predicate)


def with_row_id(table: DataFrame, name: str = ROW_ID) -> DataFrame:
    """0-based positions in a Parquet table, files in the order of their names.

    A row's position in its file comes from the reader; a file's offset is a running
    sum over one row per file, which is broadcast: a join by path would bring all rows of a file to one task.
    """
    rows = table.select("*", F.col("_metadata.file_path").alias("_path"), F.col("_metadata.row_index").alias("_at"))
    files = rows.groupBy("_path").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_path").rowsBetween(Window.unboundedPreceding, -1)
    files = files.select("_path", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return rows.join(F.broadcast(files), "_path").withColumn(name, F.col("_before") + F.col("_at")).drop("_path", "_at", "_before")


def constants(table: DataFrame, values: list) -> DataFrame:
    """A row of constants for each row; columns are named by their places."""
    return table.select(*[F.lit(v).alias(f"col_{i}") for i, v in enumerate(values)])


def sum_by_key(table: DataFrame, key: str, value: str, out: str = "total") -> DataFrame:
    """(key, total). Spark adds up within each task first and merges the tasks' sums."""
    return table.groupBy(key).agg(F.sum(value).alias(out))


def sum_avg_by_key(table: DataFrame, key: str, value: str, other: str) -> DataFrame:
    """(key, total, mean), the largest totals first, then by key."""
    out = table.groupBy(key).agg(F.sum(value).alias("total"), F.avg(other).alias("mean"))
    return out.orderBy(F.desc("total"), F.asc_nulls_last(key))


def with_group_totals(table: DataFrame, key: str, value: str, other: str) -> DataFrame:
    """Every row with its group's total and mean: a join with the groups, so that a large group's rows needn't be in one place."""
    groups = table.groupBy(F.col(key).alias("_key")).agg(F.sum(value).alias("total"), F.avg(other).alias("mean"))
    return table.join(groups, F.col(key).eqNullSafe(F.col("_key"))).drop("_key")


def sort_rows(table: DataFrame, keys: list[tuple[str, bool]]) -> DataFrame:
    """Ordered by (column, ascending); nulls are last either way."""
    return table.orderBy(*[F.asc_nulls_last(c) if up else F.desc_nulls_last(c) for c, up in keys])


def page(table: DataFrame, limit: int | None = None, offset: int = 0) -> DataFrame:
    """Skip, then take."""
    out = table.offset(offset) if offset else table
    return out if limit is None else out.limit(limit)


def expand(table: DataFrame, times: str, name: str = "copy") -> DataFrame:
    """Each row as often as ``times`` says, numbered from 0; none if it is null or below 1."""
    some = table.where(F.col(times) >= 1)
    return some.withColumn(name, F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(times).cast("bigint") - 1)))


def pad_to_power_of_two(table: DataFrame, flag: str = "is_dummy") -> DataFrame:
    """``table`` with null rows added until their number is a power of two; ``flag`` tells them.

    This hides a result's exact size from who sees only how much there is of it. It
    does not hide what a cluster reads, shuffles or writes on the way.
    """
    n = table.count()
    more = (1 << max(0, n - 1).bit_length()) - n if n else 0
    rows = table.sparkSession.range(more)
    dummies = rows.select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in table.schema], F.lit(True).alias(flag))
    return table.withColumn(flag, F.lit(False)).unionByName(dummies)


def late_materialized(narrow: DataFrame, sources: dict[str, DataFrame]) -> DataFrame:
    """Rows made of row ids, with the columns that they stand for: (id column -> a table that has it)."""
    out = narrow
    for name, table in sources.items():
        out = out.join(table, name)
    return out


def shuffled(table: DataFrame, seed: int) -> DataFrame:
    """The same rows, at random places."""
    return table.repartition(F.rand(seed))


class AccessLog:
    """Which tables queries have touched, and how often."""

    def __init__(self):
        self.queries, self.touched = 0, {}

    def record(self, *tables: str) -> None:
        self.queries += 1
        for t in tables:
            self.touched[t] = self.touched.get(t, 0) + 1
