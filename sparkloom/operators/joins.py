"""Equi-joins and how Spark is to run them."""

from __future__ import annotations

import enum
import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


class JoinStrategy(enum.Enum):
    """A wish for a join's algorithm, as Spark's hint for it."""

    HASH = "shuffle_hash"
    SORT_MERGE = "merge"
    BROADCAST = "broadcast"

    @staticmethod
    def parse(name: str) -> JoinStrategy:
        names = {"hash": "HASH", "hj": "HASH", "sort_merge": "SORT_MERGE", "sort-merge": "SORT_MERGE", "smj": "SORT_MERGE", "broadcast": "BROADCAST"}
        if name.lower() not in names:
            raise ValueError(f"no join strategy {name!r}")
        return JoinStrategy[names[name.lower()]]

    def hinted(self, sql: str) -> str:
        """The query with the hint at every SELECT, at any depth, for the tables and subqueries that its FROM names.

        A SELECT with a hint of its own keeps that one; joins that Spark makes of IN and EXISTS choose for themselves.
        """
        plain = _QUOTED.sub(lambda m: " " * len(m[0]), sql)
        hint = {"HASH": "SHUFFLE_HASH", "SORT_MERGE": "MERGE", "BROADCAST": "BROADCAST"}[self.name]
        for m in reversed(list(re.finditer(r"\bSELECT\b", plain, re.I))):
            tables = _relations(plain, m.end())
            if len(tables) > 1 and not sql[m.end() :].lstrip().startswith("/*+"):
                sql = f"{sql[: m.end()]} /*+ {hint}({', '.join(tables)}) */{sql[m.end() :]}"
        return sql


_QUOTED = re.compile(r"'(?:[^']|'')*'|\"(?:[^\"]|\"\")*\"|`[^`]*`|--[^\n]*|/\*.*?\*/", re.S)
_FROM_ENDS = re.compile(r"\b(?:WHERE|GROUP|HAVING|WINDOW|ORDER|SORT|CLUSTER|DISTRIBUTE|LIMIT|OFFSET|UNION|EXCEPT|MINUS|INTERSECT)\b", re.I)
_SET = re.compile(r"\b(?:UNION|EXCEPT|MINUS|INTERSECT)\b", re.I)
_JOIN = re.compile(r"\b(?:(?:NATURAL|INNER|CROSS|LEFT|RIGHT|FULL|OUTER|SEMI|ANTI)\s+)*JOIN\b", re.I)
_RELATION = re.compile(r"\s*(?:LATERAL\b)?\s*(\w+(?:\s*\.\s*\w+)*|\x00+)(?:\s+(?:AS\s+)?(?!(?:ON|USING|TABLESAMPLE|LATERAL|PIVOT|UNPIVOT)\b)(\w+))?", re.I)


def _relations(plain: str, start: int) -> list[str]:
    """Names, in what follows a SELECT, by which its own FROM knows tables and subqueries."""
    depth, flat = 0, []
    for c in plain[start:]:
        depth -= c == ")"
        if depth < 0:
            break
        flat.append(c if depth == 0 and c != ")" else "\x00")
        depth += c == "("
        if c == "(":
            flat[-1] = "\x00"
    own = "".join(flat)
    begin = next((m.end() for m in re.finditer(r"\bFROM\b", own, re.I) if not re.search(r"\bDISTINCT\s*$", own[: m.start()], re.I)), None)
    if begin is None or _SET.search(own[:begin]):  # the FROM of another SELECT
        return []
    end = _FROM_ENDS.search(own, begin)
    found = [_RELATION.match(part) for part in re.split(",|" + _JOIN.pattern, own[begin : end.start() if end else None], flags=re.I)]
    names = [m[2] or m[1] for m in found if m]
    return [n.split(".")[-1].strip() for n in names if "\x00" not in n]


def equi_join(left: DataFrame, right: DataFrame, keys: list[tuple[str, str]], how: str = "inner", strategy: JoinStrategy | None = None) -> DataFrame:
    """Rows of both sides whose keys are equal; null keys match nothing. Without a strategy, Catalyst chooses by size."""
    condition = None
    for a, b in keys:
        one = left[a] == right[b]
        condition = one if condition is None else condition & one
    if strategy is not None:
        # The hinted side is the one that a hash table is made of: the smaller one, where the kind of join leaves a choice.
        if how == "inner" and _bytes(left) < _bytes(right):
            left = left.hint(strategy.value)
        else:
            right = right.hint(strategy.value)
    return left.join(right, condition, how)


def _bytes(df: DataFrame) -> int:
    """Catalyst's estimate of a result's size."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def foreign_key_join(primary: DataFrame, foreign: DataFrame, key: str, foreign_key: str) -> DataFrame:
    """Each row of ``foreign`` with the row of ``primary`` that it refers to; without one, none."""
    return foreign.join(primary, foreign[foreign_key] == primary[key])


def general_join(left: DataFrame, right: DataFrame, key: str = "key", data: str = "data") -> DataFrame:
    """Many to many: key1, data1, key2, data2 of every pair with equal keys.

    The sizes of the groups are counted first. A key of many pairs is dealt out to several tasks, each of which
    joins a part of its left rows with a part of its right ones; see ``_dealt_join``.
    """
    a = left.select(F.col(key).alias("key1"), F.col(data).alias("data1"))
    b = right.select(F.col(key).alias("key2"), F.col(data).alias("data2"))
    plain = lambda one, two: one.join(two, F.col("key1") == F.col("key2"))
    if not isinstance(left.schema[key].dataType, T.AtomicType) or left.schema[key].dataType != right.schema[key].dataType or not all(isinstance(t.schema[data].dataType, T.AtomicType) for t in (left, right)):
        return plain(a, b)
    # One key has a large group for each HEAVY rows of the result or more, so that this list is short beside it.
    heavy = group_sizes(left.select(key), right.select(key), key).where(F.col("pairs") > HEAVY).collect()
    if not heavy:
        return plain(a, b)
    rows, tasks = [], 0
    for h in heavy:
        parts = math.ceil(h["pairs"] / TASK_PAIRS)
        lefts = min(parts, h["m0"], max(1, round(math.sqrt(parts * h["m0"] / h["m1"]))))
        rights = min(h["m1"], math.ceil(parts / lefts))
        rows.append((h[key], lefts, rights, math.ceil(h["m0"] / lefts / BLOCKS[0]), math.ceil(h["m1"] / rights / BLOCKS[1])))
        tasks += lefts * rights
    schema = T.StructType([T.StructField("_key", left.schema[key].dataType), *(T.StructField(c, T.LongType()) for c in ("_parts1", "_parts2", "_blocks1", "_blocks2"))])
    keys = F.broadcast(left.sparkSession.createDataFrame(rows, schema))
    rest = plain(*(t.join(keys, F.col(k) == F.col("_key"), "left_anti") for t, k in ((a, "key1"), (b, "key2"))))
    return rest.unionByName(_dealt_join(a, b, keys, tasks))


#: Pairs of one key from which on it is dealt out, and pairs that a task then makes.
HEAVY, TASK_PAIRS = 1 << 19, 1 << 24
#: Rows of the left and of the right side that are joined as one. Each right row stands beside a block of left ones at a
#: time, so that columns of the result repeat within few rows, and are stored as short runs.
BLOCKS = (64, 1024)


def _dealt_join(a: DataFrame, b: DataFrame, keys: DataFrame, tasks: int) -> DataFrame:
    """The pairs of the keys in ``keys``: _parts1 parts of the left rows meet _parts2 parts of the right ones, each in a task.

    Rows are dealt out by a hash of their data and of their number among equal rows, which no rerun of a task changes.
    """

    def blocks(side: DataFrame, n: int, other: int) -> DataFrame:
        key, data = f"key{n}", f"data{n}"
        kind = side.schema[data].dataType
        exact = F.col(data).cast("string") if isinstance(kind, T.FractionalType) else F.col(data)  # groups don't tell -0.0 from 0.0
        rows = side.groupBy(key, exact.alias(data)).agg(F.count(F.lit(1)).alias("_n")).join(keys, F.col(key) == F.col("_key"))
        rows = rows.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_n"))))
        mixed = F.xxhash64(F.col(data), "_copy")
        part, block = F.pmod(mixed, F.col(f"_parts{n}")), F.pmod(F.shiftright(mixed, 32), F.col(f"_blocks{n}"))
        held = F.struct(F.col(data).cast(kind).alias(data))  # a list leaves nulls out, but not structs of them
        out = rows.groupBy(key, f"_parts{other}", part.alias(f"_part{n}"), block.alias("_block")).agg(F.collect_list(held).alias(f"_list{n}"))
        out = out.withColumn(f"_part{other}", F.explode(F.sequence(F.lit(0).cast("long"), F.col(f"_parts{other}") - 1)))
        return out.select(F.col(key), F.col("_part1").alias(f"_a{n}"), F.col("_part2").alias(f"_b{n}"), f"_list{n}").repartition(tasks, key, f"_a{n}", f"_b{n}")

    def same(x: str) -> Column:
        return F.col(f"{x}1") == F.col(f"{x}2")

    pairs = blocks(a, 1, 2).hint("merge").join(blocks(b, 2, 1), same("key") & same("_a") & same("_b"))
    pairs = pairs.select("key1", "_list1", "key2", F.explode("_list2").alias("_two"))
    pairs = pairs.select("key1", F.explode("_list1").alias("_one"), "key2", "_two")
    return pairs.select("key1", F.col("_one.data1").alias("data1"), "key2", F.col("_two.data2").alias("data2"))


def group_sizes(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """(key, m0, m1, pairs): how often each key stands on either side, and how many pairs a join makes of it."""
    one = left.groupBy(key).agg(F.count(F.lit(1)).alias("m0"))
    two = right.groupBy(key).agg(F.count(F.lit(1)).alias("m1"))
    out = one.join(two, key, "full").where(F.col(key).isNotNull())
    out = out.withColumns({m: F.coalesce(m, F.lit(0)) for m in ("m0", "m1")})
    return out.withColumn("pairs", F.col("m0") * F.col("m1"))
