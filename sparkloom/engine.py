"""The engine: SQL text in, DataFrames and statistics out."""

from __future__ import annotations

import re
import time
from dataclasses import dataclass

from pyspark.errors import AnalysisException, ParseException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from sparkloom.catalog import Catalog
from sparkloom.errors import QueryError
from sparkloom.operators.joins import JoinStrategy
from sparkloom.operators.relational import AccessLog
from sparkloom.plans.explain import Explained, explain
from sparkloom.profiler import Profiler

_LITERAL = re.compile(r"'(?:[^']|'')*'|\"(?:[^\"]|\"\")*\"|`[^`]*`|--[^\n]*|/\*.*?\*/", re.S)


@dataclass(frozen=True)
class Statistics:
    rows: int
    planning_s: float
    execution_s: float


class Engine:
    """A catalog and a way to query it. Statements other than one SELECT (or WITH, VALUES) are refused."""

    def __init__(self, spark: SparkSession, join_strategy: JoinStrategy | str | None = None):
        self.spark = spark
        self.catalog = Catalog(spark)
        self.access = AccessLog()
        self.profiler = Profiler(spark, enabled=False)
        self._kept: list[DataFrame] = []
        self.join_strategy = JoinStrategy.parse(join_strategy) if isinstance(join_strategy, str) else join_strategy

    def create_table(self, name: str, schema: T.StructType) -> bool:
        return self.catalog.create(name, schema)

    def execute(self, sql: str) -> DataFrame:
        """The query's result, not yet computed. What Spark can't parse or resolve raises QueryError.

        Columns of equal names, as SELECT * over a join has them, are named table_column.
        """
        text = sql.strip().rstrip(";").strip()
        plain = _LITERAL.sub(" ", text)
        if ";" in plain:
            raise QueryError("one statement at a time")
        if not re.match(r"\(*\s*(SELECT|WITH|VALUES)\b", plain.strip(), re.I):
            raise QueryError("only SELECT statements are run")
        text = nulls_last(text)
        if self.join_strategy is not None:
            text = self.join_strategy.hinted(text)
        try:
            out = distinct_names(self.spark.sql(text))
            self.access.record(*(t for t in self.catalog.names() if re.search(rf"\b{re.escape(t)}\b", plain, re.I)))
            return out
        except (ParseException, AnalysisException) as e:
            raise QueryError(str(e)) from e

    def run(self, sql: str) -> tuple[DataFrame, Statistics]:
        """The result, computed and kept in memory or on disk until release(), with its statistics."""
        began = time.perf_counter()
        with self.profiler.scope("run"):
            with self.profiler.scope("plan"):
                out = self.execute(sql)
                out._jdf.queryExecution().executedPlan()
            planned = time.perf_counter()
            with self.profiler.scope("execute"):
                out = out.persist()
                self._kept.append(out)
                rows = out.count()
        return out, Statistics(rows, planned - began, time.perf_counter() - planned)

    def release(self) -> None:
        """Let go of the results that run() has kept."""
        for df in self._kept:
            df.unpersist()
        self._kept.clear()

    def explain(self, sql: str) -> Explained:
        return explain(self.execute(sql))


_ORDER = re.compile(r"\b(WITHIN\s+GROUP\s*\(\s*)?ORDER\s+BY\b", re.I)
_AFTER_ORDER = re.compile(r"\b(?:LIMIT|OFFSET|ROWS|RANGE|UNION|EXCEPT|MINUS|INTERSECT|WINDOW|CLUSTER|DISTRIBUTE)\b", re.I)


def nulls_last(sql: str) -> str:
    """The query with NULLS LAST at all ascending keys of ORDER BY that don't say where nulls go; for descending ones that is Spark's default."""
    plain = _LITERAL.sub(lambda m: "x" * len(m[0]), sql)  # of the same length
    places = []
    for m in _ORDER.finditer(plain):
        if m[1]:
            continue
        depth, at, begin = 0, m.end(), m.end()
        while at <= len(plain):
            c = plain[at : at + 1]
            over = c == "" or c == ")" and depth == 0 or depth == 0 and _AFTER_ORDER.match(plain, at) and not plain[at - 1].isalnum()
            if over or c == "," and depth == 0:
                key = plain[begin:at].rstrip()
                if key.strip() and not re.search(r"\b(?:DESC|NULLS\s+(?:FIRST|LAST)|ALL)\s*$", key, re.I):
                    places.append(begin + len(key))
                begin = at + 1
            if over:
                break
            depth += (c == "(") - (c == ")")
            at += 1
    for p in sorted(places, reverse=True):
        sql = f"{sql[:p]} NULLS LAST{sql[p:]}"
    return sql


def distinct_names(df: DataFrame) -> DataFrame:
    """``df`` with columns of equal names told apart by their tables."""
    names = [n.lower() for n in df.columns]
    if len(set(names)) == len(names):
        return df
    out = df._jdf.queryExecution().analyzed().output()
    qualified, seen = [], {}
    for i, name in enumerate(df.columns):
        new = name
        if names.count(name.lower()) > 1:
            attribute = out.apply(i)
            path = [attribute.qualifier().apply(k) for k in range(attribute.qualifier().size())]
            new = f"{path[-1]}_{name}" if path else name
        seen[new] = seen.get(new, 0) + 1
        qualified.append(new if seen[new] == 1 else f"{new}_{seen[new]}")
    return df.toDF(*qualified)
