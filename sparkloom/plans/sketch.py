"""Empty tables made up from a query's text, so that its plan can be shown without data."""

from __future__ import annotations

import re

from pyspark.sql import SparkSession
from pyspark.sql import types as T

#: What a column's name says about its type, first match first.
NAMED = (
    (r"(^|_)(id|key|count|qty|num|number|age|size|year)$", T.LongType()),
    (r"(^|_)(is|has)_|(^|_)(active|flag)$", T.BooleanType()),
    (r"date$|^date", T.DateType()),
    (r"(^|_)(ts|time|timestamp|at)$", T.TimestampType()),
    (r"price|amount|total|salary|balance|discount|tax|rate|quantity|acctbal", T.DoubleType()),
)
PLACES = (T.IntegerType(), T.StringType(), T.DoubleType(), T.BooleanType())


def column_type(name: str) -> T.DataType:
    return next((t for pattern, t in NAMED if re.search(pattern, name, re.I)), T.StringType())


def sketch_tables(spark: SparkSession, sql: str, known: dict[str, T.StructType] | None = None) -> list[str]:
    """Create an empty view for each table that ``sql`` names and that doesn't exist; their names.

    Columns are those that the query qualifies with the table or an alias of it, and
    all unqualified names where there is one table. Without any, there are col_0 to col_4.
    """
    plain = re.sub(r"'(?:[^']|'')*'", " ", sql)
    tables = re.findall(r"(?:\bFROM|\bJOIN|,)\s+(\w+)(?:\s+(?:AS\s+)?(?!ON\b|WHERE\b|GROUP\b|ORDER\b|LIMIT\b|JOIN\b|INNER\b|LEFT\b|RIGHT\b|FULL\b)([a-zA-Z]\w*))?", re.search(r"\bFROM\b.*", plain, re.I | re.S)[0].split(" WHERE ")[0], re.I)
    words = {w.lower() for w in re.findall(r"(?<![\w.])[a-zA-Z_]\w*(?![\w.(])", plain)}
    keywords = set("select from where and or not between in join inner left right full outer on as order by asc desc limit offset group having distinct is null like case when then else end date true false union all".split())
    made = []
    for name, alias in tables:
        if spark.catalog.tableExists(name):
            continue
        schema = (known or {}).get(name.lower())
        if schema is None:
            owners = {name.lower(), alias.lower()} - {""}
            columns = [c.lower() for t, c in re.findall(r"\b(\w+)\.(\w+)", plain) if t.lower() in owners]
            if len(tables) == 1:
                columns += sorted(words - keywords - owners - {c.lower() for c in columns})
            columns = list(dict.fromkeys(columns))
            fields = [T.StructField(c, column_type(c)) for c in columns]
            if not fields:
                fields = [T.StructField(f"col_{i}", PLACES[i % len(PLACES)]) for i in range(5)]
            elif "id" not in columns:
                fields = [T.StructField("id", T.LongType()), *fields]
            schema = T.StructType(fields)
        spark.createDataFrame([], schema).createOrReplaceTempView(name)
        made.append(name)
    return made
