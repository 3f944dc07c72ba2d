"""Table sources and sinks: Parquet, delimited .tbl files, pair files, JSON, CSV."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom.errors import SourceError

#: The tables that are loaded together, in this order.
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")


def scratch(spark: SparkSession) -> str:
    """A new folder's path where all executors can write and read: under ``spark.checkpoint.dir``, or, on one machine, a folder made here."""
    base, master = spark.conf.get("spark.checkpoint.dir", None), spark.conf.get("spark.master", "")
    if not base:
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise SourceError("spark.checkpoint.dir must name a folder that all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='sparkloom-')}"
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def read_parquet(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_tbl(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A ``|``-delimited file without a header, with or without a ``|`` at a line's end.

    Spaces and tabs around values and blank lines are ignored, and lines may end in
    CRLF. A value that isn't of its column's type fails the load with the file's name
    and the line; so does a line with too few or too many values. An empty value of
    another type than string is null.
    """
    lines = spark.read.text(path).select(F.rtrim("value").alias("_line"), F.input_file_name().alias("_file"))
    lines = lines.where(F.length(F.trim("_line")) > 0)
    n = len(schema.fields)
    parts = F.split("_line", r"\|", -1)

    def failed(what: str) -> Column:
        return F.raise_error(F.concat(F.lit(f"{what} in "), "_file", F.lit(": "), F.substring("_line", 1, 200)))

    rows = lines.withColumn("_parts", F.when(_count("_line", parts) == n, parts).otherwise(failed(f"not {n} values").cast("array<string>")))
    columns = []
    for i, f in enumerate(schema.fields):
        text = F.trim(F.get("_parts", F.lit(i)), F.lit(" \t\r"))
        if isinstance(f.dataType, T.StringType):
            value = text
        else:
            some = F.when(text != "", text)
            value = some.try_cast(f.dataType)
            value = F.when(some.isNotNull() & value.isNull(), failed(f"no {f.dataType.simpleString()} for {f.name}").cast(f.dataType)).otherwise(value)
        columns.append(value.alias(f.name, metadata=f.metadata))
    return rows.select(*columns)


def _count(line: str, parts: Column) -> Column:
    """The number of a line's values; nothing follows a ``|`` at its end."""
    return F.size(parts) - F.endswith(F.col(line), F.lit("|")).cast("int")


def _checked(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The lines of ``path`` with their places, and whether read_tbl fails for them (_bad)."""
    lines = _placed(spark.read.text(path), F.rtrim("value").alias("_line"), F.split(F.rtrim("value"), r"\|", -1).alias("_parts"))
    bad = _count("_line", F.col("_parts")) != len(schema.fields)
    for i, f in enumerate(schema.fields):
        if not isinstance(f.dataType, T.StringType):
            text = F.trim(F.get("_parts", F.lit(i)), F.lit(" \t\r"))
            bad |= F.coalesce((text != "") & text.try_cast(f.dataType).isNull(), F.lit(False))
    return lines.withColumn("_bad", bad & (F.length(F.trim("value")) > 0))


def _placed(lines: DataFrame, *more: Column) -> DataFrame:
    """Lines of text with their file, its split and an id that counts up within the split.

    What is given in ``more`` is computed once a line: no filter that uses it moves below the ids.
    """
    return lines.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_split"), F.monotonically_increasing_id().alias("_at"), *more)


def _numbered(lines: DataFrame, some: DataFrame | None = None) -> DataFrame:
    """``some`` of the lines, or all, with ``line``, which counts from 1 within the file.

    Lines are numbered within their split of the file, and splits by the lines before them, so that no file is read as one.
    """
    sizes = lines.groupBy("file", "_split").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    ahead = Window.partitionBy("file").orderBy("_split").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("_ahead", F.coalesce(F.sum("_n").over(ahead), F.lit(0)))
    found = (lines if some is None else some).join(F.broadcast(sizes), ["file", "_split"])  # a split's ids follow one another
    return found.withColumn("line", F.col("_ahead") + F.col("_at") - F.col("_first") + 1)


def bad_lines(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """(file, line, text) of the lines for which read_tbl fails; line counts from 1 within the file."""
    lines = _checked(spark, path, schema)
    return _numbered(lines, lines.where("_bad")).select("file", "line", F.col("value").alias("text"))


def write_tbl(table: DataFrame, path: str) -> None:
    """The counterpart of read_tbl; nulls are written as empty values."""
    line = F.concat(*[F.concat(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("|")) for c in table.columns])
    table.select(line.alias("value")).write.text(path)


def load_all(spark: SparkSession, sf_dir: str, expected: dict[str, int] | None = None, names: tuple[str, ...] = TABLES, schemas: dict[str, T.StructType] | None = None) -> dict[str, DataFrame]:
    """All tables, in order; with expected counts, a table of another size raises. A table in ``schemas`` is
    read from its ``.tbl`` file, whose first line that doesn't fit raises with the file's name and the line's number."""
    out = {}
    for name in names:
        if schemas and name in schemas:
            path = f"{sf_dir}/{name}.tbl"
            # One pass tells whether all is well; only if not are lines numbered.
            if _checked(spark, path, schemas[name]).agg(F.max("_bad")).first()[0] and (bad := bad_lines(spark, path, schemas[name]).orderBy("file", "line").first()):
                raise SourceError(f"{bad['file']}:{bad['line']}: {bad['text'][:200]}")
            out[name] = read_tbl(spark, path, schemas[name])
        else:
            out[name] = read_parquet(spark, sf_dir, name)
        if expected and name in expected and (n := out[name].count()) != expected[name]:
            raise SourceError(f"{name} has {n} rows, not {expected[name]}")
    return out


def read_pairs(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The two tables of a pair file: a line with both sizes, a blank line, then ``key data`` lines, the first table's first.

    Lines are told apart by their place in the one file, which is read in splits.
    """
    lines = _numbered(_placed(spark.read.option("lineSep", "\n").text(path))).select((F.col("line") - 1).alias("at"), F.regexp_replace("value", r"\r$", "").alias("line"))
    head = spark.read.option("lineSep", "\n").text(path).where(F.col("_metadata.file_block_start") == 0).first()
    sizes = re.fullmatch(r"\s*(\d+)\s+(\d+)\s*", head["value"] if head else "")
    if not sizes:
        raise SourceError(f"{path} doesn't begin with two sizes")
    first, second = int(sizes[1]), int(sizes[2])
    rows = lines.where((F.col("at") > 0) & (F.length(F.trim("line")) > 0))
    pairs = rows.select("at", F.regexp_extract("line", r"^\s*(-?\d+)", 1).cast("long").alias("key"), F.regexp_extract("line", r"^\s*-?\d+\s+(.*?)\s*$", 1).alias("data"))
    start = 2  # size line and blank line
    in_one = (F.col("at") >= start) & (F.col("at") < start + first)
    in_two = (F.col("at") >= start + first) & (F.col("at") < start + first + second)
    found = rows.agg(F.count_if(in_one), F.count_if(in_two)).first()
    if tuple(found) != (first, second):
        raise SourceError(f"{path} has other rows than its sizes say")
    return pairs.where(in_one).select("key", "data"), pairs.where(in_two).select("key", "data")


def write_pairs(first: DataFrame, second: DataFrame, path: str) -> None:
    """The counterpart of read_pairs, of two tables of (key, data)."""
    spark = first.sparkSession
    head = spark.createDataFrame([(0, f"{first.count()} {second.count()}"), (1, "")], "part int, value string")
    line = F.concat(F.col("key").cast("string"), F.lit(" "), F.coalesce(F.col("data").cast("string"), F.lit("")))
    for part, rows in ((2, first), (3, second)):
        head = head.unionByName(rows.select(F.lit(part).alias("part"), line.alias("value")))
    head.coalesce(1).sortWithinPartitions("part").select("value").write.text(path)


def write_rows(table: DataFrame, path: str, form: str = "parquet", **options) -> None:
    """Write as parquet, json, csv or orc; a folder that exists is an error."""
    writer = table.write.format(form)
    for k, v in options.items():
        writer = writer.option(k, v)
    writer.save(path)
