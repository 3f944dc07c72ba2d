"""Helpers shared by the corpus operators."""

from __future__ import annotations

import sys
import tempfile
import uuid

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def travels(module: str) -> None:
    """Send what ``module`` defines to executors by value: they need not have it installed."""
    cloudpickle.register_pickle_by_value(sys.modules[module])


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``.

    Only where the session leaves it unset and runs on one machine is a folder
    made here and put into the session's configuration; on a cluster executors
    would write to disks that the others don't see, which raises.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.conf.get("spark.master", "").startswith("local") or spark.conf.get("spark.master").startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        path = f"file://{tempfile.mkdtemp(prefix='sparkloom-')}"
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def written(df: DataFrame, label: str) -> DataFrame:
    """Cut lineage: write ``df`` as Parquet to the shared folder and read it.

    Files in the shared folder outlive the executors that wrote them, and go
    when the session ends. The schema is passed on, so that an empty result
    reads back too.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    there.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(there)
    return spark.read.schema(df.schema).parquet(path)


#: Rows of up to 16 bytes that a join may broadcast: some 50 MB as a hash table. Beyond, it shuffles.
BROADCAST_ROWS = 500_000


def small(keys: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """``keys``, a written table of short rows, to be broadcast in a join if they are counted to be few."""
    return F.broadcast(keys) if keys.limit(most + 1).count() <= most else keys


def tokens(text: str = "text") -> F.Column:
    """Number of words ``[^\\x20\\x09-\\x0D]+`` of a string column; null: 0."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
