"""Windowed counts over a stream of events."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def event_stream(spark: SparkSession, path: str) -> DataFrame:
    """A folder or file of Parquet events as a stream; ``ts`` gets the session's time zone."""
    schema = spark.read.parquet(path).schema
    folder, _, name = path.rstrip("/").rpartition("/")
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{folder}/{name}*")
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def hourly(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """(hour, event_type, n, cents): tumbling windows of an hour, events up to ``late`` late.

    A window is given once no event of it is awaited any more, so those that the
    newest events leave open aren't there.
    """
    windows = events.withWatermark("ts", late).groupBy(F.window("ts", "1 hour"), "event_type")
    out = windows.agg(F.count(F.lit(1)).alias("n"), F.sum(F.round(F.col("value") * 100).cast("long")).alias("cents"))
    return out.select(F.col("window.start").alias("hour"), "event_type", "n", "cents")


def run_once(stream: DataFrame, folder: str) -> str:
    """Work off all that is there, to the end, into Parquet under ``folder``."""
    out = f"{folder}/stream-{uuid.uuid4().hex}"
    query = stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{out}/state").option("path", f"{out}/rows").trigger(availableNow=True).start()
    query.awaitTermination()
    return f"{out}/rows"
