"""Structured Streaming: sources, event-time windows, duplicates and sinks."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def stream(spark: SparkSession, path: str, files_per_trigger: int = 64) -> DataFrame:
    """A Parquet file or folder as a stream; its schema is read once."""
    schema = spark.read.parquet(path).schema
    pattern = f"{path[:-1]}[{path[-1]}]"  # a pattern may name a single file
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(pattern)


def tumbling(df: DataFrame, ts: str, by: str, value: str, width: str, late: str) -> DataFrame:
    return df.withWatermark(ts, late).groupBy(F.window(ts, width), by).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("window.start").alias("start"), by, "n", "total")


def sliding(df: DataFrame, ts: str, by: str, width: str, step: str, late: str) -> DataFrame:
    return df.withWatermark(ts, late).groupBy(F.window(ts, width, step), by).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), by, "n")


def sessions(df: DataFrame, ts: str, by: str, gap: str, late: str) -> DataFrame:
    return df.withWatermark(ts, late).groupBy(F.session_window(ts, gap), by).agg(F.count("*").alias("n")).select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("stop"), by, "n")


def without_duplicates(df: DataFrame, ts: str, keys: list[str], late: str) -> DataFrame:
    return df.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)


def joined(left: DataFrame, right: DataFrame, condition: str, left_ts: str, right_ts: str, late: str) -> DataFrame:
    """Stream to stream; the condition bounds the times, so that state can be dropped."""
    return left.withWatermark(left_ts, late).join(right.withWatermark(right_ts, late), F.expr(condition))


def folder(spark: SparkSession) -> str:
    """A new folder that all executors share."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    base = base or tempfile.mkdtemp("streams")
    return f"{base.rstrip('/')}/stream-{uuid.uuid4().hex}"


def run(df: DataFrame, mode: str = "append") -> DataFrame:
    """Process what is there, exactly once, into a Parquet folder; the result as a table.

    In complete mode each batch replaces the last.
    """
    spark, at = df.sparkSession, folder(df.sparkSession)
    writer = df.writeStream.option("checkpointLocation", f"{at}/state").trigger(availableNow=True).outputMode(mode)
    if mode == "append":
        query = writer.format("parquet").option("path", f"{at}/out").start()
    else:
        query = writer.foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(f"{at}/out")).start()
    query.awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{at}/out")


def each_batch(df: DataFrame, apply: Callable[[DataFrame, int], None]) -> None:
    """Run a function on each micro-batch of what is there."""
    at = folder(df.sparkSession)
    df.writeStream.option("checkpointLocation", f"{at}/state").trigger(availableNow=True).foreachBatch(apply).start().awaitTermination()
