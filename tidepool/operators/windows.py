"""Time series, rollups and windows. Every window is partitioned by series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .aggregates import KINDS


def last_n(df: DataFrame, by: str, order: list[str], value: str, n: int, *kinds: str) -> DataFrame:
    """Adds, for each row, aggregates of the last n values of its key."""
    w = Window.partitionBy(by).orderBy(*order).rowsBetween(1 - n, 0)
    return df.withColumns({f"last_{k}": KINDS[k](value).over(w) for k in kinds})


def ring(df: DataFrame, by: str, order: list[Column], n: int) -> DataFrame:
    """The last n rows of each key; order: newest first."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("__n") <= n).drop("__n")


def downsample(df: DataFrame, series: str, ts: str, value: str, seconds: int, tie: str) -> DataFrame:
    """Fixed buckets from the epoch: count, sum, avg, min, max, first and last."""
    bucket = F.window(F.col(ts).cast("timestamp"), f"{seconds} seconds").getField("start")
    order = F.struct(ts, tie)
    return df.groupBy(series, bucket.alias("bucket")).agg(
        F.count(value).alias("n"), F.sum(value).alias("total"), F.avg(value).alias("mean"), F.min(value).alias("low"), F.max(value).alias("high"), F.min_by(value, order).alias("first"), F.max_by(value, order).alias("last")
    )


def between(df: DataFrame, ts: str, start: str, stop: str) -> DataFrame:
    return df.where(F.col(ts).between(F.lit(start).cast("timestamp_ntz"), F.lit(stop).cast("timestamp_ntz")))


def latest(df: DataFrame, series: str, order: Column) -> DataFrame:
    """The last row of each series; combines before the shuffle."""
    rest = [c for c in df.columns if c != series]
    return df.groupBy(series).agg(F.max_by(F.struct(*rest), order).alias("__r")).select(series, "__r.*")


def info(df: DataFrame, series: str, ts: str) -> DataFrame:
    return df.groupBy(series).agg(F.count("*").alias("samples"), F.min(ts).alias("first"), F.max(ts).alias("last"))


def retained(df: DataFrame, series: str, ts: str, seconds: int) -> DataFrame:
    """Samples within ``seconds`` of their series' last one."""
    ends = df.groupBy(series).agg(F.max(ts).alias("__end"))
    return df.join(ends, series).where(F.timestamp_diff("SECOND", F.col(ts), F.col("__end")) <= seconds).drop("__end")


def previous(df: DataFrame, by: str, order: list[str], value: str) -> DataFrame:
    """Adds the value before, as a swap returns it."""
    return df.withColumn("previous", F.lag(value).over(Window.partitionBy(by).orderBy(*order)))


def trailing(df: DataFrame, by: str, ts: str, seconds: int, tie: str | None = None) -> DataFrame:
    """Adds the number of the key's rows in the ``seconds`` up to each row, itself included."""
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    w = Window.partitionBy(by).orderBy(at).rangeBetween(-seconds * 1_000_000, 0)
    return df.withColumn("recent", F.count("*").over(w))


def sessions(df: DataFrame, by: str, ts: str, gap: int, tie: str) -> DataFrame:
    """Adds session, from 1: a new one begins after ``gap`` seconds of silence."""
    w = Window.partitionBy(by).orderBy(ts, tie)
    new = F.coalesce((F.timestamp_diff("SECOND", F.lag(ts).over(w), F.col(ts)) > gap).cast("int"), F.lit(1))
    return df.withColumn("__new", new).withColumn("session", F.sum("__new").over(w)).drop("__new")


def chain(df: DataFrame, by: str, order: list[str], data: Column) -> DataFrame:
    """Adds hash of each block and prev, the hash of the block before."""
    return df.withColumn("hash", F.sha2(data, 256)).withColumn("prev", F.coalesce(F.lag("hash").over(Window.partitionBy(by).orderBy(*order)), F.lit("")))


def chain_valid(df: DataFrame, by: str, order: list[str]) -> DataFrame:
    """(by, valid, length) of rows with hash and prev."""
    w = Window.partitionBy(by).orderBy(*order)
    ok = F.col("prev") == F.coalesce(F.lag("hash").over(w), F.lit(""))
    return df.withColumn("__ok", ok).groupBy(by).agg(F.bool_and("__ok").alias("valid"), F.count("*").alias("length"))
