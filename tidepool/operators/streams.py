"""Append-only streams, consumer groups, topics and event sourcing over logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def entry_id(ms: Column, seq: Column) -> Column:
    """ms-seq as text; order by the two numbers, never by the text."""
    return F.concat_ws("-", ms.cast("string"), seq.cast("string"))


def numbered(df: DataFrame, stream: str, ts: str, tie: str) -> DataFrame:
    """Adds ms and seq: the place among the stream's entries of a millisecond."""
    ms = F.unix_millis(F.col(ts).cast("timestamp"))
    return df.withColumn("ms", ms).withColumn("seq", F.row_number().over(Window.partitionBy(stream, "ms").orderBy(tie)) - 1)


def after(entries: DataFrame, ms: int, seq: int) -> DataFrame:
    return entries.where((F.col("ms") > ms) | ((F.col("ms") == ms) & (F.col("seq") > seq)))


def pending(deliveries: DataFrame, acks: DataFrame, keys: list[str]) -> DataFrame:
    """Deliveries without an ack: the last one of each entry, with how often it was delivered."""
    rest = [c for c in deliveries.columns if c not in keys]
    last = deliveries.groupBy(*keys).agg(F.max_by(F.struct(*rest), "at").alias("__r"), F.count("*").alias("deliveries")).select(*keys, "__r.*", "deliveries")
    return last.join(acks.select(*keys).distinct(), keys, "left_anti")


def pending_summary(p: DataFrame, group: str, consumer: str, entry: str) -> DataFrame:
    return p.groupBy(group, consumer).agg(F.count("*").alias("n"), F.min(entry).alias("first"), F.max(entry).alias("last"))


def claimable(p: DataFrame, at: str, now: Column, idle_seconds: int) -> DataFrame:
    return p.where(F.timestamp_diff("SECOND", F.col(at), now) >= idle_seconds)


def redelivered(log: DataFrame, message: str, ok: str, most: int) -> DataFrame:
    """(message, outcome, tries): acked, dead after ``most`` failures, or waiting."""
    tries = log.groupBy(message).agg(F.count("*").alias("tries"), F.max(F.col(ok).cast("int")).alias("__ok"))
    return tries.select(message, F.when(F.col("__ok") == 1, "acked").when(F.col("tries") >= most, "dead").otherwise("waiting").alias("outcome"), "tries")


def fan_out(messages: DataFrame, subscriptions: DataFrame, channel: str) -> DataFrame:
    """Messages to each subscriber of their channel. subscriptions: (subscriber, pattern) with SQL LIKE patterns, few."""
    from .joins import small

    return messages.join(small(subscriptions), F.expr(f"{channel} LIKE pattern"))


def versions(events: DataFrame, stream: str, order: list[str]) -> DataFrame:
    """Adds version, from 1, within each stream."""
    return events.withColumn("version", F.row_number().over(Window.partitionBy(stream).orderBy(*order)))
