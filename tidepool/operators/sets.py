"""Sets as rows of (key, member), and duplicates in time."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def union(sets: list[DataFrame], member: str) -> DataFrame:
    return reduce(DataFrame.union, [s.select(member) for s in sets]).distinct()


def intersection(sets: list[DataFrame], member: str) -> DataFrame:
    """One shuffle for any number of sets: count the sets that have a member."""
    rows = reduce(DataFrame.union, [s.select(member, F.lit(1 << i).cast("long").alias("__set")) for i, s in enumerate(sets)])
    return rows.groupBy(member).agg(F.bit_or("__set").alias("__m")).where(F.col("__m") == (1 << len(sets)) - 1).select(member)


def difference(first: DataFrame, others: list[DataFrame], member: str) -> DataFrame:
    return reduce(lambda a, b: a.join(b.select(member), member, "left_anti"), others, first.select(member).distinct())


def membership(members: DataFrame, s: DataFrame, member: str) -> DataFrame:
    """Adds found to each row of members."""
    marked = s.select(member).distinct().withColumn("__in", F.lit(True))
    return members.join(marked, member, "left").withColumn("found", F.coalesce("__in", F.lit(False))).drop("__in")


def move(sets: DataFrame, key: str, member: str, source: str, target: str, which: DataFrame) -> DataFrame:
    """Members in ``which`` go from one set to another; the others stay."""
    moving = which.select(member).distinct().withColumn("__go", F.lit(True))
    out = sets.join(moving, member, "left")
    return out.select(F.when((F.col(key) == source) & F.col("__go"), target).otherwise(F.col(key)).alias(key), member).distinct()


def first_seen(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key; combines before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("__r")).select(*keys, "__r.*")


def new_within(df: DataFrame, key: str, ts: str, seconds: int, tie: str) -> DataFrame:
    """Adds is_new: no row of the key in the seconds before."""
    last = F.lag(F.col(ts)).over(Window.partitionBy(key).orderBy(ts, tie))
    gap = F.timestamp_diff("SECOND", last, F.col(ts))
    return df.withColumn("is_new", last.isNull() | (gap >= seconds))


def observed_remove(log: DataFrame, name: str, member: str, op: str, seq: str) -> DataFrame:
    """Members whose last operation was an add."""
    return log.groupBy(name, member).agg(F.max_by(op, seq).alias("__op")).where(F.col("__op") == "add").select(name, member)
