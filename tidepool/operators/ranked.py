"""Ranked sets: rows of (key, member, score), ordered by score, then member."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ranks(z: DataFrame, key: str, member: str, score: str, descending: bool = False) -> DataFrame:
    """Adds rank, from 0."""
    order = [F.desc(score), F.desc(member)] if descending else [F.asc(score), F.asc(member)]
    return z.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(*order)) - 1)


def top(z: DataFrame, key: str, member: str, score: str, n: int, descending: bool = True) -> DataFrame:
    """First n of each key. Spark keeps n rows of each partition before the shuffle."""
    order = [F.desc(score), F.desc(member)] if descending else [F.asc(score), F.asc(member)]
    numbered = z.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("__n") <= n)
    return numbered.withColumn("rank", F.col("__n") - 1).drop("__n")


def rank_range(z: DataFrame, key: str, member: str, score: str, start: int, stop: int) -> DataFrame:
    """Ranks from start to stop, both included; negative ones count from the end."""
    w = Window.partitionBy(key)
    out = ranks(z, key, member, score).withColumn("__n", F.count("*").over(w))
    a = F.lit(start) + (F.col("__n") if start < 0 else F.lit(0))
    b = F.lit(stop) + (F.col("__n") if stop < 0 else F.lit(0))
    return out.where((F.col("rank") >= a) & (F.col("rank") <= b)).drop("__n")


def score_range(z: DataFrame, score: str, low: float | None = None, high: float | None = None, open_low: bool = False, open_high: bool = False) -> DataFrame:
    out = z
    if low is not None:
        out = out.where(F.col(score) > low if open_low else F.col(score) >= low)
    if high is not None:
        out = out.where(F.col(score) < high if open_high else F.col(score) <= high)
    return out


def lex_range(z: DataFrame, member: str, low: str | None = None, high: str | None = None, open_low: bool = False, open_high: bool = False) -> DataFrame:
    return score_range(z, member, low, high, open_low, open_high)  # type: ignore[arg-type]


def upsert(z: DataFrame, new: DataFrame, key: str, member: str, score: str, mode: str = "") -> DataFrame:
    """Apply scores: NX only adds, XX only changes, GT and LT only raise or lower, INCR adds to the score."""
    a, b = z.select(key, member, F.col(score).alias("__old")), new.select(key, member, F.col(score).alias("__new"))
    old, fresh = F.col("__old"), F.col("__new")
    value: Column = {
        "": F.coalesce(fresh, old),
        "NX": F.coalesce(old, fresh),
        "XX": F.when(old.isNotNull(), F.coalesce(fresh, old)),
        "GT": F.greatest(old, fresh),
        "LT": F.least(old, fresh),
        "INCR": F.coalesce(old, F.lit(0.0)) + F.coalesce(fresh, F.lit(0.0)),
    }[mode]
    return a.join(b, [key, member], "full").select(key, member, value.alias(score)).where(F.col(score).isNotNull())


def combine(sets: list[tuple[DataFrame, float]], member: str, score: str, how: str = "SUM", inner: bool = False) -> DataFrame:
    """Weighted union or intersection. One shuffle for any number of sets: union, then groupBy."""
    rows = [df.groupBy(member).agg(F.max(score).alias(score)).select(member, (F.col(score) * w).alias(score), F.lit(i).alias("__set")) for i, (df, w) in enumerate(sets)]
    both = rows[0]
    for r in rows[1:]:
        both = both.union(r)
    fold = {"SUM": F.sum, "MIN": F.min, "MAX": F.max}[how]
    out = both.groupBy(member).agg(fold(score).alias(score), F.count("*").alias("__n"))
    return (out.where(F.col("__n") == len(sets)) if inner else out).drop("__n")


def difference(first: DataFrame, others: list[DataFrame], member: str) -> DataFrame:
    out = first
    for o in others:
        out = out.join(o.select(member), member, "left_anti")
    return out


def priority_pop(q: DataFrame, pops: int, *order: Column) -> DataFrame:
    """What the first pops elements are."""
    return q.orderBy(*order).limit(pops)


def sampled(df: DataFrame, n: int, seed: int = 42, *tie: str) -> DataFrame:
    """n rows without replacement, by random keys; top-k, not a sort of all rows."""
    return df.orderBy(F.xxhash64(*tie, F.lit(seed)), *tie).limit(n)


def frequencies(df: DataFrame, item: str, k: int | None = None) -> DataFrame:
    """Counts of items; ties by item."""
    out = df.groupBy(item).agg(F.count("*").alias("n"))
    return out.orderBy(F.desc("n"), item).limit(k) if k else out
