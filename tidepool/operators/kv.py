"""A keyspace as a log of operations.

Rows of ``(seq, ts, key, op, value, ...)`` are appended and never changed; what a command reads is
a query over them. Last-write-wins folds use ``max_by``, which combines before the shuffle, so a
key with many writes is no hot spot.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(log: DataFrame, keys: list[str], seq: str, op: str | None = None, deletes: tuple[str, ...] = ("del",)) -> DataFrame:
    """The last row of each key; keys whose last operation deletes are gone."""
    rest = [c for c in log.columns if c not in keys]
    out = log.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(seq)).alias("__r")).select(*keys, "__r.*")
    return out.where(~F.col(op).isin(*deletes)) if op else out


def first(log: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """First write wins, as of set-if-absent."""
    rest = [c for c in log.columns if c not in keys]
    return log.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.col(seq)).alias("__r")).select(*keys, "__r.*")


def alive(kv: DataFrame, expires: str, now: Column) -> DataFrame:
    """Without what has expired; a null expiry never comes."""
    return kv.where(F.col(expires).isNull() | (F.col(expires) >= now))


def ttl(expires: Column, now: Column) -> Column:
    """Seconds left; -1 without an expiry, -2 after it."""
    left = F.timestamp_diff("SECOND", now, expires)
    return F.when(expires.isNull(), F.lit(-1).cast("long")).when(expires < now, F.lit(-2).cast("long")).otherwise(left)


def many(wanted: DataFrame, kv: DataFrame, key: str, position: str) -> DataFrame:
    """Rows of wanted with the values found; null where there is none. Order by position."""
    return wanted.join(kv, key, "left").orderBy(position)


def glob(pattern: str) -> str:
    """A glob with *, ? and [..] as a regular expression."""
    out, i = "", 0
    while i < len(pattern):
        ch = pattern[i]
        if ch == "*":
            out += ".*"
        elif ch == "?":
            out += "."
        elif ch == "[" and "]" in pattern[i + 1 :]:
            end = pattern.index("]", i + 1)
            body = pattern[i + 1 : end]
            out += "[" + ("^" + body[1:] if body[:1] in "^!" else body) + "]"
            i = end
        elif ch == "\\" and i + 1 < len(pattern):
            i += 1
            out += "\\" + pattern[i]
        else:
            out += "\\" + ch if ch in ".+()|{}^$" else ch
        i += 1
    return f"^(?s:{out})$"


def scan(kv: DataFrame, key: str, pattern: str = "*", cursor: int = 0, count: int | None = None) -> DataFrame:
    """Keys by glob; with a count, one page in key order."""
    out = kv.where(F.col(key).rlike(glob(pattern))) if pattern != "*" else kv
    return out.orderBy(key).offset(cursor).limit(count) if count else out


def rename(kv: DataFrame, key: str, old: str, new: str, only_new: bool = False) -> DataFrame:
    """old becomes new and replaces it; with only_new, nothing happens if new exists."""
    if only_new:
        taken = kv.where(F.col(key) == new).select(F.lit(True).alias("__taken")).limit(1)
        marked = kv.join(F.broadcast(taken), F.lit(True), "left")  # one row at most
        return marked.withColumn(key, F.when((F.col(key) == old) & F.col("__taken").isNull(), new).otherwise(F.col(key))).drop("__taken")
    has = kv.where(F.col(key) == old).select(F.lit(True).alias("__has")).limit(1)
    marked = kv.join(F.broadcast(has), F.lit(True), "left")
    return marked.where(~((F.col(key) == new) & F.col("__has").isNotNull())).withColumn(key, F.when(F.col(key) == old, new).otherwise(F.col(key))).drop("__has")


def copy(kv: DataFrame, key: str, old: str, new: str, replace: bool = True) -> DataFrame:
    made = kv.where(F.col(key) == old).withColumn(key, F.lit(new))
    if replace:
        return kv.join(F.broadcast(made.select(key).limit(1)), key, "left_anti").unionByName(made)
    return kv.unionByName(made.join(kv.select(key), key, "left_anti"))


def evict(kv: DataFrame, by: Column, capacity: int, *tie: str) -> DataFrame:
    """The ``capacity`` entries that stay, the largest ``by`` first: last access (LRU) or accesses (LFU)."""
    return kv.orderBy(by.desc(), *tie).limit(capacity)


def evict_each(kv: DataFrame, name: str, by: Column, capacity: int, *tie: str) -> DataFrame:
    """The same for each named cache."""
    w = Window.partitionBy(name).orderBy(by.desc(), *tie)
    return kv.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= capacity).drop("__n")


def as_of(log: DataFrame, keys: list[str], seq: str, at: int, op: str | None = None) -> DataFrame:
    """The keyspace as a transaction that began at ``at`` sees it."""
    return latest(log.where(F.col(seq) <= at), keys, seq, op)


def conflicts(log: DataFrame, keys: list[str], seq: str, began: str, writes: DataFrame) -> DataFrame:
    """Writes whose key changed after their transaction began, as an optimistic check finds them."""
    last = log.groupBy(*keys).agg(F.max(seq).alias("__last"))
    return writes.join(last, keys).where(F.col("__last") > F.col(began)).drop("__last")
