"""Joins, partitioning and tag hierarchies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import cut

#: Rows up to which a side may be broadcast after a count.
BROADCAST_ROWS = 100_000


def small(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """With a broadcast hint if a count shows few rows; else as it is, for a shuffle join."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def equi(a: DataFrame, b: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    return a.join(b, on, how)


def salted(a: DataFrame, b: DataFrame, key: str, salts: int, tie: str) -> DataFrame:
    """Inner join whose keys are cut into parts: a's rows by a hash, b's rows repeated."""
    x = a.withColumn("__salt", F.pmod(F.xxhash64(tie), F.lit(salts)).cast("int"))
    y = b.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return x.join(y, [key, "__salt"]).drop("__salt")


def cross(a: DataFrame, b: DataFrame) -> DataFrame:
    """Every pair; for two small buffers."""
    return a.crossJoin(small(b))


def as_of(left: DataFrame, right: DataFrame, key: str, left_ts: str, right_ts: str, tie: str) -> DataFrame:
    """Each left row with the last right row of its key at or before it; one shuffle and one sort, no range join."""
    extra = [c for c in right.columns if c != key]
    x = left.select(F.col(key).alias("__k"), F.col(left_ts).alias("__t"), F.lit(1).alias("__side"), F.lit(0).cast("long").alias("__tie"), F.struct(*left.columns).alias("__l"), F.lit(None).cast(right.select(F.struct(*extra)).schema[0].dataType).alias("__r"))
    y = right.select(F.col(key).alias("__k"), F.col(right_ts).alias("__t"), F.lit(0).alias("__side"), F.col(tie).cast("long").alias("__tie"), F.lit(None).cast(x.schema["__l"].dataType).alias("__l"), F.struct(*extra).alias("__r"))
    w = Window.partitionBy("__k").orderBy("__t", "__side", "__tie").rowsBetween(Window.unboundedPreceding, 0)
    return x.union(y).withColumn("__r", F.last("__r", ignorenulls=True).over(w)).where("__side = 1").select("__l.*", *[F.col(f"__r.{c}").alias(f"right_{c}") for c in extra])


def interval(points: DataFrame, spans: DataFrame, at: str, start: str, stop: str, width: int) -> DataFrame:
    """Points within [start, stop]: spans are repeated for each cell of ``width`` that they touch, then joined on the cell."""
    x = points.withColumn("__cell", F.floor(F.col(at) / width))
    y = spans.withColumn("__cell", F.explode(F.sequence(F.floor(F.col(start) / width), F.floor(F.col(stop) / width))))
    return x.join(y, "__cell").where(F.col(at).between(F.col(start), F.col(stop))).drop("__cell")


def partition_of(key: Column, n: int) -> Column:
    """Stable partition number; crc32 of the key as text."""
    return F.crc32(key.cast("string")) % n


def ring(keys: DataFrame, key: str, nodes: list[str], replicas: int = 16) -> DataFrame:
    """Adds node by consistent hashing: the first virtual node at or after the key's hash. Nodes are few and literal."""
    import zlib

    points = sorted((zlib.crc32(f"{n}#{i}".encode()), n) for n in nodes for i in range(replicas))
    table = F.array(*[F.struct(F.lit(h).cast("long").alias("h"), F.lit(n).alias("n")) for h, n in points])
    h = F.crc32(F.col(key).cast("string"))
    return keys.withColumn("node", F.coalesce(F.get(F.filter(table, lambda p: p["h"] >= h), 0)["n"], F.lit(points[0][1])))


def descendants(spark, edges: DataFrame, root_column: str, roots: DataFrame, depth: int = 32) -> DataFrame:
    """(root, tag): each root with all tags below it. Rounds of joins until none is new, each written before the next; paths that meet again end."""
    edges = cut(edges.select("parent", "child"))
    found = last = cut(roots.select(F.col(root_column).alias("root"), F.col(root_column).alias("tag")))
    for _ in range(depth):
        last = cut(last.join(edges, F.col("tag") == F.col("parent")).select("root", F.col("child").alias("tag")).distinct().join(found, ["root", "tag"], "left_anti"))
        if last.isEmpty():
            break
        found = found.union(last)
    return found
