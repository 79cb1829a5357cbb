"""Sketches. Each is built by partial aggregates that merge, so its shuffle is the sketch, not the rows."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: A hash of an item for each number: long, and not negative after pmod.
Hash = Callable[[Column, int], Column]


def by_xxhash(item: Column, i: int) -> Column:
    return F.xxhash64(item, F.lit(i))


def by_md5(item: Column, i: int) -> Column:
    """60 bits of the MD5 of ``item:i``. Slower, but other systems compute it too, so filters can be exchanged."""
    return F.conv(F.substring(F.md5(F.concat(item.cast("string"), F.lit(f":{i}")).cast("binary")), 1, 15), 16, 10).cast("long")


def hll(df: DataFrame, by: list[str], item: str, bits: int = 12) -> DataFrame:
    """(by, sketch) for merging."""
    return df.groupBy(*by).agg(F.hll_sketch_agg(item, bits).alias("sketch"))


def hll_count(sketches: DataFrame, by: list[str]) -> DataFrame:
    return sketches.groupBy(*by).agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("estimate"))


def bloom_size(items: int, error: float) -> tuple[int, int]:
    """Bits and hashes for a number of items and a rate of false positives."""
    bits = max(64, math.ceil(-items * math.log(error) / math.log(2) ** 2))
    return bits, max(1, round(bits / max(1, items) * math.log(2)))


def _places(item: Column, bits: int, hashes: int, hashed: Hash) -> Column:
    return F.array(*[F.pmod(hashed(item, i), F.lit(bits)) for i in range(hashes)])


def bloom(df: DataFrame, item: str, bits: int, hashes: int, hashed: Hash = by_xxhash) -> DataFrame:
    """(word, mask): the filter as 64-bit words, of which only those with a bit are rows."""
    at = df.select(F.explode(_places(F.col(item), bits, hashes, hashed)).alias("p"))
    return at.groupBy(F.call_function("div", F.col("p"), F.lit(64)).alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("p") % 64).cast("int"))).alias("mask"))


def bloom_contains(probe: DataFrame, item: str, words: DataFrame, bits: int, hashes: int, hashed: Hash = by_xxhash) -> DataFrame:
    """Adds maybe. The filter is joined by word; nothing is collected."""
    asked = probe.select(item).distinct().select(item, F.explode(_places(F.col(item), bits, hashes, hashed)).alias("p")).select(item, F.call_function("div", F.col("p"), F.lit(64)).alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("p") % 64).cast("int")).alias("bit"))
    hit = asked.join(words, "word", "left").groupBy(item).agg(F.min((F.coalesce(F.col("mask"), F.lit(0).cast("long")).bitwiseAND(F.col("bit")) != 0).cast("int")).alias("__m"))
    return probe.join(hit, item, "left").withColumn("maybe", F.col("__m") == 1).drop("__m")


def _cells(item: str, depth: int, width: int, hashed: Hash) -> Column:
    return F.array(*[F.struct(F.lit(i).alias("row"), F.pmod(hashed(F.col(item), i), F.lit(width)).alias("cell")) for i in range(depth)])


def count_min(df: DataFrame, item: str, depth: int, width: int, count: Column | None = None, hashed: Hash = by_xxhash) -> DataFrame:
    """(row, cell, n): the counters that aren't 0; sketches merge by union and sum."""
    n = count if count is not None else F.lit(1)
    cells = _cells(item, depth, width, hashed)
    return df.groupBy(item).agg(F.sum(n).alias("n")).select("n", F.explode(cells).alias("c")).groupBy("c.row", "c.cell").agg(F.sum("n").alias("n"))


def count_min_query(items: DataFrame, item: str, cells: DataFrame, depth: int, width: int, hashed: Hash = by_xxhash) -> DataFrame:
    """(item, estimate): the least of the item's counters."""
    asked = items.select(item).distinct().select(item, F.explode(_cells(item, depth, width, hashed)).alias("c")).select(item, "c.row", "c.cell")
    return asked.join(cells, ["row", "cell"], "left").groupBy(item).agg(F.min(F.coalesce("n", F.lit(0))).alias("estimate"))


def _print(item: str, buckets: int, prints: int, hashed: Hash) -> list[Column]:
    h = hashed(F.col(item), 0)
    return [F.pmod(h, F.lit(buckets)).alias("bucket"), F.pmod(F.shiftrightunsigned(h, 40), F.lit(prints)).alias("print")]


def fingerprints(df: DataFrame, item: str, buckets: int = 1 << 20, prints: int = 1 << 16, hashed: Hash = by_xxhash) -> DataFrame:
    """(bucket, print, n): prints in buckets. Unlike a Bloom filter it can delete: union with n = -1 and sum."""
    return df.select(*_print(item, buckets, prints, hashed)).groupBy("bucket", "print").agg(F.count("*").alias("n"))


def fingerprints_contain(probe: DataFrame, item: str, rows: DataFrame, buckets: int = 1 << 20, prints: int = 1 << 16, hashed: Hash = by_xxhash) -> DataFrame:
    """(item, maybe): whether the item's print is in its bucket. rows: fingerprints, summed after deletes."""
    asked = probe.select(item).distinct().select(item, *_print(item, buckets, prints, hashed))
    return asked.join(rows, ["bucket", "print"], "left").select(item, (F.coalesce("n", F.lit(0)) > 0).alias("maybe"))


def quantiles(df: DataFrame, by: list[str], value: str, at: list[float], accuracy: int = 10_000) -> DataFrame:
    """Approximate, from a mergeable sketch."""
    return df.groupBy(*by).agg(F.percentile_approx(value, at, accuracy).alias("quantiles"))


def quantiles_exact(df: DataFrame, by: list[str], value: str, at: list[float]) -> DataFrame:
    return df.groupBy(*by).agg(F.percentile(value, at).alias("quantiles"))


def cdf(df: DataFrame, by: list[str], value: str, x: float) -> DataFrame:
    return df.groupBy(*by).agg(F.avg((F.col(value) <= x).cast("double")).alias("cdf"))


def histogram(df: DataFrame, by: list[str], value: str, low: float, high: float, width: float) -> DataFrame:
    """(by, bucket, n): -1 below low, the last bucket at or above high."""
    last = math.floor((high - low) / width)
    bucket = F.when(F.col(value) < low, -1).when(F.col(value) >= high, last).otherwise(F.floor((F.col(value) - low) / width))
    return df.groupBy(*by, bucket.cast("int").alias("bucket")).agg(F.count("*").alias("n"))
