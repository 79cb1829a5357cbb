"""Hashes and objects as maps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def put(m: Column, key: Column | str, value: Column) -> Column:
    """Set or replace a field; the session lets the last of equal keys win."""
    return F.map_concat(m, F.create_map(F.lit(key) if isinstance(key, str) else key, value))


def put_new(m: Column, key: str, value: Column) -> Column:
    return F.when(F.map_contains_key(m, key), m).otherwise(put(m, key, value))


def drop(m: Column, *keys: str) -> Column:
    return F.map_filter(m, lambda k, _: ~k.isin(*keys))


def pick(m: Column, *keys: str) -> Column:
    return F.map_filter(m, lambda k, _: k.isin(*keys))


def merge(m: Column, other: Column) -> Column:
    return F.map_concat(m, other)


def increment(m: Column, key: str, by: float | Column) -> Column:
    return put(m, key, F.coalesce(F.try_element_at(m, F.lit(key)), F.lit(0)) + by)


def normalized(m: Column, method: str = "minmax") -> Column:
    """Feature values by range (minmax), length (l2) or largest size (max)."""
    v = F.map_values(m)
    if method == "minmax":
        low, high = F.array_min(v), F.array_max(v)
        return F.transform_values(m, lambda _, x: F.when(high > low, (x - low) / (high - low)).otherwise(0.0))
    size = F.sqrt(F.aggregate(v, F.lit(0.0), lambda t, x: t + x * x)) if method == "l2" else F.array_max(F.transform(v, F.abs))
    return F.transform_values(m, lambda _, x: F.when(size > 0, x / size).otherwise(0.0))


def clock_merge(a: Column, b: Column) -> Column:
    return F.map_zip_with(a, b, lambda _, x, y: F.greatest(F.coalesce(x, F.lit(0)), F.coalesce(y, F.lit(0))))


def clock_compare(a: Column, b: Column) -> Column:
    """before: a happened before b."""
    pairs = F.map_values(F.map_zip_with(a, b, lambda _, x, y: F.coalesce(x, F.lit(0)) - F.coalesce(y, F.lit(0))))
    less, more = F.exists(pairs, lambda d: d < 0), F.exists(pairs, lambda d: d > 0)
    return F.when(less & more, "concurrent").when(less, "before").when(more, "after").otherwise("equal")
