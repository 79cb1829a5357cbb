"""Vectors as arrays of doubles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def double(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda t, x: t + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    n = norm(a) * norm(b)
    return F.when(n > 0, dot(a, b) / n).otherwise(0.0)


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda t, x: t + x))


def normalize(a: Column) -> Column:
    n = norm(a)
    return F.when(n > 0, F.transform(a, lambda x: x / n)).otherwise(a)


def add(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def mean(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: (x + y) / 2)


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(0.0)


def matmul(a: Column, b: Column, n: int, k: int, m: int) -> Column:
    """Flat row-major matrices n x k and k x m."""
    cell = lambda i, j: F.aggregate(F.sequence(F.lit(0), F.lit(k - 1)), F.lit(0.0), lambda t, x: t + F.get(a, i * k + x) * F.get(b, x * m + j))
    return F.flatten(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.transform(F.sequence(F.lit(0), F.lit(m - 1)), lambda j: cell(i, j))))


def reshape(a: Column, columns: int) -> Column:
    """Rows of a flat tensor."""
    return F.transform(F.sequence(F.lit(0), F.call_function("div", F.size(a), F.lit(columns)).cast("int") - 1), lambda i: F.slice(a, i * columns + 1, F.lit(columns)))
