"""Arithmetic over columns. Integer division and remainder truncate toward zero."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def add(*xs: Column) -> Column:
    return reduce(lambda a, b: a + b, xs)


def sub(*xs: Column) -> Column:
    return reduce(lambda a, b: a - b, xs)


def mul(*xs: Column) -> Column:
    return reduce(lambda a, b: a * b, xs)


def div(a: Column, b: Column) -> Column:
    """Null where b is 0."""
    return F.when(b != 0, F.call_function("div", a, b))


def mod(a: Column, b: Column) -> Column:
    return F.when(b != 0, a % b)


def power(a: Column, n: int) -> Column:
    return F.pow(a, F.lit(n))


def random_between(low: int, high: int, seed: int = 42) -> Column:
    return F.floor(F.rand(seed) * (high - low + 1)).cast("long") + low


def evaluate(expression: str) -> Column:
    """A SQL arithmetic expression over columns; ^ is a power."""
    import re

    text = re.sub(r"([\w.]+|\([^()]*\))\s*\^\s*([\w.]+|\([^()]*\))", r"power(\1, \2)", expression)
    return F.expr(text).cast("double")
