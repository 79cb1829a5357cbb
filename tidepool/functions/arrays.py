"""Lists as arrays. Places count from 0; negative ones from the end."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def push(a: Column, *xs: Column) -> Column:
    return F.concat(a, F.array(*xs))


def unshift(a: Column, *xs: Column) -> Column:
    """Each is put in front in turn, so the last one comes first."""
    return F.concat(F.array(*reversed(xs)), a)


def prepend(a: Column, *xs: Column) -> Column:
    """In front, in the order given."""
    return F.concat(F.array(*xs), a)


def pop(a: Column) -> Column:
    return F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(0)))


def shift(a: Column) -> Column:
    return F.slice(a, F.lit(2), F.size(a))


def at(a: Column, i: int) -> Column:
    return F.get(a, F.lit(i) if i >= 0 else F.size(a) + i)


def slice_(a: Column, start: int, stop: int) -> Column:
    """[start, stop), clamped."""
    n = F.size(a)
    x = F.greatest(F.lit(0), F.lit(start) if start >= 0 else n + start)
    y = F.least(n, F.lit(stop) if stop >= 0 else n + stop)
    return F.slice(a, x + 1, F.greatest(F.lit(0), y - x))


def range_(a: Column, start: int, stop: int) -> Column:
    """Inclusive, as of a list."""
    n = F.size(a)
    x = F.greatest(F.lit(0), F.lit(start) if start >= 0 else n + start)
    y = F.least(n - 1, F.lit(stop) if stop >= 0 else n + stop)
    return F.slice(a, x + 1, F.greatest(F.lit(0), y - x + 1))


def splice(a: Column, start: int, count: int, *xs: Column) -> Column:
    return F.concat(F.slice(a, 1, start) if start else F.slice(a, 1, 0), F.array(*xs), F.slice(a, F.lit(start + count + 1), F.size(a)))


def set_at(a: Column, i: int, x: Column) -> Column:
    j = F.lit(i) if i >= 0 else F.size(a) + i
    return F.transform(a, lambda v, n: F.when(n == j, x).otherwise(v))


def insert(a: Column, pivot: Column, x: Column, before: bool = True) -> Column:
    """Beside the first pivot; unchanged where there is none."""
    p = F.array_position(a, pivot).cast("int")
    k = p - 1 if before else p
    return F.when(p == 0, a).otherwise(F.concat(F.slice(a, F.lit(1), k), F.array(x), F.slice(a, k + 1, F.size(a))))


def index_of(a: Column, x: Column) -> Column:
    return F.array_position(a, x) - 1


def last_index_of(a: Column, x: Column) -> Column:
    p = F.array_position(F.reverse(a), x)
    return F.when(p == 0, F.lit(-1)).otherwise(F.size(a) - p)


def positions(a: Column, x: Column, rank: int = 1, count: int = 0) -> Column:
    """All places of x from the rank-th on; a negative rank looks from the end. count 0: all."""
    hits = F.filter(F.transform(a, lambda v, i: F.when(v == x, i)), lambda i: i.isNotNull())
    hits = F.reverse(hits) if rank < 0 else hits
    return F.slice(hits, F.lit(abs(rank)), F.lit(count) if count else F.size(hits))


def remove(a: Column, x: Column, count: int = 0) -> Column:
    """All (0), the first count, or the last -count occurrences go."""
    if not count:
        return F.array_remove(a, x)
    gone = positions(a, x, 1 if count > 0 else -1, abs(count))
    return F.filter(a, lambda v, i: ~F.array_contains(gone, i))


def unique(a: Column) -> Column:
    return F.array_distinct(a)


def diff(a: Column, b: Column) -> Column:
    """What b lacks; repeats stay."""
    return F.filter(a, lambda v: ~F.array_contains(b, v))


def sort(a: Column, descending: bool = False) -> Column:
    return F.sort_array(a, asc=not descending)


def mapped(a: Column, operation: str) -> Column:
    by = {"upper": F.upper, "lower": F.lower, "reverse": F.reverse, "double": lambda v: v * 2}[operation]
    return F.transform(a, by)


def kept(a: Column, condition: str) -> Column:
    by = {"even": lambda v: v % 2 == 0, "odd": lambda v: v % 2 != 0, "positive": lambda v: v > 0, "negative": lambda v: v < 0}[condition]
    return F.filter(a, by)


def reduced(a: Column, operation: str) -> Column:
    if operation == "sum":
        return F.aggregate(a, F.lit(0).cast("long"), lambda x, v: x + v)
    return {"max": F.array_max, "min": F.array_min}[operation](a)
