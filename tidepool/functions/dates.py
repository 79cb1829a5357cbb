"""Timestamps. Months clamp to their last day; weeks start on Sunday."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UNITS = ("SECOND", "MINUTE", "HOUR", "DAY", "WEEK", "MONTH", "YEAR")


def _unit(unit: str) -> str:
    name = unit.upper().removesuffix("S")
    if name not in UNITS:
        raise ValueError(f"no such unit: {unit}")
    return name


def add(ts: Column, unit: str, n: int | Column) -> Column:
    amount = n if isinstance(n, Column) else F.lit(n)
    return F.timestamp_add(_unit(unit), amount, ts)


def diff(a: Column, b: Column, unit: str) -> Column:
    """Whole units from a to b."""
    return F.timestamp_diff(_unit(unit), a, b)


def start_of(ts: Column, unit: str) -> Column:
    if _unit(unit) == "WEEK":
        return F.date_trunc("DAY", ts) - F.make_dt_interval(F.dayofweek(ts) - 1)
    return F.date_trunc(_unit(unit), ts)


def end_of(ts: Column, unit: str) -> Column:
    """The last second of the unit."""
    return add(add(start_of(ts, unit), unit, 1), "second", -1)


def fmt(ts: Column, layout: str) -> Column:
    return F.date_format(ts, layout)


def parse(text: Column) -> Column:
    """10 digits are seconds, 13 milliseconds, else ISO 8601."""
    return F.when(text.rlike("^[0-9]{10}$"), F.timestamp_seconds(text.try_cast("long"))).when(text.rlike("^[0-9]{13}$"), F.timestamp_millis(text.try_cast("long"))).otherwise(F.try_to_timestamp(text))


def now() -> Column:
    return F.struct(F.unix_timestamp().alias("s"), F.unix_millis(F.current_timestamp()).alias("ms"), F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssXXX").alias("iso"))
