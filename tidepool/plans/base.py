"""Registry of the engine's queries: each has a DataFrame plan, the commands it covers, and SQL with the same rows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import configure


class Tables:
    """The tables of a folder, read when they are asked for."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = configure(spark), folder

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


@dataclass(frozen=True)
class Plan:
    name: str
    run: Callable[[Tables], DataFrame]
    sql: str | None
    commands: tuple[str, ...]

    def __call__(self, spark: SparkSession, folder: str) -> DataFrame:
        return self.run(Tables(spark, folder))


PLANS: dict[str, Plan] = {}


def plan(*commands: str, sql: str | None = None, name: str | None = None):
    """Register a function of Tables. commands may end in ``.*`` for a family."""

    def add(run: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        key = name or run.__name__
        assert key not in PLANS, key
        PLANS[key] = Plan(key, run, sql, commands)
        return run

    return add


def crc32_sql(text: str) -> str:
    """CRC-32 of ASCII text in SQL, a bit at a time: each byte enters at the first of its eight steps."""
    bits = f"flatten([[ord(ch)::bigint, 0, 0, 0, 0, 0, 0, 0] for ch in string_split({text}, '') if ch <> ''])"
    return f"xor(4294967295, list_reduce([4294967295::bigint] || {bits}, lambda a, e: xor(xor(a, e) >> 1, (xor(a, e) & 1) * 3988292384)))"


def scalars(table: str, key: str, entries: dict[str, tuple[str, Callable[[], Column], str | None]]) -> None:
    """A query of (key, value) for each entry: name -> commands, Column, SQL."""
    for name, (commands, column, sql) in entries.items():

        def run(t: Tables, column: Callable[[], Column] = column) -> DataFrame:
            return getattr(t, table).select(F.col(key).alias("key"), column().alias("value"))

        plan(*commands.split(), name=name, sql=f"select {key} as key, {sql} as value from {table}" if sql else None)(run)
