"""Tables in files: Parquet, ORC, JSON, CSV and text, and snapshots of a keyspace."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

FORMATS = ("parquet", "orc", "json", "csv", "text")


def read(spark: SparkSession, path: str, fmt: str = "parquet", schema: str | StructType | None = None, **options: str) -> DataFrame:
    """With a schema, nothing is inferred; CSV and JSON without one are read twice."""
    if fmt not in FORMATS:
        raise ValueError(f"no such format: {fmt}")
    reader = spark.read.format(fmt).options(**({"header": "true"} | options if fmt == "csv" else options))
    return (reader.schema(schema) if schema is not None else reader).load(path)


def write(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "errorifexists", by: list[str] | None = None, **options: str) -> None:
    if fmt not in FORMATS:
        raise ValueError(f"no such format: {fmt}")
    writer = df.write.format(fmt).mode(mode).options(**({"header": "true"} | options if fmt == "csv" else options))
    (writer.partitionBy(*by) if by else writer).save(path)


def snapshot(tables: dict[str, DataFrame], path: str) -> None:
    """A folder for each table; a later snapshot of the same path is refused."""
    for name, df in tables.items():
        write(df, f"{path}/{name}")


def restore(spark: SparkSession, path: str, *names: str) -> dict[str, DataFrame]:
    return {n: read(spark, f"{path}/{n}") for n in names}


def compact(spark: SparkSession, path: str, target: str, files: int) -> None:
    """Rewrite many small files as a given number."""
    write(read(spark, path).repartition(files), target)
