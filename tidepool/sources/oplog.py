"""Operation logs: RESP command files, as an append-only server writes them, and Parquet."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "file string, seq long, op string, args array<binary>"


def parse(data: bytes) -> list[list[bytes]]:
    """Commands of a RESP file. A command that is cut off at the end is left out."""
    out, at = [], 0
    while at < len(data):
        end = data.find(b"\r\n", at)
        if end < 0 or data[at : at + 1] != b"*":
            break
        n, at, args = int(data[at + 1 : end]), end + 2, []
        for _ in range(n):
            end = data.find(b"\r\n", at)
            if end < 0 or data[at : at + 1] != b"$":
                return out
            size = int(data[at + 1 : end])
            if end + 2 + size + 2 > len(data):
                return out
            args.append(data[end + 2 : end + 2 + size])
            at = end + 4 + size
        if args:
            out.append(args)
    return out


def encode(args: list[bytes]) -> bytes:
    return b"*%d\r\n" % len(args) + b"".join(b"$%d\r\n%s\r\n" % (len(a), a) for a in args)


def read(spark: SparkSession, path: str) -> DataFrame:
    """(file, seq, op, args) of a file or a folder of files; a file is one task's work."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                rows = parse(data)
                for i in range(0, len(rows), 10_000):
                    part = rows[i : i + 10_000]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([name] * len(part)), pa.array(range(i, i + len(part)), pa.int64()), pa.array([r[0].decode("utf-8", "replace").upper() for r in part]), pa.array([r[1:] for r in part], pa.list_(pa.binary()))],
                        ["file", "seq", "op", "args"],
                    )

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(run, SCHEMA)


def command(op: str, *args: str) -> Column:
    """A RESP command as text, of string columns, without the last line feed."""
    parts = [F.lit(op), *[F.col(a).cast("string") for a in args]]
    sized = [F.concat(F.lit("$"), F.octet_length(p).cast("string"), F.lit("\r\n"), p, F.lit("\r\n")) for p in parts]
    return F.rtrim(F.concat(F.lit(f"*{len(parts)}\r\n"), *sized), F.lit("\n"))


def write(df: DataFrame, path: str, op: str, *args: str) -> None:
    """One file for each partition, a command for each row."""
    df.select(command(op, *args).alias("value")).write.option("lineSep", "\n").text(path)
