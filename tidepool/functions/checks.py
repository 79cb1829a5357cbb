"""Validators and hash assignment."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EMAIL = r"^[^@\s]+@[^@\s.]+(\.[^@\s.]+)+$"
URL = r"^https?://[^/\s]+\S*$"
OCTET = "(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
IP = rf"^{OCTET}(?:\.{OCTET}){{3}}$"
PATTERNS = {"email": EMAIL, "url": URL, "ip": IP, "alpha": "^[A-Za-z]+$", "alphanum": "^[A-Za-z0-9]+$", "int": r"^[+-]?[0-9]+$", "float": r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?$"}


def valid(s: Column, kind: str) -> Column:
    if kind == "json":  # the parser stops after a value; within brackets, what follows is an error
        return F.coalesce(F.size(F.from_json(F.concat(F.lit("["), s, F.lit("]")), "array<string>")) == 1, F.lit(False))
    return s.rlike(PATTERNS[kind])


def length_between(s: Column, low: int, high: int) -> Column:
    return F.octet_length(s).between(low, high)


def bucket(key: Column, n: int) -> Column:
    """Stable number from 0 to n - 1, for partitions, rollouts and experiments."""
    return F.crc32(key.cast("string")) % n


def variant(key: Column, variants: list[str]) -> Column:
    return F.element_at(F.array(*map(F.lit, variants)), (bucket(key, len(variants)) + 1).cast("int"))
