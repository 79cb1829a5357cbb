"""Bitmaps as binary values; bit 0 is the highest of the first byte."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _byte(b: Column, i: Column) -> Column:
    return F.conv(F.hex(F.substring(b, i + 1, F.lit(1))), 16, 10).cast("int")


def get(b: Column, offset: int) -> Column:
    byte = F.coalesce(_byte(b, F.lit(offset // 8)), F.lit(0))
    return F.when(F.octet_length(b) > offset // 8, F.shiftright(byte, 7 - offset % 8).bitwiseAND(1)).otherwise(0)


def set_(b: Column, offset: int, bit: int) -> Column:
    """Grows with zeros as needed."""
    at = offset // 8
    full = F.concat(b, F.unhex(F.repeat(F.lit("00"), F.greatest(F.lit(0), F.lit(at + 1) - F.octet_length(b)))))
    mask = 1 << (7 - offset % 8)
    byte = _byte(full, F.lit(at))
    changed = byte.bitwiseOR(mask) if bit else byte.bitwiseAND(255 - mask)
    return F.concat(F.substring(full, F.lit(1), F.lit(at)), F.unhex(F.lpad(F.hex(changed), 2, "0")), F.substring(full, F.lit(at + 2), F.octet_length(full)))


def _bytes(b: Column) -> Column:
    return F.transform(F.sequence(F.lit(0), F.octet_length(b) - 1), lambda i: _byte(b, i))


def count(b: Column, start: int = 0, end: int = -1) -> Column:
    """Set bits of the bytes from start to end, both included."""
    n = F.octet_length(b)
    last = F.lit(end) + (n if end < 0 else F.lit(0))
    part = F.substring(b, F.lit(start + 1), F.greatest(F.lit(0), last - start + 1))
    return F.when(F.octet_length(part) > 0, F.aggregate(_bytes(part), F.lit(0), lambda t, x: t + F.bit_count(x))).otherwise(0)


def position(b: Column, bit: int) -> Column:
    """Of the first such bit, or -1."""
    text = F.array_join(F.transform(_bytes(b), lambda x: F.lpad(F.bin(x.cast("long")), 8, "0")), "")
    return F.instr(text, str(bit)) - 1


def combine(a: Column, b: Column, op: str) -> Column:
    """AND, OR or XOR; the shorter one is filled with zeros."""
    n = F.greatest(F.octet_length(a), F.octet_length(b))
    x, y = (F.rpad(F.hex(v), n * 2, F.lit("0")) for v in (a, b))
    by = {"AND": Column.bitwiseAND, "OR": Column.bitwiseOR, "XOR": Column.bitwiseXOR}[op]
    pair = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.lpad(F.hex(by(F.conv(F.substring(x, i * 2 + 1, F.lit(2)), 16, 10).cast("int"), F.conv(F.substring(y, i * 2 + 1, F.lit(2)), 16, 10).cast("int"))), 2, "0"))
    return F.unhex(F.array_join(pair, ""))


def invert(b: Column) -> Column:
    return F.unhex(F.translate(F.hex(b), "0123456789ABCDEF", "FEDCBA9876543210"))


def field(b: Column, start: int, width: int, signed: bool = False) -> Column:
    """An integer of at most 62 bits at a bit offset."""
    text = F.rpad(F.array_join(F.transform(_bytes(b), lambda x: F.lpad(F.bin(x.cast("long")), 8, "0")), ""), start + width, "0")
    v = F.conv(F.substring(text, start + 1, width), 2, 10).cast("long")
    return F.when(v >= (1 << (width - 1)), v - (1 << width)).otherwise(v) if signed else v
