"""Encodings, digests, compression and identifiers. What Spark lacks runs on Arrow batches."""

from __future__ import annotations

import hashlib
import hmac as _hmac
import zlib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

HASHES = ("md5", "sha1", "sha256", "sha384", "sha512")


def digest(x: Column, algorithm: str) -> Column:
    name = algorithm.lower().replace("-", "")
    if name not in HASHES:
        raise ValueError(f"no such hash: {algorithm}")
    return F.md5(x) if name == "md5" else F.sha1(x) if name == "sha1" else F.sha2(x, int(name[3:]))


def hmac(key: str, x: Column, algorithm: str) -> Column:
    """By two digests over the key's pads; no Python runs."""
    name = algorithm.lower().replace("-", "")
    block = 128 if name in ("sha384", "sha512") else 64
    raw = key.encode()
    raw = getattr(hashlib, name)(raw).digest() if len(raw) > block else raw
    raw = raw.ljust(block, b"\0")
    inner, outer = (F.lit(bytearray(b ^ p for b in raw)) for p in (0x36, 0x5C))
    return digest(F.concat(outer, F.unhex(digest(F.concat(inner, x.cast("binary")), name))), name)


@F.pandas_udf(T.LongType())
def adler32(x: pd.Series) -> pd.Series:
    return x.map(lambda s: zlib.adler32(s.encode()) if s is not None else None)


def rle_encode(x: Column) -> Column:
    """Runs as count and sign; aaab is 3a1b."""
    runs = F.regexp_extract_all(x, F.lit(r"(?s)((.)\2*)"), F.lit(0))
    return F.array_join(F.transform(runs, lambda r: F.concat(F.length(r).cast("string"), F.substring(r, 1, 1))), "")


def rle_decode(x: Column) -> Column:
    """Of texts without digits."""
    runs = F.regexp_extract_all(x, F.lit(r"(?s)([0-9]+)([^0-9])"), F.lit(0))
    return F.array_join(F.transform(runs, lambda r: F.repeat(F.right(r, F.lit(1)), F.left(r, F.length(r) - 1).cast("int"))), "")


@F.pandas_udf(T.BinaryType())
def compress(x: pd.Series) -> pd.Series:
    return x.map(lambda s: zlib.compress(s.encode()) if s is not None else None)


@F.pandas_udf(T.StringType())
def decompress(x: pd.Series) -> pd.Series:
    return x.map(lambda b: zlib.decompress(b).decode() if b is not None else None)


def msgpack(x: Column) -> Column:
    """A string in MessagePack."""
    b, n = x.cast("binary"), F.octet_length(x)
    head = F.when(n < 32, F.lpad(F.hex(n + 0xA0), 2, "0")).when(n < 256, F.concat(F.lit("D9"), F.lpad(F.hex(n), 2, "0"))).when(n < 65536, F.concat(F.lit("DA"), F.lpad(F.hex(n), 4, "0"))).otherwise(F.concat(F.lit("DB"), F.lpad(F.hex(n), 8, "0")))
    return F.concat(F.unhex(head), b)


def msgpack_decode(b: Column) -> Column:
    skip = F.when(F.substring(F.hex(b), 1, 2) == "D9", 2).when(F.substring(F.hex(b), 1, 2) == "DA", 3).when(F.substring(F.hex(b), 1, 2) == "DB", 5).otherwise(1)
    return F.decode(F.substring(b, skip + 1, F.octet_length(b)), "UTF-8")


def cbor(x: Column) -> Column:
    """A text string in CBOR."""
    b, n = x.cast("binary"), F.octet_length(x)
    head = F.when(n < 24, F.lpad(F.hex(n + 0x60), 2, "0")).when(n < 256, F.concat(F.lit("78"), F.lpad(F.hex(n), 2, "0"))).when(n < 65536, F.concat(F.lit("79"), F.lpad(F.hex(n), 4, "0"))).otherwise(F.concat(F.lit("7A"), F.lpad(F.hex(n), 8, "0")))
    return F.concat(F.unhex(head), b)


def cbor_decode(b: Column) -> Column:
    skip = F.when(F.substring(F.hex(b), 1, 2) == "78", 2).when(F.substring(F.hex(b), 1, 2) == "79", 3).when(F.substring(F.hex(b), 1, 2) == "7A", 5).otherwise(1)
    return F.decode(F.substring(b, skip + 1, F.octet_length(b)), "UTF-8")


def bson(key: str, x: Column) -> Column:
    """A document of one string field in BSON."""
    b, n = x.cast("binary"), F.octet_length(x) + 1

    def little(v: Column) -> Column:
        return F.unhex(F.concat(*[F.lpad(F.hex(F.shiftright(v, 8 * i).bitwiseAND(255)), 2, "0") for i in range(4)]))

    name = F.lit(bytearray(b"\x02" + key.encode() + b"\0"))
    return F.concat(little(n + len(key) + 11), name, little(n), b, F.lit(bytearray(b"\0\0")))


def csv_row(*xs: Column) -> Column:
    quoted = [F.when(x.rlike('[",\\r\\n]'), F.concat(F.lit('"'), F.replace(x, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(x) for x in xs]
    return F.concat_ws(",", *quoted)


def pair(key: Column, value: Column, style: str) -> Column:
    """toml: k = "v"; yaml: k: v; xml: <k>v</k>."""
    if style == "toml":
        return F.concat(key, F.lit(' = "'), value, F.lit('"'))
    if style == "yaml":
        return F.concat(key, F.lit(": "), value)
    return F.concat(F.lit("<"), key, F.lit(">"), value, F.lit("</"), key, F.lit(">"))


def unpair(x: Column, style: str) -> Column:
    pattern = {"toml": r'^([^=]*?)\s*=\s*"?(.*?)"?$', "yaml": r"^([^:]*):\s*(.*)$", "xml": r"^<([^>]+)>(.*)</"}[style]
    return F.struct(F.regexp_extract(x, pattern, 1).alias("key"), F.regexp_extract(x, pattern, 2).alias("value"))


CROCKFORD = "0123456789ABCDEFGHJKMNPQRSTVWXYZ"


def ulid(millis: Column, seed: Column) -> Column:
    """26 signs: 10 of the time and 16 of a hash of seed."""
    def five(v: Column, n: int) -> list[Column]:
        return [F.substring(F.lit(CROCKFORD), F.shiftright(v, 5 * i).bitwiseAND(31).cast("int") + 1, F.lit(1)) for i in reversed(range(n))]

    return F.concat(*five(millis, 10), *five(F.abs(F.xxhash64(seed) % (1 << 40)), 8), *five(F.abs(F.xxhash64(seed, F.lit(1)) % (1 << 40)), 8))


def ulid_millis(x: Column) -> Column:
    digits = [F.instr(F.lit(CROCKFORD), F.substring(x, i + 1, 1)) - 1 for i in range(10)]
    out = F.lit(0).cast("long")
    for v in digits:
        out = out * 32 + v
    return out


#: Milliseconds at which snowflake ids begin; bits of node and sequence.
SNOWFLAKE_EPOCH, NODE_BITS, SEQUENCE_BITS = 1288834974657, 10, 12


def snowflake(millis: Column, node: Column, sequence: Column) -> Column:
    return F.shiftleft(millis - SNOWFLAKE_EPOCH, NODE_BITS + SEQUENCE_BITS).bitwiseOR(F.shiftleft(node.cast("long"), SEQUENCE_BITS)).bitwiseOR(sequence.cast("long"))


def snowflake_parse(x: Column) -> Column:
    return F.struct(
        (F.shiftright(x, NODE_BITS + SEQUENCE_BITS) + SNOWFLAKE_EPOCH).alias("millis"),
        F.shiftright(x, SEQUENCE_BITS).bitwiseAND((1 << NODE_BITS) - 1).alias("node"),
        x.bitwiseAND((1 << SEQUENCE_BITS) - 1).alias("sequence"),
    )


UUID = "^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"


def check_hmac(key: str, x: str, algorithm: str) -> str:
    return _hmac.new(key.encode(), x.encode(), algorithm).hexdigest()
