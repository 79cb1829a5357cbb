"""SimHash near-duplicates.

Fingerprints of 64 bits link at ``max_bits`` differing bits or fewer. Two linked fingerprints
differ in at most ``max_bits`` of their 8 bytes, so at least ``8 - max_bits`` bytes at the same
position are equal. An inverted index finds such pairs: its posting lists are keyed by byte
positions and the bytes there. A list on one byte would hold 1/256 of all documents, so a key
joins three positions; 20 triples are enough, as any 4 positions contain one of them. In a list,
the shared positional bytes of each pair are tallied, pairs that reach the guaranteed minimum are
kept, and their bits are compared.

Equal fingerprints are one entry of the index. A list gives the links that connect its members,
not all pairs. A list of more than ``BLOCK`` entries is cut into blocks, and each pair of blocks
is a task of its own, so no link is lost and no task holds a whole long list.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

common.shipped(__name__)

#: Words of a shingle, seed of XXH64, most differing bits of a link.
SHINGLE, SEED, MAX_BITS = 4, 42, 4
#: Entries of a posting list that one task compares with each other.
BLOCK = 2048
#: Lists up to this length are compared all at once, by vector operations.
SHORT = 24


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """64 bits; a bit is 1 if it is set in over half of the shingles' hashes. No words: 0."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    size = min(shingle, len(words))
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    digest, ones = xxhash.xxh64_digest, np.zeros(64, np.int64)
    for at in range(0, n, 32768):
        a, b = starts[at : min(n, at + 32768)].tolist(), ends[at + size - 1 : min(n, at + 32768) + size - 1].tolist()
        hashes = b"".join([digest(line[i:j], SEED) for i, j in zip(a, b, strict=True)])
        ones += np.unpackbits(np.frombuffer(hashes, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(id, fp) for each row; fp is the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            prints = np.array([fingerprint(t, shingle) for t in b.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(prints.view(np.int64))], ["id", "fp"])

    return common.map_texts(df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), run, f"id {common.type_of(df, id_col)}, fp long")


def triples(positions: int = 8) -> list[tuple[int, ...]]:
    """Position triples of which any 4 of 8 positions contain one: three groups, each with its own triples and its pairs joined with one of the next group."""
    group = [0, 0, 0, 1, 1, 1, 2, 2][:positions]

    def fits(t: tuple[int, ...]) -> bool:
        g = sorted(group[i] for i in t)
        return g in ([0, 0, 0], [1, 1, 1], [0, 0, 1], [1, 1, 2], [0, 2, 2])

    return [t for t in combinations(range(positions), 3) if fits(t)]


def index_keys(max_bits: int) -> list[int]:
    """Masks of the index: positions such that two linked fingerprints agree on at least one mask."""
    if max_bits == 4:
        sets: list[tuple[int, ...]] = triples()
    elif max_bits < 8:
        sets = list(combinations(range(8), 8 - max_bits))
    else:
        raise ValueError("more than 7 differing bits can touch every byte")
    return [sum(0xFF << (8 * i) for i in s) for s in sets]


def linked(a: np.ndarray, b: np.ndarray, max_bits: int) -> np.ndarray:
    """Tally the shared positional bytes, keep what reaches the minimum, verify the bits."""
    x = np.bitwise_xor(a, b)
    kept = np.flatnonzero((x.view(np.uint8).reshape(-1, 8) == 0).sum(axis=1) >= 8 - max_bits)
    out = np.zeros(len(x), bool)
    out[kept] = np.bitwise_count(x[kept]) <= max_bits
    return out


def forest(prints: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect what links connect within one posting list."""
    rest, left, right = prints, [], []
    while len(rest):
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            p = queue.pop()
            near = linked(np.full(len(rest), p, np.uint64), rest, max_bits)
            if near.any():
                found = rest[near]
                left.append(np.full(len(found), p, np.uint64))
                right.append(found)
                queue.extend(found)
                rest = rest[~near]
    none = np.zeros(0, np.uint64)
    return (np.concatenate(left), np.concatenate(right)) if left else (none, none)


def list_edges(groups: np.ndarray, prints: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """groups: number of each entry's posting list, ascending."""
    cuts = np.flatnonzero(np.concatenate(([True], groups[1:] != groups[:-1], [True])))
    length = np.repeat(np.diff(cuts), np.diff(cuts))
    left, right = [], []
    short = (length > 1) & (length <= SHORT)
    g, p = groups[short], prints[short]
    for d in range(1, min(SHORT, len(g))):
        same = np.flatnonzero(g[d:] == g[:-d])
        if not len(same):
            break
        near = same[linked(p[same + d], p[same], max_bits)]
        left.append(p[near])
        right.append(p[near + d])
    for i in np.flatnonzero(np.diff(cuts) > SHORT):
        a, b = forest(prints[cuts[i] : cuts[i + 1]], max_bits)
        left.append(a)
        right.append(b)
    none = np.zeros(0, np.uint64)
    return (np.concatenate(left), np.concatenate(right)) if left else (none, none)


def edges(nodes: DataFrame, max_bits: int = MAX_BITS, block: int = BLOCK) -> DataFrame:
    """(u, v), u > v, of distinct fingerprints that connect all that links connect. nodes: distinct fp."""
    masks = index_keys(max_bits)
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    postings = nodes.select("fp", F.explode(F.array(*[F.struct(F.lit(i).alias("c"), F.col("fp").bitwiseAND(F.lit(m)).alias("k")) for i, m in enumerate(signed)])).alias("e")).select("fp", "e.c", "e.k")
    long_lists = common.checkpoint(postings.groupBy("c", "k").count().where(F.col("count") > block).select("c", "k", F.ceil(F.col("count") / block).cast("int").alias("n")))
    if long_lists.isEmpty():
        cut = postings.withColumns({"i": F.lit(0), "j": F.lit(0)})
    else:
        own = F.pmod(F.xxhash64("fp"), F.col("n")).cast("int")
        cut = postings.join(long_lists, ["c", "k"], "left").withColumn("n", F.coalesce("n", F.lit(1))).select("fp", "c", "k", own.alias("own"), F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("other")).select("fp", "c", "k", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None
        for b in batches:
            columns = [b.column(i).to_numpy() for i in range(5)]
            columns[0] = columns[0].view(np.uint64)
            if held is not None:
                columns = [np.concatenate(x) for x in zip(held, columns, strict=True)]
            keys = columns[1:]
            if not len(columns[0]):
                continue
            new = np.zeros(len(columns[0]), bool)
            for k in keys:
                new[1:] |= k[1:] != k[:-1]
            last = int(np.flatnonzero(new)[-1]) if new.any() else 0
            held = [x[last:] for x in columns]
            if last:
                yield found(np.cumsum(new[:last]), columns[0][:last])
        if held is not None and len(held[0]):
            yield found(np.zeros(len(held[0]), np.int64), held[0])

    def found(groups: np.ndarray, prints: np.ndarray) -> pa.RecordBatch:
        a, b = (x.view(np.int64) for x in list_edges(groups, prints, max_bits))
        return pa.RecordBatch.from_arrays([pa.array(np.maximum(a, b)), pa.array(np.minimum(a, b))], ["u", "v"])

    lists = cut.select("fp", "c", "k", "i", "j").repartition("c", "k", "i", "j").sortWithinPartitions("c", "k", "i", "j")
    return lists.mapInArrow(run, "u long, v long").distinct()


def connected(links: DataFrame) -> DataFrame:
    """(u, v) with v the smallest member of u's component, for each u that isn't it: rounds of large stars and small stars.

    What a join reads is written first, so that Spark can split the partition of a node with many links.
    """
    now = common.checkpoint(links.where("u > v").distinct())
    state = None
    while True:
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen[0] == 0 or seen == state:
            return now
        state = seen
        both = now.union(now.select("v", "u"))
        least = common.checkpoint(both.groupBy(F.col("u").alias("w")).agg(F.min("v").alias("m")).select("w", F.least("w", "m").alias("m")))
        large = common.checkpoint(both.join(least, F.col("u") == F.col("w")).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        least = common.checkpoint(large.groupBy(F.col("u").alias("w")).agg(F.min("v").alias("m")))
        small = large.join(least, F.col("u") == F.col("w")).select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v")
        now = common.checkpoint(small.where("u <> v").distinct())


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """(id, fp, component) for each row: the smallest id that links reach, itself included.

    Null and empty texts have fingerprint zero and link like others. Repeated rows get equal
    values. A null id is never the smallest one of a component that has another. An empty table
    gives an empty one. Other columns of df aren't read.
    """
    prints = common.checkpoint(fingerprints(df, id_col, text_col, shingle))
    nodes = common.checkpoint(prints.groupBy("fp").agg(F.min("id").alias("first")))
    roots = common.checkpoint(connected(edges(nodes.select("fp"), max_bits)).select(F.col("u").alias("fp"), F.col("v").alias("root")))
    rooted = nodes.join(roots, "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = common.checkpoint(rooted.join(roots.select("root").distinct(), "root", "left_semi").groupBy("root").agg(F.min("first").alias("least")))
    named = common.checkpoint(rooted.join(least, "root", "left").select("fp", F.coalesce("least", "first").alias("component")))
    return prints.join(named, "fp", "left").select("id", "fp", "component")


def deduplicate(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """The rows of df without those whose component has a smaller id. All columns stay.

    Of rows that share id and text one stays, whichever; rows that share an id but not the text
    stay or go by that id. Rows without an id stay. Null and empty texts are copies of each other.
    Very long texts count whole, an empty table gives an empty one, and columns may have any names.
    """
    return without_copies(df, near_duplicates(df, id_col, text_col, shingle, max_bits), id_col, text_col)


def without_copies(df: DataFrame, found: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows of df that stay. found: (id, component) of each row."""
    names = df.columns
    rows = df.select(*[F.col(f"`{c}`").alias(f"c_{i}") for i, c in enumerate(names)], F.col(f"`{id_col}`").alias("id"), F.xxhash64(text_col).alias("h"))
    found = common.checkpoint(found)
    away = common.checkpoint(found.where(F.col("component") < F.col("id")).select("id").distinct())
    kept = rows.join(away, "id", "left_anti")
    twice = common.checkpoint(found.where("id IS NOT NULL").groupBy("id").count().where("count > 1").select("id"))
    if not twice.isEmpty():
        kept = kept.join(twice, "id", "left_anti").unionByName(kept.join(twice, "id", "left_semi").dropDuplicates(["id", "h"]))
    return kept.select(*[F.col(f"c_{i}").alias(c) for i, c in enumerate(names)])
