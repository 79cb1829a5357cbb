"""Near copies by the Jaccard similarity of word shingles, beside the SimHash links.

Texts with a similarity of ``LEAST`` or more link. Candidates come from MinHash: ``BANDS`` keys of
``ROWS`` least hashes each. A pair at ``LEAST`` shares no key with a chance of
``(1 - LEAST**ROWS)**BANDS``, 4e-7, and a more similar pair with less. Each candidate pair is
compared by its whole shingle sets, so nothing below ``LEAST`` links.

A key's texts are first compared with one of them, the centre, which joins a large group of copies
by a linear number of pairs. Where some text of a key isn't like the centre, a task compares it
with all others of the key, so that no link within a key is left out; long keys are cut into pairs
of blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, simhash

common.shipped(__name__)

#: Words of a shingle and the similarity of a link.
SHINGLE, LEAST = 5, 0.8
ROWS, BANDS = 4, 28
#: Centres that a key's texts can have, so that groups with several keys hang together.
CENTRES = 4
#: Texts of a key that one task compares with each other.
BLOCK = 256
_RANDOM = np.random.default_rng(simhash.SEED)
FACTORS = _RANDOM.integers(0, 1 << 63, ROWS * BANDS, np.uint64) * np.uint64(2) + np.uint64(1)
SHIFTS = _RANDOM.integers(0, 1 << 63, ROWS * BANDS, np.uint64)


def shingles(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """Distinct hashes of the shingles, ascending; a shorter text is one shingle. No words: none."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    digest, n = xxhash.xxh64_intdigest, max(1, len(words) - shingle + 1)
    return np.unique(np.fromiter((digest(b" ".join(words[i : i + shingle]), simhash.SEED) for i in range(n)), np.uint64, n))


def keys(hashes: np.ndarray) -> list[int]:
    """A signed long of each band; none without shingles."""
    if not len(hashes):
        return []
    least = np.full(ROWS * BANDS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), 1024):
        part = FACTORS[:, None] * hashes[None, at : at + 1024] + SHIFTS[:, None]
        np.minimum(least, part.min(axis=1), out=least)
    bands = least.reshape(BANDS, ROWS)
    return np.array([xxhash.xxh64_intdigest(x.tobytes(), i) for i, x in enumerate(bands)], np.uint64).view(np.int64).tolist()


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether the Jaccard similarity is LEAST or more, without rounding."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both > 0 and 5 * both >= 4 * (len(a) + len(b) - both)


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (u, v) of text hashes that link. sets: (h, s), s the bytes of the shingles."""
    rows = pairs.join(sets.select(F.col("h").alias("u"), F.col("s").alias("a")), "u").join(sets.select(F.col("h").alias("v"), F.col("s").alias("b")), "v")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [similar(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)) for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(found, pa.bool_())) for c in b.columns[:2]], ["u", "v"])

    return common.checkpoint(common.map_texts(rows.select("u", "v", "a", "b"), run, "u long, v long"))


def forest(ids: list[int], settled: list[bool], sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Links that connect what links connect among texts of a key; the settled ones are connected already."""
    sizes = np.array([len(s) for s in sets])
    whole, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
    group = np.where(settled, -1, np.arange(len(sets)))
    out = []
    for i in np.flatnonzero(~np.array(settled)):
        where = np.minimum(np.searchsorted(sets[i], whole), sizes[i] - 1)
        both = np.bincount(owner[sets[i][where] == whole], minlength=len(sets))
        for j in np.flatnonzero((5 * both >= 4 * (sizes + sizes[i] - both)) & (group != group[i])):
            if group[j] != group[i]:
                out.append((max(ids[i], ids[j]), min(ids[i], ids[j])))
                group[group == group[j]] = group[i]
    return out


def within_keys(members: DataFrame, sets: DataFrame, block: int) -> DataFrame:
    """(u, v) of forest over each key's members (key, h, settled); of long lists, over each pair of blocks."""
    size = members.groupBy("key").agg(F.ceil(F.count("*") / block).cast("int").alias("k"))
    own = F.pmod(F.xxhash64("h"), F.col("k")).cast("int")
    cut = members.join(size, "key").select("key", "h", "settled", own.alias("own"), F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("other"))
    cut = common.checkpoint(cut.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "h", "settled"))
    rows = cut.join(sets, "h").select("key", "i", "j", "h", "settled", "s").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []

        def out() -> pa.RecordBatch:
            links = forest(*map(list, zip(*held, strict=True))) if len(held) > 1 else []
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in links], pa.int64()) for i in (0, 1)], ["u", "v"])

        for b in batches:
            for key, i, j, h, settled, s in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if (key, i, j) != at:
                    yield out()
                    at = (key, i, j)
                held.append((h, settled, np.frombuffer(s, np.uint64)))
        yield out()

    return common.checkpoint(common.map_texts(rows, run, "u long, v long").distinct())


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """(id, component) for each row: the smallest id that links reach, SimHash's among them."""
    kind = common.type_of(df, id_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lines = b.column(2).to_pylist()
            sets = [shingles(t) for t in lines]
            prints = np.array([simhash.fingerprint(t) for t in lines], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(prints), pa.array([len(s) for s in sets], pa.int64()), pa.array([keys(s) for s in sets], pa.list_(pa.int64()))], ["id", "h", "fp", "n", "keys"])

    source = df.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("h"), F.col(text_col).alias("text"))
    rows = common.checkpoint(common.map_texts(source, run, f"id {kind}, h long, fp long, n long, keys array<long>"))
    nodes = common.checkpoint(rows.groupBy("h").agg(F.min("id").alias("first"), F.first("fp").alias("fp"), F.first("n").alias("n"), F.first("keys").alias("keys")))

    prints = common.checkpoint(nodes.groupBy("fp").agg(F.min("h").alias("v")))
    by_bits = simhash.edges(prints.select("fp")).join(prints.select(F.col("fp").alias("u"), F.col("v").alias("a")), "u").join(prints.select(F.col("fp").alias("v"), F.col("v").alias("b")), "v").select(F.col("a").alias("u"), F.col("b").alias("v"))
    links = common.checkpoint(nodes.select("fp", F.col("h").alias("u")).join(prints, "fp").select("u", "v").union(by_bits))

    postings = nodes.select("h", "n", F.explode("keys").alias("key"))
    order = F.struct(F.xxhash64("h", F.pmod("key", F.lit(CENTRES))).alias("o"), F.col("h").alias("c"), F.col("n").alias("m"))
    shared = common.checkpoint(postings.groupBy("key").agg(F.count("*").alias("k"), F.min(order).alias("e")).where("k > 1").select("key", "k", "e.c", "e.m"))
    postings = common.checkpoint(postings.join(shared, "key"))
    # A similarity of 4/5 needs sizes in that relation.
    fits = "5 * least(n, m) >= 4 * greatest(n, m)"
    stars = common.checkpoint(postings.where(f"h <> c AND {fits}").select(F.greatest("h", "c").alias("u"), F.least("h", "c").alias("v")).distinct())
    texts = df.select(F.xxhash64(text_col).alias("h"), F.col(text_col).alias("text")).join(postings.select("h").distinct(), "h", "left_semi").dropDuplicates(["h"])

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([shingles(t).tobytes() for t in b.column(1).to_pylist()], pa.binary())], ["h", "s"])

    sets = common.checkpoint(common.map_texts(texts, held, "h long, s binary"))
    near = verified(stars, sets)
    at_centre = near.select(F.col("u").alias("h"), F.col("v").alias("c")).union(near.select("v", "u")).withColumn("near", F.lit(True))
    members = common.checkpoint(postings.where("k > 2").join(at_centre, ["h", "c"], "left").select("key", "h", (F.col("near").isNotNull() | (F.col("h") == F.col("c"))).alias("settled")))
    open_keys = members.where("NOT settled").select("key").distinct()
    roots = rooted(links.union(near).union(within_keys(members.join(open_keys, "key", "left_semi"), sets, block)))

    whole = common.checkpoint(nodes.select("h", "first").join(roots.withColumnRenamed("u", "h"), "h", "left").select("h", "first", F.coalesce("v", "h").alias("root")))
    least = common.checkpoint(whole.groupBy("root").agg(F.min("first").alias("component")))
    return rows.select("id", "h").join(whole.join(least, "root").select("h", "component"), "h").select("id", "component")


def rooted(links: DataFrame) -> DataFrame:
    return common.checkpoint(simhash.connected(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))))


def deduplicate(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of df without those whose component has a smaller id, as simhash.deduplicate."""
    return simhash.without_copies(df, near_duplicates(df, id_col, text_col), id_col, text_col)
