"""Quality by importance resampling.

Two generative models over hashed n-grams, words and word pairs in ``BUCKETS`` buckets: one of the
target, one of the raw texts. A document's log weight is the sum over its n-grams of the log ratio.
Adding Gumbel noise and taking the top k draws k documents without replacement in proportion to
their weights.

The raw model counts all documents. The target model counts at most ``MAX_TARGET`` documents,
those with the smallest hash of the id.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, decontaminate

common.shipped(__name__)

BUCKETS, SMOOTHING, MAX_TARGET, FRACTION = 10_000, 1.0, 20_000, 0.5


def hashed(text: str | None) -> np.ndarray:
    """Buckets of the words and pairs of neighbours."""
    words = decontaminate.words_of(text)
    h = np.fromiter(map(zlib.crc32, words), np.uint64, len(words))
    pairs = h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:] * np.uint64(0xC2B2AE3D27D4EB4F)
    return np.concatenate((h, pairs >> np.uint64(20))) % np.uint64(BUCKETS)


def log_ratio(docs: DataFrame, target_ids: DataFrame, id_col: str, text_col: str) -> np.ndarray:
    """Log ratio of each bucket. target_ids: (id)."""
    first = target_ids.where("id IS NOT NULL").distinct().orderBy(F.xxhash64("id"), "id").limit(MAX_TARGET)
    held = docs.sparkSession.sparkContext.broadcast({r[0] for r in first.collect()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        for b in batches:
            found = [hashed(t).astype(np.int64) for t in b.column(1).to_pylist()]
            own = [h for i, h in zip(b.column(0).to_pylist(), found, strict=True) if i in held.value]
            for parts, sums in ((found, raw), (own, target)):
                if parts:
                    sums += np.bincount(np.concatenate(parts), minlength=BUCKETS)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(BUCKETS)), pa.array(raw), pa.array(target)], ["bucket", "raw", "target"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    sums = common.map_texts(rows, run, "bucket long, raw long, target long").groupBy("bucket").agg(F.sum("raw"), F.sum("target")).collect()
    raw, target = np.full(BUCKETS, SMOOTHING), np.full(BUCKETS, SMOOTHING)
    for bucket, r, t in sums:
        raw[bucket] += r
        target[bucket] += t
    return np.log(target / target.sum()) - np.log(raw / raw.sum())


def kth_largest(df: DataFrame, column: str, k: int) -> float:
    """Exactly, by rounds of histograms; no task or driver sees more than a histogram."""
    low, high, n = df.agg(F.min(column), F.max(column), F.count(column)).first()
    if not n or k <= 0:
        return math.inf
    if k >= n:
        return low
    while low < high:
        width = (high - low) / 1024
        cell = F.least(F.lit(1023), F.floor((F.col(column) - low) / width)).cast("int")
        cells = df.where(F.col(column).between(low, high)).groupBy(cell.alias("cell")).agg(F.count("*"), F.min(column), F.max(column)).orderBy(F.desc("cell")).collect()
        for _, count, a, b in cells:
            if k <= count:
                low, high = a, b
                break
            k -= count
    return low


def resample(docs: DataFrame, target_ids: DataFrame, fraction: float = FRACTION, seed: int = 17, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, log_weight, gumbel, selected) for each row of docs. target_ids: (id).

    The rows with the largest gumbel, ``fraction`` of all, are selected. The noise is a hash of id
    and text, so only rows equal in both tie; those that tie with the last are selected too. Null
    and empty texts have weight 1, log 0. Very long texts are counted whole. Ids may be null. An
    empty table gives an empty one. Other columns aren't read.
    """
    held = docs.sparkSession.sparkContext.broadcast(log_ratio(docs, target_ids, id_col, text_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            weights = [float(held.value[hashed(t).astype(np.int64)].sum()) for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(weights, pa.float64())], ["id", "h", "log_weight"])

    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(id_col).cast("string"), text_col, F.lit(seed)).alias("h"), F.col(text_col).alias("text"))
    u = (F.shiftrightunsigned("h", 12).cast("double") + 0.5) / float(1 << 52)
    noisy = common.checkpoint(common.map_texts(rows, run, f"id {common.type_of(docs, id_col)}, h long, log_weight double").select("id", "log_weight", (F.col("log_weight") - F.log(-F.log(u))).alias("gumbel")))
    threshold = kth_largest(noisy, "gumbel", math.ceil(fraction * noisy.count()))
    return noisy.withColumn("selected", F.col("gumbel") >= F.lit(float(threshold)))
