"""Toxicity by non-negative positive-unlabelled learning.

A linear model over the presence of words and word beginnings. It is fitted in numpy on confirmed
toxic documents (P) and on unlabelled documents (U) drawn from all documents regardless of label.
With class prior pi and logistic loss, the risk is
``pi R_P(+) + max(0, R_U(-) - pi R_P(-))``; where the bracket falls below zero, its gradient is
followed backwards. Negative labels serve for pi alone.

The fit sees at most ``MAX_POSITIVE`` and ``MAX_UNLABELLED`` documents, those with the smallest
hash of the id, and all features that are much commoner in P than in U. Scoring reads every word of
every text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

common.shipped(__name__)

MAX_POSITIVE, MAX_UNLABELLED = 2000, 5000
#: Positives that a feature is in: so many, or such a share of fewer.
LEAST_POSITIVES, LEAST_SHARE = 6, 0.3
THRESHOLD = 0.3
#: Lengths of word beginnings, in code points.
PREFIXES = (4, 5, 6, 7, 8)
WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str | None) -> set[str]:
    return set(WORD.findall((text or "").lower()))


def features_of(word: str) -> list[str]:
    """The word, marked, and its beginnings."""
    return [word + "$", *[word[:n] for n in PREFIXES if len(word) >= n]]


class Model:
    def __init__(self, weights: dict[str, float], bias: float) -> None:
        self.weights, self.bias = weights, bias
        shortest = min(PREFIXES)
        #: A word has a feature only if its first code points are here.
        self.heads = {f.removesuffix("$")[:shortest] for f in weights}

    def score(self, text: str | None) -> float:
        found: set[str] = set()
        heads, weights, shortest = self.heads, self.weights, min(PREFIXES)
        for w in words_of(text):
            if w[:shortest] in heads:
                found.update(f for f in features_of(w) if f in weights)
        x = self.bias + sum(sorted(weights[f] for f in found))
        return float(1 / (1 + np.exp(-min(max(x, -500), 500))))


class Table:
    """Features of documents as numbers; each word's are looked up once."""

    def __init__(self) -> None:
        self.names: list[str] = []
        self._number: dict[str, int] = {}
        self._of: dict[str, np.ndarray] = {}

    def _features(self, word: str) -> np.ndarray:
        out = []
        for f in features_of(word):
            if f not in self._number:
                self._number[f] = len(self.names)
                self.names.append(f)
            out.append(self._number[f])
        return np.array(out, np.int32)

    def document(self, words: str) -> np.ndarray:
        parts = []
        for w in words.split():
            own = self._of.get(w)
            if own is None:
                own = self._of[w] = self._features(w)
            parts.append(own)
        return np.unique(np.concatenate(parts)) if parts else np.zeros(0, np.int32)

    def counts(self, docs: list[np.ndarray]) -> np.ndarray:
        out = np.zeros(len(self.names), np.int64)
        for d in docs:
            out[d] += 1
        return out


def chosen(p: np.ndarray, n_p: int, u: np.ndarray, n_u: int) -> np.ndarray:
    """Features much commoner in P than in U. p, u: documents that have each."""
    least = min(LEAST_POSITIVES, max(1, int(np.ceil(LEAST_SHARE * n_p))))
    return np.flatnonzero((p >= least) & ((p + 0.5) / (n_p + 1) > 3 * (u + 0.5) / (n_u + 1)))


class Rows:
    """A matrix of zeros and ones by its ones: columns, row after row, and how many each row has."""

    def __init__(self, docs: list[np.ndarray], number: np.ndarray, width: int) -> None:
        """The last column is one in every row."""
        kept = [np.append(number[d][number[d] >= 0], width - 1) for d in docs]
        self.columns, self.sizes, self.width = np.concatenate(kept), np.array(list(map(len, kept))), width
        self.starts = np.cumsum(self.sizes) - self.sizes

    def times(self, w: np.ndarray) -> np.ndarray:
        return np.add.reduceat(w[self.columns], self.starts)

    def transposed(self, r: np.ndarray) -> np.ndarray:
        return np.bincount(self.columns, np.repeat(r, self.sizes), self.width)


def fit(positive: list[str], unlabelled: list[str], prior: float, steps: int = 300) -> Model | None:
    """positive, unlabelled: the distinct words of each document, parted by spaces. None without positives."""
    if not positive or not unlabelled:
        return None
    prior = min(max(prior, 1e-4), 0.9)
    table = Table()
    pf, uf = ([table.document(d) for d in docs] for docs in (positive, unlabelled))
    p_counts, u_counts = table.counts(pf), table.counts(uf)
    columns = sorted(chosen(p_counts, len(pf), u_counts, len(uf)).tolist(), key=lambda i: table.names[i])
    names = [table.names[i] for i in columns]
    number = np.full(len(table.names), -1)
    number[columns] = np.arange(len(columns))
    xp, xu = (Rows(docs, number, len(names) + 1) for docs in (pf, uf))
    del table, pf, uf
    w = np.zeros(len(names) + 1)
    w[-1] = np.log(prior / (1 - prior))
    m, v = np.zeros_like(w), np.zeros_like(w)
    softplus, sigmoid = lambda z: np.logaddexp(0, z), lambda z: 1 / (1 + np.exp(-np.clip(z, -60, 60)))
    for t in range(1, steps + 1):
        fp, fu = xp.times(w), xu.times(w)
        negative = softplus(fu).mean() - prior * softplus(fp).mean()
        g_negative = xu.transposed(sigmoid(fu)) / len(fu) - prior * xp.transposed(sigmoid(fp)) / len(fp)
        g = prior * xp.transposed(sigmoid(fp) - 1) / len(fp) + g_negative if negative >= 0 else -g_negative
        g[:-1] += 5e-4 * w[:-1]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return Model({f: float(x) for f, x in zip(names, w, strict=False) if abs(x) > 1e-6}, float(w[-1]))


def train(docs: DataFrame, labels: DataFrame, learn: Column | None = None, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model | None:
    """learn: condition on the column id; only these rows are learned from."""
    learn = F.lit(True) if learn is None else learn
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(F.col("id").isNotNull())
    marked = labels.select(F.col(id_col).alias("id"), F.col(label_col).alias("y")).where(F.col("id").isNotNull() & F.col("y").isin(0, 1) & learn)
    prior = marked.agg(F.avg("y")).first()[0]
    if not prior:
        return None

    def sample(ids: DataFrame, most: int) -> list[str]:
        first = ids.distinct().orderBy(F.xxhash64("id"), "id").limit(most)  # at most `most` ids are broadcast
        picked = texts.join(F.broadcast(first), "id", "left_semi")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield pa.RecordBatch.from_arrays([pa.array([" ".join(sorted(words_of(t))) for t in b.column(1).to_pylist()], pa.string())], ["words"])

        return [r[0] for r in common.map_texts(picked, run, "words string").collect()]

    return fit(sample(marked.where("y = 1").select("id"), MAX_POSITIVE), sample(texts.where(learn).select("id"), MAX_UNLABELLED), prior)


def score(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) for each row. Null and empty texts get the score of no features; without a model all scores are 0.

    Very long texts are read whole. Repeated rows get equal values; ids may be null; an empty table
    gives an empty one. Other columns aren't read.
    """
    held = _broadcast(docs, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(*held.value) if held.value else None
        for b in batches:
            scores = [own.score(t) if own else 0.0 for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(scores, pa.float64())], ["id", "score"])

    return common.map_texts(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), run, f"id {common.type_of(docs, id_col)}, score double")


def reject(docs: DataFrame, model: Model | None, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """The rows of docs with a score below the threshold; all columns stay, whatever their names.

    Null and empty texts have the score of no features; very long ones are read whole. Repeated rows
    stay or go together; without a model all stay; an empty table gives an empty one.
    """
    held = _broadcast(docs, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(*held.value) if held.value else None
        for b in batches:
            texts = b.column(b.schema.get_field_index(text_col)).to_pylist()
            yield b.filter(pa.array([own is None or own.score(t) < threshold for t in texts], pa.bool_()))

    return common.map_texts(docs, run, docs.schema)


def _broadcast(docs: DataFrame, model: Model | None):
    """Weights by feature, as plain values; features come from at most MAX_POSITIVE documents."""
    return docs.sparkSession.sparkContext.broadcast((model.weights, model.bias) if model else None)
