"""Language identification with segmentation-marginalised unigrams.

Each language has a probability for every piece of a fixed public vocabulary. A word's probability
is the sum over all its segmentations into pieces, by the forward algorithm; a text's is the
product over its words. The piece probabilities are trained by expectation-maximisation on a
bounded sample of the learned rows, with the forward-backward algorithm; the vocabulary stays as
it is.

Words are runs of letters in lower case, of any length, each with the vocabulary's word mark in
front. A letter that the vocabulary lacks is a piece of its own, with one probability for all such
letters. Sums over long words are scaled as they go, so that they don't vanish.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

common.shipped(__name__)

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
#: Learned documents of a language. The fit sees all their words but those of over LONG letters; scoring sums these one by one, scaled.
SAMPLE, LONG = 300, 32
ROUNDS, SMOOTHING, MARK = 4, 0.05, "▁"
#: Words whose probabilities a task keeps.
CACHE = 200_000
#: ASCII but letters to space; letters beyond ASCII are told apart where a token is first met.
PARTED = bytes(c if 65 <= c <= 90 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))


def load_vocabulary(path: str = VOCABULARY) -> dict[str, int]:
    """Piece to id, of a sentencepiece model file. Control and byte pieces are left out."""
    import sentencepiece

    p = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [p.id_to_piece(i) for i in range(p.get_piece_size()) if not (p.is_control(i) or p.is_unknown(i) or p.is_byte(i))]
    return {x: i for i, x in enumerate(dict.fromkeys(pieces))}


def tokens_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(PARTED).split()


def words_of(token: bytes) -> list[str]:
    """Runs of letters; other signs beyond ASCII part them."""
    word = token.decode("utf-8", "surrogatepass").lower()
    return [word] if word.isalpha() else "".join(c if c.isalpha() else " " for c in word).split()


class Pieces:
    """Finds the pieces of many words at once, by a 64-bit polynomial hash of code points."""

    FACTOR = np.uint64(0x9E3779B97F4A7C15)

    def __init__(self, pieces: dict[str, int]) -> None:
        self.unknown, self.longest = len(pieces), max(map(len, pieces), default=1)
        hashes = np.zeros(len(pieces), np.uint64)
        for n in range(1, self.longest + 1):
            own = [(x, i) for x, i in pieces.items() if len(x) == n]
            if own:
                h = np.zeros(len(own), np.uint64)
                for column in codes([x for x, _ in own]).T:
                    h = self.step(h, column)
                hashes[[i for _, i in own]] = h
        order = np.argsort(hashes)
        self.hashes, self.ids = hashes[order], order
        self.seen = np.zeros(1 << 20, bool)
        self.seen[(hashes >> np.uint64(44)).astype(np.int64)] = True

    def step(self, h: np.ndarray, column: np.ndarray) -> np.ndarray:
        return (h + column + np.uint64(1)) * self.FACTOR

    def arcs(self, words: list[str]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(start, end, words that have a piece there, pieces) by start, then end. words: of one length, the mark included."""
        grid = codes(words)
        n = grid.shape[1]
        for a in range(n):
            h = np.zeros(len(words), np.uint64)
            for b in range(a + 1, min(n, a + self.longest) + 1):
                h = self.step(h, grid[:, b - 1])
                maybe = np.flatnonzero(self.seen[(h >> np.uint64(44)).astype(np.int64)])
                at = np.minimum(np.searchsorted(self.hashes, h[maybe]), len(self.hashes) - 1)
                hit = self.hashes[at] == h[maybe]
                found, ids = maybe[hit], self.ids[at[hit]]
                if b == a + 1 and len(found) < len(words):
                    every = np.full(len(words), self.unknown)
                    every[found] = ids
                    found, ids = np.arange(len(words)), every
                if len(found):
                    yield a, b, found, ids

    def score(self, words: list[str], p: np.ndarray) -> np.ndarray:
        """[word, language]: sums over all segmentations. words: of one length."""
        alpha = np.zeros((len(words[0]) + 1, len(words), p.shape[1]))
        alpha[0] = 1
        for a, b, found, ids in self.arcs(words):
            alpha[b, found] += alpha[a, found] * p[ids]
        return alpha[-1]

    def log_score(self, word: str, p: np.ndarray) -> np.ndarray:
        """[language]: the logarithm of the same sum for one word of any length. Only the last sums are held, scaled by what is added to the logarithm."""
        grid = codes([word])[0]
        n, longest = len(grid), min(self.longest, len(grid))
        # ids[j][a]: the piece of j + 1 letters from a, -1 if none.
        h, ids = np.zeros(n, np.uint64), []
        for j in range(longest):
            h = self.step(h[: n - j], grid[j:])
            at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
            ids.append(np.where(self.hashes[at] == h, self.ids[at], -1).tolist() if len(self.hashes) else [-1] * (n - j))
        last, scale = [np.ones(p.shape[1])], np.zeros(p.shape[1])
        for b in range(1, n + 1):
            now = np.zeros(p.shape[1])
            for j in range(min(longest, b)):
                i = ids[j][b - 1 - j]
                if i >= 0 or j == 0:
                    now = now + last[-1 - j] * p[i if i >= 0 else self.unknown]
            last = [*last[1 - self.longest :], now] if self.longest > 1 else [now]
            top = np.max(last, axis=0)
            if (top < 1e-100).any():
                top = np.maximum(top, 1e-300)
                last, scale = [x / top for x in last], scale + np.log(top)
        return np.log(np.maximum(last[-1], 1e-300)) + scale


def codes(words: list[str]) -> np.ndarray:
    """[word, position]: code points. words: of one length."""
    return np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(words), -1).astype(np.uint64)


class Lattice:
    """All segmentations of some words, for the fit: arcs (word, start, end, piece)."""

    def __init__(self, words: list[str], pieces: Pieces) -> None:
        parts: list[list[np.ndarray]] = [[], [], [], []]
        self.n = len(words)
        self.sizes = np.array([len(w) + 1 for w in words], np.int64)
        for size in np.unique(self.sizes):
            own = np.flatnonzero(self.sizes == size)
            for a, b, found, ids in pieces.arcs([MARK + words[i] for i in own]):
                for part, x in zip(parts, (own[found], np.full(len(found), a), np.full(len(found), b), ids), strict=True):
                    part.append(x)
        self.word, self.start, self.end, self.piece = (np.concatenate(x).astype(np.int32) for x in parts)
        order = np.argsort(self.word, kind="stable")
        self.word, self.start, self.end, self.piece = (x[order] for x in (self.word, self.start, self.end, self.piece))
        self.longest = int(self.sizes.max())

    def _steps(self, by: np.ndarray) -> list[np.ndarray]:
        order = np.argsort(by, kind="stable")
        cuts = np.searchsorted(by[order], np.arange(self.longest + 2))
        return [order[cuts[i] : cuts[i + 1]] for i in range(self.longest + 1)]

    def forward(self, p: np.ndarray) -> np.ndarray:
        """[word, position, language]: probability of all segmentations up to the position."""
        alpha = np.zeros((self.n, self.longest + 1, p.shape[1]))
        alpha[:, 0] = 1
        for e, arcs in enumerate(self._steps(self.end)):
            if e and len(arcs):
                w = self.word[arcs]
                mass = alpha[w, self.start[arcs]] * p[self.piece[arcs]]
                first = np.flatnonzero(np.concatenate(([True], w[1:] != w[:-1])))  # arcs are in the order of words
                alpha[w[first], e] = np.add.reduceat(mass, first, axis=0)
        return alpha

    def total(self, alpha: np.ndarray) -> np.ndarray:
        return alpha[np.arange(self.n), self.sizes]

    def expected(self, p: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """[piece, language]: expected uses. counts: [word, language]."""
        alpha = self.forward(p)
        beta = np.zeros_like(alpha)
        beta[np.arange(self.n), self.sizes] = 1
        for s, arcs in reversed(list(enumerate(self._steps(self.start)))):
            if len(arcs):
                w = self.word[arcs]
                mass = beta[w, self.end[arcs]] * p[self.piece[arcs]]
                first = np.flatnonzero(np.concatenate(([True], w[1:] != w[:-1])))
                beta[w[first], s] = np.add.reduceat(mass, first, axis=0)
        weight = counts / np.maximum(self.total(alpha), 1e-300)
        use = alpha[self.word, self.start] * p[self.piece] * beta[self.word, self.end] * weight[self.word]
        return np.stack([np.bincount(self.piece, use[:, j], len(p)) for j in range(p.shape[1])], axis=1)


class Model:
    def __init__(self, languages: list[str], pieces: dict[str, int], p: np.ndarray, prior: np.ndarray) -> None:
        self.languages, self.pieces, self.p, self.prior = languages, pieces, p, np.log(prior)
        self.finder = Pieces(pieces)
        self.rows: dict[bytes, int] = {}
        #: Of each token, the log-probabilities of its words, and how many words it has.
        self.logs = np.zeros((0, len(languages) + 1))

    def log_words(self, words: list[str]) -> np.ndarray:
        """[word, language]. words: of one length, without the mark."""
        if len(words[0]) > LONG:
            return np.stack([self.finder.log_score(MARK + w, self.p) for w in words])
        return np.log(np.maximum(self.finder.score([MARK + w for w in words], self.p), 1e-300))

    def _learn(self, tokens: set[bytes]) -> None:
        new = [t for t in tokens if t not in self.rows]
        if not new:
            return
        if len(self.rows) + len(new) > CACHE:
            self.rows, self.logs = {}, self.logs[:0]
            new = list(tokens)
        by: dict[int, list[tuple[str, int]]] = {}
        for i, t in enumerate(new):
            for w in words_of(t):
                by.setdefault(len(w), []).append((w, i))
        logs = np.zeros((len(new), len(self.languages) + 1))
        for own in by.values():
            for at in range(0, len(own), 4096):
                part = own[at : at + 4096]
                where = np.array([i for _, i in part])
                np.add.at(logs[:, :-1], where, self.log_words([w for w, _ in part]))
                np.add.at(logs[:, -1], where, 1)
        self.rows.update(zip(new, range(len(self.logs), len(self.logs) + len(new)), strict=True))
        self.logs = np.concatenate([self.logs, logs])

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """Language and its posterior; ("und", 0) without letters or without languages."""
        counted = [Counter(tokens_of(t)) for t in texts]
        self._learn(set().union(*counted))
        out, row = [], self.rows.__getitem__
        for counts in counted:
            x = np.fromiter(counts.values(), np.float64, len(counts)) @ self.logs[list(map(row, counts))] if counts else np.zeros(1)
            if not x[-1] or not self.languages:
                out.append(("und", 0.0))
                continue
            x = self.prior + x[:-1]
            x = np.exp(x - x.max())
            best = int(x.argmax())
            out.append((self.languages[best], float(x[best] / x.sum())))
        return out


def fit(samples: dict[str, Counter], totals: dict[str, int], pieces: dict[str, int]) -> Model:
    """samples: words of each language. totals: documents of each language, for the prior."""
    languages = sorted(samples)
    words = sorted({w for c in samples.values() for w in c if len(w) <= LONG}, key=lambda w: (len(w), w))
    finder = Pieces(pieces)
    p = np.full((len(pieces) + 1, len(languages)), 1 / (len(pieces) + 1))
    blocks = [words[i : i + 4000] for i in range(0, len(words), 4000)]
    lattices = [(Lattice(b, finder), np.array([[samples[x][w] for x in languages] for w in b], float)) for b in blocks]
    for _ in range(ROUNDS if lattices else 0):
        use = sum(lattice.expected(p, counts) for lattice, counts in lattices) + SMOOTHING
        p = use / use.sum(axis=0)
    n = np.array([totals[x] for x in languages], float)
    return Model(languages, pieces, p, (n + 1) / (n + 1).sum() if len(n) else n)


def train(docs: DataFrame, learn: Column | None = None, vocabulary: str = VOCABULARY, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """learn: condition on the column id. Rows with null text or language aren't learned from.

    Of each language, about SAMPLE documents with the smallest hash of the id are read. The model
    holds a number for each piece and language, and one language's worth is some 250 kB.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where(F.col("text").isNotNull() & F.col("lang").isNotNull() & (F.lit(True) if learn is None else learn))
    totals = {r[0]: r[1] for r in rows.groupBy("lang").count().collect()}  # one row for each language
    share = {x: min(1.0, SAMPLE / n) for x, n in totals.items()}
    samples: dict[str, Counter] = {x: Counter() for x in totals}
    if totals:
        part = F.create_map(*[F.lit(v) for kv in share.items() for v in kv])
        picked = rows.where(F.pmod(F.coalesce(F.xxhash64("id"), F.lit(0)), F.lit(1_000_003)) < F.element_at(part, F.col("lang")) * 1_000_003)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                counts: dict[str, Counter] = {}
                for t, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    counts.setdefault(x, Counter()).update(w for token in tokens_of(t) for w in words_of(token))
                flat = [(x, w, k) for x, c in counts.items() for w, k in c.items()]
                yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in flat], t) for i, t in enumerate((pa.string(), pa.string(), pa.int64()))], ["lang", "word", "n"])

        for x, w, n in common.map_texts(picked.select("text", "lang"), run, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n")).collect():
            samples[x][w] = n
    return fit(samples, totals, load_vocabulary(vocabulary))


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score) for each row. Null texts and texts without a letter: und, 0.

    Very long texts and words are read whole. An empty table gives an empty one. Equal posteriors go to the language that sorts first. Repeated rows get equal values. Other
    columns aren't read.
    """
    held = docs.sparkSession.sparkContext.broadcast((model.languages, model.pieces, model.p, np.exp(model.prior)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(*held.value)
        for b in batches:
            found = own.predict(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x for x, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())], ["id", "lang_pred", "score"])

    return common.map_texts(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), run, f"id {common.type_of(docs, id_col)}, lang_pred string, score double")
