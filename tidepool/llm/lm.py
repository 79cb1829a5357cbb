"""Language-model scores by prediction by partial matching.

The pretrained model is a trie of byte contexts up to ``ORDER``, counted over all learned texts.
Escapes are estimated by method C: with ``d`` distinct symbols in ``T`` occurrences, an escape has
``d / (T + d)``. A shorter context leaves out the symbols of the longer ones that escaped to it
(symbol exclusion); what no context has is uniform. A text's symbols are its UTF-8 bytes and one
end; before them stand start marks.

The counts of all contexts are gathered over the whole corpus and all are used. The ``CONTEXTS``
commonest make up a table of states that is broadcast (at most 76 MB): as they are closed under
dropping the first or the last byte, scoring is a walk through the table, for all positions of a
batch at once. A position whose context of ``ORDER`` bytes is in the table has its exact
probability there. The other positions, a few in a hundred, are counted by document, and their
probabilities come from the counts of their contexts by a shuffle on the context's last bytes.
Contexts of up to ``LOW`` bytes, whose number the alphabet bounds, are broadcast for that.

Word statistics for the base score: counts of words over all learned texts. Words at or above a
count that at most ``FREQUENT`` words reach are broadcast, long ones by a digest; the others, of
which none is frequent, are joined by shuffle.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

common.shipped(__name__)

ORDER, CONTEXTS, LOW = 4, 49152, 2
#: Symbols 0 to 255 are bytes; the end is predicted, the start isn't.
END, START, SYMBOLS, BASE = 256, 257, 257, 258
FREQUENT, FREQUENT_BYTES = 1 << 18, 64
#: Entries that a task holds before it passes counts on.
HELD = 1 << 21
#: Mark of a row of logp, of a learned symbol's row by its order, and of a row that asks.
ASKED = 9


def symbols_of(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """All symbols, each text with its start marks and end, and where each text begins."""
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    sizes = np.array([len(r) + ORDER + 1 for r in raw], np.int64)
    begin = np.cumsum(sizes) - sizes
    out = np.full(int(sizes.sum()), START, np.int64)
    data = np.frombuffer(b"".join(raw), np.uint8)
    inner = np.ones(len(out), bool)
    for j in range(ORDER):
        inner[begin + j] = False
    last = begin + sizes - 1
    inner[last] = False
    out[inner] = data
    out[last] = END
    return out, begin


def grams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Codes of context and symbol, ORDER + 1 symbols in base BASE, and their counts."""
    s, begin = symbols_of(texts)
    if not len(s):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    predicted = np.ones(len(s), bool)
    for j in range(ORDER):
        predicted[begin + j] = False
    at = np.flatnonzero(predicted)
    code = np.zeros(len(at), np.int64)
    for j in range(ORDER, -1, -1):
        code = code * BASE + s[at - j]
    return np.unique(code, return_counts=True)


def summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    codes, n = (np.concatenate(x) for x in zip(*parts, strict=True))
    codes, where = np.unique(codes, return_inverse=True)
    return codes, np.bincount(where, n, len(codes)).astype(np.int64)


class Model:
    """logp[state, symbol], natural logarithms, and step[state, symbol], the state after the symbol."""

    def __init__(self, counts: dict[tuple[int, int], dict[int, int]]) -> None:
        """counts: by (order, context code), the count of each symbol."""
        known = sorted(counts)
        if (0, 0) not in counts:
            known = [(0, 0)]
        number = {x: i for i, x in enumerate(known)}
        parents = [number.get((k - 1, c % BASE ** (k - 1)), 0) if k else -1 for k, c in known]
        rows = [(np.fromiter(own, np.int64, len(own)), np.fromiter(own.values(), np.float64, len(own))) for own in (counts.get(x, {}) for x in known)]
        #: Whether a state's context has ORDER bytes.
        self.full = np.array([k == ORDER for k, _ in known])
        self.logp = np.empty((len(known), SYMBOLS), np.float32)
        self.step = np.zeros((len(known), BASE), np.uint16)  # CONTEXTS is below 1 << 16
        for (k, c), i in number.items():
            chain, at = [], i
            while at >= 0:
                chain.append(np.zeros(SYMBOLS))
                chain[-1][rows[at][0]] = rows[at][1]
                at = parents[at]
            self.logp[i] = logs_of(chain)
            if k:  # shorter contexts have smaller numbers
                self.step[i] = self.step[parents[i]]
            if k < ORDER:
                for s in range(BASE):
                    child = number.get((k + 1, c * BASE + s))
                    if child is not None:
                        self.step[i, s] = child

    def walk(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """log10 of each text's probability over the positions whose context of ORDER bytes is a state; of the others: text, code as in grams, count."""
        if not texts:
            none = np.zeros(0, np.int64)
            return np.zeros(0), none, none, none
        s, begin = symbols_of(texts)
        out = np.zeros(len(s), np.float64)
        flat_step, flat_log = self.step.ravel(), self.logp.ravel()
        places = []
        for a in range(ORDER, len(s), 1 << 20):
            b = min(len(s), a + (1 << 20))
            state = np.zeros(b - a, np.int64)
            for j in range(ORDER, 0, -1):
                state = flat_step[state * BASE + s[a - j : b - j]].astype(np.int64)
            whole = self.full[state]
            out[a:b] = np.where(whole, flat_log[state * SYMBOLS + np.minimum(s[a:b], END)], 0)
            places.append(np.flatnonzero(~whole) + a)
        for j in range(ORDER):
            out[begin + j] = 0
        at = np.concatenate(places) if places else np.zeros(0, np.int64)
        at = at[s[at] != START]
        code = np.zeros(len(at), np.int64)
        for j in range(ORDER, -1, -1):
            code = code * BASE + s[at - j]
        owner = np.searchsorted(begin, at, "right") - 1
        order = np.lexsort((code, owner))
        owner, code = owner[order], code[order]
        new = np.flatnonzero(np.concatenate(([True], (owner[1:] != owner[:-1]) | (code[1:] != code[:-1])))) if len(at) else np.zeros(0, np.int64)
        return np.add.reduceat(out, begin) / np.log(10), owner[new], code[new], np.diff(np.append(new, len(at)))


def logs_of(chain: list[np.ndarray]) -> np.ndarray:
    """Natural logarithms of all symbols. chain: counts of each symbol in a context and its shorter ones."""
    p, mass, left = np.zeros(SYMBOLS), 1.0, np.ones(SYMBOLS, bool)
    for n in chain:
        seen = left & (n > 0)
        d = int(seen.sum())
        if d:
            total = n[seen].sum()
            escape = d if d < left.sum() else 0
            p[seen] = mass * n[seen] / (total + escape)
            mass *= escape / (total + escape)
            left &= ~seen
    if left.any():
        p[left] = mass / left.sum()
    with np.errstate(divide="ignore"):  # the escape of a context that has seen every symbol is never asked for
        return np.log(p)


def pairs_of(docs: DataFrame, learn: Column | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(k, ctx, s, n): how often each symbol follows each context, of order k, over the learned rows."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    rows = rows if learn is None else rows.where(learn)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for b in batches:
            texts = b.column(0).to_pylist()
            held.extend(grams(texts[i : i + 200]) for i in range(0, len(texts), 200))
            if sum(len(c) for c, _ in held) > HELD:
                held = [summed(held)]
                if len(held[0][0]) > HELD // 2:
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in held.pop()], ["code", "n"])
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in summed(held)], ["code", "n"])

    counted = common.map_texts(rows.select("text"), run, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))
    each = [F.struct(F.lit(k).alias("k"), F.expr(f"(code div {BASE}) % {BASE**k}").alias("ctx")) for k in range(ORDER + 1)]
    return common.checkpoint(counted.select("n", F.expr(f"int(code % {BASE})").alias("s"), F.explode(F.array(*each)).alias("e")).groupBy("e.k", "e.ctx", "s").agg(F.sum("n").alias("n")))


def train(pairs: DataFrame) -> Model:
    """The table of the commonest contexts. pairs: pairs_of()."""
    kept = pairs.groupBy("k", "ctx").agg(F.sum("n").alias("total")).orderBy(F.desc("total"), "k", "ctx").limit(CONTEXTS)
    counts: dict[tuple[int, int], dict[int, int]] = {}
    found = pairs.join(F.broadcast(kept.select("k", "ctx")), ["k", "ctx"], "left_semi").toArrow()  # at most CONTEXTS * SYMBOLS rows
    for k, ctx, s, n in zip(*(found.column(x).to_pylist() for x in ("k", "ctx", "s", "n")), strict=True):
        counts.setdefault((k, ctx), {})[s] = n
    return Model(counts)


class Low:
    """Counts of the contexts of up to LOW bytes, whose number the alphabet bounds: at most BASE**2 contexts of SYMBOLS symbols."""

    def __init__(self, keys: np.ndarray, s: np.ndarray, n: np.ndarray) -> None:
        """keys: k * BASE**LOW + ctx, ascending."""
        self.keys, self.s, self.n = keys, s, n

    def chain(self, ctx: int) -> list[np.ndarray]:
        """Counts of each symbol in the contexts that end ctx, from LOW bytes down."""
        out = []
        for k in range(LOW, -1, -1):
            key = k * BASE**LOW + ctx % BASE**k
            a, b = np.searchsorted(self.keys, [key, key + 1])
            row = np.zeros(SYMBOLS)
            row[self.s[a:b]] = self.n[a:b]
            out.append(row)
        return out


def rare_logs(pairs: DataFrame, codes: DataFrame) -> DataFrame:
    """(code, logp): log10 of the probability of the last symbol of each code after the others. codes: (code), distinct.

    Contexts and codes meet by the last three bytes of the context, which at most BASE contexts of
    ORDER bytes share, so a group is bounded by the alphabet.
    """
    low = pairs.where(f"k <= {LOW}").selectExpr(f"k * {BASE**LOW}L + ctx AS key", "s", "n").toArrow().sort_by("key")
    low_arrays = [low.column(x).to_numpy() for x in ("key", "s", "n")]
    held = codes.sparkSession.sparkContext.broadcast((low_arrays[0], low_arrays[1].astype(np.int16), low_arrays[2]))
    high = pairs.where(f"k > {LOW}").selectExpr(f"ctx % {BASE**3}L AS g", "k", f"int(ctx div {BASE**3}L) AS c", "s", "n")
    asked = codes.selectExpr(f"(code div {BASE}) % {BASE**3}L AS g", f"{ASKED} AS k", f"int(code div {BASE**4}L) AS c", f"int(code % {BASE}) AS s", "0L AS n")
    rows = high.join(asked.select("g").distinct(), "g", "left_semi").unionByName(asked).repartition("g").sortWithinPartitions("g", "k", "c")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lower, rest = Low(*held.value), None
        for b in batches:
            now = [b.column(i).to_numpy() for i in range(5)]
            now = now if rest is None else [np.concatenate(x) for x in zip(rest, now, strict=True)]
            if not len(now[0]):
                continue
            cut = int(np.searchsorted(now[0], now[0][-1])) if (now[0][1:] >= now[0][:-1]).all() else 0
            if cut == 0:  # one group as yet, or a new partition's rows after another's
                cut = int(np.flatnonzero(now[0][1:] != now[0][:-1])[-1]) + 1 if (now[0][1:] != now[0][:-1]).any() else 0
            rest = [x[cut:] for x in now]
            if cut:
                yield groups([x[:cut] for x in now], lower)
        if rest is not None and len(rest[0]):
            yield groups(rest, lower)

    def groups(columns: list[np.ndarray], lower: Low) -> pa.RecordBatch:
        g = columns[0]
        edges = np.flatnonzero(np.concatenate(([True], g[1:] != g[:-1], [True])))
        codes_, logs = [], []
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            k, c, s, n = (x[a:b] for x in columns[1:])
            if k[-1] != ASKED:
                continue
            chain = lower.chain(int(g[a]) % BASE**LOW)
            three = np.zeros(SYMBOLS)
            three[s[k == 3]] = n[k == 3]
            chain.insert(0, three)
            four, wanted = k == 4, k == ASKED
            for first in np.unique(c[wanted]).tolist():
                own = np.zeros(SYMBOLS)
                mine = four & (c == first)
                own[s[mine]] = n[mine]
                symbols = s[wanted & (c == first)].astype(np.int64)
                logs.append(logs_of([own, *chain])[symbols] / np.log(10))
                codes_.append((first * BASE**3 + int(g[a])) * BASE + symbols)
        none = np.zeros(0)
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate([none.astype(np.int64), *codes_])), pa.array(np.concatenate([none, *logs]))], ["code", "logp"])

    return common.map_texts(rows, run, "code long, logp double")


def tokens_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def word_counts(docs: DataFrame, learn: Column | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, c) over the learned rows; the word null stands for the ends."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    rows = rows if learn is None else rows.where(learn)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, ends = Counter(), 0

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([None, *held], pa.binary()), pa.array([ends, *held.values()], pa.int64())], ["word", "c"])

        for b in batches:
            for t in b.column(0).to_pylist():
                held.update(tokens_of(t))
                ends += 1
            if len(held) > HELD // 4:
                yield out()
                held, ends = Counter(), 0
        yield out()

    return common.map_texts(rows.select("text"), run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c")).where("c > 0")


def digested(word: bytes) -> bytes:
    """The word, or of a long one a blank, which no word has, and a digest."""
    return word if len(word) <= FREQUENT_BYTES else b" " + hashlib.md5(word, usedforsecurity=False).digest()


def scores(docs: DataFrame, learn: Column | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, n_known, train_tokens, base_score, score) for each row of docs.

    base_score is the unigram score of words and one end, score the model's log10 probability.
    Null and empty texts have the end alone; very long ones are scored whole. With nothing learned,
    the base is 0 and the model uniform. Repeated rows get equal values; ids may be null. An empty
    table gives an empty one. Other columns aren't read.
    """
    spark = docs.sparkSession
    pairs = pairs_of(docs, learn, id_col, text_col)
    model = train(pairs)
    words = common.checkpoint(word_counts(docs, learn, id_col, text_col))
    total, distinct = words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    ends = (words.where("word IS NULL").first() or (None, 0))[1]
    levels = dict(words.where("word IS NOT NULL").groupBy(F.expr("int(floor(log2(c)))")).count().collect())
    level, n = 64, 0
    while level and n + levels.get(level - 1, 0) <= FREQUENT:
        level -= 1
        n += levels.get(level, 0)
    common_words = F.expr("int(floor(log2(c)))") >= level
    short = F.when(F.octet_length("word") <= FREQUENT_BYTES, F.col("word")).otherwise(F.concat(F.lit(b" "), F.unhex(F.md5("word"))))
    # At most FREQUENT words of FREQUENT_BYTES each.
    frequent = {bytes(r[0]): r[1] for r in words.where(F.col("word").isNotNull() & common_words).select(short, "c").toLocalIterator()}
    norm = np.log10(total + distinct + 1)
    logs = {w: float(np.log10(c + 1) - norm) for w, c in frequent.items()}
    held, known = spark.sparkContext.broadcast((model.logp, model.step, model.full)), spark.sparkContext.broadcast(logs)
    end_log = float(np.log10(ends + 1) - norm)

    def walked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model.__new__(Model)
        own.logp, own.step, own.full = held.value
        for b in batches:
            texts = b.column(2).to_pylist()
            for i in range(0, len(texts), 200):
                score, owner, code, n = own.walk(texts[i : i + 200])
                at = pa.array(np.concatenate((np.arange(len(score)), owner)) + i)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(at), b.column(1).take(at), pa.array(np.concatenate((np.full(len(score), -1), code))), pa.array(np.concatenate((np.ones(len(score), np.int64), n))), pa.array(np.concatenate((score, np.zeros(len(code)))))],
                    ["id", "h", "code", "n", "score"],
                )

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = known.value.get
        for b in batches:
            n, n_known, base = [], [], []
            for t in b.column(2).to_pylist():
                tokens = tokens_of(t)
                found = [x for x in map(get, map(digested, tokens)) if x is not None]
                n.append(len(tokens) + 1)
                n_known.append(len(found) + (ends > 0))
                base.append(sum(found) + end_log)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64()), pa.array(n_known, pa.int64()), pa.array(base, pa.float64())], ["id", "h", "n_tokens", "n_known", "base"])

    def rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep = known.value
        for b in batches:
            row, word, n = [], [], []
            for i, t in enumerate(b.column(2).to_pylist()):
                for w, k in Counter(x for x in tokens_of(t) if digested(x) not in keep).items():
                    row.append(i)
                    word.append(w)
                    n.append(k)
            at = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), pa.array(word, pa.binary()), pa.array(n, pa.int64())], ["id", "h", "word", "n"])

    kind = common.type_of(docs, id_col)
    # Rows are told apart by id and hash of the text; rows equal in both are repeats, and m counts them.
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("h"), F.col(text_col).alias("text"))
    coded, path = common.written(common.map_texts(rows, walked, f"id {kind}, h long, code long, n long, score double"), "lm")
    exact = rare_logs(pairs, common.checkpoint(coded.where("code >= 0").select("code").distinct()))
    heads = common.map_texts(rows, whole, f"id {kind}, h long, n_tokens long, n_known long, base double")
    others = common.map_texts(rows, rest, f"id {kind}, h long, word binary, n long")
    rare = words.where(F.col("word").isNotNull() & ~common_words).withColumnRenamed("word", "w")
    joined = others.join(rare, F.col("word") == F.col("w"), "left").select("id", "h", F.when(F.col("c") > 0, F.col("n")).otherwise(0).alias("n_known"), (F.col("n") * (F.log10(F.coalesce("c", F.lit(0)) + F.lit(1)) - F.lit(float(norm)))).alias("base"))
    scored = coded.where("code < 0").select("id", "h", "score").union(coded.where("code >= 0").join(exact, "code").select("id", "h", F.col("n") * F.col("logp")))
    both = heads.unionByName(joined, allowMissingColumns=True).unionByName(scored, allowMissingColumns=True)
    sums = both.groupBy("id", "h").agg(F.count("n_tokens").alias("m"), F.max("n_tokens").alias("n_tokens"), F.sum("n_known").alias("n_known"), F.sum("base").alias("base"), F.sum("score").alias("score"))
    out = common.checkpoint(sums)
    common.removed(spark, path)
    return out.select("id", "n_tokens", F.expr("n_known div m").alias("n_known"), F.lit(int(total)).cast("long").alias("train_tokens"), (F.col("base") / F.col("m")).alias("base_score"), (F.col("score") / F.col("m")).alias("score"), F.explode(F.sequence(F.lit(1), F.col("m").cast("int"))).alias("__nth")).drop("__nth")
