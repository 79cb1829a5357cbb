"""Benchmark decontamination with an FM-index per training shard.

A phrase is a window of ``WINDOW`` consecutive words of a benchmark item, or a whole shorter item.
Each task gathers its documents' words into shards. Words that no item has can't be part of an
occurrence, so they only part the text; runs of other words that are shorter than the shortest
phrase go too. What remains is indexed whole: suffix array by prefix doubling, Burrows-Wheeler
transform in a wavelet matrix, suffix positions sampled. All phrases are searched backwards at
once, occurrences are located by walks to the next sample, and overlapping ones merge into spans.

The benchmark is read in blocks of bounded size. Each is broadcast for a pass of its own over the
documents and given up before the next, so a benchmark of any size is covered, and what a worker
holds is one block. A longer run than a shard is cut into shards that overlap by a phrase.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

common.shipped(__name__)

#: Words of a window; symbols of a shard; bytes of a broadcast block of items; bytes of texts that a task holds.
WINDOW, SHARD, BLOCK_BYTES, HELD_BYTES = 10, 1 << 18, 1 << 22, 1 << 25
#: Distance of suffix samples.
SAMPLE = 8
#: ASCII letters to lower case; what is neither digit, letter nor beyond ASCII to space.
FOLDED = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(FOLDED).split()


class WaveletMatrix:
    """Ranks of symbols in a sequence, a bit level at a time."""

    def __init__(self, symbols: np.ndarray, sigma: int) -> None:
        self.bits = max(1, int(sigma - 1).bit_length())
        self.ones, self.zeros, now = [], [], symbols
        for level in range(self.bits - 1, -1, -1):
            bit = (now >> level) & 1
            self.ones.append(np.concatenate(([0], np.cumsum(bit))).astype(np.int32))
            self.zeros.append(int(len(now) - bit.sum()))
            now = np.concatenate((now[bit == 0], now[bit == 1]))

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each position."""
        first, at = np.zeros_like(at), at.copy()
        for level, (ones, zeros) in enumerate(zip(self.ones, self.zeros, strict=True)):
            bit = ((symbol >> (self.bits - 1 - level)) & 1).astype(bool)
            first = np.where(bit, zeros + ones[first], first - ones[first])
            at = np.where(bit, zeros + ones[at], at - ones[at])
        return at - first


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Positions in the order of their suffixes; each 0 of text differs from the others and is below all symbols."""
    n, bars = len(text), text == 0
    rank = np.where(bars, np.cumsum(bars) - 1, text.astype(np.int64) + int(bars.sum()))
    step = 1
    order = np.argsort(rank, kind="stable")
    while True:
        ranked = rank[order]
        new = np.concatenate(([True], ranked[1:] != ranked[:-1]))
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(new)
        if new.all():
            return order
        tail = np.zeros(n, np.int64)
        tail[:-step] = rank[step:] if step < n else 0
        rank = rank * (n + 2) + tail
        order = np.argsort(rank, kind="stable")
        step *= 2


class FMIndex:
    """text: symbols from 1; 0 parts runs, and stands first and last."""

    def __init__(self, text: np.ndarray, sigma: int) -> None:
        order = suffix_array(text)
        before = text[order - 1]
        self.n, self.tree = len(text), WaveletMatrix(before, sigma)
        self.below = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=sigma)))).astype(np.int64)
        self.before = before
        # A walk ends at a run's start, so it never steps over a 0.
        self.sampled = (order % SAMPLE == 0) | (before == 0)
        self.nth = np.cumsum(self.sampled) - 1
        self.samples = order[self.sampled]

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the rows of phrases that occur: which, and the range of suffixes."""
        alive = np.arange(len(phrases))
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n, np.int64)
        for j in range(phrases.shape[1] - 1, -1, -1):
            c = phrases[alive, j].astype(np.int64)
            low, high = self.below[c] + self.tree.rank(c, low), self.below[c] + self.tree.rank(c, high)
            on = high > low
            alive, low, high = alive[on], low[on], high[on]
        return alive, low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        rows, steps = rows.copy(), np.zeros(len(rows), np.int64)
        on = np.flatnonzero(~self.sampled[rows])
        while len(on):
            c = self.before[rows[on]].astype(np.int64)
            rows[on] = self.below[c] + self.tree.rank(c, rows[on])
            steps[on] += 1
            on = on[~self.sampled[rows[on]]]
        return self.samples[self.nth[rows]] + steps


class Phrases:
    """The phrases of some items. items: (id as text, text)."""

    def __init__(self, items: list[tuple[str, str]], window: int) -> None:
        self.vocabulary: dict[bytes, int] = {}
        owners: dict[tuple[int, ...], set[str]] = {}
        for item, text in items:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words_of(text)]
            for i in range(max(1, len(ids) - window + 1) if ids else 0):
                owners.setdefault(tuple(ids[i : i + window]), set()).add(item)
        by: dict[int, list[tuple[int, ...]]] = {}
        for p in owners:
            by.setdefault(len(p), []).append(p)
        self.by_length = {n: (np.array(ps, np.int32), [owners[p] for p in ps]) for n, ps in sorted(by.items())}
        self.shortest, self.longest = min(by, default=0), max(by, default=0)

    def find(self, documents: list[list[bytes]]) -> dict[int, tuple[list[tuple[int, int]], set[str]]]:
        """By number of document: merged spans of words, end exclusive, and items. In shards of bounded size."""
        out: dict[int, tuple[list[tuple[int, int]], set[str]]] = {}
        if not self.shortest or not documents:
            return out
        get = self.vocabulary.get
        bar = (np.zeros(1, np.int32), np.full(1, -1), np.zeros(1, np.int64))
        held, size = [bar], 1

        def flush() -> None:
            if size > 1:
                self._shard(*[np.concatenate(x) for x in zip(*held, strict=True)], out)

        for d, words in enumerate(documents):
            ids = np.array([get(w, 0) for w in words] + [0], np.int32)
            on = np.diff(np.concatenate(([0], (ids > 0).astype(np.int8))))
            for a, b in zip(np.flatnonzero(on == 1).tolist(), np.flatnonzero(on == -1).tolist(), strict=True):
                if b - a < self.shortest:
                    continue
                for x in range(a, b, SHARD):
                    y = min(b, x + SHARD + self.longest - 1)
                    held.append((np.append(ids[x:y], np.int32(0)), np.full(y - x + 1, d), np.arange(x, y + 1)))
                    size += y - x + 1
                    if size >= SHARD:
                        flush()
                        held, size = [bar], 1
        flush()
        return {d: (merged(spans), items) for d, (spans, items) in out.items()}

    def _shard(self, text: np.ndarray, owner: np.ndarray, place: np.ndarray, out: dict) -> None:
        index = FMIndex(text, len(self.vocabulary) + 1)
        for n, (phrases, owners) in self.by_length.items():
            which, low, high = index.search(phrases)
            if not len(which):
                continue
            count = high - low
            rows = np.repeat(low, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            at = index.locate(rows)
            for p, d, w in zip(np.repeat(which, count).tolist(), owner[at].tolist(), place[at].tolist(), strict=True):
                spans, items = out.setdefault(d, ([], set()))
                spans.append((w, w + n))
                items |= owners[p]


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def places(text: str, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans of words as code points of text, end exclusive."""
    raw = text.encode("utf-8", "surrogatepass")
    folded = np.frombuffer(raw.translate(FOLDED), np.uint8) != 32
    edge = np.diff(np.concatenate(([0], folded.astype(np.int8), [0])))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    points = np.concatenate(([0], np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)))
    return [(int(points[starts[a]]), int(points[ends[b - 1]])) for a, b in spans]


def blocks_of(benchmark: DataFrame, item_col: str, text_col: str, window: int) -> Iterator:
    """Broadcasts of at most about BLOCK_BYTES of items each, one after the other; an item is never parted. At least one."""
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(text_col).alias("text")).where("item IS NOT NULL AND text IS NOT NULL").distinct()
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-size // BLOCK_BYTES))
    for i in range(n):
        part = items if n == 1 else items.where(F.pmod(F.xxhash64("item"), F.lit(n)) == i)
        yield n, benchmark.sparkSession.sparkContext.broadcast([(r[0], r[1]) for r in part.collect()])


def search(texts: list[str | None], phrases: Phrases) -> list[tuple[int, list[tuple[int, int]], set[str]]]:
    """Number of words, merged word spans and items of each text."""
    words = [words_of(t) for t in texts]
    found = phrases.find(words)
    return [(len(w), *found.get(i, ([], set()))) for i, w in enumerate(words)]


def gathered(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[pa.Table]:
    """Batches joined until a shard is full."""
    held, size = [], 0
    for b in batches:
        held.append(b)
        size += b.column(column).nbytes
        if size >= HELD_BYTES:
            yield pa.Table.from_batches(held)
            held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """(id, n_words, n_hit, items, spans) for each row of docs.

    items: ids of the items with occurring windows, as text, sorted as strings. spans: removal
    spans in code points, end exclusive. Null and empty texts have no words. Items without id or
    words have no windows; repeated items count once. Repeated rows get equal values. Empty
    tables give none, or rows without hits. Other columns aren't read.
    """
    kind = common.type_of(docs, id_col)
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("h"), F.col(text_col).alias("text"))
    parts = []
    for n, block in blocks_of(benchmark, item_col, item_text_col, window):
        part = common.map_texts(rows, searched(block, window), f"id {kind}, h long, {HITS}")
        if n == 1:
            return part.drop("h", "places")
        # What hits is written before the block is given up; rows equal in id and text hit alike.
        parts.append(common.checkpoint(part.where("n_hit > 0").dropDuplicates(["id", "h"])))
        block.unpersist()
    hits = parts[0]
    for part in parts[1:]:
        hits = hits.union(part)
    hits = hits.groupBy(F.col("id").alias("i"), F.col("h").alias("g")).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), F.flatten(F.collect_list(F.arrays_zip("places", "spans"))).alias("found"))
    counted = common.map_texts(rows, counted_words, f"id {kind}, h long, n_words long")
    both = counted.join(common.checkpoint(hits), F.col("id").eqNullSafe(F.col("i")) & (F.col("h") == F.col("g")), "left").select("id", "n_words", "items", "found")
    return common.map_texts(both, joined, f"id {kind}, {HITS.split(', places')[0]}")


#: What a search gives; places are spans in words.
HITS = "n_words long, n_hit long, items array<string>, spans array<struct<start: long, end: long>>, places array<struct<start: long, end: long>>"
SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def searched(block, window: int):
    """A function of batches (id, h, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases = Phrases(block.value, window)
        for held in gathered(batches, 2):
            texts = held.column(2).to_pylist()
            found = search(texts, phrases)
            yield pa.RecordBatch.from_arrays(
                [
                    held.column(0).combine_chunks(),
                    held.column(1).combine_chunks(),
                    pa.array([n for n, _, _ in found], pa.int64()),
                    pa.array([sum(b - a for a, b in spans) for _, spans, _ in found], pa.int64()),
                    pa.array([sorted(items) for _, _, items in found], pa.list_(pa.string())),
                    pa.array([[{"start": a, "end": b} for a, b in places(t, spans)] if spans else [] for t, (_, spans, _) in zip(texts, found, strict=True)], SPANS),
                    pa.array([[{"start": a, "end": b} for a, b in spans] for _, spans, _ in found], SPANS),
                ],
                ["id", "h", "n_words", "n_hit", "items", "spans", "places"],
            )

    return run


def counted_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([len(words_of(t)) for t in b.column(2).to_pylist()], pa.int64())], ["id", "h", "n_words"])


def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans that the blocks gave, merged."""
    for b in batches:
        hit, spans = [], []
        for found in b.column(3).to_pylist():
            own = sorted((x["places"]["start"], x["places"]["end"], x["spans"]["start"], x["spans"]["end"]) for x in found or ())
            words = merged([x[:2] for x in own])
            hit.append(sum(y - x for x, y in words))
            spans.append([{"start": min(p[2] for p in own if x <= p[0] < y), "end": max(p[3] for p in own if x <= p[0] < y)} for x, y in words])
        items = [x or [] for x in b.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(hit, pa.int64()), pa.array(items, pa.list_(pa.string())), pa.array(spans, SPANS)], ["id", "n_words", "n_hit", "items", "spans"])


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """docs with the removal spans cut out of the texts, until no window is left. All columns stay.

    A cut leaves a newline. Texts without hits stay as they are, null among them; a text that
    loses its last word is dropped. Very long texts are searched whole. Repeated rows are cut
    alike, an empty benchmark cuts nothing, an empty table gives an empty one, and columns may
    have any names. A benchmark of several blocks takes a pass for each, until a round of passes
    cuts nothing more.
    """
    path, quiet, turn = None, 0, 0
    while True:
        for n, block in blocks_of(benchmark, item_col, item_text_col, window):
            cuts = docs.sparkSession.sparkContext.accumulator(0)
            out = common.map_texts(docs, cutting(block, window, text_col, cuts if n > 1 else None), docs.schema)
            if n == 1:
                return out
            docs, now = common.written(out, f"cut-{turn}")
            block.unpersist()
            if path is not None:
                common.removed(docs.sparkSession, path)
            path, turn = now, turn + 1
            quiet = 0 if cuts.value else quiet + 1
            if quiet >= n:
                return docs


def cutting(block, window: int, text_col: str, cuts):
    """A function of batches that cuts the block's phrases out of the texts. cuts: counts the texts cut, if given."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases = Phrases(block.value, window)
        for b in batches:
            at = b.schema.get_field_index(text_col)
            texts = b.column(at).to_pylist()
            keep, turn, cut = [True] * len(texts), list(range(len(texts))), False
            while turn:
                found = search([texts[i] for i in turn], phrases)
                hit = [(i, n, spans) for i, (n, spans, _) in zip(turn, found, strict=True) if spans]
                for i, n, spans in hit:
                    out, last = [], 0
                    for x, y in places(texts[i], spans):
                        out.append(texts[i][last:x])
                        last = y
                    texts[i] = "\n".join([*out, texts[i][last:]])
                    keep[i] = n > sum(y - x for x, y in spans)
                    cut = True
                turn = [i for i, _, _ in hit if keep[i]]
            if cut:
                if cuts is not None:
                    cuts.add(1)
                b = b.set_column(at, b.schema.field(at), pa.array(texts, b.schema.field(at).type)).filter(pa.array(keep))
            yield b

    return run


#: The rows of the query in DuckDB.
SQL = r"""
with lowered as (
  select doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) as w from documents),
items as (
  select item_id::varchar as item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark where item_id is not null and text is not null),
phrases as (
  select distinct item, least(10, len(w)) as n, array_to_string(w[i:i + 9], ' ') as p from (select item, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) as i from items where len(w) > 0)),
places as (
  select doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') as p from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as i from lowered, (select distinct n from phrases))),
found as (select doc_id, n, i, item from places join phrases using (n, p)),
hits as (select doc_id, count(distinct k) as n_hit from (select doc_id, unnest(range(i, i + n)) as k from found) group by 1),
named as (select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as names from (select distinct doc_id, item from found) group by 1)
select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items, sha256(coalesce(names, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from lowered left join hits using (doc_id) left join named using (doc_id)
"""
