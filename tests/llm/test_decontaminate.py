import hashlib
import random
import re

import duckdb
import numpy as np
import pytest

from tidepool.llm import decontaminate as d
from tidepool.llm import queries

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain(docs, items):
    out = []
    windows = {}
    for item, text in items:
        w = plain_words(text)
        for i in range(max(1, len(w) - 9) if w else 0):
            windows.setdefault(tuple(w[i : i + 10]), set()).add(str(item))
    lengths = {len(w) for w in windows}
    for i, text in docs:
        w, hit, found = plain_words(text), set(), set()
        for n in lengths:
            for a in range(len(w) - n + 1):
                if tuple(w[a : a + n]) in windows:
                    hit |= set(range(a, a + n))
                    found |= windows[tuple(w[a : a + n])]
        out.append((i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return out


def test_query_against_brute_force(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    want = plain(docs, items)
    assert any(x[-1] for x in want)
    got = [tuple(r) for r in queries.op9_decontamination(spark, sf).collect()]
    assert sorted(got) == sorted(want)
    c = duckdb.connect()
    for t in ("documents", "benchmark"):
        c.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    assert sorted(c.sql(d.SQL).fetchall()) == sorted(want)


@pytest.mark.parametrize("shard", [1 << 18, 40])
def test_random_texts_and_short_items(spark, monkeypatch, shard):
    monkeypatch.setattr(d, "SHARD", shard)
    rng = random.Random(5)
    text = lambda n: " ".join(rng.choice("ab") for _ in range(n))
    items = [(i, text(rng.choice([0, 1, 3, 9, 10, 11, 14]))) for i in range(12) if i != 3] + [(None, "a b"), (50, None), (4, "a a a b")]
    docs = [(i, rng.choice([text, lambda n: text(n // 2) + " zz " + text(n // 2)])(rng.randint(0, 60))) for i in range(60)]
    phrases = d.Phrases([(str(i), t) for i, t in items if i is not None and t is not None], 10)
    found = phrases.find([d.words_of(t) for _, t in docs])
    want = plain(docs, [x for x in items if None not in x])
    for n, (_, _, hit, k, sha, _) in enumerate(want):
        spans, ids = found.get(n, ([], set()))
        assert (sum(b - a for a, b in spans), len(ids)) == (hit, k)
        assert hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest() == sha


def test_index_ranks_and_locates():
    rng = np.random.default_rng(1)
    text = np.concatenate(([0], rng.integers(0, 5, 500), [0])).astype(np.int32)
    index = d.FMIndex(text, 5)
    for _ in range(50):
        phrase = rng.integers(1, 5, rng.integers(1, 5)).astype(np.int32)
        want = [i for i in range(len(text) - len(phrase) + 1) if (text[i : i + len(phrase)] == phrase).all()]
        which, low, high = index.search(phrase[None, :])
        got = sorted(index.locate(np.arange(low[0], high[0])).tolist()) if len(which) else []
        assert got == want


def test_removal_and_odd_rows(spark):
    passage = "one two three four five six seven eight nine ten eleven"
    rows = [(1, None, "k"), (2, "", "k"), (3, f"Before — {passage.upper()}! After", "k"), (4, passage, "k"), (5, "one two three four five " + passage + " six seven eight nine ten eleven", "k"), (6, "clean", None), (6, "clean", None), (7, "word " * 100_000, "k")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_hit string")
    benchmark = spark.createDataFrame([(1, passage), (1, passage), (2, None), (None, "clean")], "item_id long, text string")
    got = {r.id: r for r in d.contamination(docs, benchmark).collect()}
    assert (got[3].n_words, got[3].n_hit, got[3]["items"]) == (14, 11, ["1"])
    a, b = got[3].spans[0]
    assert rows[2][1][a:b] == passage.upper()
    out = d.decontaminate(docs, benchmark)
    assert out.columns == docs.columns
    left = {r.doc_id: r.text for r in out.collect()}
    assert left[3] == "Before — \n! After" and 4 not in left and 5 not in left and left[1] is None and left[2] == ""
    assert out.count() == 6
    assert d.contamination(docs.limit(0), benchmark).count() == 0
    assert {r.n_hit for r in d.contamination(docs, benchmark.limit(0)).collect()} == {0}


def test_blocks_and_shards_give_the_same(spark, monkeypatch):
    words = [f"w{i % 37}" for i in range(4000)]
    items = [(i, " ".join(words[50 * i : 50 * i + 14 + i])) for i in range(12)] + [(90, "w1 w2"), (91, "nowhere at all")]
    texts = [" ".join(words), None, "", "x " + items[3][1] + " y", "x " + items[3][1] + " y", items[5][1] + " z " + items[7][1]]
    docs = spark.createDataFrame([(None if i == 3 else i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    benchmark = spark.createDataFrame(items, "item_id long, text string")

    def both():
        found = sorted(map(str, d.contamination(docs, benchmark).collect()))
        return found, sorted(map(str, d.decontaminate(docs, benchmark).collect()))

    whole = both()
    monkeypatch.setattr(d, "SHARD", 100)
    assert both() == whole
    monkeypatch.setattr(d, "BLOCK_BYTES", 300)
    found, left = both()
    assert found == whole[0]
    phrases = d.Phrases([(str(i), t) for i, t in items], d.WINDOW)
    assert not phrases.find([d.words_of(r.text) for r in d.decontaminate(docs, benchmark).collect()])
