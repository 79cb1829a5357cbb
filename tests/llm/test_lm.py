import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tidepool.llm import common, lm, queries


def plain_words(text):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]


def plain_ppm(texts, order):
    """Counts of every context, and a function that scores one text symbol by symbol."""
    counts = {}
    for t in texts:
        s = [257] * order + list((t or "").encode()) + [256]
        for i in range(order, len(s)):
            for k in range(order + 1):
                counts.setdefault(tuple(s[i - k : i]), Counter())[s[i]] += 1

    def score(text):
        s, total = [257] * order + list((text or "").encode()) + [256], 0.0
        for i in range(order, len(s)):
            excluded = set()
            for k in range(order, -1, -1):
                seen = {x: n for x, n in counts.get(tuple(s[i - k : i]), {}).items() if x not in excluded}
                if not seen:
                    continue
                escape = len(seen) if len(seen) + len(excluded) < 257 else 0
                whole = sum(seen.values()) + escape
                if s[i] in seen:
                    total += math.log10(seen[s[i]] / whole)
                    break
                total += math.log10(escape / whole)
                excluded |= set(seen)
            else:
                total += math.log10(1 / (257 - len(excluded)))
        return total

    return score


@pytest.mark.parametrize("contexts", [49152, 40, 1])
def test_ppm_against_symbol_by_symbol(spark, monkeypatch, contexts):
    monkeypatch.setattr(lm, "CONTEXTS", contexts)
    learned = ["the cat sat", "the cart sat", "", "übel", None, "aaaa\nbbbb", "the cat sat"]
    texts = [*learned, "the cab", "zz\x00", "ü", "cat " * 300]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    score = plain_ppm(learned, lm.ORDER)
    got = {r.id: r.score for r in lm.scores(docs, common.F.col("id") < len(learned)).collect()}
    assert np.allclose([got[i] for i in range(len(texts))], [score(t) for t in texts], rtol=1e-5)


def test_table_of_contexts_is_a_distribution(spark, monkeypatch):
    monkeypatch.setattr(lm, "CONTEXTS", 20)
    docs = spark.createDataFrame([(1, "abracadabra alakazam"), (2, "abra kadabra")], "doc_id long, text string")
    model = lm.train(lm.pairs_of(docs))
    assert len(model.logp) == 20
    assert np.allclose(np.exp(model.logp.astype(float)).sum(axis=1), 1, atol=1e-4)


@pytest.mark.parametrize(("frequent", "contexts"), [(1 << 18, 49152), (40, 300)])
def test_query_against_brute_force(spark, sf, monkeypatch, frequent, contexts):
    monkeypatch.setattr(lm, "FREQUENT", frequent)
    monkeypatch.setattr(lm, "CONTEXTS", contexts)
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    out = {r.doc_id: zlib.crc32(str(r.doc_id).encode()) % 7 == 2 for r in docs}
    c = Counter()
    for r in docs:
        if not out[r.doc_id]:
            c.update([*plain_words(r.text), None])
    n, v = sum(c.values()), len(c)
    rows = {r.doc_id: r for r in queries.op8_lm(spark, sf).collect()}
    assert len(rows) == len(docs)
    for r in docs:
        tokens = [*plain_words(r.text), None]
        got = rows[r.doc_id]
        assert (got.held_out, got.n_tokens, got.n_known, got.train_tokens) == (out[r.doc_id], len(tokens), sum(c[t] > 0 for t in tokens), n)
        assert math.isclose(got.base_score, sum(math.log10((c[t] + 1) / (n + v + 1)) for t in tokens), rel_tol=1e-9)
    score = plain_ppm([r.text for r in docs if not out[r.doc_id]], lm.ORDER)
    for r in sorted(docs, key=lambda r: len(r.text or ""))[:150]:
        assert math.isclose(rows[r.doc_id].score, score(r.text), rel_tol=1e-5)
    held = [r for r in docs if out[r.doc_id]]
    bits = -sum(rows[r.doc_id].score for r in held) * math.log2(10) / sum(len(r.text.encode()) + 1 for r in held)
    assert bits < 3


def test_odd_rows(spark):
    rows = [(1, None, 1.0), (2, "", 1.0), (None, "a a b", 1.0), (3, "rare", 1.0), (3, "rare", 1.0), (4, "word " * 100_000, 1.0), (5, "long" * 50 + " x", 1.0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, score double")
    got = lm.scores(df).collect()
    assert len(got) == 7 and all(r.score < 0 for r in got)
    assert [r.n_tokens for r in got if r.id == 3] == [2, 2]
    assert {r.n_tokens for r in got if r.id in (1, 2)} == {1}
    nothing = lm.scores(df, ~common.fold("id", 1) & (common.F.col("id") == 99)).collect()
    assert {(r.n_known, r.train_tokens, r.base_score) for r in nothing} == {(0, 0, 0.0)}
    assert lm.scores(df.limit(0)).count() == 0
