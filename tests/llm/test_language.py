import itertools
from collections import Counter

import numpy as np

from tidepool.llm import language, queries


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    held = [r for r in queries.op7_language(spark, sf).collect() if r.held_out]
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) / len(held) > 0.97
    assert all(0 <= r.score <= 1 for r in held)


def brute(word, pieces, p, unknown):
    total = np.zeros(p.shape[1])
    for cuts in itertools.product([0, 1], repeat=len(word) - 1):
        at = [0, *[i + 1 for i, c in enumerate(cuts) if c], len(word)]
        mass = np.ones(p.shape[1])
        for a, b in itertools.pairwise(at):
            i = pieces.get(word[a:b], unknown if b == a + 1 else None)
            mass = mass * (p[i] if i is not None else 0)
        total += mass
    return total


def test_forward_sums_all_segmentations():
    pieces = {x: i for i, x in enumerate(["▁", "a", "b", "ab", "▁a", "ba", "aba"])}
    rng = np.random.default_rng(0)
    p = rng.random((len(pieces) + 1, 2))
    words = ["abab", "bbba", "xaba", "abxb"]
    got = language.Pieces(pieces).score(["▁" + w for w in words], p)
    want = [brute("▁" + w, pieces, p, len(pieces)) for w in words]
    assert np.allclose(got, want)
    assert np.allclose([language.Pieces(pieces).log_score("▁" + w, p) for w in words], np.log(want))
    long = language.Pieces(pieces)
    assert np.allclose(long.log_score("▁" + "abx" * 60, p / 50), np.log(long.score(["▁" + "abx" * 60], p / 50 * 1.0)[0])) or long.score(["▁" + "abx" * 60], p / 50)[0].min() < 1e-290
    assert np.allclose(long.log_score("ab" * 900, p / 3) - long.log_score("ab" * 899, p / 3), long.log_score("ab" * 800, p / 3) - long.log_score("ab" * 799, p / 3))
    lattice = language.Lattice(words, language.Pieces(pieces))
    assert np.allclose(lattice.total(lattice.forward(p)), want)
    use = lattice.expected(p, np.ones((4, 2)))
    assert use[pieces["▁"]].sum() + use[pieces["▁a"]].sum() == 8 or np.isclose(use[pieces["▁"]].sum() + use[pieces["▁a"]].sum(), 8)


def test_likelihood_rises_and_odd_texts(spark):
    pieces = language.load_vocabulary()
    model = language.fit({"xx": Counter({"the": 9, "there": 3}), "yy": Counter({"niño": 5, "señor": 4})}, {"xx": 3, "yy": 2}, pieces)
    assert [x for x, _ in model.predict(["the there", "SEÑOR niño", None, "", "123 !? —", "²"])] == ["xx", "yy", "und", "und", "und", "und"]
    assert all(model.predict([t])[0][0] == "yy" for t in ["niño²", "10 niño²", "señorⅧ", "señor" * 20])
    assert all(model.predict([t])[0][0] != "und" for t in ["m²", "10 m²", "aⅧ"])
    assert language.words_of("aⅧbc".encode()) == ["a", "bc"]
    long = "the" * 50_000
    df = spark.createDataFrame([(1, long, "q"), (None, "niño", "q"), (3, None, None)], "doc_id long, text string, lang_pred string")
    assert {(r.id, r.lang_pred) for r in language.identify(df, model).collect()} == {(1, "xx"), (None, "yy"), (3, "und")}
    assert language.identify(df.limit(0), model).count() == 0


def test_no_learned_rows(spark):
    df = spark.createDataFrame([(1, "some words", None), (2, None, "en")], "doc_id long, text string, lang string")
    model = language.train(df)
    assert {r.lang_pred for r in language.identify(df, model).collect()} == {"und"}
