import zlib

import numpy as np

from tidepool.llm import queries, toxicity


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    truth = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = queries.op3_toxicity(spark, sf).collect()
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    for r in rows:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
    held = [(r.predicted, truth[r.doc_id]) for r in rows if r.held_out and r.doc_id in truth]
    assert sum(p == t for p, t in held) / len(held) > 0.9


def test_fit_ranks_planted_words():
    clean = [f"word{i} plain{i % 7}" for i in range(400)]
    bad = [f"word{i} vile" for i in range(40)]
    model = toxicity.fit(bad[:20], clean + bad, 0.1)
    assert model.score("this is VILE") > 0.5 > 0.3 > model.score("plain3 word5")
    assert model.score(None) == model.score("") == model.score("123 !!")


def test_no_positives_and_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, 2.0), (2, "", 1.0), (None, "x " * 200_000, 0.0), (2, "", 1.0)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(1, 0), (2, None), (None, 1)], "doc_id long, toxic int")
    assert toxicity.train(docs, labels) is None
    assert [r.score for r in toxicity.score(docs, None).collect()] == [0.0] * 4
    assert toxicity.reject(docs, None).columns == docs.columns and toxicity.reject(docs, None).count() == 4
    assert toxicity.train(docs.limit(0), labels.limit(0)) is None
    assert toxicity.score(docs.limit(0), None).count() == 0


def test_few_positives_with_one_marker():
    model = toxicity.fit(["zorgle a b", "c zorgle", "zorgle d", "e f zorgle", "zorgle"], [f"w{i % 50} v{i % 7}" for i in range(400)] + ["zorgle x"] * 5, 0.1)
    assert model.score("some zorgle text") > 0.5 > model.score("some text")


def test_rows_are_a_matrix():
    number = np.array([2, -1, 0, 1])
    docs = [np.array([0, 1, 3]), np.array([], np.int32), np.array([2])]
    x = toxicity.Rows(docs, number, 4)
    plain = np.array([[0, 1, 1, 1], [0, 0, 0, 1], [1, 0, 0, 1]], float)
    w, r = np.array([1.0, 2, 4, 8]), np.array([1.0, 10, 100])
    assert (x.times(w) == plain @ w).all() and (x.transposed(r) == plain.T @ r).all()
