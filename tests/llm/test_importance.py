import math
from collections import Counter

import numpy as np

from tidepool.llm import importance, queries


def test_query_weights_against_plain(spark, sf):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    good = {r.doc_id for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if r.quality == 1}
    raw, target = Counter(), Counter()
    for i, t in docs.items():
        c = Counter(importance.hashed(t).tolist())
        raw.update(c)
        if i in good:
            target.update(c)
    n = importance.BUCKETS
    size = [sum(c.values()) + n for c in (target, raw)]
    ratio = [math.log((target[b] + 1) / size[0]) - math.log((raw[b] + 1) / size[1]) for b in range(n)]
    rows = queries.op1_importance(spark, sf).collect()
    assert len(rows) == len(docs)
    for r in rows:
        assert math.isclose(r.log_weight, sum(ratio[b] for b in importance.hashed(docs[r.doc_id]).tolist()), abs_tol=1e-6)
    chosen = sorted((r.gumbel for r in rows), reverse=True)[: math.ceil(len(rows) / 2)]
    assert sorted((r.gumbel for r in rows if r.selected), reverse=True) == chosen


def test_target_like_texts_weigh_more(spark):
    rows = [(i, " ".join(("tide pool shore" if i % 2 else "scrap rust heap").split() * 5)) for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = importance.resample(df, df.where("doc_id % 2 = 1").selectExpr("doc_id as id")).collect()
    assert min(r.log_weight for r in out if r.id % 2) > max(r.log_weight for r in out if not r.id % 2)
    assert np.mean([r.id % 2 for r in out if r.selected]) > 0.9


def test_kth_largest(spark):
    values = [5.0, 1.0, 1.0, -3.5, 1e9, 1.0, 1.0000000000000002]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    for k in range(1, len(values) + 1):
        assert importance.kth_largest(df, "x", k) == sorted(values, reverse=True)[k - 1]
    assert importance.kth_largest(df.limit(0), "x", 1) == math.inf


def test_odd_rows(spark):
    rows = [(1, None, 0), (2, "", 0), (None, "a b", 0), (3, "a b", 0), (3, "a b", 0), (4, "w " * 200_000, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, selected int")
    none = spark.createDataFrame([], "id long")
    out = importance.resample(df, none).collect()
    assert len(out) == 6 and {r.log_weight for r in out if r.id in (1, 2)} == {0.0}
    assert sum(r.selected for r in out) >= 3
    assert importance.resample(df.limit(0), none).count() == 0
