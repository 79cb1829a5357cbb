import hashlib
import math
import re

import duckdb
import pytest

from tidepool.llm import mixing, queries


def share(sizes, weights=(1, 2, 3), most=3):
    """Reshare round by round. sizes: in the order of the sources."""
    w = [weights[i % len(weights)] for i in range(len(sizes))]
    capped, total = set(), sum(sizes)
    while True:
        free = sum(x for i, x in enumerate(w) if i not in capped)
        rest = total - sum(most * sizes[i] for i in capped)
        out = [most * s if i in capped else (w[i] * rest / free if free else 0) for i, s in enumerate(sizes)]
        over = {i for i in range(len(sizes)) if i not in capped and out[i] > most * sizes[i]}
        if not over:
            return out
        capped |= over


@pytest.mark.parametrize("sizes", [[100, 100, 100], [1, 1, 1000], [0, 5, 7, 1, 90, 3, 3], [7], [0, 0], [1] * 9 + [500]])
def test_targets_against_rounds(spark, sizes):
    df = spark.createDataFrame([(False, f"s{i:02}", n) for i, n in enumerate(sizes)], "none boolean, name string, size long")
    got = [r.num / r.den for r in mixing.targets(df).orderBy("name").collect()]
    assert all(math.isclose(a, b, abs_tol=1e-9) for a, b in zip(got, share(sizes), strict=True))


def test_query_against_sql_and_brute_force(spark, sf):
    got = sorted(tuple(r) for r in queries.op5_mixing(spark, sf).collect())
    assert got == sorted(tuple(r) for r in queries.op5_mixing(spark, sf).collect())
    c = duckdb.connect()
    c.sql(f"create view documents as select * from '{sf}/documents.parquet'")
    assert got == sorted(c.sql(mixing.SQL).fetchall())
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    size = {r.doc_id: len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for r in docs}
    sources = sorted({r.source for r in docs})
    target = dict(zip(sources, share([sum(size[r.doc_id] for r in docs if r.source == s) for s in sources]), strict=True))
    signs = lambda t: sum(c in mixing.SIGNS for c in t)
    q = {r.doc_id: 16 - min(15, 60 * signs(r.text) // len(r.text)) if r.text else 1 for r in docs}
    u = {i: (int(hashlib.md5(f"mix:{i}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52 for i in size}
    taken = {r[0]: r[4] for r in got}
    for s in sources:
        own = sorted((-math.log(u[r.doc_id]) / q[r.doc_id], r.doc_id) for r in docs if r.source == s)
        whole = sum(size[i] for _, i in own)
        epochs, left = (divmod(int(target[s] + 1e-9), whole)) if whole else (0, 0)
        for _, i in own:
            part = min(size[i], left)
            assert taken[i] == epochs * size[i] + part
            left -= part
        assert abs(sum(taken[i] for _, i in own) - target[s]) < 1


def test_odd_rows(spark):
    rows = [(1, None, "a", 1.5), (2, "", "b", 1.5), (3, "x y z", None, 1.5), (None, "q r", "a", 1.5), (4, "w " * 300_000, "b", 1.5), (4, "w " * 300_000, "b", 1.5), (5, "one", "", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, target double")
    out = mixing.mix(df)
    assert out.columns == ["doc_id", "text", "source", "size", "source_size", "target", "taken"]
    got = out.collect()
    assert len(got) == 7
    assert sorted(r.size for r in got) == [0, 0, 1, 2, 3, 300_000, 300_000]
    assert all(0 <= r.taken <= 3 * r.size for r in got)
    assert {r.target for r in got if r.source is None} == {9.0}
    assert mixing.mix(df.limit(0)).count() == 0


def test_ends_by_narrowing(spark):
    rows = [(False, "a", i, i % 97, 1 + i % 5, ((i * 7919) % 1000 + 1) / 100) for i in range(1500)] + [(True, "", None, i % 40, 3, 0.5) for i in range(400)] + [(False, "b", 1, 1, 0, 1.0)]
    df = spark.createDataFrame(rows, "none boolean, name string, id long, tie long, size long, key double")
    for budget in (1, 700, 1199):
        left = spark.createDataFrame([(False, "a", budget), (True, "", budget), (False, "b", 0)], "none boolean, name string, left long")
        got = {r.name: r for r in mixing.ends(df, left, 10).collect()}
        assert got.keys() == {"a", ""}
        for none, name in ((False, "a"), (True, "")):
            own, total = sorted((k, -1 if i is None else i, t, s) for n, m, i, t, s, k in rows if (n, m) == (none, name)), 0
            at = next(j for j in range(len(own)) if sum(x[3] for x in own[: j + 1]) > budget)
            first = next(j for j, x in enumerate(own) if x[:3] == own[at][:3])
            total = sum(x[3] for x in own[:first])
            r = got[name]
            assert (r.k, -1 if r.i is None else r.i, r.t, r.rest, r.copies) == (*own[at][:3], budget - total, sum(x[:3] == own[at][:3] for x in own))
