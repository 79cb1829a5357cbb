"""Every registered query against its SQL in DuckDB."""

import math
import os

import duckdb
import pytest

from tidepool.plans import PLANS

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
KINDS = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "timestamp": "TIMESTAMP", "timestamp_ntz": "TIMESTAMP", "date": "DATE"}


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for t in TABLES:
        at = f"{sf}/{t}.parquet"
        c.sql(f"create view {t} as select * from '{at + '/*.parquet' if os.path.isdir(at) else at}'")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    return v


@pytest.mark.parametrize("name", sorted(PLANS))
def test_query(name, spark, sf, duck):
    p = PLANS[name]
    df = p(spark, sf)
    columns = sorted(df.columns)
    rows = sorted(repr(tuple(plain(r[c]) for c in columns)) for r in df.collect())
    assert rows
    if p.sql:
        want = duck.sql(p.sql)
        kinds = dict(zip(want.columns, map(str, want.types), strict=True))
        assert sorted(kinds) == columns
        assert {c: KINDS.get(k, k) for c, k in df.dtypes} == kinds
        order = sorted(range(len(columns)), key=lambda i: want.columns[i])
        assert rows == sorted(repr(tuple(plain(r[i]) for i in order)) for r in want.fetchall())
