import random
import re
from itertools import combinations

import numpy as np
import xxhash

from tidepool.llm import queries, simhash


def plain_fingerprint(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(rows):
    """rows: (id, fingerprint)."""
    root = {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for (i, a), (j, b) in combinations(rows, 2):
        if (a ^ b).bit_count() <= 4:
            x, y = sorted((find(i), find(j)))
            root[y] = x
    return {i: find(i) for i, _ in rows}


def test_triples_cover_every_four_positions():
    triples = simhash.triples()
    assert len(triples) == 20
    assert all(any(set(t) <= set(four) for t in triples) for four in combinations(range(8), 4))


def test_forest_and_blocks_lose_no_link(spark):
    rng = random.Random(3)
    base = rng.getrandbits(64)
    prints = {base}
    while len(prints) < 400:
        x = rng.choice(sorted(prints)) if rng.random() < 0.7 else rng.getrandbits(64)
        for _ in range(rng.randint(0, 5)):
            x ^= 1 << rng.randrange(64)
        prints.add(x)
    rows = sorted(enumerate(sorted(prints)))
    want = plain_components(rows)
    signed = {i: int(np.array(p, np.uint64).view(np.int64)) for i, p in rows}
    nodes = spark.createDataFrame([(p,) for p in signed.values()], "fp long")
    for block in (2048, 16):
        roots = {r.u: r.v for r in simhash.connected(simhash.edges(nodes, block=block)).collect()}
        groups = {}
        for i, p in signed.items():
            groups.setdefault(roots.get(p, p), set()).add(i)
        expected = {}
        for i, r in want.items():
            expected.setdefault(r, set()).add(i)
        assert sorted(map(sorted, groups.values())) == sorted(map(sorted, expected.values()))


def test_query_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    rows = [(r.doc_id, plain_fingerprint(r.text)) for r in docs]
    want = plain_components(rows)
    got = queries.op10_simhash(spark, sf).collect()
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in got} == {i: (f"{p:016x}", want[i]) for i, p in rows}


def test_odd_rows(spark):
    long = " ".join(f"w{i}" for i in range(50_000))
    rows = [(1, None, "x"), (2, "", "y"), (3, " \t\n", None), (4, "a b", "s"), (5, "A  B", "s"), (6, long, "s"), (7, long, "s"), (7, long, "s"), (9, "twice told tales here", "p"), (9, "twice told tales here", "q"), (None, "lonely words stand here", "s"), (8, "é à ü", "s")]
    df = spark.createDataFrame(rows, "doc_id long, text string, component string")
    got = {(r.id, r.component) for r in simhash.near_duplicates(df).collect()}
    assert got == {(1, 1), (2, 1), (3, 1), (4, 4), (5, 4), (6, 6), (7, 6), (None, None), (8, 8), (9, 9)}
    kept = simhash.deduplicate(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 4, 6, 8, 9]
    assert simhash.near_duplicates(df.limit(0)).count() == 0


def test_fingerprint_matches_plain():
    for text in ("", "a", "One two THREE", "a b c d", "a b c d e f g " * 9, "Ä ö ü ß x y"):
        assert simhash.fingerprint(text) == plain_fingerprint(text)
