import random
from itertools import combinations

import corpus_pipeline
from tidepool.llm import jaccard, simhash


def plain_set(text):
    words = (text or "").lower().split()
    return {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def components(texts):
    """By all links: Jaccard at 0.8 or more, or 4 bits of SimHash."""
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    sets, prints = [plain_set(t) for t in texts], [simhash.fingerprint(t) for t in texts]
    for i, j in combinations(range(len(texts)), 2):
        both = len(sets[i] & sets[j])
        if (both and 5 * both >= 4 * len(sets[i] | sets[j])) or (prints[i] ^ prints[j]).bit_count() <= 4:
            a, b = sorted((find(i), find(j)))
            root[b] = a
    return [find(i) for i in range(len(texts))]


def test_near_copies_go_against_brute_force(spark):
    rng = random.Random(5)
    texts = []
    for _ in range(25):
        words = [f"w{rng.randrange(10_000)}" for _ in range(rng.randint(20, 300))]
        texts.append(" ".join(words))
        for _ in range(rng.randint(0, 4)):  # copies of copies, so that chains drift below 0.8 of the first
            words = list(words)
            for _ in range(max(1, len(words) // rng.choice((25, 50, 100)))):
                words[rng.randrange(len(words))] = f"x{rng.randrange(10_000)}"
            texts.append(" ".join(words))
    texts += ["", None, "a b", "A  b", texts[0]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = components(texts)
    for block in (jaccard.BLOCK, 2):
        assert {r.id: r.component for r in jaccard.near_duplicates(df, block=block).collect()} == dict(enumerate(want))
    kept = {r.doc_id for r in corpus_pipeline.remove_near_duplicates(spark, df, "").collect()}
    assert kept == {i for i, r in enumerate(want) if i == r}
    assert len(kept) < simhash.deduplicate(df).count()


def test_odd_rows(spark):
    rows = [(1, "twice told tales here", "p"), (1, "twice told tales here", "q"), (None, "lonely words stand here", "s"), (2, None, None), (3, "", "s")]
    df = spark.createDataFrame(rows, "doc_id long, text string, component string")
    kept = jaccard.deduplicate(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 2]
    assert jaccard.deduplicate(df.limit(0)).count() == 0
