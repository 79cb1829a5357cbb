"""Edge cases that the tables don't have: ties, order, signs, clamps, bytes and empty input."""

import datetime as dt
import hmac
import re

import pytest
from pyspark.sql import functions as F

from tidepool.functions import arrays, bits, checks, codec, dates, geo, jsons, maps, maths, strings, vectors
from tidepool.functions.scripts import Functions, Pipeline
from tidepool.operators import aggregates, graph, joins, kv, ml, ranked, sets, sketches, state, streams, windows
from tidepool.session import configure
from tidepool.sources import files, oplog


@pytest.fixture(scope="module")
def one(spark):
    configure(spark)
    return lambda *columns: tuple(spark.range(1).select(*columns).first())


def test_downsample_takes_all_of_a_bucket(spark):
    df = spark.createDataFrame([("s", dt.datetime(1970, 1, 1) + dt.timedelta(seconds=s), v, i) for i, (s, v) in enumerate([(0, 1.0), (30, 3.0), (60, 2.0), (90, 8.0)])], "k string, ts timestamp, v double, i long")
    got = windows.downsample(df, "k", "ts", "v", 60, "i").orderBy("bucket").collect()
    assert [(r.mean, r.first, r.last, r.n) for r in got] == [(2.0, 1.0, 3.0, 2), (5.0, 2.0, 8.0, 2)]


def test_last_n(spark):
    df = spark.createDataFrame([("k", i, float(i)) for i in range(1, 6)], "k string, i int, v double")
    assert [r.last_sum for r in windows.last_n(df, "k", ["i"], "v", 3, "sum").orderBy("i").collect()] == [1, 3, 6, 9, 12]


def test_ties_go_to_the_first_item(spark):
    df = spark.createDataFrame([(x,) for x in "bbaac"], "x string")
    assert [tuple(r) for r in ranked.frequencies(df, "x", 1).collect()] == [("a", 2)]


def test_weighted_union_and_intersection(spark):
    a = spark.createDataFrame([("x", 1.0), ("y", 2.0)], "m string, s double")
    b = spark.createDataFrame([("y", 3.0), ("z", 4.0)], "m string, s double")
    union = {r.m: r.s for r in ranked.combine([(a, 2.0), (b, 3.0)], "m", "s").collect()}
    assert union == {"x": 2, "y": 13, "z": 12}
    assert {r.m: r.s for r in ranked.combine([(a, 2.0), (b, 3.0)], "m", "s", inner=True).collect()} == {"y": 13}


def test_histogram_edges(spark):
    df = spark.createDataFrame([("k", v) for v in (-1.0, 0.0, 2.9, 3.0, 10.0, 11.0)], "k string, v double")
    assert {r.bucket: r.n for r in sketches.histogram(df, ["k"], "v", 0.0, 10.0, 3.0).collect()} == {-1: 1, 0: 2, 1: 1, 3: 2}


def test_difference_keeps_repeats(one):
    a, b = F.array(F.lit(1), F.lit(1), F.lit(2)), F.array(F.lit(2))
    assert one(arrays.diff(a, b))[0] == [1, 1]


def test_stream_ids_are_numbers(spark):
    df = spark.createDataFrame([(9, 0), (10, 0)], "ms long, seq long")
    assert [r.ms for r in streams.after(df, 9, 0).collect()] == [10]
    assert [r[0] for r in df.orderBy("ms").select(streams.entry_id(F.col("ms"), F.col("seq"))).collect()] == ["9-0", "10-0"]


def test_months_clamp_and_weeks_begin_on_sunday(one):
    ts = F.lit("2024-01-31 10:00:00").cast("timestamp")
    got = one(dates.add(ts, "month", 1), dates.start_of(ts, "week"), dates.end_of(ts, "day"), dates.diff(ts, dates.add(ts, "days", 2), "hour"))
    assert got == (dt.datetime(2024, 2, 29, 10), dt.datetime(2024, 1, 28), dt.datetime(2024, 1, 31, 23, 59, 59), 48)


def test_bytes_and_slices(one):
    s = F.lit("Ouè")
    assert one(strings.strlen(s), strings.slice_(s, -2, -1), strings.pad_left(s, 2, "*"), strings.title(F.lit("ÉCOLE")), strings.replace(F.lit("a.a.a"), ".", "-", 1), strings.trim(F.lit("xxaxx"), "x")) == (4, "uè", "Ouè", "École", "a-a.a", "a")
    assert one(strings.slice_(s, 2, 1), strings.truncate(F.lit("abcdef"), 5), strings.last_index(F.lit("abab"), "ab"), strings.index(F.lit("x"), "y")) == ("", "ab...", 2, -1)
    assert one(strings.lcs_length(F.lit("AGGTAB"), F.lit("GXTXAYB")))[0] == 4


def test_last_of_equal_keys_wins(one):
    m = F.create_map(F.lit("a"), F.lit(1), F.lit("b"), F.lit(1))
    assert one(maps.merge(m, F.create_map(F.lit("a"), F.lit(2))))[0] == {"a": 2, "b": 1}
    assert one(maps.clock_compare(F.create_map(F.lit("n"), F.lit(1)), F.create_map(F.lit("n"), F.lit(2))))[0] == "before"


def test_division_truncates(one):
    assert one(maths.div(F.lit(7), F.lit(-2)), maths.mod(F.lit(-7), F.lit(3)), maths.div(F.lit(1), F.lit(0))) == (-3, -1, None)
    assert one(maths.evaluate("2 + 3 * 2 ^ 3"))[0] == 26


@pytest.mark.parametrize("algorithm", ["md5", "sha1", "sha256", "sha384", "sha512"])
@pytest.mark.parametrize("key", ["k", "long" * 50])
def test_hmac(one, algorithm, key):
    assert one(codec.hmac(key, F.lit("Ouè"), algorithm))[0] == hmac.new(key.encode(), "Ouè".encode(), algorithm).hexdigest()


def test_codecs(one):
    assert one(codec.rle_encode(F.lit("aaab")), codec.rle_decode(F.lit("3a1b12c"))) == ("3a1b", "aaab" + "c" * 12)
    assert bytes(one(codec.bson("k", F.lit("v")))[0]) == b"\x0e\0\0\0\x02k\0\x02\0\0\0v\0\0"
    for n in (5, 40, 300, 70_000):
        text = F.repeat(F.lit("x"), F.lit(n))
        assert one(F.length(codec.msgpack_decode(codec.msgpack(text))), F.length(codec.cbor_decode(codec.cbor(text)))) == (n, n)
    assert one(codec.unpair(F.lit("k: a: b"), "yaml"))[0].value == "a: b"


def test_bits(one):
    b = F.lit(bytearray(b"\x80\x01"))
    assert one(bits.get(b, 0), bits.get(b, 15), bits.get(b, 99), bits.count(b), bits.count(b, -0, 0), bits.position(b, 0)) == (1, 1, 0, 2, 1, 1)
    assert bytes(one(bits.set_(b, 23, 1))[0]) == b"\x80\x01\x01"
    assert bytes(one(bits.combine(b, F.lit(bytearray(b"\xff")), "XOR"))[0]) == b"\x7f\x01"
    assert bytes(one(bits.invert(b))[0]) == b"\x7f\xfe" and one(bits.field(b, 0, 8, signed=True))[0] == -128


def test_json_edits(one):
    doc = F.lit('{"a":{"b":[1,2]},"n":2}')
    assert one(jsons.set_(doc, "$.a.b[1]", 9), jsons.delete(doc, "$.a"), jsons.add_number(doc, "$.n", 1), jsons.append_array(doc, "$.a.b", 3)) == ('{"a":{"b":[1,9]},"n":2}', '{"n":2}', '{"a":{"b":[1,2]},"n":3}', '{"a":{"b":[1,2,3]},"n":2}')
    assert one(jsons.set_(F.lit("not json"), "$.a", 1), jsons.delete(doc, "$.x.y"), jsons.type_(doc, "$.a.b"), jsons.type_(doc, "$.n")) == (None, '{"a":{"b":[1,2]},"n":2}', "array", "number")
    assert one(checks.valid(F.lit('{"a":1}'), "json"), checks.valid(F.lit('{"a":1}}'), "json"), checks.valid(F.lit(""), "json"), checks.valid(F.lit("1,2"), "json")) == (True, False, False, False)


def test_geo(one):
    paris, london = (F.lit(48.8566), F.lit(2.3522)), (F.lit(51.5074), F.lit(-0.1278))
    assert abs(one(geo.distance(*paris, *london))[0] - 343.5) < 1
    assert one(geo.geohash(F.lit(57.64911), F.lit(10.40744), 11))[0] == "u4pruydqqvj"
    assert one(F.lit(True), geo.distance(F.lit(0.0), F.lit(179.9), F.lit(0.0), F.lit(-179.9)) < 30)[1]


def test_vectors(one):
    v = F.array(F.lit(3.0), F.lit(4.0))
    assert one(vectors.norm(v), vectors.cosine(v, v), vectors.cosine(v, F.array(F.lit(0.0), F.lit(0.0))), vectors.normalize(v)) == (5.0, 1.0, 0.0, [0.6, 0.8])
    m = F.array(*[F.lit(float(i)) for i in range(1, 7)])
    assert one(vectors.matmul(m, m, 2, 3, 2))[0] == [22.0, 28.0, 49.0, 64.0]


def test_queue_stack_and_underflow(spark):
    ops = ["pop", "push", "push", "pop", "push", "pop", "pop", "pop", "push"]
    log = spark.createDataFrame([("q", i, o) for i, o in enumerate(ops)], "k string, seq int, op string")
    assert [r.seq for r in state.queue(log, "k", "op", "seq").collect()] == [8]
    log = spark.createDataFrame([("q", i, o) for i, o in enumerate(["pop", "push", "push", "push", "pop"])], "k string, seq int, op string")
    assert sorted(r.seq for r in state.queue(log, "k", "op", "seq").collect()) == [2, 3]
    assert sorted(r.seq for r in state.stack(log, "k", "op", "seq").collect()) == [1, 2]


def test_queue_and_stack_against_a_fold(spark):
    import random

    rng = random.Random(2)
    log = [(k, i, rng.choice(["push", "push", "pop"])) for k in "ab" for i in range(200)]
    queues, stacks = {"a": [], "b": []}, {"a": [], "b": []}
    for k, i, op in log:
        for held, at in ((queues[k], 0), (stacks[k], -1)):
            if op == "push":
                held.append(i)
            elif held:
                held.pop(at)
    df = spark.createDataFrame(log, "k string, seq int, op string")
    for fold, want in ((state.queue, queues), (state.stack, stacks)):
        got = {}
        for r in fold(df, "k", "op", "seq").collect():
            got.setdefault(r.k, []).append(r.seq)
        assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items() if v}


def test_state_machine_over_chunks(spark, monkeypatch):
    monkeypatch.setattr(state, "CHUNK", 3)
    moves = {("a", "x"): "b", ("b", "x"): "c", ("c", "x"): "a", ("b", "y"): "a"}
    events = ["x", "x", "?", "x", "x", "y", "x", "x", "x"]
    now, want = "a", []
    for e in events:
        now = moves.get((now, e), now)
        want.append(now)
    log = spark.createDataFrame([("m", i, e) for i, e in enumerate(events)], "k string, seq int, e string")
    assert [r.state for r in state.machine(log, "k", "e", "seq", moves, "a").orderBy("seq").collect()] == want


def test_limits(spark):
    at = lambda *s: spark.createDataFrame([("k", i, dt.datetime(2024, 1, 1) + dt.timedelta(seconds=x)) for i, x in enumerate(s)], "k string, i int, ts timestamp")
    assert [r.allowed for r in state.token_bucket(at(0, 1, 2, 3, 14), "k", "ts", "i", 2.0, 0.1).orderBy("i").collect()] == [True, True, False, False, True]
    assert [r.allowed for r in state.cooled_down(at(0, 5, 10, 12), "k", "ts", "i", 10).orderBy("i").collect()] == [True, False, True, False]
    calls = at(0, 1, 2, 30, 31).withColumn("bad", F.col("i") < 2)
    assert [r.state for r in state.circuit(calls, "k", "ts", "i", "bad", 2, 20).orderBy("i").collect()] == ["closed", "open", "open", "closed", "closed"]
    assert [r.i for r in state.debounced(at(0, 1, 2, 30), "k", "ts", "i", 10).orderBy("i").collect()] == [2, 3]
    asks = at(0, 1, 2, 100).withColumn("who", F.when(F.col("i") == 1, "b").otherwise("a"))
    assert [r.granted for r in state.leases(asks, "k", "who", "ts", 10, "i").orderBy("i").collect()] == [True, False, True, True]


def test_counter_reset_and_registry(spark):
    log = spark.createDataFrame([("c", 1, 5, False), ("c", 2, 0, True), ("c", 3, 2, False), ("d", 1, 4, False)], "k string, seq int, d int, r boolean")
    assert {r.k: r.value for r in aggregates.counter(log, "k", F.col("d"), "seq", F.col("r")).collect()} == {"c": 2, "d": 4}
    ops = spark.createDataFrame([("a", 1, "create"), ("a", 2, "delete"), ("b", 1, "set"), ("b", 2, "get")], "k string, seq int, op string")
    assert [r.k for r in state.registry(ops, "k", "op", "seq").collect()] == ["b"]


def test_keys(spark):
    assert kv.glob("a*b?[c-e].") == r"^(?s:a.*b.[c-e]\.)$" and kv.glob("[!x]\\*") == r"^(?s:[^x]\*)$"
    df = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    assert sorted(map(tuple, kv.rename(df, "k", "a", "b").collect())) == [("b", 1)]
    assert sorted(map(tuple, kv.rename(df, "k", "x", "b").collect())) == [("a", 1), ("b", 2)]
    assert sorted(map(tuple, kv.copy(df, "k", "a", "b", replace=False).collect())) == [("a", 1), ("b", 2)]


def test_sets_and_joins(spark):
    frames = [spark.createDataFrame([(x,) for x in xs], "m int") for xs in ((1, 2, 3, 3), (2, 3), (3, 4))]
    assert sorted(r.m for r in sets.intersection(frames, "m").collect()) == [3]
    assert sorted(r.m for r in sets.union(frames, "m").collect()) == [1, 2, 3, 4]
    left = spark.createDataFrame([("k", 1), ("k", 5), ("j", 5)], "k string, t int")
    right = spark.createDataFrame([("k", 1, 10), ("k", 4, 40), ("k", 4, 41)], "k string, at int, v int")
    got = {(r.k, r.t): r.right_v for r in joins.as_of(left, right, "k", "t", "at", "v").collect()}
    assert got == {("k", 1): 10, ("k", 5): 41, ("j", 5): None}


def test_graph_levels_leave_cycles_out(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "c"), ("x", "y"), ("y", "x")], "src string, dst string")
    assert {r.node: r.level for r in graph.levels(e).collect()} == {"a": 0, "b": 1, "c": 2}


def test_baskets_cut_into_parts_lose_no_pair(spark):
    rows = [("b1", i) for i in range(9)] + [("b2", i) for i in (1, 2)]
    df = spark.createDataFrame(rows, "b string, i int")
    for most in (100, 3):
        got = {(r.a, r.b): r.n for r in ml.together(df, "b", "i", 1, most).collect()}
        assert len(got) == 36 and got[1, 2] == 2


def test_command_files(spark, tmp_path):
    commands = [[b"SET", b"k", b"v\r\n*1"], [b"DEL", b"k"]]
    data = b"".join(map(oplog.encode, commands))
    assert oplog.parse(data) == commands and oplog.parse(data + b"*2\r\n$3\r\nSE") == commands and oplog.parse(b"") == []
    (tmp_path / "a.aof").write_bytes(data)
    assert [(r.seq, r.op, bytes(r.args[0])) for r in oplog.read(spark, str(tmp_path)).orderBy("seq").collect()] == [(0, "SET", b"k"), (1, "DEL", b"k")]
    with pytest.raises(ValueError):
        files.read(spark, str(tmp_path), "xlsx")


def test_scripts_and_pipelines(spark):
    fns = Functions(spark)
    fns.load("tp_add", "a INT, b INT", "INT", "a + b")
    assert spark.range(1).select(F.expr("tp_add(1, 2)")).first()[0] == 3
    fns.delete("tp_add")
    p = Pipeline("p").add("double", lambda df: df.withColumn("id", F.col("id") * 2))
    p.before.append(lambda df: df.where("id > 0"))
    assert [r.id for r in p(spark.range(3)).orderBy("id").collect()] == [2, 4]


def test_bloom_has_few_false_positives(spark):
    size, hashes = sketches.bloom_size(1000, 0.01)
    words = sketches.bloom(spark.range(1000), "id", size, hashes)
    inside = sketches.bloom_contains(spark.range(1000), "id", words, size, hashes).where("maybe").count()
    outside = sketches.bloom_contains(spark.range(10_000, 20_000), "id", words, size, hashes).where("maybe").count()
    assert inside == 1000 and outside < 300


def test_places_across_the_date_line_and_at_the_poles(spark):
    import math
    import random

    from tidepool.operators import geo

    rng = random.Random(5)
    spots = [(rng.uniform(-90, 90), rng.uniform(-180, 180)) for _ in range(150)] + [(0.0, 179.9), (0.0, -179.9), (89.9, 10.0), (89.9, -170.0), (-89.99, 0.0), (-89.0, 179.0), (45.0, 180.0), (45.0, -180.0)]
    df = spark.createDataFrame([(i, *x) for i, x in enumerate(spots)], "member int, lat double, lon double")

    def apart(a, b):
        (y1, x1), (y2, x2) = ((math.radians(v) for v in p) for p in (a, b))
        return 12742 * math.asin(math.sqrt(min(1, math.sin((y2 - y1) / 2) ** 2 + math.cos(y1) * math.cos(y2) * math.sin((x2 - x1) / 2) ** 2)))

    for km in (30.0, 800.0, 6000.0):
        got = {(r.a_member, r.b_member) for r in geo.pairs_within(df, df, km).collect()}
        assert got == {(i, j) for i, a in enumerate(spots) for j, b in enumerate(spots) if apart(a, b) <= km}
        for lat, lon in ((0.0, 179.99), (89.5, 0.0), (-60.0, -179.0)):
            assert {r.member for r in geo.radius(df, lat, lon, km).collect()} == {i for i, a in enumerate(spots) if apart(a, (lat, lon)) <= km}


def test_pairs_of_crowded_places_broadcast_no_places(spark, tmp_path, monkeypatch):
    """The size that Spark estimates leaves out that each of b's rows is repeated for nine cells, so a broadcast of them could fill the driver."""
    from tidepool.operators import geo

    spots = [(0.0, 179.9), (0.0, -179.9), (40.0, 20.0)]
    rows = [(i, None if i % 50 == 0 else "x", *spots[i % 3]) for i in range(150)] + [(1, "x", *spots[1])] * 3
    spark.createDataFrame(rows, "member int, name string, lat double, lon double").write.parquet(f"{tmp_path}/spots")
    df = spark.read.parquet(f"{tmp_path}/spots")
    want = sorted(repr((*a, *b)) for a in rows for b in rows if (a[2] == 0) == (b[2] == 0))
    for most in (4096, 20):
        monkeypatch.setattr(geo, "CELL_ROWS", most, raising=False)
        got = geo.pairs_within(df, df, 100.0)
        lines = got._jdf.queryExecution().executedPlan().toString().splitlines()
        depths = [re.search(r"\w", x).start() if re.search(r"\w", x) else 0 for x in lines]
        for i, x in enumerate(lines):
            if "BroadcastExchange" in x:
                below = next((j for j in range(i + 1, len(lines)) if depths[j] <= depths[i]), len(lines))
                assert not any("Generate explode" in y for y in lines[i:below])
        assert got.columns == [f"{side}_{c}" for side in "ab" for c in df.columns] + ["distance"]
        assert sorted(repr(tuple(r)[:-1]) for r in got.collect()) == want


def test_hash_tree_has_one_root_over_all_nodes(spark, tmp_path):
    """Also over more nodes than one node has rows, of negative keys and keys beyond 2^53, and of nulls."""
    import duckdb

    from tidepool.plans import PLANS

    far = 1024 * 1024 + 5
    for i, rows in enumerate((
        [(0, "a"), (1, "b"), (1023, "c"), (1024, "d"), (far - 1024, "e"), (far, "f"), (2 * far, None), (2 * far + 1, "g")],
        [(7, "a"), (6, None)],
        [(-1, "a"), (-1024, "b"), (-5000, "c")],
        [(2**60 - 1, "a"), (2**60, "b"), (2**60 + 1, "c")],
        [(None, "a"), (3, "b"), (5000, None)],
        [(None, "a")],
        [],
    )):
        at = f"{tmp_path}/{i}"
        spark.createDataFrame(rows, "p_partkey bigint, p_name string").coalesce(1).write.parquet(f"{at}/part.parquet")
        c = duckdb.connect()
        c.sql(f"create view part as select * from '{at}/part.parquet/*.parquet'")
        got = PLANS["merkle_root"](spark, at)
        assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, c.sql(PLANS["merkle_root"].sql).fetchall())), rows
        assert got.dtypes == [("level", "int"), ("node", "bigint"), ("hash", "string")]
