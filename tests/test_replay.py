"""The keyspace against a plain interpreter of the same commands."""

import random
import re

import pytest

from tidepool.operators import replay


def interpret(commands):
    s, h, m, z, ls = {}, {}, {}, {}, {}
    for op, *a in commands:
        if op in ("DEL", "FLUSHALL"):
            for d in (s, h, m, z, ls):
                for k in list(d) if op == "FLUSHALL" else a:
                    d.pop(k, None)
        elif op == "SET":
            s[a[0]] = a[1]
        elif op == "SETNX":
            s.setdefault(*a)
        elif op == "MSET":
            s.update(zip(a[::2], a[1::2], strict=True))
        elif op == "INCRBY":
            if re.fullmatch("-?[0-9]{0,18}", s.get(a[0], "")) and s.get(a[0]) != "-":
                s[a[0]] = str(int(s.get(a[0]) or "0") + int(a[1]))
        elif op == "APPEND":
            s[a[0]] = s.get(a[0], "") + a[1]
        elif op == "HSET":
            h.setdefault(a[0], {}).update(zip(a[1::2], a[2::2], strict=True))
        elif op == "HDEL":
            for f in a[1:]:
                h.get(a[0], {}).pop(f, None)
        elif op == "HINCRBY":
            d = h.setdefault(a[0], {})
            d[a[1]] = str(int(d.get(a[1], "0")) + int(a[2]))
        elif op in ("SADD", "SREM"):
            (set.update if op == "SADD" else set.difference_update)(m.setdefault(a[0], set()), a[1:])
        elif op == "ZADD":
            z.setdefault(a[0], {}).update((y, float(x)) for x, y in zip(a[1::2], a[2::2], strict=True))
        elif op == "ZREM":
            for x in a[1:]:
                z.get(a[0], {}).pop(x, None)
        elif op == "ZINCRBY":
            d = z.setdefault(a[0], {})
            d[a[2]] = d.get(a[2], 0.0) + float(a[1])
        elif op == "RPUSH":
            ls.setdefault(a[0], []).extend(a[1:])
        elif op == "LPUSH":
            ls[a[0]] = [*reversed(a[1:]), *ls.get(a[0], [])]
    return s, h, m, z, ls


def commands(rng, n):
    key, x = lambda: rng.choice("abc"), lambda: rng.choice("pqrs")
    num = lambda: str(rng.randint(-5, 9))
    kinds = [
        lambda: ("SET", "s" + key(), num()),
        lambda: ("SETNX", "s" + key(), num()),
        lambda: ("MSET", "sa", num(), "sd", num()),
        lambda: ("INCRBY", "s" + key(), num()),
        lambda: ("APPEND", "s" + key(), rng.choice(["7", "1", "x"])),
        lambda: ("HSET", "h" + key(), x(), num(), "t", num()),
        lambda: ("HDEL", "h" + key(), x()),
        lambda: ("HINCRBY", "h" + key(), x(), num()),
        lambda: ("SADD", "m" + key(), x(), x()),
        lambda: ("SREM", "m" + key(), x()),
        lambda: ("ZADD", "z" + key(), num(), x(), num(), "t"),
        lambda: ("ZREM", "z" + key(), x()),
        lambda: ("ZINCRBY", "z" + key(), num(), x()),
        lambda: ("RPUSH", "l" + key(), x(), num()),
        lambda: ("LPUSH", "l" + key(), x(), num()),
        lambda: ("DEL", rng.choice("shmzl") + key(), rng.choice("shmzl") + key()),
    ]
    return [rng.choice(kinds)() for _ in range(n)]


def test_replay_against_an_interpreter(spark):
    rng = random.Random(11)
    ran = commands(rng, 150) + [("FLUSHALL",)] + commands(rng, 150)
    log = spark.createDataFrame([(i, c[0], [a.encode() for a in c[1:]]) for i, c in enumerate(ran)], "seq long, op string, args array<binary>")
    s, h, m, z, ls = interpret(ran)
    assert {r.key: r.value for r in replay.strings(log).collect()} == s
    assert {(r.key, r.field): r.value for r in replay.hashes(log).collect()} == {(k, f): v for k, d in h.items() for f, v in d.items()}
    assert {(r.key, r.member) for r in replay.sets(log).collect()} == {(k, x) for k, d in m.items() for x in d}
    assert {(r.key, r.member): r.score for r in replay.ranked_sets(log).collect()} == {(k, x): v for k, d in z.items() for x, v in d.items()}
    got = {}
    for r in replay.lists(log).orderBy("key", "pos").collect():
        got.setdefault(r.key, []).append(r.value)
    assert got == ls


def run(state, op, *a):
    """One command on {key: value}; values are text, dict, set, or list. False if it wouldn't take effect."""
    if op == "FLUSHALL":
        state.clear()
    elif op in ("DEL", "UNLINK"):
        if not any(k in state for k in a):
            return False
        for k in a:
            state.pop(k, None)
    elif op == "RENAME":
        if a[0] not in state:
            return False
        state[a[1]] = state.pop(a[0])
    elif op == "RENAMENX":
        if a[0] not in state or a[1] in state:
            return False
        state[a[1]] = state.pop(a[0])
    elif op == "SET":
        state[a[0]] = a[1]
    elif op == "MSET":
        state.update(zip(a[::2], a[1::2], strict=True))
    elif op == "APPEND":
        if not isinstance(state.get(a[0], ""), str):
            return False
        state[a[0]] = state.get(a[0], "") + a[1]
    elif op in ("HSET", "HSETNX"):
        h = state.get(a[0], {})
        if not isinstance(h, dict) or op == "HSETNX" and a[1] in h:
            return False
        state[a[0]] = {**h, a[1]: a[2]}
    elif op == "SADD":
        m = state.get(a[0], set())
        if not isinstance(m, set):
            return False
        state[a[0]] = m | {a[1]}
    elif op == "SMOVE":
        m, to = state.get(a[0]), state.get(a[1], set())
        if not isinstance(m, set) or a[2] not in m or len(m) < 2 or not isinstance(to, set) or a[0] == a[1]:
            return False
        state[a[0]], state[a[1]] = m - {a[2]}, to | {a[2]}
    elif op == "RPUSH":
        v = state.get(a[0], [])
        if not isinstance(v, list):
            return False
        state[a[0]] = [*v, *a[1:]]
    return True


def folded(log):
    t = replay.tables(log)
    got = {r.key: r.value for r in t["strings"].collect()}
    for r in t["hashes"].collect():
        got.setdefault(r.key, {})[r.field] = r.value
    for r in t["sets"].collect():
        got.setdefault(r.key, set()).add(r.member)
    for r in t["lists"].orderBy("key", "pos").collect():
        got.setdefault(r.key, []).append(r.value)
    return got


@pytest.mark.parametrize("seed", [3, 4])
def test_renames_and_changes_of_kind(spark, seed):
    rng = random.Random(seed)
    key, x = lambda: rng.choice("abcdefgh"), lambda: rng.choice("pqrs")
    kinds = [
        lambda: ("SET", key(), x()),
        lambda: ("MSET", "a", x(), "z", x()),
        lambda: ("APPEND", key(), x()),
        lambda: ("HSET", key(), x(), x()),
        lambda: ("HSETNX", key(), x(), x()),
        lambda: ("SADD", key(), x()),
        *[lambda: ("SADD", rng.choice("tu"), x()), lambda: ("SMOVE", "t", "u", x())] * 2,
        lambda: ("RENAME", "u", key()),
        lambda: ("RPUSH", key(), x(), x()),
        lambda: ("RENAME", key(), key()),
        lambda: ("RENAME", key(), key()),
        lambda: ("RENAMENX", key(), key()),
        lambda: ("DEL", key(), key()),
        lambda: ("UNLINK", key()),
    ]
    state, ran = {}, []
    for i in range(500):
        c = ("FLUSHALL",) if i == 120 else rng.choice(kinds)()
        if run(state, *c):
            ran.append(c)
    log = spark.createDataFrame([(i, c[0], [a.encode() for a in c[1:]]) for i, c in enumerate(ran)], "seq long, op string, args array<binary>")
    assert {c[0] for c in ran} >= {"RENAME", "RENAMENX", "SMOVE", "HSETNX", "FLUSHALL"}
    assert folded(log) == state


def test_a_long_chain_of_renames(spark):
    ran = [("SET", "k0", "v"), *[("RENAME", f"k{i}", f"k{i + 1}") for i in range(40)], ("APPEND", "k40", "w"), ("RENAME", "k40", "k40"), ("SET", "k3", "new")]
    log = spark.createDataFrame([(i, c[0], [a.encode() for a in c[1:]]) for i, c in enumerate(ran)], "seq long, op string, args array<binary>")
    assert folded(log) == {"k40": "vw", "k3": "new"}
    assert folded(log.limit(0)) == {}


def test_appends_and_streams(spark):
    ran = [("SET", "k", "a"), ("APPEND", "k", "b"), ("APPEND", "k", "c"), ("APPEND", "n", "x"), ("XADD", "s", "1-0", "f", "v"), ("XADD", "s", "2-0", "f", "w"), ("XDEL", "s", "1-0")]
    log = spark.createDataFrame([(i, c[0], [a.encode() for a in c[1:]]) for i, c in enumerate(ran)], "seq long, op string, args array<binary>")
    assert {r.key: r.value for r in replay.strings(log).collect()} == {"k": "abc", "n": "x"}
    assert [(r.id, r.fields) for r in replay.streams(log).collect()] == [("2-0", {"f": "w"})]
    assert all(t.limit(0).count() == 0 for t in replay.tables(log).values())


def test_steps_and_appends_in_order(spark):
    ran = [("SET", "k", "1"), ("APPEND", "k", "2"), ("INCR", "k"), ("APPEND", "n", "4"), ("INCRBY", "n", "6"), ("APPEND", "n", "x"), ("INCR", "n"), *[("INCR", "c")] * 40]
    log = spark.createDataFrame([(i, c[0], [a.encode() for a in c[1:]]) for i, c in enumerate(ran)], "seq long, op string, args array<binary>")
    assert {r.key: r.value for r in replay.strings(log).collect()} == {"k": "13", "n": "10x", "c": "40"}
