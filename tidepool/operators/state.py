"""State behind logs: registries, queues, state machines and rate limits.

Each is a fold over a log in the order of ``seq``. Where a fold needs a key's rows in order it is a
window over the key; token buckets, circuit breakers and leases, whose next state is no sum, run
through sorted Arrow batches and hold one key's state, never its rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import kv

#: Verbs of named registries by what they do to a row.
WRITES = ("create", "set", "register", "add", "update", "enable", "disable", "on", "off", "toggle", "renew", "grant", "assign", "elect", "join")
DELETES = ("delete", "del", "remove", "unregister", "revoke", "deregister", "leave", "resign", "clear")


def registry(log: DataFrame, name: str, op: str, seq: str) -> DataFrame:
    """What is registered: the last write of each name that no delete follows."""
    return kv.latest(log.where(F.col(op).isin(*WRITES, *DELETES)), [name], seq, op, DELETES)


def toggled(log: DataFrame, name: str, op: str, seq: str) -> DataFrame:
    """(name, state) of switches: toggles since the last on or off."""
    fixed = log.where(F.col(op).isin("on", "off")).groupBy(name).agg(F.max(seq).alias("__at"), F.max_by(op, seq).alias("__base"))
    rows = log.where(F.col(op).isin("on", "off", "toggle")).join(fixed, name, "left")
    turns = F.sum(F.when((F.col(op) == "toggle") & (F.col("__at").isNull() | (F.col(seq) > F.col("__at"))), 1).otherwise(0))
    return rows.groupBy(name).agg(((F.first("__base", ignorenulls=True).eqNullSafe("on").cast("int") + turns) % 2 == 1).alias("state"))


def queue(log: DataFrame, name: str, op: str, seq: str) -> DataFrame:
    """Pushes that no pop has taken, first in first out. A pop of an empty queue takes nothing.

    Depth without underflow is the running sum minus its running minimum below zero, so all is windows.
    """
    w = Window.partitionBy(name).orderBy(seq).rowsBetween(Window.unboundedPreceding, 0)
    step = F.when(F.col(op) == "push", 1).otherwise(-1)
    rows = log.withColumn("__s", F.sum(step).over(w)).withColumn("__low", F.least(F.lit(0), F.min("__s").over(w)))
    rows = rows.withColumn("__wasted", -F.col("__low")).withColumn("__pops", F.sum(F.when(F.col(op) == "pop", 1).otherwise(0)).over(w))
    ends = rows.groupBy(name).agg((F.max("__pops") - F.max("__wasted")).alias("__taken"))
    pushes = rows.where(F.col(op) == "push").withColumn("__nth", F.row_number().over(Window.partitionBy(name).orderBy(seq)))
    return pushes.join(ends, name).where(F.col("__nth") > F.col("__taken")).drop("__s", "__low", "__wasted", "__pops", "__nth", "__taken")


def stack(log: DataFrame, name: str, op: str, seq: str) -> DataFrame:
    """Pushes that no pop has taken, last in first out: those whose depth no later row falls below."""
    w = Window.partitionBy(name).orderBy(seq)
    step = F.when(F.col(op) == "push", 1).otherwise(-1)
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    rows = log.withColumn("__s", F.sum(step).over(run)).withColumn("__d", F.col("__s") - F.least(F.lit(0), F.min("__s").over(run)))
    later = F.min("__d").over(w.rowsBetween(1, Window.unboundedFollowing))
    return rows.withColumn("__later", later).where((F.col(op) == "push") & (F.col("__later").isNull() | (F.col("__later") >= F.col("__d")))).drop("__s", "__d", "__later")


#: Rows of a key whose transitions are composed at a time.
CHUNK = 256


def machine(log: DataFrame, name: str, event: str, seq: str, transitions: dict[tuple[str, str], str], start: str) -> DataFrame:
    """Adds state after each event. An event without a transition changes nothing.

    An event is a function from states to states. Functions of CHUNK rows at a time are composed
    side by side; a fold over the chunks, not the rows, finds the state at the start of each.
    """
    states = sorted({start, *(a for a, _ in transitions), *transitions.values()})
    index = {s: i for i, s in enumerate(states)}
    events = sorted({e for _, e in transitions})
    same = F.array(*[F.lit(i) for i in range(len(states))])
    table = F.create_map(*[x for e in events for x in (F.lit(e), F.array(*[F.lit(index[transitions.get((s, e), s)]) for s in states]))])
    numbered = log.withColumn("__n", F.row_number().over(Window.partitionBy(name).orderBy(seq)) - 1).withColumn("__chunk", F.floor(F.col("__n") / CHUNK)).withColumn("__f", F.coalesce(F.try_element_at(table, F.col(event)), same))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("__n", "__f"))), lambda x: x["__f"])
    composed = numbered.groupBy(name, "__chunk").agg(ordered.alias("__p")).select(F.col(name).alias("__key"), "__chunk", F.aggregate("__p", same, lambda acc, f: F.transform(acc, lambda s: F.get(f, s))).alias("__g"))

    def step(state: int, row: tuple) -> tuple[int, tuple]:
        return int(row[2][state]), (row[0], row[1], state)

    kind = dict(log.dtypes)[name]
    starts = scan(composed, "__key", ["__chunk"], f"__key {kind}, __chunk long, __start int", lambda: index[start], step)
    within = Window.partitionBy(name, "__chunk").orderBy("__n").rowsBetween(Window.unboundedPreceding, 0)
    path = numbered.withColumn("__path", F.collect_list("__f").over(within)).withColumnRenamed("__chunk", "__c")
    joined = path.join(starts, (F.col(name) == F.col("__key")) & (F.col("__c") == F.col("__chunk")))
    last = F.aggregate("__path", F.col("__start"), lambda s, f: F.get(f, s))
    return joined.withColumn("state", F.get(F.array(*map(F.lit, states)), last)).drop("__n", "__c", "__f", "__path", "__key", "__chunk", "__start")


def scan[S](df: DataFrame, key: str, order: list[str], schema: str, start: Callable[[], S], step: Callable[[S, tuple], tuple[S, tuple]]) -> DataFrame:
    """A fold in order whose next state is no sum: rows of a key come sorted, in batches, and one state is kept.

    step: state and row (in the order of df's columns) to state and output row.
    """
    at = df.columns.index(key)
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, state = object(), start()
        for b in batches:
            out = []
            for row in b.itertuples(index=False, name=None):
                if row[at] != now:
                    now, state = row[at], start()
                state, made = step(state, row)
                out.append(made)
            yield pd.DataFrame(out, columns=names)

    return df.repartition(key).sortWithinPartitions(key, *order).mapInPandas(run, schema)


def _timed(df: DataFrame, key: str, ts: str, tie: str, *more: str) -> tuple[DataFrame, str]:
    """(key, tie, seconds, more...) and the schema of the first two."""
    kinds = dict(df.dtypes)
    at = (F.unix_micros(F.col(ts).cast("timestamp")) / 1e6).alias("__at")
    return df.select(key, tie, at, *more), f"{key} {kinds[key]}, {tie} {kinds[tie]}"


def token_bucket(df: DataFrame, key: str, ts: str, tie: str, capacity: float, per_second: float) -> DataFrame:
    """(key, tie, allowed, tokens): one token for each row, refilled over time up to capacity. A leaky bucket is the same seen from the other side."""

    def step(state: tuple, row: tuple) -> tuple:
        left, last = state
        left = min(capacity, left + (0 if last is None else (row[2] - last) * per_second))
        ok = left >= 1
        return (left - ok, row[2]), (row[0], row[1], ok, left - ok)

    rows, schema = _timed(df, key, ts, tie)
    return scan(rows, key, ["__at", tie], f"{schema}, allowed boolean, tokens double", lambda: (capacity, None), step)


def circuit(df: DataFrame, key: str, ts: str, tie: str, failed: str, threshold: int, timeout: float, successes: int = 1) -> DataFrame:
    """(key, tie, state) after each call: closed, open or half-open."""

    def step(now: tuple, row: tuple) -> tuple:
        state, fails, good, opened = now
        at, bad = row[2], row[3]
        if state == "open" and at - opened >= timeout:
            state, good = "half-open", 0
        if state == "closed":
            fails = fails + 1 if bad else 0
            if fails >= threshold:
                state, opened = "open", at
        elif state == "half-open":
            good += not bad
            if bad:
                state, opened = "open", at
            elif good >= successes:
                state, fails = "closed", 0
        return (state, fails, good, opened), (row[0], row[1], state)

    rows, schema = _timed(df, key, ts, tie, failed)
    return scan(rows, key, ["__at", tie], f"{schema}, state string", lambda: ("closed", 0, 0, 0.0), step)


def cooled_down(df: DataFrame, key: str, ts: str, tie: str, seconds: float) -> DataFrame:
    """(key, tie, allowed): a row passes if ``seconds`` lie between it and the last that passed."""

    def step(last: float | None, row: tuple) -> tuple:
        ok = last is None or row[2] - last >= seconds
        return (row[2] if ok else last), (row[0], row[1], ok)

    rows, schema = _timed(df, key, ts, tie)
    return scan(rows, key, ["__at", tie], f"{schema}, allowed boolean", lambda: None, step)


def debounced(df: DataFrame, key: str, ts: str, tie: str, seconds: int) -> DataFrame:
    """Rows that no other of their key follows within ``seconds``."""
    after = F.lead(ts).over(Window.partitionBy(key).orderBy(ts, tie))
    return df.withColumn("__after", after).where(F.col("__after").isNull() | (F.timestamp_diff("SECOND", F.col(ts), F.col("__after")) >= seconds)).drop("__after")


def held(log: DataFrame, name: str, delta: str, seq: str) -> DataFrame:
    """Adds held: permits taken and not given back, never below zero. For semaphores, pools, bulkheads and back pressure."""
    w = Window.partitionBy(name).orderBy(seq).rowsBetween(Window.unboundedPreceding, 0)
    total = log.withColumn("__t", F.sum(delta).over(w))
    return total.withColumn("held", F.col("__t") - F.least(F.lit(0), F.min("__t").over(w))).drop("__t")


def leases(log: DataFrame, name: str, holder: str, ts: str, seconds: float, tie: str) -> DataFrame:
    """(name, tie, granted): who asks gets the lock if it is free, its own, or its lease is over."""

    def step(state: tuple, row: tuple) -> tuple:
        owner, until = state
        ok = owner is None or owner == row[3] or row[2] > until
        return ((row[3], row[2] + seconds) if ok else state), (row[0], row[1], ok)

    rows, schema = _timed(log, name, ts, tie, holder)
    return scan(rows, name, ["__at", tie], f"{schema}, granted boolean", lambda: (None, 0.0), step)
