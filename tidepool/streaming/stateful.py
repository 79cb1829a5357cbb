"""Stateful operators on streams: state is kept by key and survives restarts."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def running_counts(df: DataFrame, key: str) -> DataFrame:
    """(key, n, batch_rows) after each batch in which a key has rows."""

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        (n,) = state.get if state.exists else (0,)
        rows = sum(len(b) for b in batches)
        state.update((n + rows,))
        yield pd.DataFrame({key: [k[0]], "n": [n + rows], "batch_rows": [rows]})

    kind = dict(df.dtypes)[key]
    return df.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, n long, batch_rows long", "n long", "append", GroupStateTimeout.NoTimeout)


def message_queue(df: DataFrame, message: str, ok: str, most: int) -> DataFrame:
    """(message, outcome, tries) once a message is acked or has failed ``most`` times; the rest stay in state."""

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        tries, done = state.get if state.exists else (0, False)
        out = []
        for b in batches:
            for good in b[ok]:
                if done:
                    continue
                tries += 1
                done = bool(good) or tries >= most
                if done:
                    out.append((k[0], "acked" if good else "dead", tries))
        state.update((tries, done))
        yield pd.DataFrame(out, columns=[message, "outcome", "tries"])

    kind = dict(df.dtypes)[message]
    return df.select(message, ok).groupBy(message).applyInPandasWithState(step, f"{message} {kind}, outcome string, tries long", "tries long, done boolean", "append", GroupStateTimeout.NoTimeout)
