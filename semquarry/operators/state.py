"""Order-dependent folds over a key's events, in batch: rate limits, circuit breakers, sessions.

Rows are dealt by key and sorted, and each task walks its rows once with the state of the key at hand, so
memory is one batch and one state, however many events a key has.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame


def fold(df: DataFrame, key: str, order: list[str], step: Callable[[Any, Any], tuple[Any, Any]], output: str, kind: str) -> DataFrame:
    """``df`` with what ``step(state, row) -> (state, output)`` gives for each row; a key's first state is None."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, state = object(), None
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                k = getattr(row, key)
                k = None if pd.isna(k) else k  # rows without a key are one key
                if k != now:
                    now, state = k, None
                state, value = step(state, row)
                out.append(value)
            yield batch.assign(**{output: out})

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.repartition(key).sortWithinPartitions(key, *order).mapInPandas(run, f"{fields}, {output} {kind}")


def limiter(window: float, most: int) -> Callable:
    """Allows ``most`` events in a window that the first event after the last window's end opens. Column at: seconds."""

    def step(state, row):
        start, n = state or (None, 0)
        if start is None or row.at - start >= window:
            start, n = row.at, 0
        return (start, min(n + 1, most)), n < most

    return step


def breaker(threshold: int) -> Callable:
    """closed -> open at ``threshold`` failures; open -> half-open on a success; half-open -> closed or open. Column ok."""

    def step(state, row):
        name, failures = state or ("closed", 0)
        if name == "closed":
            failures = 0 if row.ok else failures + 1
            name = "open" if failures >= threshold else "closed"
        elif name == "open":
            name = "half-open" if row.ok else "open"
        else:
            name, failures = ("closed", 0) if row.ok else ("open", failures)
        return (name, failures), name

    return step


def session() -> Callable:
    """Labels events add, update, contradict, retrieve and expire of a session's keys; a retrieval of a contradicted or expired key is stale."""

    def step(state, row):
        known = dict(state or {})
        old = known.get(row.item)
        label = row.type
        if row.type in ("add", "update"):
            label = "conflict" if row.type == "add" and old == "live" else row.type
            known[row.item] = "live"
        elif row.type in ("contradict", "expire"):
            known[row.item] = row.type
        elif row.type == "retrieve":
            label = "fresh" if old == "live" else "missing" if old is None else "stale"
        return known, label

    return step
