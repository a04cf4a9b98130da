"""The stateful operators on streams: what ``operators.state`` folds in batch, with state kept by key."""

from __future__ import annotations

import json
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def fold_stream(events: DataFrame, key: str, order: list[str], step: Callable, output: str, kind: str) -> DataFrame:
    """Append-mode stream of the events with the fold's output; a micro-batch's rows of a key are taken in order.

    Late rows are folded when they come: the order is that of arrival between micro-batches.
    """
    columns = events.columns

    def run(_, frames, state: GroupState):
        now = json.loads(state.get[0]) if state.exists else None
        rows = pd.concat(list(frames), ignore_index=True)[columns].sort_values(order, kind="stable")
        out = []
        for row in rows.itertuples(index=False):
            now, value = step(tuple(now) if isinstance(now, list) else now, row)
            out.append(value)
        state.update((json.dumps(now),))
        yield rows.assign(**{output: out})

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in events.schema.fields)
    return events.groupBy(key).applyInPandasWithState(run, f"{fields}, {output} {kind}", "state string", "append", GroupStateTimeout.NoTimeout)


def idempotent(events: DataFrame, key: str, time: str, ttl: str) -> DataFrame:
    """The first event of each key within the time to live; state older than that is dropped."""
    return events.withWatermark(time, ttl).dropDuplicatesWithinWatermark([key])


def telemetry(events: DataFrame, time: str, late: str, every: str, by: list[str]) -> DataFrame:
    return events.withWatermark(time, late).groupBy(F.window(time, every), *by).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
