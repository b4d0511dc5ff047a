"""Keyed state over event time: what a key's events come to, taken in their order, with timers.

A stream may bring a key's events in any order within its lateness. They wait in the key's state until the watermark has
passed them, then a fold takes them by time and number; a fold may set a timer, which goes off when the watermark has
passed it, before any later event. So the rows that come out do not depend on how events were cut into batches, a batch
that is run again gives the same rows, and a key whose fold has nothing left to wait for has no state.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


class Fold(Protocol):
    """State is a dictionary of plain values, or None; its key `due`, in milliseconds, is the timer.

    An event has its moment as `us` and `ms`, micro- and milliseconds, its `seq`, and the stream's other columns.
    """

    def event(self, key, state: dict | None, event: dict) -> tuple[dict | None, list[tuple]]: ...

    def timer(self, key, state: dict) -> tuple[dict | None, list[tuple]]: ...


def advance(fold: Fold, key, state: dict | None, events: list[dict], past: int | None) -> tuple[dict | None, list[tuple]]:
    """The fold over events in order, timers between them and up to `past`; None: to the end of time."""
    out: list[tuple] = []
    for event in [*events, None]:
        until = past if event is None else event["ms"]
        while state is not None and state.get("due") is not None and (until is None or state["due"] <= until):
            state, rows = fold.timer(key, state)
            out += rows
        if event is not None:
            state, rows = fold.event(key, state, event)
            out += rows
    return state, out


def _order(event: dict) -> tuple:
    return event["us"], event["seq"]


def folded(events: DataFrame, key: str, make: Callable[[], Fold], schema: str, late: str = "1 hour", ts: str = "ts", seq: str = "seq") -> DataFrame:
    """Rows that folds give of the stream events: columns key, ts, seq and plain values, each key's in order.

    Without a stream the same rows come from sorted groups, timers to the end of time going off.
    """
    columns = [c for c in events.columns if c not in (key, ts, seq)]
    names = [x.split()[0] for x in schema.split(", ")]
    rows = events.withColumn("us", F.unix_micros(ts)).withColumnRenamed(seq, "seq")
    given = ["us", "seq", *columns]

    def told(pdf: pd.DataFrame) -> list[dict]:
        found = [{k: None if pd.isna(v) else v for k, v in zip(given, r)} for r in pdf[given].astype(object).itertuples(index=False)]
        return [e | {"ms": e["us"] // 1000} for e in found]

    if not events.isStreaming:

        def whole(keys: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
            _, out = advance(make(), keys[0], None, sorted(told(pdf), key=_order), None)
            return pd.DataFrame(out, columns=names)

        return rows.drop(ts).groupBy(key).applyInPandas(whole, schema)

    def step(keys: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        waiting, own = (json.loads(x) for x in state.get) if state.exists else ([], None)
        for pdf in pdfs:
            waiting += told(pdf)
        past = state.getCurrentWatermarkMs()
        waiting.sort(key=_order)
        ready = [e for e in waiting if e["us"] <= 1000 * past]  # rows after the watermark may still come
        waiting = waiting[len(ready) :]
        own, out = advance(make(), keys[0], own, ready, past)
        if not waiting and own is None:
            state.remove()
        else:
            state.update((json.dumps(waiting, default=int), json.dumps(own, default=int)))
            ahead = [x for x in (waiting[0]["ms"] + 1 if waiting else None, (own or {}).get("due")) if x is not None]
            if ahead:
                state.setTimeoutTimestamp(max(min(ahead), past + 1))
        yield pd.DataFrame(out, columns=names)

    timed = rows.withWatermark(ts, late)
    return timed.groupBy(key).applyInPandasWithState(step, schema, "waiting string, own string", "append", GroupStateTimeout.EventTimeTimeout)
