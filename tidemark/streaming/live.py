"""Live event history: the decayed counts of operators.history on a stream.

State per entity is one time and one sum a scale, so it stays small however long the history. An entity's events of one
micro-batch are taken in time order, equal times together: emitted first, added afterwards. Late events (not after
the entity's last time) are marked and change nothing. State of an entity that has been silent for a set span can expire.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

MICROS = 1_000_000.0


def live_decay(events: DataFrame, entity: str, us: str, taus: dict[str, float], forget_after_ms: int | None = None) -> DataFrame:
    """entity, us, late and v_<scale> for every event of a streaming (entity long, us long) table.

    A null entity or time is late: it has no history, and is emitted once an event as all others. forget_after_ms: an
    entity without events for so long, by the clock, loses its state and starts anew (default: never).
    """
    names = list(taus)
    timeout = GroupStateTimeout.NoTimeout if forget_after_ms is None else GroupStateTimeout.ProcessingTimeTimeout

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last, *sums = state.get if state.exists else (None, *[0.0] * len(names))
        times = pd.concat(list(frames))[us]
        nobody = key[0] is None or pd.isna(key[0])
        who = None if nobody else key[0]
        out = [(who, None, True, *[0.0] * len(names))] * int(times.isna().sum())
        for at, n in sorted(times.dropna().value_counts().items()):
            at = int(at)
            if nobody or (last is not None and at <= last):
                out += [(who, at, True, *[0.0] * len(names))] * int(n)
                continue
            gap = 0.0 if last is None else (at - last) / MICROS
            sums = [s * math.exp(-gap / taus[t]) for s, t in zip(sums, names, strict=True)]
            out += [(who, at, False, *sums)] * int(n)
            sums, last = [s + int(n) for s in sums], at
        if last is not None:
            state.update((last, *sums))
            if forget_after_ms is not None:
                state.setTimeoutDuration(forget_after_ms)
        made = pd.DataFrame(out, columns=["entity", "us", "late", *(f"v_{t}" for t in names)])
        yield made.astype({"entity": "Int64", "us": "Int64"})

    values = ", ".join(f"v_{t} double" for t in names)
    return events.groupBy(entity).applyInPandasWithState(step, f"entity long, us long, late boolean, {values}", f"last long, {values}", "append", timeout)
