"""The limiter and the idempotency rule on Structured Streaming."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def limiter(events: DataFrame, key: str, seconds: int, most: int, time: str = "ts", id_: str = "event_id", late: str = "1 hour") -> DataFrame:
    """The anchored window limiter on a stream: one row an event, in append mode.

    The state of a key is its window's start and its count; it is dropped when event time has passed the
    window's end, so state holds only keys with an open window.
    """
    kind = dict(events.dtypes)[key]
    wait = pd.Timedelta(seconds=seconds)
    out = f"{id_} bigint, {key} {kind}, n int, reset_at timestamp, limited boolean"

    def run(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(frames)).sort_values([time, id_])
        start, n = (pd.Timestamp(state.get[0], unit="us"), state.get[1]) if state.exists else (None, 0)
        ns, ends = [], []
        for t in rows[time]:
            if start is None or start + wait <= t:
                start, n = t, 0
            n += 1
            ns.append(n)
            ends.append(start + wait)
        state.update((int(start.value // 1000), n))
        until = int((start + wait).value // 1_000_000)
        state.setTimeoutTimestamp(max(until, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({id_: rows[id_].to_numpy(), key: k[0], "n": ns, "reset_at": ends, "limited": [x > most for x in ns]})

    return events.withWatermark(time, late).groupBy(key).applyInPandasWithState(run, out, "start bigint, n int", "append", GroupStateTimeout.EventTimeTimeout)


def first_only(requests: DataFrame, keys: list[str], time: str = "ts", within: str = "1 day") -> DataFrame:
    """The first request of each key; repeats within the time are dropped."""
    return requests.withWatermark(time, within).dropDuplicatesWithinWatermark(keys)
