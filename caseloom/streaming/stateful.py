"""Stateful operators on streams: stored answers, a limiter whose store is swept and capped, stream frames.

They use ``transformWithState``, by rows or in pandas; the session must keep its state in RocksDB
(``state_store(spark)`` says so before a query starts).
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators import folds

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def state_store(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)


def _rank(value) -> tuple:
    """A value as Spark orders it: null before all others, NaN after them."""
    return (0,) if value is None else (2,) if value != value else (1, value)


class Answers(StatefulProcessor):
    """The answers of the first requests of a bucket of keys; requests of a batch are taken in their order.

    A call to the state is a trip from Python to the JVM and back, which costs more than a request: a bucket's answers
    are read at once (Spark sends them by the hundred), and those that are new are added at once."""

    def __init__(self, columns: list[str], order: list[str], ttl_ms: int | None):
        self.columns, self.order, self.ttl_ms = columns, order, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.answers = handle.getListState("answers", "key string, status int, body string, at bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        made = Row(*self.columns, "outcome", "answered_status", "answered_body")
        stored = {k: answer for k, *answer in self.answers.get()}
        empty, fresh, again = not stored, {}, False
        for r in sorted(rows, key=lambda r: [_rank(r[c]) for c in self.order]):
            k, now = r["_key"], r["_ms"]
            known = stored.get(k)
            if known is None or (self.ttl_ms is not None and known[2] + self.ttl_ms <= now):
                again = again or known is not None
                known = stored[k] = fresh[k] = [r["status"], r["body"], now]
                found = ("run", *known[:2])
            elif known[0] == 0:
                found = ("conflict", folds.CONFLICT, None)
            else:
                found = ("replay", *known[:2])
            yield made(*[r[c] for c in self.columns], *found)
        if again:  # an answer whose time is over gives its place to the next
            self.answers.put([(k, *answer) for k, answer in stored.items()])
        elif fresh:
            self.answers.appendList([(k, *answer) for k, answer in fresh.items()])
        if empty and fresh and self.ttl_ms is not None:  # (a bucket that holds answers has one timer)
            self.handle.registerTimer(min(at for *_, at in fresh.values()) + self.ttl_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now = max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs())
        alive = [x for x in self.answers.get() if x[3] + self.ttl_ms > now]
        if alive:
            self.answers.put(alive)
            self.handle.registerTimer(min(at for *_, at in alive) + self.ttl_ms)
        else:
            self.answers.clear()
        return iter([])

    def close(self) -> None:
        pass


def first_wins(
    requests: DataFrame, keys: list[str], token: str, order: list[str], ttl: int | None = None, time: str = "ts", late: str = "1 minute", longest: int = 200, buckets: int = 1 << 12
) -> DataFrame:
    """``folds.first_wins`` on a stream of requests.

    With ``ttl``, an answer is replayed for so many seconds after its request's moment (event time); then its key is new,
    and its state goes as the watermark passes.  Without, answers are kept for good, as in the batch form.

    Keys are dealt to ``buckets`` by hash, and state is kept by bucket: a batch reads the answers of the buckets that it
    touches.  Some hundreds of keys a bucket are right; the number is fixed for the life of a checkpoint."""
    state_store(requests.sparkSession)
    bypass = folds.bypasses(token, longest)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in requests.schema) + ", outcome string, answered_status int, answered_body string"
    timed = requests if ttl is None else requests.withWatermark(time, late)
    ms = F.lit(0).cast("long") if ttl is None else F.coalesce(F.unix_millis(F.col(time)), F.lit(0))
    # (one text, with nulls in their places)
    known = timed.where(~bypass).withColumns({"_key": F.to_json(F.array(*[F.col(k).cast("string") for k in keys], folds.token(token))), "_ms": ms})
    known = known.withColumn("_bucket", F.pmod(F.xxhash64("_key"), F.lit(buckets))).groupBy("_bucket")
    processor = Answers(requests.columns, order, None if ttl is None else ttl * 1000)
    known = known.transformWithState(processor, schema, "Append", "None" if ttl is None else "EventTime")
    past = requests.where(bypass).withColumns({"outcome": F.lit("bypass"), "answered_status": F.col("status"), "answered_body": F.col("body")})
    return known.unionByName(past)


class Store(StatefulProcessor):
    """One shard of the limiter's store: windows by key, keys in the order in which they came in."""

    def __init__(self, key: str, time: str, id_: str, seconds: int, most: int, cap: int, sweep: int):
        self.names, self.wait, self.most, self.cap, self.sweep = (key, time, id_), seconds * 1000, most, cap, sweep * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.windows = handle.getMapState("windows", "key string", "start bigint, n int")
        self.keys = handle.getListState("keys", "key string")
        self.size = handle.getValueState("size", "n int")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        name, time, id_ = self.names
        events = pd.concat(list(rows)).sort_values([time, id_], kind="stable")
        seen: dict[str, tuple[int, int]] = {}
        out, fresh, last = [], [], 0
        for k, t, i in zip(events[name], events[time], events[id_], strict=True):
            now = t.value // 1_000_000
            if k not in seen:
                if self.windows.containsKey((k,)):
                    seen[k] = tuple(self.windows.getValue((k,)))
                else:
                    fresh.append((k,))
            start, n = seen.get(k, (None, 0))
            if start is None or start + self.wait <= now:
                start, n = now, 0
            seen[k], last = (start, n + 1), max(last, now)
            out.append((i, k, n + 1, pd.Timestamp(start + self.wait, unit="ms"), n + 1 > self.most))
        for k, window in seen.items():
            self.windows.updateValue((k,), window)
        if fresh:
            self.keys.appendList(fresh)
            self.size.update(((self.size.get() or (0,))[0] + len(fresh),))
        if not any(True for _ in self.handle.listTimers()):
            self.handle.registerTimer((last // self.sweep + 1) * self.sweep)
        yield pd.DataFrame(out, columns=[id_, name, "n", "reset_at", "limited"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = expiredTimerInfo.getExpiryTimeInMs()
        alive = []
        for (k,) in self.keys.get():
            if self.windows.getValue((k,))[0] + self.wait <= now:
                self.windows.removeKey((k,))
            else:
                alive.append((k,))
        for (k,) in alive[: max(0, len(alive) - self.cap)]:  # those that came in first go first
            self.windows.removeKey((k,))
        alive = alive[max(0, len(alive) - self.cap) :]
        if alive:
            self.keys.put(alive)
            self.size.update((len(alive),))
            self.handle.registerTimer(now + self.sweep)
        else:
            self.keys.clear()
            self.size.clear()
        return iter([])

    def close(self) -> None:
        pass


def capped_limiter(
    events: DataFrame, key: str, seconds: int, most: int, cap: int = 50_000, sweep: int = 300, shards: int = 16, time: str = "ts", id_: str = "event_id", late: str = "1 minute"
) -> DataFrame:
    """The anchored limiter with a store of bounded size: a row for each event.

    Keys are dealt to shards by hash.  When event time passes a multiple of ``sweep`` seconds, a shard drops the windows
    that have ended and then, while it holds more than its part of ``cap``, the keys that came in first; a key that was
    dropped begins anew.  ``cap`` bounds what is left after a sweep, as a backstop; between sweeps a shard may hold more."""
    state_store(events.sparkSession)
    kind = events.schema[id_].dataType.simpleString()
    rows = events.select(F.col(key).cast("string").alias(key), time, id_).withColumn("shard", F.pmod(F.xxhash64(key), F.lit(shards)))
    store = Store(key, time, id_, seconds, most, -(-cap // shards), sweep)
    return rows.withWatermark(time, late).groupBy("shard").transformWithStateInPandas(
        store, f"`{id_}` {kind}, `{key}` string, n int, reset_at timestamp, limited boolean", "Append", "EventTime"
    )


class Frames(StatefulProcessor):
    """Per stream what its frames have said so far, and the bytes of a frame that is not whole."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", "said string, torn binary")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        chunks = pd.concat(list(rows)).sort_values("seq", kind="stable")
        known = self.state.get()
        said, torn = (json.loads(known[0]), bytes(known[1])) if known else (folds.nothing_said(), b"")
        torn += b"".join(bytes(c) for c in chunks["chunk"] if c is not None)
        *whole, torn = torn.replace(b"\r\n", b"\n").split(b"\n\n") if not torn.endswith(b"\r") else [torn]
        for frame in whole:
            folds.hear(said, frame.decode("utf-8", "replace"))
        if chunks["last"].any():
            folds.hear(said, torn.decode("utf-8", "replace"))
            self.state.clear()
            yield pd.DataFrame([(*key, *folds.heard(said))], columns=["stream_id", "content", "sources", "error", "complete"])
        else:
            self.state.update((json.dumps(said), torn))

    def close(self) -> None:
        pass


def frames(chunks: DataFrame) -> DataFrame:
    """``folds.frames`` on a stream of (stream_id, seq, chunk binary, last): a row for a stream when its last chunk is in."""
    state_store(chunks.sparkSession)
    kind = chunks.schema["stream_id"].dataType.simpleString()
    return chunks.groupBy("stream_id").transformWithStateInPandas(
        Frames(), f"stream_id {kind}, content string, sources string, error string, complete boolean", "Append", "None"
    )
