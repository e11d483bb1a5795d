"""Anchored windows: the first event of a key opens a window, the first at or after its end opens the next.

Which events open windows depends on all before them, but a key is not one task's
work.  Events are dealt by ranges of (key, time), so that a busy key lies in many
partitions, and a partition's part in a key is a function of one number, the end
of the window that is open when the part begins:

1. Within a partition every event points to the first one at or after its window's
   end; doubling the pointers gives, for every event, the last opener of the chain
   that it would begin here and so the end of the window that the chain leaves open.
2. Only for keys that lie in several partitions: each such end is a node, placed in
   the partition with the first event that is not before it, and evaluated there: it
   points to the node that it leaves behind.  From the start of each key the nodes
   that are really reached are found by pointer doubling, in as many rounds as the
   number of partitions has binary digits.
3. Every partition, told what is open as it begins, marks its openers and numbers
   its events.

The driver holds a row for each partition and key that crosses its border, at most
two a partition.  A partition's events (``part_rows``) are a task's; a key's are not.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .. import tables

EPOCH = "1970-01-01 00:00:00"
#: The partition of a node after which no event comes.
NOWHERE = 1 << 40


def _keys(part: pa.Table) -> Iterator[tuple[int, int]]:
    """(start, end) of the rows of each key in a sorted partition; nulls are a key."""
    ids = pc.dictionary_encode(part["key"].combine_chunks(), null_encoding="encode").indices.to_numpy(zero_copy_only=False)
    edges = np.flatnonzero(np.concatenate(([True], np.diff(ids) != 0, [True])))
    yield from zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)


def _ordered(part: pa.Table) -> pa.Table:
    return part.take(pc.sort_indices(part, sort_keys=[("seq", "ascending")]))


def chain_ends(t: np.ndarray, wait: int) -> np.ndarray:
    """For every event, in time order, the last opener of the windows that begin with it."""
    at = np.searchsorted(t, t + wait, "left")
    jump = np.where(at < len(t), at, np.arange(len(t)))
    while not np.array_equal(further := jump[jump], jump):
        jump = further
    return jump


def openers(t: np.ndarray, wait: int, until: int | None) -> np.ndarray:
    """Places of the events that open windows, if one is open until then as the events begin."""
    following = np.searchsorted(t, t + wait, "left")
    k = 0 if until is None else int(np.searchsorted(t, until, "left"))
    out = []
    while k < len(t):
        out.append(k)
        k = int(following[k])
    return np.array(out, "i8")


class Borders(NamedTuple):
    """Keys that lie in several partitions, each named by where it begins: (partition, row)."""

    parts: dict[tuple[int, int], list[tuple[int, int]]]  # (partition, time of the key's last event there), in order
    runs: dict[tuple[int, int], tuple[tuple[int, int], int]]  # where a run begins -> its key's name, the key's events before it

    def next(self, name: tuple[int, int], part: int, until: int) -> int:
        """The first later partition with an event of the key at or after ``until``."""
        return next((p for p, last in self.parts[name] if p > part and last >= until), NOWHERE)


def _borders(runs: DataFrame) -> Borders:
    own = W.partitionBy("key")
    crossing = runs.withColumn("_p", F.count("*").over(own)).where("_p > 1").withColumn("_k", F.min(F.struct("part", "first")).over(own))
    out, before = Borders(defaultdict(list), {}), defaultdict(int)
    for r in crossing.select("part", "first", "last", "n", "_k").orderBy("part", "first").collect():  # at most two a partition
        name = tuple(r["_k"])
        out.parts[name].append((r["part"], r["last"]))
        out.runs[r["part"], r["first"]] = (name, before[name])
        before[name] += r["n"]
    return out


_NODE = "key_part long, key_row long, rank long, until long, part long"


def _nodes(rows: list[tuple]) -> pa.Table:
    return pa.table([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)] if rows else [pa.array([], pa.int64())] * 5, names=[x.split(" ")[0] for x in _NODE.split(", ")])


def _entries(dealt: DataFrame, b: Borders) -> dict[tuple[int, int], tuple[int, int]]:
    """What is open as a run of a crossing key begins: run -> (end of the window, rank of its opener); none for a key's first."""
    spark = dealt.sparkSession
    sent = spark.sparkContext.broadcast(b)  # at most two runs a partition
    hot = spark.createDataFrame([(p,) for p, _ in b.runs], "part long")
    rows = dealt.join(F.broadcast(hot.distinct()), "part", "left_semi").select("part", "seq", "key", "t", "wait")

    def hot_runs(part: pa.Table) -> Iterator[tuple[int, tuple[int, int], int, np.ndarray, int]]:
        part = _ordered(part)
        here, t, wait = part["part"][0].as_py(), part["t"].to_numpy(), part["wait"]
        for start, end in _keys(part):
            if found := sent.value.runs.get((here, start)):
                yield here, *found, t[start:end], wait[start].as_py()

    def left_behind(part: pa.Table) -> pa.Table:
        out = []
        for here, name, before, t, wait in hot_runs(part):
            for i in np.unique(chain_ends(t, wait)).tolist():
                until = int(t[i]) + wait
                out.append((*name, before + i, until, sent.value.next(name, here, until)))
        return _nodes(out)

    nodes = tables.written(rows.groupBy("part").applyInArrow(left_behind, _NODE), "limiter-nodes")
    starts = spark.createDataFrame([(*name, -1, None, parts[0][0]) for name, parts in b.parts.items()], _NODE)

    def passed(part: pa.Table, asked: pa.Table) -> pa.Table:
        """Each node that is placed here, with the one that it leaves behind."""
        out = []
        if part.num_rows and asked.num_rows:
            named: dict[tuple[int, int], list] = defaultdict(list)
            for r in asked.to_pylist():
                named[r["key_part"], r["key_row"]].append(r)
            for here, name, before, t, wait in hot_runs(part):
                ends = chain_ends(t, wait)
                for r in named[name]:
                    i = int(ends[0 if r["until"] is None else np.searchsorted(t, r["until"], "left")])
                    until = int(t[i]) + wait
                    out.append((*name, r["rank"], before + i, until, sent.value.next(name, here, until)))
        return pa.table([pa.array([r[k] for r in out], pa.int64()) for k in range(6)], names=["key_part", "key_row", "rank", "to", "until", "part"])

    edges = rows.groupBy("part").cogroup(nodes.unionByName(starts).where(F.col("part") != NOWHERE).groupBy("part"))
    edges = tables.written(edges.applyInArrow(passed, "key_part long, key_row long, rank long, to long, until long, part long"), "limiter-edges")
    key = ["key_part", "key_row"]
    jump = edges.select(*key, "rank", "to")
    reached = starts.select(*key, "rank")
    for _ in range(max(map(len, b.parts.values())).bit_length() + 1):
        reached = tables.written(reached.union(reached.join(jump, [*key, "rank"]).select(*key, F.col("to").alias("rank"))).distinct(), "limiter-reached")
        jump = tables.written(jump.join(jump.select(*key, F.col("rank").alias("to"), F.col("to").alias("_to")), [*key, "to"]).select(*key, "rank", F.col("_to").alias("to")), "limiter-jumps")
    left = edges.join(reached, [*key, "rank"]).select(*key, F.col("to").alias("rank"), "until", "part")
    found: dict[tuple[int, int], list] = defaultdict(list)
    for r in left.collect():  # a node for each run at most
        found[r["key_part"], r["key_row"]].append((r["part"], r["until"], r["rank"]))
    out = {}
    for (part, row), (name, _) in b.runs.items():
        # the window that is open here is the one that the next reached node after the runs before comes from
        if (part, row) != name:
            out[part, row] = min(x for x in found[name] if x[0] >= part)[1:]
    return out


def limited(
    events: DataFrame, key: str, seconds: int | Column, most: int | Column, time: str = "ts", id_: str = "event_id", part_rows: int = 200_000
) -> DataFrame:
    """Every event with its window: (id, key, n in the window, reset_at, limited from number most + 1 on).

    ``seconds`` and ``most`` may differ from key to key, but not within one.  Events of one moment are taken by id.
    A null key is a key like others; an event without a time opens no window and is not limited (n 0, reset_at null)."""
    spark, kind = events.sparkSession, events.schema[key].dataType.simpleString()
    col = lambda x: x if isinstance(x, Column) else F.lit(x)
    micros = F.timestamp_diff("MICROSECOND", F.lit(EPOCH).cast("timestamp_ntz"), F.col(time).cast("timestamp_ntz"))
    e = events.select(F.col(key).alias("key"), micros.alias("t"), F.col(id_).alias("i"), (col(seconds).cast("long") * 1_000_000).alias("wait"), col(most).cast("long").alias("most"))
    e = tables.written(e, "limiter-events")
    timed, parts = e.where("t is not null"), max(1, math.ceil(e.count() / part_rows))
    dealt = tables.ranged(timed, parts, [F.asc_nulls_first("key"), "t", "i"], "limiter-dealt")
    b = _borders(dealt.groupBy("part", "key").agg(F.count("*").alias("n"), F.min("seq").alias("first"), F.max("t").alias("last")))
    entries = _entries(dealt, b) if b.runs else {}
    sent = spark.sparkContext.broadcast((b.runs, entries))  # at most two runs a partition

    def numbered(part: pa.Table) -> pa.Table:
        runs, open_ = sent.value
        part = _ordered(part)
        here, t, waits, most_ = part["part"][0].as_py(), part["t"].to_numpy(), part["wait"].to_numpy(), part["most"].to_numpy()
        n, until = np.zeros(len(t), "i8"), np.zeros(len(t), "i8")
        for start, end in _keys(part):
            before = runs.get((here, start), (None, 0))[1]
            ends, rank = open_.get((here, start), (None, None))
            own, wait = t[start:end], int(waits[start])
            first = openers(own, wait, ends)
            at = np.searchsorted(first, np.arange(len(own)), "right") - 1  # the last opener so far
            if len(first):
                opener, reset = first[np.maximum(at, 0)] + before, own[first[np.maximum(at, 0)]] + wait
            else:
                opener, reset = np.zeros(len(own), "i8"), np.zeros(len(own), "i8")
            if ends is not None:
                opener, reset = np.where(at < 0, rank, opener), np.where(at < 0, ends, reset)
            n[start:end], until[start:end] = before + np.arange(len(own)) - opener + 1, reset
        columns = [part["i"], part["key"], pa.array(n.astype("i4")), pa.array(until, pa.timestamp("us")), pa.array(n > most_)]
        return pa.table(columns, names=[id_, key, "n", "reset_at", "limited"])

    schema = f"`{id_}` {e.schema['i'].dataType.simpleString()}, `{key}` {kind}, n int, reset_at timestamp_ntz, limited boolean"
    out = dealt.groupBy("part").applyInArrow(numbered, schema)
    untimed = e.where("t is null").select(F.col("i").alias(id_), F.col("key").alias(key), F.lit(0).alias("n"), F.lit(None).cast("timestamp_ntz").alias("reset_at"), F.lit(False).alias("limited"))
    return out.union(untimed)
