"""Anchored windows against a plain fold."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from caseloom.operators import limiter

START = dt.datetime(2024, 1, 1)


def plain(rows, seconds, most):
    """{id: (key, n, reset_at, limited)} of (id, key, ts) rows."""
    out, state = {}, {}
    for i, k, t in sorted((r for r in rows if r[2] is not None), key=lambda r: (r[2], r[0])):
        wait = dt.timedelta(seconds=seconds(k) if callable(seconds) else seconds)
        start, n = state.get(k, (None, 0))
        if start is None or start + wait <= t:
            start, n = t, 0
        state[k] = (start, n + 1)
        out[i] = (k, n + 1, start + wait, n + 1 > most)
    return out | {i: (k, 0, None, False) for i, k, t in rows if t is None}


def moments(n, seed, keys, span, hot=0.35):
    rng = random.Random(seed)
    return [(i, keys[0] if rng.random() < hot else rng.choice(keys), START + dt.timedelta(seconds=rng.randrange(span)) if rng.random() > 0.02 else None) for i in range(n)]


def found(df):
    return {r["event_id"]: (r["user_id"], r["n"], r["reset_at"], r["limited"]) for r in df.collect()}


BIG = 1 << 53
KEYS = [None, BIG, BIG + 1, -3, 5, 6]


@pytest.mark.parametrize(("part_rows", "seconds", "span"), [(25, 60, 3000), (25, 4000, 3000), (10_000, 60, 3000)])
def test_windows_of_split_keys(spark, part_rows, seconds, span):
    rows = moments(200, part_rows, KEYS, span)
    df = spark.createDataFrame(rows, "event_id long, user_id long, ts timestamp_ntz").repartition(3)
    assert found(limiter.limited(df, "user_id", seconds, 3, part_rows=part_rows)) == plain(rows, seconds, 3)


def test_one_key_of_many_partitions(spark):
    """A key alone, in windows that end within, at and far beyond partitions; all its events at three moments."""
    for seconds, span in ((50, 4000), (900, 4000), (10, 3)):
        rows = [(i, "k", t) for i, _, t in moments(150, seconds, [1], span)]
        df = spark.createDataFrame(rows, "event_id long, user_id string, ts timestamp_ntz")
        assert found(limiter.limited(df, "user_id", seconds, 2, part_rows=12)) == plain(rows, seconds, 2)


def test_windows_differ_by_key(spark):
    rows = moments(200, 8, ["a:1", "a:2", "b:1", "c:1"], 5000)
    waits = {"a": 60, "b": 600, "c": 3600}
    df = spark.createDataFrame(rows, "event_id long, user_id string, ts timestamp_ntz").withColumn("n", F.lit("clash"))
    wait = F.element_at(F.create_map(*[F.lit(x) for kv in waits.items() for x in kv]), F.substring("user_id", 1, 1))
    assert found(limiter.limited(df, "user_id", wait, 1, part_rows=30)) == plain(rows, lambda k: waits[k[0]], 1)


def test_a_busy_key_is_no_task_of_its_own(spark):
    rows = [(i, 1 if i % 3 else i, START + dt.timedelta(seconds=i)) for i in range(900)]
    df = spark.createDataFrame(rows, "event_id long, user_id long, ts timestamp_ntz")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    out = limiter.limited(df, "user_id", 30, 5, part_rows=100)
    sizes = out.withColumn("p", F.spark_partition_id()).where("user_id = 1").groupBy("p").count().collect()
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert found(out) == plain(rows, 30, 5) and len(sizes) > 3
    assert limiter.limited(df.limit(0), "user_id", 30, 5).count() == 0


def test_policies():
    from caseloom.operators.policies import POLICIES

    assert len(POLICIES) == 45 == len({p[0] for p in POLICIES}) and {p[2] for p in POLICIES} == {1, 10, 15, 60}


def test_requests_without_a_policy_pass(spark):
    from caseloom.operators import policies

    rows = [(i, b, u, None, "a", START + dt.timedelta(seconds=i)) for i, (b, u) in enumerate([("auth:login", None), ("auth:login", "x"), ("odd", "x"), (None, "x"), ("office:export", "y")])]
    got = policies.limited(spark.createDataFrame(rows, "id long, b string, u string, o string, a string, t timestamp_ntz"), "b", "u", "o", "a", "t", "id").orderBy("id").collect()
    assert [(r["bucket"], r["n"], r["limited"]) for r in got] == [("auth:login", 1, False), ("auth:login", 2, False), ("odd", 0, False), (None, 0, False), ("office:export", 1, False)]
    shifted = spark.range(1).select(*[policies.item_bucket(F.lit(r), F.lit(m)) for r in ("cases", "clients", "teams") for m in ("GET", "PATCH", "DELETE")]).first()
    assert tuple(shifted) == ("cases:update", "cases:delete", None, "clients:update", "clients:delete", None, None, None, None)
