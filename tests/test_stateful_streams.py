"""Stateful streams against their batch forms and plain Python."""

import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from caseloom.operators import folds
from caseloom.sources.byte_streams import ByteStreams
from caseloom.streaming import replay, stateful

START = dt.datetime(2024, 1, 1)


@pytest.fixture
def stores(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


REQUESTS = "i int, user string, token string, status int, body string, ts timestamp_ntz"


def test_stored_answers_equal_the_batch(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice(["u", "v", None]), rng.choice(["k", " k ", "m", "", None, "x" * 201, "n"]), rng.choice([0, 200, 422]), f"b{i}", START + dt.timedelta(seconds=rng.randrange(500))) for i in range(120)]
    d = spark.createDataFrame(rows, REQUESTS)
    want = folds.first_wins(d, ["user"], "token", ["ts", "i"]).collect()
    got = replay.replayed(d, "ts", lambda s: stateful.first_wins(s, ["user"], "token", ["ts", "i"])).select(*want[0].asDict()).collect()
    assert sorted(map(str, got)) == sorted(map(str, want))


def test_answers_are_kept_by_bucket(spark, stores, tmp_path):
    """Many keys are few groups of state; nulls and long numbers come back as they are, first ones first, in any time zone."""
    rows = [(i if i % 9 else None, "u", f"k{i % 400}", None if i % 11 == 0 else 200, None if i % 5 == 0 else f"b{i}", None if i == 400 else START + dt.timedelta(seconds=i), 2**53 + i) for i in range(1200)]
    d = spark.createDataFrame(rows, REQUESTS.replace("_ntz", "") + ", n long")
    at, out = str(tmp_path / "in"), str(tmp_path / "out")
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "Asia/Kolkata")
    try:
        d.write.parquet(at)
        s = stateful.first_wins(spark.readStream.schema(d.schema).parquet(at), ["user"], "token", ["ts", "n"], buckets=4)
        q = s.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        assert q.awaitTermination(60)
        assert sum(o["numRowsTotal"] for o in q.lastProgress["stateOperators"]) < 50  # (400 if each key were a group)
        want = folds.first_wins(d, ["user"], "token", ["ts", "n"]).collect()
        got = spark.read.parquet(out).select(*want[0].asDict()).collect()
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    assert sorted(map(str, got)) == sorted(map(str, want))


def test_an_answer_is_gone_after_its_time(spark, stores, tmp_path):
    at, out, schema = str(tmp_path / "in"), str(tmp_path / "out"), REQUESTS.replace("_ntz", "")
    spark.createDataFrame([], schema).write.parquet(at)
    s = stateful.first_wins(spark.readStream.schema(schema).parquet(at), ["user"], "token", ["ts", "i"], ttl=60, late="0 seconds")
    sizes = []
    for rows in ([(1, 0), (2, 59)], [(3, 61)], [(4, 100), (5, 121)], [(6, 500)]):
        spark.createDataFrame([(i, "u", "k" if i < 6 else "other", 200, f"b{i}", START + dt.timedelta(seconds=t)) for i, t in rows], schema).write.mode("append").parquet(at)
        q = s.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        assert q.awaitTermination(60)
        sizes.append(q.lastProgress["stateOperators"][0]["numRowsTotal"])
    got = {r["i"]: (r["outcome"], r["answered_body"]) for r in spark.read.parquet(out).collect()}
    assert got == {1: ("run", "b1"), 2: ("replay", "b1"), 3: ("run", "b3"), 4: ("replay", "b3"), 5: ("run", "b5"), 6: ("run", "b6")}
    assert sizes[-1] <= sizes[0]  # the first key's answer has gone as the last one's came


def test_the_store_is_swept_and_capped(spark, stores, tmp_path):
    at, out = str(tmp_path / "in"), "capped"
    schema = "event_id long, user_id string, ts timestamp"
    moment = lambda s: START + dt.timedelta(seconds=s)
    spark.createDataFrame([], schema).write.parquet(at)
    s = spark.readStream.schema(schema).parquet(at)
    limited = stateful.capped_limiter(s, "user_id", 1000, 2, cap=3, sweep=100, shards=1, late="0 seconds")
    q = limited.writeStream.format("memory").queryName(out).option("checkpointLocation", str(tmp_path / "c")).start()
    # a to e come in at 0..4; a, b again at 50: they keep their places, the oldest, and go first when the sweep at 100 cuts five to three
    batches = [[(i, k, i) for i, k in enumerate("abcde")], [(10, "a", 50), (11, "b", 51)], [(20, "f", 150)], [(30 + i, k, 160 + i) for i, k in enumerate("abcdef")]]
    for rows in batches:
        spark.createDataFrame([(i, k, moment(t)) for i, k, t in rows], schema).coalesce(1).write.mode("append").parquet(at)
        q.processAllAvailable()
    q.stop()
    got = {r["event_id"]: (r["n"], r["limited"]) for r in spark.table(out).collect()}
    assert [got[i] for i in (0, 10, 11)] == [(1, False), (2, False), (2, False)]
    # f came in as the sweep was due: a and b, then the oldest, begin anew; c (cut next, for f) does too or counts on, d to f count on
    assert [got[30][0], got[31][0]] == [1, 1] and [got[33][0], got[34][0], got[35][0]] == [2, 2, 2]


def test_ended_windows_are_dropped(spark, stores, tmp_path):
    at, schema = str(tmp_path / "in"), "event_id long, user_id string, ts timestamp"
    spark.createDataFrame([], schema).write.parquet(at)
    s = spark.readStream.schema(schema).parquet(at)
    q = stateful.capped_limiter(s, "user_id", 10, 1, cap=100, sweep=60, shards=1, late="0 seconds").writeStream.format("memory").queryName("swept").option("checkpointLocation", str(tmp_path / "c")).start()
    for rows in ([(i, f"k{i}", i) for i in range(30)], [(100, "k0", 70)], [(101, "k0", 200)], [(102, "k0", 400)]):
        spark.createDataFrame([(i, k, START + dt.timedelta(seconds=t)) for i, k, t in rows], schema).coalesce(1).write.mode("append").parquet(at)
        q.processAllAvailable()
    rows_kept = [o["numRowsTotal"] for o in q.lastProgress["stateOperators"]]
    q.stop()
    assert rows_kept[0] < 10  # thirty windows, thirty places in the order and their bookkeeping have gone
    assert {r["event_id"]: r["n"] for r in spark.table("swept").collect()} == {i: 1 for i in [*range(30), 100, 101, 102]}


def frames_of(rng, k):
    parts = [f"event: delta\ndata: {json.dumps({'text': rng.choice(['é', 'a b', 'ش', chr(10)])}, ensure_ascii=False)}\n\n" for _ in range(k % 5)]
    parts += rng.sample(["event: sources\ndata: [1,\ndata: 2]\n\n", "data: {}\n\n", "event: delta\ndata: {broken\n\n", 'event: delta\ndata: {"text":5}\n\n', ": note\n\n", 'event: error\ndata: {"message":"no"}\n\n'], k % 4)
    return "".join(parts) + rng.choice(["event: done\ndata: {}\n\n", 'event: done\ndata: {"content":" Z ","sources":[]}', ""])


def test_byte_streams_however_torn_and_after_a_restart(spark, stores, tmp_path):
    rng = random.Random(8)
    spark.dataSource.register(ByteStreams)
    at = tmp_path / "streams"
    at.mkdir()
    whole = {f"s{k}": frames_of(rng, k).encode() for k in range(12)}
    want = folds.frames(spark.createDataFrame([(k, 0, v.decode()) for k, v in whole.items()], "stream_id string, seq int, chunk string")).collect()

    def start():
        s = spark.readStream.format("caseloom_bytes").option("path", str(at)).load()
        return stateful.frames(s).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).start()

    sent, q = dict.fromkeys(whole, 0), start()
    for step in range(4):
        for k, v in whole.items():
            upto = len(v) if step == 3 else rng.randint(sent[k], len(v))
            with (at / f"{k}.sse").open("ab") as f:
                f.write(v[sent[k] : upto])
            sent[k] = upto
            if step == 3:
                (at / f"{k}.end").touch()
        if step == 2:  # a new run of the query goes on where the last one was
            q.stop()
            q = start()
        q.processAllAvailable()
    q.stop()
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    assert sorted(map(str, got)) == sorted(map(str, want)) and len(got) == 12
