"""Restore proofs, logs, exports: exactly once, whatever is run again."""

import datetime as dt
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from caseloom.operators import exports, proof
from caseloom.sources import archive, files
from caseloom.streaming import logs

AT = dt.datetime(2024, 1, 1)


def test_one_changed_row_is_found(spark):
    rows = [(i, i % 7, None if i % 5 == 0 else f"t{i}") for i in range(500)] + [(None, 1, "x"), (3, 3, "t3")]
    d = spark.createDataFrame(rows, "k long, a int, b string").repartition(7)
    assert proof.proved(d, d.repartition(3), ["k"], ["k", "a", "b"]) and proof.differences(d, d.coalesce(1), ["k"], ["k", "a", "b"]).count() == 0
    other = d.withColumn("b", F.when(F.col("k") == 77, "changed").otherwise(F.col("b")))
    assert not proof.proved(d, other, ["k"], ["k", "a", "b"])
    assert sorted(map(tuple, proof.differences(d, other, ["k"], ["k", "a", "b"]).collect())) == [(77, 0, 1), (77, 1, 0)]
    # a repeated row that is there once, a lost row, values that move between columns
    assert [tuple(r) for r in proof.differences(d, d.distinct(), ["k"], ["k", "a", "b"]).collect()] == [(3, 2, 1)]
    assert [tuple(r) for r in proof.differences(d, d.where("k is not null"), ["k"], ["k", "a", "b"]).collect()] == [(None, 1, 0)]
    x, y = (spark.createDataFrame([r], "k long, a string, b string") for r in ((1, "1", "12"), (1, "11", "2")))
    assert proof.differences(x, y, ["k"], ["k", "a", "b"]).count() == 2 and not proof.proved(x, x.limit(0), ["k"], ["a"])


def test_differences_take_one_set_of_sums(spark, tmp_path):
    d = spark.createDataFrame([(i, f"t{i}") for i in range(300)] + [(7, "t7"), (None, None)], "k long, b string")
    other = d.where("k <> 3 OR k IS NULL").withColumn("b", F.when(F.col("k") == 8, "x").otherwise(F.col("b")))
    for n, x in (("l", d), ("r", other)):
        x.write.parquet(str(tmp_path / n))
    left, right = (spark.read.parquet(str(tmp_path / n)) for n in "lr")
    found = proof.differences(left, right, ["k"], ["k", "b"])
    assert sorted(map(tuple, found.collect())) == [(3, 1, 0), (8, 0, 1), (8, 1, 0)]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") <= 6  # (the rows of each side; the sums of both, planned with either side, are one exchange)
    # a row that is there twice and once, two that are on one side alone; totals over buckets are those of all rows
    a, b = (spark.createDataFrame([(1, v) for v in vs], "k long, b string") for vs in ("xxyy", "xzz"))
    assert sorted(map(tuple, proof.differences(a, b, ["k"], ["k", "b"]).collect())) == [(1, 0, 2), (1, 2, 0), (1, 2, 1)]
    by = proof.digests(proof.bucketed(d, ["k"], [F.col("k"), F.col("b")]), "_bucket").agg(*[F.sum(p).cast("decimal(38,0)").alias(p) for p in ("n", *proof.PARTS)]).first()
    assert list(map(int, proof.digests(proof.bucketed(d, ["k"], [F.col("k"), F.col("b")])).first())) == list(map(int, by))


def test_pruned_snapshots_are_gone(spark, tmp_path):
    path = str(tmp_path / "s")
    for day in ("2024-01-01", "2024-01-02", "2024-01-05"):
        files.snapshot(spark.range(3), path, day)
    assert files.pruned(spark, path, "2024-01-05", 3) == ["2024-01-01"]
    assert files.restored(spark, path, "2024-01-02").count() == 3 and files.restored(spark, path, "2024-01-01").count() == 0
    assert files.pruned(spark, path, "2024-01-05", 3) == []


def test_a_batch_that_is_run_twice_is_added_once(spark, tmp_path):
    path = str(tmp_path / "log")
    a, b = spark.range(5).toDF("n"), spark.range(5, 8).toDF("n")
    for batch, rows in ((0, a), (1, b), (1, b), (0, a)):
        logs.write_batch(rows, batch, path)
    assert sorted(r["n"] for r in spark.read.parquet(path).collect()) == list(range(8))


def test_log_of_a_stream(spark, tmp_path):
    given, out = str(tmp_path / "in"), str(tmp_path / "out")
    rows = [("act", "t", AT, "\t1.1.1.1 ,2.2.2.2"), ("act", None, AT, " ,3.3.3.3"), ("act", "t", AT, None)]
    spark.createDataFrame(rows, "action string, entity_type string, at timestamp_ntz, forwarded string").coalesce(1).write.parquet(given)
    stream = logs.audit_rows(spark.readStream.schema("action string, entity_type string, at timestamp_ntz, forwarded string").parquet(given))
    for _ in range(2):  # the second run finds nothing new
        q = logs.appended(stream, out, str(tmp_path / "c")).trigger(availableNow=True).start()
        assert q.awaitTermination(60)
    got = spark.read.parquet(out).collect()
    assert sorted(r["ip_address"] for r in got) == ["1.1.1.1", "local", "local"] and {r["batch"] for r in got} == {0} and all(r["actor_id"] is None for r in got)


def test_usage_rows(spark):
    d = spark.createDataFrame([(1, 2, "assistant", "m", 5, 6, 7, True, AT, "secret question")], "office_id long, user_id long, feature string, model string, input_tokens long, output_tokens long, latency_ms long, success boolean, at timestamp_ntz, prompt string")
    r = logs.usage_rows(d)
    assert "prompt" not in r.columns and r.first()["error_code"] is None
    with pytest.raises(Exception, match="unknown feature"):
        logs.usage_rows(d.withColumn("feature", F.lit("other"))).collect()


def test_notes_of_documents(spark):
    rows = [(1, "a", "x/y.pdf", "s", b"12345", 1), (2, "a", "b", "s", b"1234567", 2), (3, "a", None, "s", b"12345", 3), (4, "a", "c", None, b"1", 4), (5, "a", "c", "/uploads/c", b"1", 5), (6, "a", "c", "s", None, 6), (7, None, "n" * 200, "s", b"1", 7)]
    d = spark.createDataFrame(rows, "id long, tenant string, name string, url string, content binary, created_at int")
    got = {r["id"]: (r["file"], r["note"]) for r in exports.noted(d, 10).collect()}
    assert got == {1: ("documents/1-x_y.pdf", None), 2: (None, exports.NO_ROOM), 3: ("documents/3-", None), 4: (None, exports.NO_FILE), 5: (None, exports.OLD_FILE), 6: (None, exports.LOST_FILE), 7: ("documents/7-" + "n" * 148, None)}


def test_archives_have_volumes(spark, tmp_path):
    path = str(tmp_path / "zips")
    rows = [(t, f"e{i}", k, f"{t}{i}.{k};".encode() * 50) for t in ("a", None) for i in range(12) for k in (1, 0)]
    archive.write(spark.createDataFrame(rows, "tenant string, entry string, seq int, content binary"), path, volume_bytes=2000)
    got = archive.read(spark, path).collect()
    assert len(got) == 24 and len({(r["tenant"], r["volume"]) for r in got}) > 4
    assert all(bytes(r["content"]) == b"".join(f"{r['tenant'] or None}{r['entry'][1:]}.{k};".encode() * 50 for k in (0, 1)) for r in got)
    archive.write(spark.createDataFrame([("c", "e", 0, b"x")], "tenant string, entry string, seq int, content binary"), path)
    assert archive.read(spark, path).count() == 25 and archive.read(spark, str(tmp_path / "none")).count() == 0


def test_a_failed_export_task_leaves_neither_duplicates_nor_orphans(tmp_path):
    code = f"""
import sys
sys.path.insert(0, {str(Path(__file__).resolve().parents[1])!r})
from pathlib import Path
from caseloom.session import session
from caseloom.sources import archive
from pyspark import TaskContext
from pyspark.sql import functions as F
spark = session("t", "local[2,3]")
spark.dataSource.register(archive.Archives)
@F.udf("binary")
def body(i):
    if i == 59 and TaskContext.get().attemptNumber() == 0:
        raise RuntimeError("lost")
    return bytes([i]) * 100
at = {str(tmp_path / "zips")!r}
rows = spark.range(60).coalesce(1).select(F.floor(F.col("id") / 6).cast("string").alias("tenant"), F.lit(0).alias("volume"), F.concat(F.lit("e"), F.col("id").cast("string")).alias("entry"), F.lit(0).cast("long").alias("seq"), body("id").alias("content"))
rows.write.format("caseloom_archive").option("path", at).mode("append").save()
assert archive.read(spark, at).count() == 60
assert len(list(Path(at).glob("*.zip"))) == 10  # those of the first attempt are gone
before = sorted(p.name for p in Path(at).iterdir())
try:
    rows.withColumn("content", F.raise_error(F.lit("no")).cast("binary")).write.format("caseloom_archive").option("path", at).mode("append").save()
    raise SystemExit(3)
except Exception as e:
    assert "no" in str(e)
assert sorted(p.name for p in Path(at).iterdir()) == before
"""
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=200)
    assert done.returncode == 0, done.stderr[-3000:]
