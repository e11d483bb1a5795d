from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from caseloom.operators import limiter
from caseloom.sources import files
from caseloom.streaming import folds as streams


def test_uploads_by_size_extension_and_content(spark, tmp_path):
    for name, body in {"a.pdf": b"%PDF-1", "b.pdf": b"nope\x00", "c.exe": b"MZ", "d.txt": b"%PDF is only text here", "e.txt": b"", "f.jpeg": b"\xff\xd8\xff\xe0", "g.xlsx": b"PK\x03", "h.xls": b"PK"}.items():
        (tmp_path / name).write_bytes(body)
    got = {r["path"].rpartition("/")[2]: r["reason"] for r in files.accepted(files.binary(spark, str(tmp_path))).collect()}
    assert got == {"a.pdf": None, "b.pdf": "content", "c.exe": "extension", "d.txt": None, "f.jpeg": None, "g.xlsx": None, "h.xls": "content"}
    none = spark.createDataFrame([("/x/e.txt", 0, b"")], "path string, length long, content binary")  # (the binary reader leaves out empty files)
    assert files.accepted(none).first()["reason"] == "empty"
    typed = files.binary(spark, str(tmp_path), "a.pdf").withColumn("media", F.lit("text/html"))
    assert files.accepted(typed, "media").first()["reason"] == "media_type"
    assert files.within(typed, str(tmp_path)).count() == 1
    with pytest.raises(Exception, match="outside the root"):
        files.within(typed, str(tmp_path / "sub")).collect()
    assert files.newest(files.binary(spark, str(tmp_path))).first()["path"] is not None


def test_export_keeps_to_the_allowed_columns(spark, tmp_path):
    users = spark.createDataFrame([(1, "n", "hash")], "id int, name string, password string")
    manifest = files.export({"users": users}, {"users": ["id", "name"]}, str(tmp_path / "out"))
    assert [tuple(r) for r in manifest.collect()] == [("users", 1)]
    assert spark.read.json(str(tmp_path / "out/users")).columns == ["id", "name"]


def test_snapshots(spark, tmp_path):
    path = str(tmp_path / "s")
    files.snapshot(spark.range(3), path, "2024-01-01")
    files.snapshot(spark.range(5), path, "2024-01-02")
    files.snapshot(spark.range(4), path, "2024-01-02")
    assert files.restored(spark, path, "2024-01-01").count() == 3 and files.restored(spark, path, "2024-01-02").count() == 4
    days = spark.read.parquet(path).select("snapshot_day").distinct()
    assert files.expired(days, "snapshot_day", "2024-01-05", 3).count() == 1


def test_requests(spark):
    d = spark.createDataFrame([('{"a":1}',), ("{",), (None,)], "body string")
    assert [r["status"] for r in files.requests(d, "body", "a int").collect()] == [200, 400, 400]


@pytest.fixture
def event_dir(spark, tmp_path):
    at = [0, 10, 20, 30, 59, 60, 200, 201]
    rows = [(i, i % 2, datetime(2024, 1, 1) + timedelta(seconds=s)) for i, s in enumerate(at)]
    path = str(tmp_path / "events")
    spark.createDataFrame(rows, "event_id long, user_id long, ts timestamp").coalesce(1).write.parquet(path)
    return path


def test_streamed_limiter_equals_the_batch(spark, event_dir, tmp_path):
    stream = spark.readStream.schema("event_id long, user_id long, ts timestamp").parquet(event_dir)
    q = streams.limiter(stream, "user_id", 60, 2).writeStream.format("memory").queryName("limited").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {r["event_id"]: (r["n"], r["limited"]) for r in spark.table("limited").collect()}
    batch = limiter.limited(spark.read.parquet(event_dir).withColumn("ts", F.col("ts").cast("timestamp_ntz")), "user_id", 60, 2)
    assert got == {r["event_id"]: (r["n"], r["limited"]) for r in batch.collect()}


def test_streamed_first_only(spark, tmp_path):
    path = str(tmp_path / "r")
    rows = [("a", datetime(2024, 1, 1)), ("a", datetime(2024, 1, 1, 0, 1)), ("b", datetime(2024, 1, 1))]
    spark.createDataFrame(rows, "token string, ts timestamp").coalesce(1).write.parquet(path)
    stream = spark.readStream.schema("token string, ts timestamp").parquet(path)
    q = streams.first_only(stream, ["token"]).writeStream.format("memory").queryName("firsts").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(r["token"] for r in spark.table("firsts").collect()) == ["a", "b"]


def test_synthetic_practice_is_whole(spark):
    from caseloom.operators import integrity
    from caseloom.sources.synthetic import practice

    p = practice(spark, 3, 4)
    assert {n: df.count() for n, df in p.items()} == {"offices": 3, "staff": 9, "clients": 12, "cases": 12, "hearings": 12, "invoices": 12}
    assert integrity.orphans(p["cases"], p["staff"], "owner_id").count() == 0 and integrity.orphans(p["invoices"], p["cases"], "case_id").count() == 0
    assert integrity.mismatches(p["cases"], p["clients"], "client_id", "office_id", "office_id").count() == 0
