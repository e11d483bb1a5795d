"""Written tables that cut a plan: in the folder that ``spark.checkpoint.dir`` names, which the driver and all executors share."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

_LEFT: dict[str, SparkSession] = {}


def folder(spark: SparkSession) -> str:
    """The shared folder; a local session without one (as in tests) gets one made."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or "-cluster" in master:
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    made = "file://" + tempfile.mkdtemp(prefix="caseloom-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def place(spark: SparkSession, name: str) -> str:
    """A new path in it, deleted at exit."""
    path = f"{folder(spark)}/caseloom/{name}-{uuid.uuid4().hex[:12]}"
    _LEFT[path] = spark
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet and read back: a lost executor costs a task's work, never the plan before it."""
    path = place(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ranged(df: DataFrame, parts: int, order: list[Column | str], name: str) -> DataFrame:
    """``df`` dealt to partitions by ranges of ``order`` and sorted, with each row's partition (part) and place in it (seq); written."""
    dealt = df.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    return written(dealt.withColumn("part", F.shiftright("_at", 33)).withColumn("seq", F.col("_at").bitwiseAND((1 << 33) - 1)).drop("_at"), name)


def delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


@atexit.register
def _clean() -> None:
    with contextlib.suppress(Exception):  # the session may be gone
        for path, spark in list(_LEFT.items()):
            delete(spark, path)
