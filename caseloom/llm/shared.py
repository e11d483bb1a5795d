"""Tables in the folder that the driver and all executors share.

Long lineages are cut by writing a table to the folder named by
``spark.checkpoint.dir`` and reading it back, so a lost executor costs one
task's work and never the table.  The folder is read from the session; only a
local session without the setting (as in tests) gets one made for it.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

_LEFT: dict[str, SparkSession] = {}


def shared_dir(spark: SparkSession) -> str:
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if "-cluster" in spark.sparkContext.master:
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    made = "file://" + tempfile.mkdtemp(prefix="caseloom-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def slices(batches: Iterator, rows: int = 1000) -> Iterator:
    """Arrow batches in slices of at most so many rows, for what a task makes of a slice is larger than its texts.

    (Spark bounds the bytes of a batch by spark.sql.execution.arrow.maxBytesPerBatch, 64 MB by default.)"""
    for b in batches:
        for k in range(0, b.num_rows, rows):
            yield b.slice(k, rows)


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/caseloom/{name}-{uuid.uuid4().hex[:12]}"
    _LEFT[path] = spark
    return path


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def drop(spark: SparkSession, *paths: str) -> None:
    """Delete tables that no later plan reads."""
    for path in paths:
        if _LEFT.pop(path, None) is not None:
            _delete(spark, path)


def saved(df: DataFrame, name: str, partition_by: str | None = None) -> tuple[DataFrame, str]:
    """``df`` written as Parquet to the shared folder and read back; its path."""
    spark = df.sparkSession
    path = new_path(spark, name)
    out = df.write.option("compression", "zstd" if name.endswith("_z") else "snappy")
    if partition_by:
        out = out.partitionBy(partition_by)
    out.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


@atexit.register
def _clean() -> None:
    for path, spark in list(_LEFT.items()):
        try:
            _delete(spark, path)
        except Exception:  # noqa: BLE001  the session may be gone already
            return
