"""A table as a stream: its rows come in order, in micro-batches, through a streaming operator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from .. import tables


def replayed(df: DataFrame, order: str, operator: Callable[[DataFrame], DataFrame], batches: int = 3, name: str = "replay") -> DataFrame:
    """What ``operator`` writes when the rows of ``df`` come in as many batches as given, by ranges of ``order`` (a moment).

    Every batch is a write to a folder that a file stream reads; the result is a file sink's, so a query that is
    started again neither loses nor repeats rows."""
    spark = df.sparkSession
    given, out, state = (tables.place(spark, f"{name}-{x}") for x in ("given", "out", "state"))
    moment = F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.col(order).cast("timestamp_ntz"))
    at = df.select(moment.cast("double").alias("at")).approxQuantile("at", [k / batches for k in range(1, batches)], 0.01)
    parts = spark.conf.get("spark.sql.shuffle.partitions")
    df.limit(0).write.parquet(given)
    # the number of state stores is fixed as a query starts: as many as the cluster's cores
    spark.conf.set("spark.sql.shuffle.partitions", str(spark.sparkContext.defaultParallelism))
    try:
        found = operator(spark.readStream.schema(df.schema).parquet(given))
        for low, high in zip([None, *at], [*at, None], strict=True):
            here = (F.lit(True) if low is None else moment >= low) & (F.lit(True) if high is None else moment < high)
            df.where(F.coalesce(here, F.lit(low is None))).write.mode("append").parquet(given)
            # every batch is a run of its own that goes on from the checkpoint
            q = found.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).outputMode("append").trigger(availableNow=True).start()
            q.awaitTermination()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", parts)
    return spark.read.schema(found.schema).parquet(out)
