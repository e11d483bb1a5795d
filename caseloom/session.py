"""One session for applications and tests."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(name: str = "caseloom", master: str | None = None, **conf: str) -> SparkSession:
    """UTC, adaptive execution on; other settings are the cluster's own unless given."""
    b = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    b = b.config("spark.sql.adaptive.skewJoin.enabled", "true")
    if master:
        b = b.master(master).config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "8")
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    return b.getOrCreate()
