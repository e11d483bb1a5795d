"""Data-quality queries: mismatches, orphans, duplicates, counts and drift."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F


def mismatches(child: DataFrame, parent: DataFrame, foreign: str, mine: str, theirs: str, key: str = "id") -> DataFrame:
    """Children whose ``mine`` differs from their parent's ``theirs`` (nulls differ from nothing)."""
    p = parent.select(F.col(key).alias("_key"), F.col(theirs).alias("_theirs"))
    return child.join(p, child[foreign] == p["_key"]).where(F.col(mine) != F.col("_theirs")).drop("_key")


def orphans(child: DataFrame, parent: DataFrame, foreign: str, key: str = "id") -> DataFrame:
    """Children that name a parent which isn't there; a null name is no orphan."""
    return child.where(F.col(foreign).isNotNull()).join(parent.select(F.col(key).alias(foreign)), foreign, "left_anti")


def childless(parent: DataFrame, child: DataFrame, foreign: str, key: str = "id") -> DataFrame:
    return parent.join(child.select(F.col(foreign).alias(key)), key, "left_anti")


def duplicates(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """(name, n) of each table."""
    parts = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n") for name, df in sorted(tables.items())]
    return reduce(lambda a, b: a.unionByName(b), parts)


def drift(now: DataFrame, before: DataFrame) -> DataFrame:
    """Counts (name, n) beside those of a baseline; shrunk where there are fewer now or none."""
    b = before.select("name", F.col("n").alias("before"))
    out = now.join(b, "name", "full")
    return out.withColumn("shrunk", F.coalesce("n", F.lit(0)) < F.coalesce("before", F.lit(0)))


def violations(checks: dict[str, DataFrame]) -> DataFrame:
    """(name, n) of rows that each check finds."""
    return row_counts(checks)
