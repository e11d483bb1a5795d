"""Federated substring search: case and accents do not matter."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

FOLDED = "UNICODE_CI_AI"


LONGEST, SHORTEST = 120, 2


def asked(query: str | None) -> str | None:
    """What is searched for: without white space around it, cut; None if that is too short to search."""
    q = (query or "").strip()[:LONGEST]
    return q if len(q) >= SHORTEST else None


def holds(column: Column | str, query: str) -> Column:
    """Whether the text contains the query, folded; false for null."""
    c = F.col(column) if isinstance(column, str) else column
    return F.coalesce(F.contains(F.collate(c, FOLDED), F.collate(F.lit(query), FOLDED)), F.lit(False))


def bucket(df: DataFrame, kind: str, label: str, where: list[str], query: str | None, size: int = 8) -> DataFrame:
    """(kind, id, label): the first ``size`` hits by label and id. Hits are cut to a top-k before anything is joined to them."""
    if query is None:
        df, query = df.limit(0), ""
    hit = reduce(lambda a, b: a | b, [holds(c, query) for c in where])
    out = df.where(hit).select(F.lit(kind).alias("kind"), F.col("id").cast("long").alias("id"), F.col(label).cast("string").alias("label"))
    return out.orderBy("label", "id").limit(size)


def federated(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), parts)
