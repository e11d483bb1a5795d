"""Lookups of single rows: filters that reach the scan, and one row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row, functions as F


def by_key(df: DataFrame, **keys: object) -> DataFrame:
    """The row with this unique key, simple or compound, if there is one."""
    for name, value in keys.items():
        df = df.where(F.col(name).isNull() if value is None else F.col(name) == F.lit(value))
    return df.limit(1)


def first_match(df: DataFrame, where: Column, *order: str) -> DataFrame:
    """The first row, in this order, that a predicate (a scope, an id) picks; planned as a top one."""
    return df.where(where).orderBy(*order).limit(1)


def required(df: DataFrame) -> DataFrame:
    """The first row of a lookup, as a plan that fails if there is none."""
    there = df.limit(1).select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row"))
    one = df.sparkSession.range(1).join(there, F.lit(True), "left")
    return one.where(F.when(F.col("_row").isNull(), F.raise_error(F.lit("no such row")).cast("boolean")).otherwise(True)).select("_row.*")


def found(df: DataFrame) -> Row:
    """The row of a lookup; an error if there is none."""
    row = df.first()
    if row is None:
        raise LookupError("no such row")
    return row
