"""Nested results: a parent's children as a sorted array of structs, all or the first few."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F


def top_per(df: DataFrame, by: str | list[str], order: list[Column], n: int) -> DataFrame:
    """The first n rows of each key; limited before the shuffle where Spark can."""
    keys = [by] if isinstance(by, str) else by
    return df.withColumn("_i", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col("_i") <= n).drop("_i")


def first_per(df: DataFrame, by: str, order: list[str], *columns: str) -> DataFrame:
    """One row a key: the columns of its first row by ``order`` (an aggregate, not a window)."""
    at = F.min_by(F.struct(*columns), F.struct(*order)).alias("_first")
    return df.groupBy(by).agg(at).select(by, *[F.col(f"_first.{c}").alias(c) for c in columns])


def children(df: DataFrame, by: str, fields: list[str], name: str) -> DataFrame:
    """(by, name): each key's rows as an array of structs in the order of their fields."""
    return df.groupBy(by).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias(name))


def attach(parents: DataFrame, nested: DataFrame, key: str, by: str, name: str) -> DataFrame:
    """Parents with their array, empty where they have no children."""
    kind = nested.schema[name].dataType.simpleString()
    out = parents.join(nested.withColumnRenamed(by, "_by"), F.col(key) == F.col("_by"), "left").drop("_by")
    return out.withColumn(name, F.coalesce(name, F.expr(f"cast(array() as {kind})")))


def signatures(signed: DataFrame, files: DataFrame, staff: DataFrame) -> DataFrame:
    """Signatures (document_id, image_id, signer_id, signed_at) with the names of the document, of the image and of the signer.

    The file table stands in two roles; a signature whose image or signer is gone keeps its row."""
    doc = files.select(F.col("id").alias("document_id"), F.col("name").alias("document"))
    image = files.select(F.col("id").alias("image_id"), F.col("name").alias("image"))
    signer = staff.select(F.col("id").alias("signer_id"), F.col("name").alias("signer"))
    return signed.join(doc, "document_id").join(image, "image_id", "left").join(signer, "signer_id", "left")


def numbered(df: DataFrame, by: list[str], order: list[Column], name: str = "place") -> DataFrame:
    """Ordinals from 1 within each key, as a list shows them after its filters."""
    return df.withColumn(name, F.row_number().over(W.partitionBy(*by).orderBy(*order)))
