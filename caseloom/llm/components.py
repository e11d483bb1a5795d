"""Connected components of an edge table, by alternating star contractions.

Every round is two grouped minima joined back to the edges, so a hub with
millions of neighbours is an aggregate and a (splittable) join, never one
task's list.  Rounds are written to the shared folder; the number of rounds is
logarithmic in practice.  Nothing but two numbers a round reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .shared import drop, saved


def _large_star(e: DataFrame) -> DataFrame:
    both = e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
    return both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(e: DataFrame) -> DataFrame:
    low = e.groupBy("a").agg(F.min("b").alias("m"))
    moved = e.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(low.select("a", F.col("m").alias("b")))


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) of every node that has an edge to another node.

    ``edges``: two long columns.  Null ends and loops are ignored; repeated
    edges count once.  The component is the smallest node of its class.
    """
    spark = edges.sparkSession
    a, b = edges.columns
    e = (
        edges.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b"))
        .where("a <> b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct()
    )
    e, path = saved(e, "edges")
    before = None
    for _ in range(max_rounds):
        mark = e.agg(F.count("*"), F.expr("bit_xor(xxhash64(a, b))")).first()
        if mark[0] == 0 or mark == before:
            break
        before = mark
        nxt, nxt_path = saved(_small_star(_large_star(e).distinct()).where("a <> b").distinct(), "edges")
        drop(spark, path)
        e, path = nxt, nxt_path
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )
