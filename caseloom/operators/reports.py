"""Operational reports as single-pass aggregates.

Money is summed as decimal(18,2) and returned as double, so sums do not depend
on the order of rows.  Counts per parent are aggregated before the join, so two
counts on one parent never multiply each other.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .. import tables

OPEN = ("UNPAID", "OVERDUE", "PARTIAL")


def money(c: Column | str, where: Column | None = None) -> Column:
    """Sum of an amount, 0 for none."""
    c = F.col(c) if isinstance(c, str) else c
    c = c.cast("decimal(18,2)")
    c = c if where is None else F.when(where, c)
    return F.coalesce(F.sum(c), F.lit(0).cast("decimal(18,2)")).cast("double")


def share(part: Column, whole: Column) -> Column:
    """Whole percent, halves up; 0 where the whole is 0."""
    return F.when(whole > 0, F.floor(part / whole * 100 + 0.5)).otherwise(0).cast("long")


def revenue_tiles(invoices: DataFrame) -> DataFrame:
    """Dashboard measures: revenue is what paid invoices brought in, unpaid the full amount of open ones."""
    return invoices.agg(
        money("paid", F.col("status") == "PAID").alias("revenue"), money("amount", F.col("status").isin(*OPEN)).alias("unpaid"), F.count("*").alias("n_invoices")
    )


def invoice_totals(invoices: DataFrame) -> DataFrame:
    """Report measures: all that was paid, and all that was not, whatever the status."""
    return invoices.agg(
        money("amount").alias("total"), money("paid").alias("paid"), (money("amount") - money("paid")).alias("unpaid"), F.count("*").alias("n_invoices")
    ).withColumn("unpaid", F.round("unpaid", 2))


def group_counts(df: DataFrame, key: str, name: str = "n") -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias(name))


def top_groups(df: DataFrame, key: str, n: int) -> DataFrame:
    """The n largest groups; equal ones by key."""
    return group_counts(df, key).orderBy(F.desc("n"), key).limit(n)


def group_sums(invoices: DataFrame) -> DataFrame:
    return invoices.groupBy("status").agg(money("amount").alias("amount"), money("paid").alias("paid"), F.count("*").alias("n"))


def with_counts(parents: DataFrame, key: str, **children: tuple[DataFrame, str]) -> DataFrame:
    """parents with the number of rows of each child table (name=(child, foreign key)); 0 for none."""
    for name, (child, foreign) in children.items():
        counts = child.where(F.col(foreign).isNotNull()).groupBy(F.col(foreign).alias("_key")).agg(F.count("*").alias(name))
        parents = parents.join(counts, parents[key] == counts["_key"], "left").drop("_key").withColumn(name, F.coalesce(name, F.lit(0).cast("long")))
    return parents


def shares(groups: DataFrame, n: str = "n") -> DataFrame:
    """Group counts with their share of the total and of the largest."""
    every = W.partitionBy()
    return groups.withColumn("of_total", share(F.col(n), F.sum(n).over(every))).withColumn(
        "of_largest", share(F.col(n), F.greatest(F.max(n).over(every), F.lit(1)))
    )


def pivot_counts(df: DataFrame, key: str, values: tuple[str, ...], keep: tuple[str, ...]) -> DataFrame:
    """A count column for each value, 0 for none, and their sum over ``keep``."""
    counts = [F.count_if(F.col(key) == v).alias(v.lower()) for v in values]
    out = df.agg(F.count(key).alias("total"), *counts)
    return out.withColumn("kept", sum((F.col(v.lower()) for v in keep), F.lit(0).cast("long")))


def time_conversion(entries: DataFrame) -> DataFrame:
    """Minutes in all, billable and invoiced, and what part of the billable was invoiced."""
    billable = F.coalesce(F.sum(F.when(F.col("billable"), F.col("minutes"))), F.lit(0)).cast("long")
    invoiced = F.coalesce(F.sum(F.when(F.col("billable") & F.col("invoiced"), F.col("minutes"))), F.lit(0)).cast("long")
    return entries.agg(F.coalesce(F.sum("minutes"), F.lit(0)).cast("long").alias("minutes"), billable.alias("billable"), invoiced.alias("invoiced")).withColumn(
        "conversion", share(F.col("invoiced"), F.col("billable"))
    )


def discrete_percentiles(df: DataFrame, key: str, value: str, error: Column, ps: tuple[float, ...] = (0.5, 0.95), part_rows: int = 1_000_000) -> DataFrame:
    """min, the values at place floor(n p) of the ascending values, max and the number of errors, for each key.

    Selection over ranges: rows are dealt by (key, value), equal ones to several partitions if they are many, and
    counted by partition and key; sums of the counts before a partition say in which one each place lies, and at which
    row.  Only counts meet by key, so a key may hold all rows.  Rows without a value do not count; a null key is one."""
    rows = df.where(F.col(value).isNotNull()).select(F.col(key).alias("_k"), F.col(value).alias("_v"), error.alias("_e")).withColumn("_tie", F.monotonically_increasing_id())
    rows = tables.written(rows, "percentiles-rows")
    dealt = tables.ranged(rows, max(1, math.ceil(rows.count() / part_rows)), [F.asc_nulls_first("_k"), "_v", "_tie"], "percentiles-dealt")
    runs = dealt.groupBy("part", "_k").agg(F.count("*").alias("_here"), F.min("seq").alias("_first"), F.min("_v").alias("_low"), F.max("_v").alias("_high"), F.count_if("_e").alias("_errors"))
    own = W.partitionBy("_k")  # a row a partition and key
    runs = tables.written(runs.withColumn("_before", F.sum("_here").over(own.orderBy("part")) - F.col("_here")).withColumn("_n", F.sum("_here").over(own)), "percentiles-runs")
    places = F.array(*[F.struct(F.lit(f"p{round(p * 100)}").alias("_p"), F.least(F.floor(F.col("_n") * p), F.col("_n") - 1).alias("_place")) for p in ps])
    wanted = runs.select("part", "_first", "_here", "_before", F.explode(places).alias("_w")).where("_w._place >= _before and _w._place < _before + _here")
    wanted = wanted.select("part", (F.col("_first") + F.col("_w._place") - F.col("_before")).alias("seq"), F.col("_w._p").alias("_p"))
    found = dealt.join(wanted, ["part", "seq"]).groupBy(F.struct("_k").alias("_s")).agg(*[F.max(F.when(F.col("_p") == f"p{round(p * 100)}", F.col("_v"))).alias(f"p{round(p * 100)}") for p in ps])
    whole = runs.groupBy(F.struct("_k").alias("_s")).agg(F.min("_low").alias("lowest"), F.max("_high").alias("highest"), F.sum("_errors").alias("errors"), F.sum("_here").alias("n"))
    names = [f"p{round(p * 100)}" for p in ps]
    return whole.join(found, "_s").select(F.col("_s._k").alias(key), "lowest", *names, "highest", "errors", "n")  # (structs, so that a null key meets itself)


def since_month_start(df: DataFrame, as_of: str, key: str = "created_at") -> DataFrame:
    """Rows from the start of the month on; there is no upper bound."""
    return df.where(F.col(key) >= F.date_trunc("month", F.lit(as_of).cast("timestamp")).cast("timestamp_ntz"))


def monthly_cap(log: DataFrame, tenant: Column, as_of: str, cap: int = 500) -> DataFrame:
    """Calls of each tenant this month, and whether one more is allowed (fewer than ``cap`` so far)."""
    used = since_month_start(log, as_of).groupBy(tenant.alias("tenant")).agg(F.count("*").alias("used"))
    return used.withColumn("allowed", F.col("used") < cap)
