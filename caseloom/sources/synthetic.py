"""A deterministic practice of any size, from ranges and expressions only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def practice(spark: SparkSession, offices: int = 5, each: int = 8) -> dict[str, DataFrame]:
    """offices, staff (a manager and two lawyers each), clients, cases, hearings and invoices (``each`` of them an office)."""
    rows = spark.range(offices * each).withColumn("office_id", F.expr(f"id div {each}"))
    at = F.expr("timestamp_ntz'2024-01-01' + make_dt_interval(cast(id % 365 as int))")
    status = F.element_at(F.array(*map(F.lit, ("ACTIVE", "PENDING", "CLOSED", "SUSPENDED"))), (F.col("id") % 4 + 1).cast("int"))
    staff = spark.range(offices * 3).select(
        "id", F.expr("id div 3").alias("office_id"), F.when(F.col("id") % 3 == 0, "OFFICE_MANAGER").otherwise("LAWYER").alias("role")
    )
    cases = rows.select("id", "office_id", F.col("id").alias("client_id"), (F.col("office_id") * 3 + F.col("id") % 3).alias("owner_id"), status.alias("status"), at.alias("created_at"))
    amount = (F.col("id") * 37 % 1000 + 100).cast("double")
    return {
        "offices": spark.range(offices).select("id", F.concat(F.lit("Office "), F.col("id").cast("string")).alias("name")),
        "staff": staff,
        "clients": rows.select("id", "office_id", (F.col("office_id") * 3 + F.col("id") % 3).alias("owner_id"), F.concat(F.lit("Client "), F.col("id").cast("string")).alias("name")),
        "cases": cases,
        "hearings": rows.select("id", F.col("id").alias("case_id"), at.alias("date"), F.lit("UPCOMING").alias("status")),
        "invoices": rows.select("id", F.col("id").alias("client_id"), F.when(F.col("id") % 3 > 0, F.col("id")).alias("case_id"), amount.alias("amount"), F.when(F.col("id") % 2 == 0, amount).otherwise(0.0).alias("paid")),
    }
