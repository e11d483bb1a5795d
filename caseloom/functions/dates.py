"""Dates, durations and numbers as Column expressions. Nothing reads the clock; now is always a column."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def micros(c: Column) -> Column:
    return F.unix_micros(c.cast("timestamp"))


def age(at: Column, now: Column) -> Column:
    """just now, minutes, hours or days since."""
    s = F.floor((micros(now) - micros(at)) / 1000000)
    n = lambda d: F.floor(s / d).cast("string")
    return F.when(s < 60, "now").when(s < 3600, F.concat(n(60), F.lit("m"))).when(s < 86400, F.concat(n(3600), F.lit("h"))).otherwise(F.concat(n(86400), F.lit("d")))


def h_mm(minutes: Column) -> Column:
    return F.concat(F.floor(minutes / 60).cast("string"), F.lit(":"), F.lpad((minutes % 60).cast("string"), 2, "0"))


def minutes_of(h_mm_: Column) -> Column:
    p = F.split(h_mm_, ":")
    return F.try_element_at(p, F.lit(1)).try_cast("int") * 60 + F.coalesce(F.try_element_at(p, F.lit(2)).try_cast("int"), F.lit(0))


def hh_mm_ss(seconds: Column) -> Column:
    two = lambda c: F.when(c > 99, c.cast("string")).otherwise(F.lpad(c.cast("string"), 2, "0"))
    return F.concat_ws(":", two(F.floor(seconds / 3600)), two(F.floor(seconds / 60) % 60), two(seconds % 60))


def size_text(n: Column) -> Column:
    """Bytes as B, whole KB or MB with one decimal; halves up."""
    kb = F.floor(n / 1024 + 0.5).cast("string")
    tenths = F.floor(n / 1048576 * 10 + 0.5).cast("long")
    mb = F.concat(F.floor(tenths / 10).cast("string"), F.lit("."), (tenths % 10).cast("string"))
    return F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B"))).when(n < 1048576, F.concat(kb, F.lit(" KB"))).otherwise(F.concat(mb, F.lit(" MB")))


def half_up(c: Column) -> Column:
    """To the nearest whole number, halves towards plus infinity."""
    return F.floor(c + 0.5)


def month_grid(day: Column) -> Column:
    """struct(blanks before the first, Sunday first; days of the month)."""
    first = F.trunc(day, "month")
    return F.struct((F.dayofweek(first) - 1).alias("blanks"), F.day(F.last_day(day)).alias("days"))


def spine(spark, start: str, days: int):
    """(day): consecutive days."""
    return spark.range(days).select(F.date_add(F.lit(start).cast("date"), F.col("id").cast("int")).alias("day"))


def valid_moment(c: Column) -> Column:
    """The moment, or null if the text is none."""
    return F.try_to_timestamp(c)


def recent(at: Column, now: Column, minutes: int = 5) -> Column:
    """Within so many minutes of now, either way."""
    return F.abs(micros(now) - micros(at)) <= minutes * 60 * 1000000
