"""Writes as transformations: the table after the write, from the table before it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import trim_all


def patched(df: DataFrame, patch: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """A sparse update. patch: key, and for each column c its value and has_c; a value counts only where has_c is true (null clears)."""
    p = patch.select(F.col(key).alias("_key"), *[F.col(c).alias(f"_{c}") for c in columns], *[F.col(f"has_{c}").alias(f"_has_{c}") for c in columns])
    out = df.join(p, df[key] == p["_key"], "left")
    new = {c: F.when(F.coalesce(F.col(f"_has_{c}"), F.lit(False)), F.col(f"_{c}")).otherwise(F.col(c)) for c in columns}
    return out.select(*[new[c].alias(c) if c in new else F.col(c) for c in df.columns])


def inserted(raw: DataFrame, required: list[str], optional: list[str] = (), lower: tuple[str, ...] = (), **defaults: Column) -> DataFrame:
    """New rows from raw ones: required texts trimmed (rows that lack one are left out), optional ones trimmed and null if blank,
    ``lower`` in lower case; other columns from ``defaults``."""
    trimmed = {c: trim_all(F.col(c)) for c in (*required, *optional)}
    whole = reduce(lambda a, b: a & b, [F.coalesce(trimmed[c] != "", F.lit(False)) for c in required], F.lit(True))
    values = {c: F.nullif(v, F.lit("")) for c, v in trimmed.items()}
    values |= {c: F.lower(values[c]) for c in lower} | defaults
    return raw.where(whole).select(*[values.get(c, F.col(c)).alias(c) for c in dict.fromkeys([*raw.columns, *values])])


def updated(df: DataFrame, where: Column, **values: Column) -> DataFrame:
    """A bulk update of the rows that a predicate picks."""
    hit = F.coalesce(where, F.lit(False))
    return df.select(*[F.when(hit, values[c]).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in df.columns])


def deleted(df: DataFrame, keys: DataFrame, key: str = "id") -> DataFrame:
    return df.join(keys.select(F.col(key)), key, "left_anti")


def detached(gone: DataFrame, owned: dict[str, DataFrame], linked: dict[str, DataFrame], key: str = "case_id") -> tuple[dict[str, DataFrame], DataFrame]:
    """Deleting parents (gone: id): rows of ``owned`` tables go too, rows of ``linked`` ones lose their link.

    Returns the tables afterwards and (name, n): how many rows of each were touched."""
    ids = gone.select(F.col("id").alias(key)).distinct()
    after = {n: t.join(ids, key, "left_anti").select(*t.columns) for n, t in owned.items()}
    mark = ids.withColumnRenamed(key, "_gone")
    for n, t in linked.items():
        out = t.join(mark, t[key] == mark["_gone"], "left")
        after[n] = out.select(*[F.when(F.col("_gone").isNull(), F.col(c)).alias(c) if c == key else F.col(c) for c in t.columns])
    counts = None
    for n, t in {**owned, **linked}.items():
        part = t.join(ids, key, "left_semi").agg(F.count("*").alias("n")).select(F.lit(n).alias("name"), "n")
        counts = part if counts is None else counts.unionByName(part)
    return after, counts


def upserted(df: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """Rows replace those with their key and are added where there is none."""
    same = [c for c in df.columns if c != key]
    r = rows.select(F.col(key).alias("_key"), *[F.col(c).alias(f"_{c}") for c in same])
    out = df.join(r, df[key] == r["_key"], "full")
    new = F.col("_key").isNotNull()
    return out.select(F.coalesce(F.col(key), F.col("_key")).alias(key), *[F.when(new, F.col(f"_{c}")).otherwise(F.col(c)).alias(c) for c in same]).select(*df.columns)


def backfilled(df: DataFrame, column: str, *sources: Column) -> DataFrame:
    """Nulls of a column filled from the first source that has a value."""
    return df.withColumn(column, F.coalesce(F.col(column), *sources))


def notices(changes: DataFrame) -> DataFrame:
    """(user_id, case_id, kind) for changes (case_id, owner_id, actor_id, old/new status and lawyer_id) that the owner did not make.

    One notice for a changed status, one for a changed lawyer."""
    kinds = F.filter(
        F.array(F.when(~F.col("old_status").eqNullSafe(F.col("new_status")), F.lit("status")), F.when(~F.col("old_lawyer_id").eqNullSafe(F.col("new_lawyer_id")), F.lit("assignment"))),
        lambda x: x.isNotNull(),
    )
    return changes.where(F.col("owner_id") != F.col("actor_id")).select(F.col("owner_id").alias("user_id"), "case_id", F.explode(kinds).alias("kind"))
