"""Proof that two row sets are the same, and where they are not: digests that do not depend on the order of rows.

A row's digest is the MD5 of its columns' texts, each with a mark for null; a row
set's is the number of its rows and the sums of the digests' four 32-bit parts,
which partial sums make in any order and any partitioning.  Sets are compared from
coarse to fine: the totals, then buckets of keys, and rows only of buckets that
differ, so that a restored table of which nothing was lost costs two scans.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

PARTS = ("a", "b", "c", "d")


def row_digest(columns: list[Column]) -> Column:
    texts = [F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-")) for c in columns]
    return F.md5(F.concat(*texts).cast("binary"))


def _parts(digest: str) -> list[Column]:
    """Its four 32-bit parts as longs, whose sums are exact for 2^31 rows."""
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("bigint") for k in range(len(PARTS))]


def _halves(digest: str) -> list[Column]:
    """128 bits of hashes of it as four 32-bit parts: for comparison alone, at a fraction of what its hex digits cost to read."""
    hashes = [F.xxhash64(digest), F.xxhash64(digest, F.lit(1))]
    return [x for h in hashes for x in (F.shiftrightunsigned(h, 32), h.bitwiseAND(F.lit(0xFFFFFFFF)))]


def bucketed(df: DataFrame, key: list[str], columns: list[Column], hex_digits: int = 2) -> DataFrame:
    """df with its row digest (_digest) and the bucket of its key (_bucket): the first digits of the key's MD5."""
    return df.withColumn("_digest", row_digest(columns)).withColumn("_bucket", F.substring(row_digest([F.col(k) for k in key]), 1, hex_digits))


def digests(df: DataFrame, by: str | None = None) -> DataFrame:
    """(n, a, b, c, d) of a bucketed df, for each value of ``by`` if given.

    Sums are longs within a bucket (a text cast to a decimal and decimal sums cost more than the MD5), decimals over buckets."""
    inner = df.groupBy(*dict.fromkeys([*([by] if by else []), "_bucket"])).agg(F.count("*").alias("n"), *[F.sum(x).alias(p) for p, x in zip(PARTS, _parts("_digest"), strict=True)])
    whole = [F.col(p).cast("decimal(38,0)") for p in PARTS]
    if by == "_bucket":
        return inner.select("_bucket", "n", *whole)
    n = F.coalesce(F.sum("n"), F.lit(0)).alias("n")
    return (inner.groupBy(by) if by else inner.groupBy()).agg(n, *[F.sum(x).cast("decimal(38,0)").alias(p) for p, x in zip(PARTS, whole, strict=True)])


def differences(left: DataFrame, right: DataFrame, key: list[str], columns: list[str], hex_digits: int = 2) -> DataFrame:
    """``key``, in_left and in_right (how many rows of it, as they are) of every row that is not in both as often.

    A changed row is two: one only left, one only right.  Both sides are one set whose right rows count against the left
    ones: a bucket is uneven if its sums are not zero, and only rows of uneven buckets are compared, by one aggregate."""
    sides = (bucketed(d.select(*key, *[c for c in columns if c not in key]), key, [F.col(c) for c in columns], hex_digits) for d in (left, right))
    marked = (d.select(*key, "_digest", "_bucket", F.lit(x).alias("_left"), F.lit(1 - x).alias("_right")) for d, x in zip(sides, (1, 0), strict=True))
    both = next(marked).unionByName(next(marked))
    sign = F.col("_left") - F.col("_right")
    sums = both.groupBy("_bucket").agg(F.sum(sign).alias("n"), *[F.sum(x * sign).alias(p) for p, x in zip(PARTS, _halves("_digest"), strict=True)])
    uneven = sums.where(" OR ".join(f"{x} <> 0" for x in ("n", *PARTS))).select("_bucket")  # 16^hex_digits rows at most
    rows = both.join(F.broadcast(uneven), "_bucket", "left_semi").groupBy(*key, F.unhex("_digest").alias("_digest"))
    return rows.agg(F.sum("_left").alias("in_left"), F.sum("_right").alias("in_right")).where("in_left <> in_right").drop("_digest")


def proved(left: DataFrame, right: DataFrame, key: list[str], columns: list[str]) -> bool:
    """Whether both have the same rows, by their totals alone."""
    a, b = (digests(bucketed(d, key, [F.col(c) for c in columns])).first() for d in (left, right))
    return tuple(a) == tuple(b)
