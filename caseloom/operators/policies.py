"""Limiter policies: which bucket a request counts in, how many it takes and for how long a window lasts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from . import limiter

# Fixed values: (bucket, requests a window, minutes, whose: the user's, the office's or, before there is a user, the address's alone).
POLICIES = (
    ("auth:login", 8, 1, "address"),
    ("auth:2fa-verify", 12, 1, "address"),
    ("auth:signup", 5, 10, "address"),
    ("auth:forgot-password", 5, 10, "address"),
    ("auth:reset-password", 20, 60, "address"),
    ("auth:verify-email", 10, 10, "address"),
    ("auth:verify-email:resend", 3, 15, "user"),
    ("trial-request:create", 5, 60, "address"),
    ("2fa:setup", 10, 60, "user"),
    ("2fa:enable", 10, 60, "user"),
    ("2fa:disable", 10, 60, "user"),
    ("search", 60, 1, "user"),
    ("ai:assistant", 20, 60, "user"),
    ("ai:case-analysis", 10, 60, "user"),
    ("ai:contract-draft", 10, 60, "user"),
    ("ai:contract-draft-export", 20, 60, "user"),
    ("ai:contract-review", 10, 60, "user"),
    ("ai:legal-search", 20, 60, "user"),
    ("admin:office-activate", 20, 60, "user"),
    ("admin:office-extend-trial", 20, 60, "user"),
    ("admin:office-suspend", 20, 60, "user"),
    ("audit-logs:list", 120, 60, "user"),
    ("calendar:create", 60, 60, "user"),
    ("cases:create", 120, 60, "user"),
    ("cases:update", 120, 60, "user"),
    ("cases:delete", 60, 60, "user"),
    ("citizen:create", 20, 60, "user"),
    ("clients:create", 120, 60, "user"),
    ("clients:update", 120, 60, "user"),
    ("clients:delete", 60, 60, "user"),
    ("documents:delete", 30, 60, "user"),
    ("documents:ocr", 15, 60, "user"),
    ("documents:sign", 20, 60, "user"),
    ("documents:upload", 30, 60, "user"),
    ("email:send", 20, 60, "user"),
    ("invoices:create", 120, 60, "user"),
    ("invoices:update", 120, 60, "user"),
    ("office:export", 3, 60, "office"),
    ("sessions:create", 120, 60, "user"),
    ("sessions:update", 120, 60, "user"),
    ("site-settings:update", 30, 60, "user"),
    ("team:create", 20, 60, "user"),
    ("team:update", 60, 60, "user"),
    ("timelog:create", 120, 60, "user"),
    ("timelog:update", 120, 60, "user"),
)
# Reading one case or client counts as an update, changing it as a deletion, and deleting it is free.
SHIFTED = {"GET": "update", "PATCH": "delete"}


def item_bucket(resource: Column, method: Column) -> Column:
    """The bucket of a request for one case or client; null for none."""
    verb = F.create_map(*[F.lit(x) for kv in SHIFTED.items() for x in kv])[method]
    return F.when(resource.isin("cases", "clients"), F.concat(resource, F.lit(":"), verb))


def limited(requests: DataFrame, bucket: str, user: str, office: str, address: str, time: str, id_: str, policies: tuple = POLICIES) -> DataFrame:
    """(id, bucket, n, reset_at, limited) of every request; one without a known bucket has n 0 and is let through.

    All policies are one pass: a counter's key is bucket, whose and address, its window that of its policy."""
    spark = requests.sparkSession
    table = spark.createDataFrame(list(policies), "bucket string, most int, minutes int, whose string")
    r = requests.select(F.col(id_).alias("_id"), F.col(bucket).alias("bucket"), F.col(user).alias("_user"), F.col(office).alias("_office"), F.col(address).alias("_address"), F.col(time).alias("_ts"))
    r = r.join(F.broadcast(table), "bucket", "left")  # one row a policy
    whose = F.when(F.col("whose") == "user", F.col("_user").cast("string")).when(F.col("whose") == "office", F.col("_office").cast("string"))
    key = F.to_json(F.array(F.col("bucket"), whose, F.col("_address").cast("string")))  # (nulls and separators keep their places)
    known = r.where("minutes is not null").select("_id", "_ts", key.alias("_key"), "most", (F.col("minutes") * 60).alias("_wait"))
    hits = limiter.limited(known, "_key", F.col("_wait"), F.col("most"), "_ts", "_id")
    hits = hits.select(F.col("_id").alias(id_), F.from_json("_key", "array<string>")[0].alias("bucket"), "n", "reset_at", "limited")
    free = r.where("minutes is null").select(F.col("_id").alias(id_), "bucket", F.lit(0).alias("n"), F.lit(None).cast("timestamp_ntz").alias("reset_at"), F.lit(False).alias("limited"))
    return hits.union(free)
