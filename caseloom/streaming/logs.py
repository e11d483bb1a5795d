"""Log rows (audit, usage, notices) and a sink that adds each batch of them once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..functions.text import trim_all

# What the log of calls to the assistant knows them by.
FEATURES = ("assistant", "contract_review", "legal_search", "case_analysis", "contract_draft")


# What the audit log knows actions by.
ACTIONS = (
    "admin.office_activated", "admin.office_suspended", "admin.trial_extended", "ai.assistant_used", "ai.case_analyzed", "ai.contract_drafted", "ai.contract_reviewed", "ai.legal_search",
    "auth.login_failed", "auth.logout", "calendar.event_created", "calendar.event_deleted", "case.created", "case.deleted", "case.updated", "citizen.account_created",
    "client.created", "client.deleted", "client.updated", "document.deleted", "document.ocr_failed", "document.ocr_run", "document.signed", "document.uploaded",
    "email.send_blocked", "email.send_failed", "email.sent", "invoice.created", "invoice.delete_blocked", "invoice.deleted", "invoice.updated", "office.data_exported",
    "session.created", "session.deleted", "session.updated", "site_settings.updated", "team.member_created", "team.member_updated", "timelog.created", "timelog.delete_blocked", "timelog.deleted", "timelog.updated",
)


def action_kind(action: Column) -> Column:
    """struct(known, entity, deed, refused): whether the log knows an action, its two parts, and whether it records a refusal or failure."""
    deed = F.split_part(action, F.lit("."), F.lit(2))
    return F.struct(
        F.coalesce(action.isin(*ACTIONS), F.lit(False)).alias("known"), F.split_part(action, F.lit("."), F.lit(1)).alias("entity"), deed.alias("deed"),
        (F.endswith(deed, F.lit("_blocked")) | F.endswith(deed, F.lit("_failed"))).alias("refused"),
    )


def _or_null(df: DataFrame, name: str, kind: str = "string") -> Column:
    return F.col(name).cast(kind) if name in df.columns else F.lit(None).cast(kind)


def audit_rows(requests: DataFrame) -> DataFrame:
    """Audit rows of requests (action, entity_type, at and, where they have them, forwarded, real_ip, user_agent, actor_*, office_id, entity_id, metadata).

    The office is the one that the details name (office_id), or else the actor's (actor_office_id); the address that
    before the first comma of forwarded, or else real_ip, or 'local'; an actor's own e-mail goes before one given (given_email)."""
    get = lambda n, k="string": _or_null(requests, n, k)
    return requests.select(
        F.coalesce(get("office_id", "long"), get("actor_office_id", "long")).alias("office_id"), get("actor_id", "long").alias("actor_id"),
        F.coalesce(get("actor_email"), get("given_email")).alias("actor_email"), get("actor_role").alias("actor_role"), F.col("action"), get("entity_type").alias("entity_type"),
        get("entity_id").alias("entity_id"), F.coalesce(F.nullif(trim_all(F.split_part(get("forwarded"), F.lit(","), F.lit(1))), F.lit("")), F.nullif(get("real_ip"), F.lit("")), F.lit("local")).alias("ip_address"),
        get("user_agent").alias("user_agent"), get("metadata").alias("metadata"), F.col("at").alias("created_at"),
    )


def usage_rows(calls: DataFrame) -> DataFrame:
    """Rows of the log of calls: never what was asked or answered; a call of an unknown feature is an error."""
    feature = F.when(F.col("feature").isin(*FEATURES), F.col("feature")).otherwise(F.raise_error(F.concat(F.lit("unknown feature: "), F.coalesce("feature", F.lit("null")))).cast("string"))
    return calls.select(
        "office_id", "user_id", feature.alias("feature"), "model", F.col("input_tokens").cast("int").alias("input_tokens"), F.col("output_tokens").cast("int").alias("output_tokens"),
        F.col("latency_ms").cast("int").alias("latency_ms"), "success", _or_null(calls, "error_code").alias("error_code"), F.col("at").alias("created_at"),
    )


def write_batch(rows: DataFrame, batch: int, path: str) -> None:
    """Rows of a batch as its own partition, written anew if the batch is run again."""
    out = rows.withColumn("batch", F.lit(batch).cast("long")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    out.partitionBy("batch").parquet(path)


def appended(stream: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    """Adds the rows of a stream to a log, each batch once whatever is run again."""
    return stream.writeStream.foreachBatch(lambda df, batch: write_batch(df, batch, path)).option("checkpointLocation", checkpoint)
