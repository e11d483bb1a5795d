"""Decisions: subscription tiers, guards, tokens, authorization and validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import trim_all

GRACE_DAYS = 7


def _days(n: int) -> Column:
    return F.expr(f"interval {n} days")


def tier(status: Column, trial_end: Column, period_end: Column, updated: Column, as_of: Column) -> Column:
    """active, grace or blocked.

    None at all, ACTIVE and unknown states are active, CANCELED is blocked at once.  A trial is active while its end is
    open or ahead, then has a grace of seven days; PAST_DUE has it from the end of the period or, without
    one, from the last update.  The last moment of grace belongs to it.
    """

    def grace(since: Column) -> Column:
        return F.when(as_of <= since + _days(GRACE_DAYS), "grace").otherwise("blocked")

    return (
        F.when(status == "CANCELED", "blocked")
        .when(status == "TRIALING", F.when(trial_end.isNull() | (trial_end > as_of), "active").otherwise(grace(trial_end)))
        .when(status == "PAST_DUE", grace(F.coalesce(period_end, updated)))
        .otherwise("active")
    )


def grace_ends(status: Column, trial_end: Column, period_end: Column, updated: Column, as_of: Column) -> Column:
    """The last moment of grace, of states that have or had one; else null."""
    anchor = F.when((status == "TRIALING") & (trial_end <= as_of), trial_end).when(status == "PAST_DUE", F.coalesce(period_end, updated))
    return anchor + _days(GRACE_DAYS)


def admits(tier_: Column, writes: Column, exempt: Column) -> Column:
    """active may do all, grace may read, blocked nothing; exempt requests pass."""
    return exempt | (tier_ == "active") | ((tier_ == "grace") & ~writes)


def trial_days_left(status: Column, trial_end: Column, as_of: Column) -> Column:
    """Days begun until the end of a trial, at least 0; null for other states."""
    left = F.expr("0L") + F.ceil((F.unix_micros(trial_end.cast("timestamp")) - F.unix_micros(as_of.cast("timestamp"))) / 86400000000)
    return F.when((status == "TRIALING") & trial_end.isNotNull(), F.greatest(F.lit(0).cast("long"), left))


def may_delete_invoice(paid: Column, status: Column) -> Column:
    return ~((F.coalesce(paid, F.lit(0.0)) > 0) | (status == "PAID"))


def may_delete_entry(invoiced: Column) -> Column:
    return ~F.coalesce(invoiced, F.lit(False))


def finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))


def patched_amounts(amount: Column, paid: Column, new_amount: Column, new_paid: Column) -> Column:
    """null if a change of an invoice's amounts may be made, else what is wrong; null new values are not supplied and stay."""
    after = F.coalesce(new_paid, paid) <= F.coalesce(new_amount, amount)
    return (
        F.when(new_amount.isNotNull() & ~(finite(new_amount) & (new_amount > 0)), "amount").when(new_paid.isNotNull() & ~(finite(new_paid) & (new_paid >= 0)), "paid")
        .when(~F.coalesce(after, F.lit(False)), "over")
    )


def valid_amounts(amount: Column, paid: Column) -> Column:
    """A positive finite amount of which at least 0 and at most all is paid."""
    return F.coalesce(finite(amount) & finite(paid) & (amount > 0) & (paid >= 0) & (paid <= amount), F.lit(False))


def usable_token(used_at: Column, expires_at: Column, as_of: Column) -> Column:
    """Neither used nor past its end (at the very end it still counts)."""
    return used_at.isNull() & ~(expires_at < as_of)


def mail_decision(role: Column, office: Column, client_office: Column, colleague_office: Column) -> Column:
    """Why a member may or may not write to an address; the offices are those of the client and colleague found under it (null: none)."""
    return (
        F.when(role == "CITIZEN", "citizen_role_not_permitted")
        .when(client_office == office, "client_recipient")
        .when(colleague_office == office, "colleague_recipient")
        .when(role == "OFFICE_MANAGER", "manager_override")
        .otherwise("recipient_not_associated")
    )


def mail_allowed(decision: Column) -> Column:
    return ~decision.isin("citizen_role_not_permitted", "recipient_not_associated")


def enum_or(c: Column, values: list[str], default: str | None) -> Column:
    """The value if it is one of them, else the default (null: refused)."""
    return F.when(c.isin(*values), c).otherwise(F.lit(default))


def missing_fields(required: list[str], notes: Column | None = None, enough: int = 40) -> Column:
    """Names of blank required columns; none if the notes are long enough to stand for them."""
    gone = F.filter(F.array(*[F.when(F.coalesce(trim_all(F.col(c).cast("string")), F.lit("")) == "", F.lit(c)) for c in required]), lambda x: x.isNotNull())
    return gone if notes is None else F.when(F.length(trim_all(F.coalesce(notes, F.lit("")))) >= enough, F.expr("cast(array() as array<string>)")).otherwise(gone)


def with_defaults(singleton: DataFrame, defaults: dict[str, object]) -> DataFrame:
    """One row: the stored singleton's fields, each with its default where there is no row or no value."""
    base = singleton.sparkSession.range(1).select(*[F.lit(v).alias(f"_{k}") for k, v in defaults.items()])
    row = singleton.limit(1).withColumn("_one", F.lit(0))
    return base.join(row, F.col("_one") == 0, "left").select(*[F.coalesce(F.col(k), F.col(f"_{k}")).alias(k) for k in defaults])


def dispatched(kind: Column, changes: dict[str, tuple[str, bool]]) -> Column:
    """struct(status, ends): the state that an event sets and whether it ends a period; null for events of other kinds."""
    out = F.lit(None).cast("struct<status: string, ends: boolean>")
    for name, (status, ends) in changes.items():
        out = F.when(kind == name, F.struct(F.lit(status).alias("status"), F.lit(ends).alias("ends"))).otherwise(out)
    return out


def chosen(column: Column, choice: object | None) -> Column:
    """Rows of the choice, or all rows while nothing is chosen."""
    return F.lit(True) if choice is None else column == F.lit(choice)
