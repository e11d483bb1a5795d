"""Row-level scopes: which rows of each table a principal may see.

A scope is a function of a principal and tables that returns a DataFrame with
the columns of the first table.  Predicates are conjunctions of Columns, so
search and paging predicates can be added without replacing one another, and
existence tests stay semi joins.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import names, trim_all

MANAGER, LAWYER, CITIZEN, PLATFORM = "OFFICE_MANAGER", "LAWYER", "CITIZEN", "PLATFORM_ADMIN"


@dataclass(frozen=True)
class Principal:
    role: str
    office: int
    user: int | None = None
    client: int | None = None

    @property
    def manages(self) -> bool:
        return self.role == MANAGER


def every(*conditions: Column | None) -> Column:
    """The conjunction; absent conditions are left out, none at all is true."""
    return reduce(lambda a, b: a & b, [c for c in conditions if c is not None], F.lit(True))


def some(*conditions: Column | None) -> Column:
    """The disjunction; absent conditions are left out, none at all is false."""
    return reduce(lambda a, b: a | b, [c for c in conditions if c is not None], F.lit(False))


def clients(who: Principal, table: DataFrame, cases: DataFrame) -> DataFrame:
    """Of the office; a lawyer's own clients and those with a case of theirs."""
    rows = table.where(F.col("office_id") == who.office)
    if who.manages:
        return rows
    held = cases.where((F.col("owner_id") == who.user) & (F.col("office_id") == who.office)).select(F.col("client_id").alias("_held")).distinct()
    return rows.join(held, rows["id"] == held["_held"], "left").where(some(F.col("owner_id") == who.user, F.col("_held").isNotNull())).drop("_held")


def clients_owned(who: Principal, table: DataFrame) -> DataFrame:
    """Of the office; a lawyer's own only."""
    return table.where(every(F.col("office_id") == who.office, None if who.manages else F.col("owner_id") == who.user))


def cases(who: Principal, table: DataFrame) -> DataFrame:
    """By owner; being the assigned lawyer of a case does not show it."""
    return table.where(every(F.col("office_id") == who.office, None if who.manages else F.col("owner_id") == who.user))


def of_cases(who: Principal, table: DataFrame, case_table: DataFrame) -> DataFrame:
    """Rows (with case_id) of the cases that the principal sees."""
    seen = cases(who, case_table).select(F.col("id").alias("case_id"))
    return table.join(seen, "case_id", "left_semi")


def invoices(who: Principal, table: DataFrame, case_table: DataFrame, client_table: DataFrame) -> DataFrame:
    """Of the office (by client); a lawyer's by the owner of the case, or of the client where there is no case."""
    parents = client_table.select(F.col("id").alias("client_id"), F.col("office_id").alias("_office"), F.col("owner_id").alias("_client_owner"))
    out = table.join(parents, "client_id")
    if who.manages:
        return out.where(F.col("_office") == who.office).select(*table.columns)
    linked = case_table.select(F.col("id").alias("case_id"), F.col("owner_id").alias("_case_owner"))
    mine = some(F.col("_case_owner") == who.user, F.col("case_id").isNull() & (F.col("_client_owner") == who.user))
    return out.where(F.col("_office") == who.office).join(linked, "case_id", "left").where(mine).select(*table.columns)


def files(who: Principal, table: DataFrame, case_table: DataFrame) -> DataFrame:
    """Of the office; a lawyer's own and those of their cases."""
    rows = table.where(F.col("office_id") == who.office)
    if who.manages:
        return rows
    linked = case_table.select(F.col("id").alias("case_id"), F.col("owner_id").alias("_case_owner"))
    mine = some(F.col("owner_id") == who.user, F.col("_case_owner") == who.user)
    return rows.join(linked, "case_id", "left").where(mine).select(*table.columns)


def staff(who: Principal, table: DataFrame) -> DataFrame:
    """Colleagues for a manager, oneself for a lawyer; citizens are not staff."""
    own = None if who.manages else F.col("slot") == who.user
    return table.where(every(F.col("office_id") == who.office, F.col("role").isin(MANAGER, LAWYER), own))


def own_time(who: Principal, table: DataFrame, staff_table: DataFrame) -> DataFrame:
    """Time entries of the office's staff; a lawyer's own."""
    seen = staff(who, staff_table).select(F.col("id").alias("user_id"))
    return table.join(seen, "user_id", "left_semi")


def citizen(who: Principal, table: DataFrame, client: str = "client_id") -> DataFrame:
    """A client's own rows, in their office."""
    return table.where(every(F.col(client) == who.client, F.col("office_id") == who.office))


def may_enter(role: Column, email: Column, wanted: str, admins: str) -> Column:
    """Whether a role passes a gate; platform administrators are named by a comma-separated list."""
    named = names(F.lit(admins))
    gates = {
        "office": role.isin(MANAGER, LAWYER), "manager": role == MANAGER, "citizen": role == CITIZEN,
        "platform": F.array_contains(named, F.lower(trim_all(email))),
    }
    return gates[wanted]


def live_session(users: DataFrame, offices: DataFrame, tokens: DataFrame) -> DataFrame:
    """Tokens (user_id, version, second_factor) of active users of active offices with the user's current version."""
    u = users.alias("u").join(offices.alias("o"), F.col("u.office_id") == F.col("o.id"))
    t = tokens.alias("t").join(u, F.col("t.user_id") == F.col("u.id"))
    current = F.coalesce(F.col("u.session_version"), F.lit(0)) == F.coalesce(F.col("t.version"), F.lit(0))
    factor = ~F.col("u.two_factor") | F.col("t.second_factor")
    return t.where(every(F.col("u.active"), F.col("o.active"), current, factor)).select("t.*")


def may_receive(addresses: DataFrame, client_table: DataFrame, staff_table: DataFrame) -> DataFrame:
    """addresses (email) that a visible client or an active colleague has, with which of them."""
    known = client_table.select(F.lower("email").alias("_e")).where("_e is not null").distinct()
    near = staff_table.where("active").select(F.lower("email").alias("_f")).where("_f is not null").distinct()
    out = addresses.join(known, F.lower("email") == F.col("_e"), "left").join(near, F.lower("email") == F.col("_f"), "left")
    return out.withColumn("client", F.col("_e").isNotNull()).withColumn("colleague", F.col("_f").isNotNull()).drop("_e", "_f").where("client or colleague")
