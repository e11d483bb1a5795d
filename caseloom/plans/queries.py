"""Registered queries: the operators bound to the tables, each with its SQL for a plain engine.

``@query(sql)`` registers a function of a Catalog under its name; its SQL may use
the domain tables and {o} (the first office with staff), {now} and {log_now}.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from ..functions import data, dates, documents, text
from ..operators import dml, folds, integrity, limiter, nested, paging, policies, reports, rules, scope, search
from ..streaming import replay, stateful
from .catalog import AS_OF, LOG_AS_OF, Catalog, with_domain

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
SLOT = 3
OFFICE = "(SELECT min(s_nationkey) FROM supplier)"


def query(sql: str | None = None):
    def register(f: Callable[[Catalog], DataFrame]) -> Callable[[Catalog], DataFrame]:
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Catalog(spark, sf_dir))
        if sql:
            ORACLE[f.__name__] = with_domain(sql.replace("{o}", OFFICE).replace("{now}", f"TIMESTAMP '{AS_OF}'").replace("{log_now}", f"TIMESTAMP '{LOG_AS_OF}'").strip())
        return f

    return register


def now():
    return F.lit(AS_OF).cast("timestamp_ntz")


def lawyer(c: Catalog) -> scope.Principal:
    return scope.Principal(scope.LAWYER, c.first_office, SLOT)


def manager(c: Catalog) -> scope.Principal:
    return scope.Principal(scope.MANAGER, c.first_office, SLOT)


# --- scoped lists and pages


def _case_list(c: Catalog, cursor: tuple | None = None) -> DataFrame:
    rows = paging.window(scope.cases(lawyer(c), c.cases), 20, cursor=cursor)
    rows = rows.join(c.clients.select(F.col("id").alias("client_id"), F.col("name").alias("client_name")), "client_id")
    own = c.hearings.join(F.broadcast(rows.select(F.col("id").alias("case_id"))), "case_id", "left_semi")  # at most 21 ids
    out = reports.with_counts(rows, "id", n_hearings=(own, "case_id"))
    return out.select("id", "client_name", "status", "type", "created_at", "n_hearings")


CASE_PAGE = """SELECT c.id, l.name AS client_name, c.status, c.type, c.created_at,
  (SELECT count(*) FROM hearings h WHERE h.case_id = c.id) AS n_hearings
FROM cases c JOIN clients l ON l.id = c.client_id WHERE c.office_id = {o} AND c.owner_id = 3 %s ORDER BY c.created_at DESC, c.id DESC LIMIT 21"""
SECOND = "1999-06-01 00:00:00"


@query(CASE_PAGE % "")
def case_list_page(c):
    return _case_list(c)


@query(CASE_PAGE % f"AND (c.created_at < TIMESTAMP '{SECOND}' OR (c.created_at = TIMESTAMP '{SECOND}' AND c.id < 5000))")
def case_list_page2(c):
    from datetime import datetime

    return _case_list(c, (datetime.fromisoformat(SECOND), 5000))


@query("""SELECT id, created_at, count(*) OVER () AS total FROM cases WHERE office_id = {o} QUALIFY row_number() OVER (ORDER BY created_at ASC, id ASC) <= 51""")
def case_page_ascending(c):
    seen = scope.cases(manager(c), c.cases)
    total = seen.agg(F.count("*").alias("total"))
    return paging.window(seen, 50, ascending=True).crossJoin(F.broadcast(total)).select("id", "created_at", "total")  # one row beside a page


@query("""SELECT id, name, owner_id FROM clients WHERE office_id = {o} AND (owner_id = 3 OR EXISTS
  (SELECT 1 FROM cases k WHERE k.client_id = clients.id AND k.owner_id = 3 AND k.office_id = clients.office_id))""")
def client_scope_or_exists(c):
    return scope.clients(lawyer(c), c.clients, c.cases).select("id", "name", "owner_id")


@query("SELECT id, name FROM clients WHERE office_id = {o} AND owner_id = 3")
def client_scope_owned(c):
    return scope.clients_owned(lawyer(c), c.clients).select("id", "name")


@query("SELECT id, status FROM cases WHERE office_id = {o}")
def case_scope_manager(c):
    return scope.cases(manager(c), c.cases).select("id", "status")


@query("""SELECT h.case_id, h.line, h.room, h.date FROM hearings h JOIN cases k ON k.id = h.case_id WHERE k.office_id = {o} AND k.owner_id = 3""")
def session_scope(c):
    return scope.of_cases(lawyer(c), c.hearings, c.cases).select("case_id", "line", "room", "date")


@query("""SELECT i.id, i.status, i.amount FROM invoices i JOIN clients l ON l.id = i.client_id LEFT JOIN cases k ON k.id = i.case_id
WHERE l.office_id = {o} AND (k.owner_id = 3 OR (i.case_id IS NULL AND l.owner_id = 3))""")
def invoice_scope_nullable_parent(c):
    return scope.invoices(lawyer(c), c.invoices, c.cases, c.clients).select("id", "status", "amount")


@query("""SELECT f.id, f.name FROM files f LEFT JOIN cases k ON k.id = f.case_id WHERE f.office_id = {o} AND (f.owner_id = 3 OR k.owner_id = 3)""")
def document_scope(c):
    return scope.files(lawyer(c), c.files, c.cases).select("id", "name")


@query("SELECT id, name, role FROM staff WHERE office_id = {o}")
def staff_scope(c):
    return scope.staff(manager(c), c.staff).select("id", "name", "role")


@query("""SELECT t.case_id, t.user_id, t.line, t.minutes FROM time_entries t JOIN staff s ON s.id = t.user_id WHERE s.office_id = {o}""")
def time_scope(c):
    return scope.own_time(manager(c), c.time_entries, c.staff).select("case_id", "user_id", "line", "minutes")


@query("""SELECT k.id, k.status, k.type FROM cases k WHERE k.client_id = (SELECT min(id) FROM clients WHERE office_id = {o}) AND k.office_id = {o}""")
def citizen_scope(c):
    first = c.clients.where(F.col("office_id") == c.first_office).agg(F.min("id")).first()[0]
    return scope.citizen(scope.Principal(scope.CITIZEN, c.first_office, client=first), c.cases).select("id", "status", "type")


@query("""WITH p AS (SELECT id, CASE WHEN active THEN role ELSE 'CITIZEN' END AS role, lower(name) || '@x.org' AS email FROM staff)
SELECT id, role, role IN ('OFFICE_MANAGER', 'LAWYER') AS office, role = 'OFFICE_MANAGER' AS manager, role = 'CITIZEN' AS citizen, email IN ('supplier#000000001@x.org', 'supplier#000000004@x.org') AS platform FROM p""")
def role_gates(c):
    """The staff at each gate; those of them who are not active come as clients."""
    mail = F.concat(F.lit("\t "), F.upper("name"), F.lit("@x.org\n"))
    p = c.staff.select("id", F.when(F.col("active"), F.col("role")).otherwise("CITIZEN").alias("role"), mail.alias("email"))
    return p.select("id", "role", *[scope.may_enter(F.col("role"), F.col("email"), g, "Supplier#000000001@x.org,\tSUPPLIER#000000004@X.org, ,").alias(g) for g in ("office", "manager", "citizen", "platform")])


@query("""SELECT s.id FROM staff s JOIN offices o ON o.id = s.office_id WHERE s.active AND o.active AND s.slot % 2 = s.id % 3 AND (s.id % 4 <> 0 OR s.id % 3 = 0)""")
def active_sessions(c):
    users = c.staff.select("id", "office_id", "active", (F.col("slot") % 2).alias("session_version"), (F.col("id") % 4 == 0).alias("two_factor"))
    tokens = c.staff.select(F.col("id").alias("user_id"), (F.col("id") % 3).alias("version"), (F.col("id") % 3 == 0).alias("second_factor"))
    return scope.live_session(users, c.offices, tokens).select(F.col("user_id").alias("id"))


# --- reports


@query("""SELECT coalesce(CAST(sum(CASE WHEN status = 'PAID' THEN CAST(paid AS DECIMAL(18,2)) END) AS DOUBLE), 0) AS revenue,
  coalesce(CAST(sum(CASE WHEN status IN ('UNPAID', 'OVERDUE', 'PARTIAL') THEN CAST(amount AS DECIMAL(18,2)) END) AS DOUBLE), 0) AS unpaid, count(*) AS n_invoices FROM invoices""")
def dashboard_revenue(c):
    return reports.revenue_tiles(c.invoices)


@query("""SELECT (SELECT count(*) FROM clients WHERE office_id = {o}) AS clients, (SELECT count(*) FROM cases WHERE office_id = {o} AND status = 'ACTIVE') AS active_cases,
  (SELECT count(*) FROM cases WHERE office_id = {o} AND created_at >= {now}) AS new_cases""")
def dashboard_tiles(c):
    o = c.first_office
    cases = c.cases.where(F.col("office_id") == o).agg(F.count_if(F.col("status") == "ACTIVE").alias("active_cases"), F.count_if(F.col("created_at") >= now()).alias("new_cases"))
    return c.clients.where(F.col("office_id") == o).agg(F.count("*").alias("clients")).crossJoin(cases)  # one row each


@query("SELECT status, count(*) AS n FROM cases GROUP BY status")
def report_status(c):
    return reports.group_counts(c.cases, "status")


@query("SELECT type, count(*) AS n FROM cases WHERE office_id = {o} GROUP BY type ORDER BY n DESC, type LIMIT 6")
def report_type_top6(c):
    return reports.top_groups(c.cases.where(F.col("office_id") == c.first_office), "type", 6)


@query("""SELECT status, CAST(sum(CAST(amount AS DECIMAL(18,2))) AS DOUBLE) AS amount, CAST(sum(CAST(paid AS DECIMAL(18,2))) AS DOUBLE) AS paid, count(*) AS n FROM invoices GROUP BY status""")
def report_invoice_status(c):
    return reports.group_sums(c.invoices)


@query("""SELECT CAST(sum(CAST(amount AS DECIMAL(18,2))) AS DOUBLE) AS total, CAST(sum(CAST(paid AS DECIMAL(18,2))) AS DOUBLE) AS paid,
  CAST(sum(CAST(amount AS DECIMAL(18,2))) - sum(CAST(paid AS DECIMAL(18,2))) AS DOUBLE) AS unpaid, count(*) AS n_invoices FROM invoices""")
def report_invoice_totals(c):
    return reports.invoice_totals(c.invoices)


@query("""SELECT s.id, s.name, (SELECT count(*) FROM clients l WHERE l.office_id = s.office_id AND l.owner_id = s.slot) AS n_clients,
  (SELECT count(*) FROM cases k WHERE k.office_id = s.office_id AND k.lawyer_id = s.slot) AS n_cases FROM staff s""")
def report_team_counts(c):
    key = lambda slot: F.concat_ws("/", F.col("office_id"), slot)
    staff = c.staff.withColumn("_k", key(F.col("slot")))
    held = c.clients.select(key(F.col("owner_id")).alias("_ck"))
    led = c.cases.where("lawyer_id is not null").select(key(F.col("lawyer_id")).alias("_lk"))
    return reports.with_counts(staff, "_k", n_clients=(held, "_ck"), n_cases=(led, "_lk")).select("id", "name", "n_clients", "n_cases")


SHARES = """WITH g AS (SELECT status, count(*) AS n FROM cases GROUP BY status) SELECT status, n,
  CAST(floor(n / sum(n) OVER () * 100 + 0.5) AS BIGINT) AS of_total, CAST(floor(n / greatest(max(n) OVER (), 1) * 100 + 0.5) AS BIGINT) AS of_largest FROM g"""


@query(SHARES)
def report_shares(c):
    return reports.shares(reports.group_counts(c.cases, "status"))


@query("""SELECT CAST(floor(CAST(sum(CAST(paid AS DECIMAL(18,2))) AS DOUBLE) / CAST(sum(CAST(amount AS DECIMAL(18,2))) AS DOUBLE) * 100 + 0.5) AS BIGINT) AS collected,
  CAST(100 - floor(CAST(sum(CAST(paid AS DECIMAL(18,2))) AS DOUBLE) / CAST(sum(CAST(amount AS DECIMAL(18,2))) AS DOUBLE) * 100 + 0.5) AS BIGINT) AS remaining,
  CAST(least(100, count(*) * 25) AS BIGINT) AS bar FROM invoices""")
def report_collected(c):
    t = reports.invoice_totals(c.invoices)
    collected = reports.share(F.col("paid"), F.col("total"))
    return t.select(collected.alias("collected"), (100 - collected).alias("remaining"), F.least(F.lit(100).cast("long"), F.col("n_invoices") * 25).alias("bar"))


@query("""SELECT CAST(sum(minutes) AS BIGINT) AS minutes, CAST(sum(CASE WHEN billable THEN minutes ELSE 0 END) AS BIGINT) AS billable,
  CAST(sum(CASE WHEN billable AND invoiced THEN minutes ELSE 0 END) AS BIGINT) AS invoiced,
  CAST(floor(sum(CASE WHEN billable AND invoiced THEN minutes ELSE 0 END) / sum(CASE WHEN billable THEN minutes ELSE 0 END) * 100 + 0.5) AS BIGINT) AS conversion FROM time_entries""")
def timelog_conversion(c):
    return reports.time_conversion(c.time_entries)


@query("""SELECT count(status) AS total, count(*) FILTER (status = 'ACTIVE') AS active, count(*) FILTER (status = 'CLOSED') AS closed, count(*) FILTER (status = 'SUSPENDED') AS suspended,
  count(*) FILTER (status = 'PENDING') AS pending, count(*) FILTER (status IN ('ACTIVE', 'PENDING')) AS kept FROM cases""")
def case_tabs(c):
    return reports.pivot_counts(c.cases, "status", ("ACTIVE", "CLOSED", "SUSPENDED", "PENDING"), ("ACTIVE", "PENDING"))


OVERVIEW = """WITH sub AS (SELECT office_id, max_by(status, id) AS status, max(id) AS last FROM cases GROUP BY office_id),
first AS (SELECT office_id, min(id) AS manager_id, min_by(name, id) AS manager FROM staff GROUP BY office_id)
SELECT o.id, o.name, o.active, f.manager_id, f.manager, coalesce(s.status, 'NONE') AS subscription, coalesce(CAST(l.n AS BIGINT), 0) AS n_clients
FROM offices o LEFT JOIN first f ON f.office_id = o.id LEFT JOIN sub s ON s.office_id = o.id
LEFT JOIN (SELECT office_id, count(*) AS n FROM clients GROUP BY office_id) l ON l.office_id = o.id"""


@query(OVERVIEW)
def tenant_overview(c):
    first = nested.first_per(c.staff, "office_id", ["id"], "id", "name").select("office_id", F.col("id").alias("manager_id"), F.col("name").alias("manager"))
    sub = c.cases.groupBy("office_id").agg(F.max_by("status", "id").alias("status"))
    out = reports.with_counts(c.offices, "id", n_clients=(c.clients, "office_id"))
    out = out.join(first, out["id"] == first["office_id"], "left").drop("office_id").join(sub, out["id"] == sub["office_id"], "left")
    return out.select("id", "name", "active", "manager_id", "manager", F.coalesce("status", F.lit("NONE")).alias("subscription"), "n_clients")


@query("""SELECT CAST(action AS VARCHAR) AS action, min(value) AS lowest, list_sort(list(value))[CAST(floor(count(value) * 0.5) AS INT) + 1] AS p50,
  list_sort(list(value))[CAST(floor(count(value) * 0.95) AS INT) + 1] AS p95, max(value) AS highest, count(*) FILTER (value > 90) AS errors, count(*) AS n
FROM log WHERE value IS NOT NULL GROUP BY action""")
def latency_percentiles_discrete(c):
    return reports.discrete_percentiles(c.log, "action", "value", F.col("value") > 90)


@query("""SELECT actor_id % 25 AS tenant, count(*) AS used, count(*) < 500 AS allowed FROM log WHERE created_at >= date_trunc('month', {log_now}) GROUP BY 1""")
def monthly_cap(c):
    return reports.monthly_cap(c.log, F.col("actor_id") % 25, LOG_AS_OF)


@query("SELECT count(*) AS n FROM cases WHERE created_at >= date_trunc('month', {now})")
def since_month_start(c):
    return reports.since_month_start(c.cases, AS_OF).agg(F.count("*").alias("n"))


@query("""SELECT k.id, k.created_at, l.name AS client_name, s.name AS lawyer_name FROM (SELECT * FROM cases ORDER BY created_at DESC, id DESC LIMIT 5) k
JOIN clients l ON l.id = k.client_id LEFT JOIN (SELECT office_id, slot, min(name) AS name FROM staff GROUP BY office_id, slot) s ON s.office_id = k.office_id AND s.slot = k.lawyer_id""")
def recent_cases(c):
    recent = c.cases.orderBy(F.desc("created_at"), F.desc("id")).limit(5)
    names = c.staff.groupBy("office_id", F.col("slot").alias("lawyer_id")).agg(F.min("name").alias("lawyer_name"))
    out = recent.join(c.clients.select(F.col("id").alias("client_id"), F.col("name").alias("client_name")), "client_id")
    return out.join(names, ["office_id", "lawyer_id"], "left").select("id", "created_at", "client_name", "lawyer_name")


@query("""SELECT h.case_id, h.line, h.room, h.date, l.name AS client_name FROM hearings h JOIN cases k ON k.id = h.case_id JOIN clients l ON l.id = k.client_id
WHERE h.date BETWEEN {now} AND {now} + INTERVAL 2 DAY""")
def upcoming_window(c):
    soon = c.hearings.where(F.col("date").between(now(), now() + F.expr("interval 2 days")))
    out = soon.join(c.cases.select(F.col("id").alias("case_id"), "client_id"), "case_id")
    return out.join(c.clients.select(F.col("id").alias("client_id"), F.col("name").alias("client_name")), "client_id").select("case_id", "line", "room", "date", "client_name")


# --- search


@query("""SELECT * FROM (SELECT 'client' AS kind, l.id, l.name AS label FROM clients l WHERE l.active AND l.office_id = {o} AND (l.owner_id = 3 OR EXISTS (SELECT 1 FROM cases k WHERE k.client_id = l.id AND k.owner_id = 3 AND k.office_id = {o}))
  AND (contains(lower(strip_accents(name)), 'me') OR contains(lower(strip_accents(segment)), 'me')) ORDER BY label, id LIMIT 8)
UNION ALL SELECT * FROM (SELECT 'case', id, type AS label FROM cases WHERE office_id = {o} AND owner_id = 3 AND (contains(lower(strip_accents(type)), 'me') OR contains(lower(status), 'me')) ORDER BY label, id LIMIT 8)
UNION ALL SELECT * FROM (SELECT 'invoice', i.id, 'ME-' || i.id AS label FROM invoices i JOIN clients l ON l.id = i.client_id LEFT JOIN cases k ON k.id = i.case_id
  WHERE l.office_id = {o} AND (k.owner_id = 3 OR (i.case_id IS NULL AND l.owner_id = 3)) ORDER BY label, id LIMIT 8)
UNION ALL SELECT * FROM (SELECT 'file', f.id, f.name AS label FROM files f LEFT JOIN cases k ON k.id = f.case_id WHERE f.office_id = {o} AND (f.owner_id = 3 OR k.owner_id = 3) AND contains(lower(strip_accents(f.name)), 'me') ORDER BY label, id LIMIT 8)""")
def search_federated(c):
    """What a member may see of clients, cases, invoices and files, eight of each at most."""
    who, q = lawyer(c), search.asked(" \tMÉ  ")
    bills = scope.invoices(who, c.invoices, c.cases, c.clients).withColumn("number", F.concat(F.lit("ME-"), F.col("id").cast("string")))
    return search.federated([
        search.bucket(scope.clients(who, c.clients, c.cases).where("active"), "client", "name", ["name", "segment"], q),
        search.bucket(scope.cases(who, c.cases), "case", "type", ["type", "status"], q),
        search.bucket(bills, "invoice", "number", ["number"], q), search.bucket(scope.files(who, c.files, c.cases), "file", "name", ["name"], q),
    ])


@query("""SELECT id, contains(lower(strip_accents(text)), 'reel') AS found FROM files""")
def search_folded(c):
    return c.files.select("id", search.holds("text", "RÉEL").alias("found"))


# --- nested results


@query("""SELECT id, CAST(len(hearings_) AS INT) AS n, CAST(list_min(hearings_) AS TIMESTAMP) AS first FROM (SELECT k.id, list(h.date) FILTER (h.date IS NOT NULL) AS hearings_
FROM cases k LEFT JOIN hearings h ON h.case_id = k.id AND h.status = 'UPCOMING' WHERE k.office_id = {o} GROUP BY k.id) WHERE len(hearings_) > 0""")
def nested_case_detail(c):
    rows = scope.of_cases(manager(c), c.hearings.where("status = 'UPCOMING'"), c.cases)
    out = nested.attach(scope.cases(manager(c), c.cases), nested.children(rows, "case_id", ["date", "line", "room"], "hearings"), "id", "case_id", "hearings")
    return out.where(F.size("hearings") > 0).select("id", F.size("hearings").alias("n"), F.col("hearings")[0]["date"].alias("first"))


@query("""SELECT case_id, date, line, room FROM hearings WHERE status = 'UPCOMING' QUALIFY row_number() OVER (PARTITION BY case_id ORDER BY date, line, room) <= 3""")
def nested_top3(c):
    return nested.top_per(c.hearings.where("status = 'UPCOMING'"), "case_id", [F.col("date"), F.col("line"), F.col("room")], 3).select("case_id", "date", "line", "room")


@query("SELECT case_id, min(date) AS next FROM hearings WHERE status = 'UPCOMING' GROUP BY case_id")
def next_hearing(c):
    return nested.first_per(c.hearings.where("status = 'UPCOMING'"), "case_id", ["date", "line", "room"], "date").select("case_id", F.col("date").alias("next"))


@query("""SELECT conv_id, turn, role, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS INT) AS place FROM
(SELECT * FROM conversations WHERE role IN ('user', 'assistant') AND trim(text) <> '' QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 10)""")
def chat_last_turns(c):
    said = c["conversations"].where(F.col("role").isin("user", "assistant") & (text.trim_all(F.col("text")) != "")).withColumn("text", text.cut(F.col("text"), 2000))
    kept = nested.top_per(said, "conv_id", [F.desc("turn")], 10)
    return kept.select("conv_id", "turn", "role", F.row_number().over(W.partitionBy("conv_id").orderBy("turn")).alias("place"))


# --- integrity


@query("""WITH i AS (SELECT i.id, i.case_id, i.client_id, CASE WHEN i.id % 97 = 0 THEN 24 ELSE l.office_id END AS office_id FROM invoices i JOIN clients l ON l.id = i.client_id),
h AS (SELECT h.case_id, CASE WHEN h.room % 89 = 0 THEN 24 ELSE k.office_id END AS office_id FROM hearings h JOIN cases k ON k.id = h.case_id)
SELECT 'case_client' AS name, count(*) AS n FROM cases k JOIN clients l ON l.id = k.client_id WHERE k.office_id <> l.office_id
UNION ALL SELECT 'file_case', count(*) FROM files f JOIN cases k ON k.id = f.case_id WHERE f.office_id <> k.office_id
UNION ALL SELECT 'invoice_case', count(*) FROM i JOIN cases k ON k.id = i.case_id WHERE i.office_id <> k.office_id
UNION ALL SELECT 'invoice_client', count(*) FROM i JOIN clients l ON l.id = i.client_id WHERE i.office_id <> l.office_id
UNION ALL SELECT 'hearing_case', count(*) FROM h JOIN cases k ON k.id = h.case_id WHERE h.office_id <> k.office_id
UNION ALL SELECT 'client_owner', count(*) FROM clients l JOIN staff s ON s.id = l.owner_id WHERE l.office_id <> s.office_id
UNION ALL SELECT 'case_owner', count(*) FROM cases k JOIN staff s ON s.id = k.owner_id WHERE k.office_id <> s.office_id
UNION ALL SELECT 'file_owner', count(*) FROM files f JOIN staff s ON s.id = f.owner_id WHERE f.office_id <> s.office_id""")
def audit_tenant_mismatch(c):
    """The office of every child beside its parent's and its owner's; some invoices and hearings have strayed to another."""
    theirs = lambda d, key: d.select(F.col("id").alias(key), F.col("office_id").alias("_office"))
    bills = c.invoices.join(theirs(c.clients, "client_id"), "client_id").select("id", "case_id", "client_id", F.when(F.col("id") % 97 == 0, 24).otherwise(F.col("_office")).alias("office_id"))
    hearings = c.hearings.join(theirs(c.cases, "case_id"), "case_id").select("case_id", F.when(F.col("room") % 89 == 0, 24).otherwise(F.col("_office")).alias("office_id"))
    pairs = {
        "case_client": (c.cases, c.clients, "client_id"), "file_case": (c.files, c.cases, "case_id"), "invoice_case": (bills, c.cases, "case_id"), "invoice_client": (bills, c.clients, "client_id"),
        "hearing_case": (hearings, c.cases, "case_id"), "client_owner": (c.clients, c.staff, "owner_id"), "case_owner": (c.cases, c.staff, "owner_id"), "file_owner": (c.files, c.staff, "owner_id"),
    }
    return integrity.violations({name: integrity.mismatches(child, parent, key, "office_id", "office_id").drop("_theirs") for name, (child, parent, key) in pairs.items()})


@query("""SELECT 'case_client' AS name, count(*) AS n FROM cases k WHERE NOT EXISTS (SELECT 1 FROM clients l WHERE l.id = k.client_id)
UNION ALL SELECT 'file_case', count(*) FROM files f WHERE f.case_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM cases k WHERE k.id = f.case_id)
UNION ALL SELECT 'file_label', count(*) FROM files f WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = f.id)
UNION ALL SELECT 'hearing_case', count(*) FROM hearings h WHERE NOT EXISTS (SELECT 1 FROM cases k WHERE k.id = h.case_id)""")
def audit_orphans(c):
    return integrity.violations({
        "case_client": integrity.orphans(c.cases, c.clients, "client_id"), "file_case": integrity.orphans(c.files, c.cases, "case_id"),
        "file_label": integrity.childless(c.files, c["labels"], "doc_id"), "hearing_case": integrity.orphans(c.hearings, c.cases, "case_id"),
    })


@query("SELECT case_id, line, count(*) AS n FROM hearings GROUP BY case_id, line HAVING count(*) > 1")
def audit_duplicates(c):
    return integrity.duplicates(c.hearings, "case_id", "line")


@query("SELECT 'cases' AS name, count(*) AS n FROM cases UNION ALL SELECT 'clients', count(*) FROM clients UNION ALL SELECT 'hearings', count(*) FROM hearings")
def audit_counts(c):
    return integrity.row_counts({"cases": c.cases, "clients": c.clients, "hearings": c.hearings})


@query("""WITH b(name, before) AS (VALUES ('cases', CAST(10 AS BIGINT)), ('clients', CAST(99999999 AS BIGINT)), ('gone', CAST(1 AS BIGINT))),
m AS (SELECT 'cases' AS name, count(*) AS n FROM cases UNION ALL SELECT 'clients', count(*) FROM clients)
SELECT coalesce(m.name, b.name) AS name, n, before, coalesce(n, 0) < coalesce(before, 0) AS shrunk FROM m FULL JOIN b ON b.name = m.name""")
def audit_drift(c):
    before = c.spark.createDataFrame([("cases", 10), ("clients", 99999999), ("gone", 1)], "name string, n bigint")
    return integrity.drift(integrity.row_counts({"cases": c.cases, "clients": c.clients}), before).select("name", "n", "before", "shrunk")


@query("""SELECT f.id FROM files f WHERE f.case_id IN (SELECT k.id FROM cases k JOIN offices o ON o.id = k.office_id WHERE starts_with(o.name, 'NATION_1') OR o.id % 10 = 1)""")
def semi_by_parent_name(c):
    offices = c.offices.where(F.col("name").startswith("NATION_1") | (F.col("id") % 10 == 1)).select(F.col("id").alias("office_id"))
    cases = c.cases.join(offices, "office_id", "left_semi").select(F.col("id").alias("case_id"))
    return c.files.join(cases, "case_id", "left_semi").select("id")


@query("""SELECT f.id, coalesce(f.owner, k.lawyer_id, m.manager_id) AS owner FROM (SELECT *, CASE WHEN id % 3 = 0 THEN owner_id END AS owner FROM files) f
LEFT JOIN cases k ON k.id = f.case_id LEFT JOIN (SELECT office_id, min(id) AS manager_id FROM staff GROUP BY office_id) m ON m.office_id = f.office_id""")
def backfill_owner(c):
    files = c.files.select("id", "case_id", F.col("office_id").alias("fo"), F.when(F.col("id") % 3 == 0, F.col("owner_id")).alias("owner"))
    chiefs = nested.first_per(c.staff, "office_id", ["id"], "id").select(F.col("office_id").alias("fo"), F.col("id").alias("manager_id"))
    out = files.join(c.cases.select(F.col("id").alias("case_id"), "lawyer_id"), "case_id", "left").join(chiefs, "fo", "left")
    return dml.backfilled(out, "owner", F.col("lawyer_id"), F.col("manager_id")).select("id", "owner")


# --- rules

SUBS = """(SELECT id, CASE WHEN id % 11 = 0 THEN NULL WHEN id % 19 = 0 THEN 'ODD' WHEN status = 'CLOSED' THEN CASE WHEN id % 2 = 0 THEN 'CANCELED' ELSE 'ACTIVE' END WHEN status = 'ACTIVE' THEN 'TRIALING' ELSE 'PAST_DUE' END AS st,
  CASE WHEN id % 13 = 0 THEN NULL ELSE created_at END AS ends, created_at FROM cases)"""
TIER = """CASE st WHEN 'CANCELED' THEN 'blocked'
  WHEN 'TRIALING' THEN CASE WHEN ends IS NULL OR ends > {now} THEN 'active' WHEN {now} <= ends + INTERVAL 7 DAY THEN 'grace' ELSE 'blocked' END
  WHEN 'PAST_DUE' THEN CASE WHEN {now} <= coalesce(ends, created_at) + INTERVAL 7 DAY THEN 'grace' ELSE 'blocked' END ELSE 'active' END"""


def _subs(c: Catalog) -> DataFrame:
    st = F.expr("case when id % 11 = 0 then null when id % 19 = 0 then 'ODD' when status = 'CLOSED' then if(id % 2 = 0, 'CANCELED', 'ACTIVE') when status = 'ACTIVE' then 'TRIALING' else 'PAST_DUE' end")
    d = c.cases.select("id", st.alias("st"), F.expr("case when id % 13 = 0 then null else created_at end").alias("ends"), "created_at")
    how = (F.col("st"), F.col("ends"), F.col("ends"), F.col("created_at"), now())
    return d.withColumn("tier", rules.tier(*how)).withColumn("grace_ends", rules.grace_ends(*how))


@query(f"""SELECT id, {TIER} AS tier, CASE WHEN st = 'TRIALING' AND ends <= {{now}} THEN ends WHEN st = 'PAST_DUE' THEN coalesce(ends, created_at) END + INTERVAL 7 DAY AS grace_ends FROM {SUBS} s""")
def subscription_tier(c):
    return _subs(c).select("id", "tier", "grace_ends")


@query(f"SELECT id, id % 17 = 0 OR tier = 'active' OR (tier = 'grace' AND id % 2 = 0) AS admitted FROM (SELECT id, {TIER} AS tier FROM {SUBS} s) t")
def access_gate(c):
    return _subs(c).select("id", rules.admits(F.col("tier"), F.col("id") % 2 != 0, F.col("id") % 17 == 0).alias("admitted"))


@query(f"""SELECT id, CASE WHEN st = 'TRIALING' AND ends IS NOT NULL THEN greatest(0, CAST(ceil((epoch_us(ends) - epoch_us({{now}})) / 86400000000) AS BIGINT)) END AS days_left FROM {SUBS} s""")
def trial_days_left(c):
    return _subs(c).select("id", rules.trial_days_left(F.col("st"), F.col("ends"), now()).alias("days_left"))


@query("""SELECT id, NOT (paid > 0 OR status = 'PAID') AS may_delete, coalesce(amount > 0 AND paid >= 0 AND paid <= amount, false) AS valid FROM invoices""")
def guards(c):
    return c.invoices.select("id", rules.may_delete_invoice(F.col("paid"), F.col("status")).alias("may_delete"), rules.valid_amounts(F.col("amount"), F.col("paid")).alias("valid"))


@query("SELECT case_id, user_id, line, minutes, NOT invoiced AS may_delete FROM time_entries")
def entry_guard(c):
    return c.time_entries.select("case_id", "user_id", "line", "minutes", rules.may_delete_entry(F.col("invoiced")).alias("may_delete"))


@query("""WITH d AS (SELECT l.id, CASE WHEN l.id % 9 = 0 THEN 'CITIZEN' WHEN l.id % 4 = 0 THEN 'OFFICE_MANAGER' ELSE 'LAWYER' END AS role, l.id % 3 AS office, CASE WHEN l.active THEN l.office_id % 3 END AS client, s.office_id % 3 AS colleague
  FROM clients l LEFT JOIN staff s ON s.id = l.id),
r AS (SELECT id, CASE WHEN role = 'CITIZEN' THEN 'citizen_role_not_permitted' WHEN client = office THEN 'client_recipient' WHEN colleague = office THEN 'colleague_recipient' WHEN role = 'OFFICE_MANAGER' THEN 'manager_override' ELSE 'recipient_not_associated' END AS reason FROM d)
SELECT id, reason, reason IN ('client_recipient', 'colleague_recipient', 'manager_override') AS allowed FROM r""")
def mail_authorization(c):
    """Members of three offices write to addresses under which the clients (if active) and staff of the same number are found."""
    i, staff = F.col("id"), c.staff.select("id", F.col("office_id").alias("near"))
    d = c.clients.join(staff, "id", "left")
    role = F.when(i % 9 == 0, "CITIZEN").when(i % 4 == 0, "OFFICE_MANAGER").otherwise("LAWYER")
    reason = rules.mail_decision(role, i % 3, F.when(F.col("active"), F.col("office_id") % 3), F.col("near") % 3)
    return d.select("id", reason.alias("reason")).withColumn("allowed", rules.mail_allowed(F.col("reason")))


@query("SELECT id, id % 4 <> 0 AND NOT (created_at < {now}) AS usable FROM cases")
def token_validity(c):
    return c.cases.select("id", rules.usable_token(F.when(F.col("id") % 4 == 0, F.col("created_at")), F.col("created_at"), now()).alias("usable"))


@query("SELECT id, CASE WHEN status IN ('ACTIVE', 'CLOSED') THEN status ELSE 'ACTIVE' END AS created, CASE WHEN status IN ('ACTIVE', 'CLOSED') THEN status END AS changed FROM cases")
def enum_defaults(c):
    known = ["ACTIVE", "CLOSED"]
    return c.cases.select("id", rules.enum_or(F.col("status"), known, "ACTIVE").alias("created"), rules.enum_or(F.col("status"), known, None).alias("changed"))


@query("""SELECT name AS title, 'en' AS lang, CAST(CASE WHEN active THEN 14 ELSE 0 END AS INT) AS trial_days FROM offices WHERE id = {o}""")
def singleton_defaults(c):
    """The settings that the first office has stored: its name, no language, and no trial if it is closed."""
    stored = c.offices.where(F.col("id") == c.first_office).select(F.col("name").alias("title"), F.lit(None).cast("string").alias("lang"), F.when(~F.col("active"), 0).alias("trial_days"))
    return rules.with_defaults(stored, {"title": "Practice", "lang": "en", "trial_days": 14})


# --- folds

LIMITER = """WITH e AS (SELECT id AS event_id, actor_id AS user_id, created_at AS ts, row_number() OVER (PARTITION BY actor_id ORDER BY created_at, id) AS rn FROM log),
f AS (SELECT event_id, user_id, ts, rn, ts AS start, 1 AS n FROM e WHERE rn = 1 UNION ALL
  SELECT e.event_id, e.user_id, e.ts, e.rn, CASE WHEN f.start + INTERVAL 24 HOUR <= e.ts THEN e.ts ELSE f.start END,
    CASE WHEN f.start + INTERVAL 24 HOUR <= e.ts THEN 1 ELSE f.n + 1 END FROM f JOIN e ON e.user_id = f.user_id AND e.rn = f.rn + 1)
SELECT event_id, user_id, CAST(n AS INT) AS n, start + INTERVAL 24 HOUR AS reset_at, n > 3 AS limited FROM f"""


@query(LIMITER)
def rate_limit_anchored(c):
    return limiter.limited(c["events"], "user_id", 86400, 3)


@query(LIMITER.replace("SELECT event_id, user_id, CAST(n AS INT) AS n, start + INTERVAL 24 HOUR AS reset_at, n > 3 AS limited FROM f",
  "SELECT event_id, CAST(ceil((epoch_us(start + INTERVAL 24 HOUR) - epoch_us(ts)) / 1000000) AS BIGINT) AS wait FROM f WHERE n > 3"))
def retry_after(c):
    hits = limiter.limited(c["events"], "user_id", 86400, 3).where("limited").join(c["events"].select("event_id", "ts"), "event_id")
    return hits.select("event_id", folds.retry_after(F.col("reset_at"), F.col("ts")).alias("wait"))


SITES = ", ".join(f"({i}, '{b}', {most}, {minutes}, '{whose}')" for i, (b, most, minutes, whose) in enumerate(policies.POLICIES))


@query(f"""WITH p(site, bucket, most, minutes, whose) AS (VALUES {SITES}),
q AS (SELECT id, actor_id, CAST(json_extract_string(props, '$.k') AS INT) AS k, 1704067200000000 + (epoch_us(created_at) - 1704067200000000) // 500 AS t FROM log),
s AS (SELECT q.*, CASE WHEN k < 90 THEN (SELECT bucket FROM p WHERE p.site = k % 45) ELSE CASE k % 5 WHEN 0 THEN 'cases:update' WHEN 1 THEN 'cases:delete' WHEN 2 THEN NULL WHEN 3 THEN 'clients:update' ELSE 'clients:delete' END END AS bucket FROM q),
k AS (SELECT s.id, s.t, s.bucket, p.most, p.minutes * 60000000::BIGINT AS wait, CASE whose WHEN 'user' THEN actor_id % 2 WHEN 'office' THEN actor_id % 25 ELSE -1 END AS whose, actor_id % 3 = 0 AS address
  FROM s JOIN p ON p.bucket = s.bucket),
e AS (SELECT *, row_number() OVER (PARTITION BY bucket, whose, address ORDER BY t, id) AS rn FROM k),
f AS (SELECT id, bucket, whose, address, t, rn, most, wait, t AS start, 1 AS n FROM e WHERE rn = 1 UNION ALL
  SELECT e.id, e.bucket, e.whose, e.address, e.t, e.rn, e.most, e.wait, CASE WHEN f.start + e.wait <= e.t THEN e.t ELSE f.start END, CASE WHEN f.start + e.wait <= e.t THEN 1 ELSE f.n + 1 END
  FROM f JOIN e ON e.bucket = f.bucket AND e.whose = f.whose AND e.address = f.address AND e.rn = f.rn + 1)
SELECT id, bucket, CAST(n AS INT) AS n, n > most AS limited FROM f UNION ALL SELECT id, bucket, CAST(0 AS INT), false FROM s WHERE bucket IS NULL""")
def rate_limit_policies(c):
    """The log as requests at the sites of the policies, at 500 times its speed."""
    k, a = F.from_json("props", "k int")["k"], F.col("actor_id")
    sites = F.array(*[F.lit(p[0]) for p in policies.POLICIES])
    item = policies.item_bucket(F.when(k % 5 < 3, "cases").otherwise("clients"), F.element_at(F.array(*map(F.lit, ("GET", "PATCH", "DELETE", "GET", "PATCH"))), k % 5 + 1))
    start = F.lit("2024-01-01").cast("timestamp_ntz")
    micros = F.floor(F.timestamp_diff("MICROSECOND", start, F.col("created_at")) / 500)
    r = c.log.select(
        "id", F.when(k < 90, F.element_at(sites, k % 45 + 1)).otherwise(item).alias("bucket"), (a % 2).alias("user"), (a % 25).alias("office"), (a % 3 == 0).alias("address"),
        (start + F.make_dt_interval(secs=(micros / 1_000_000).cast("decimal(18,6)"))).alias("at"),
    )
    return policies.limited(r, "bucket", "user", "office", "address", "at", "id").select("id", "bucket", "n", "limited")


ANSWERS = """WITH r AS (SELECT id, actor_id, action, created_at, props AS body, CASE WHEN id % 6 = 0 THEN 0 WHEN id % 7 = 0 THEN 422 ELSE 200 END AS status,
  CASE id % 10 WHEN 0 THEN ' ' || chr(9) WHEN 1 THEN repeat('x', 201) WHEN 2 THEN chr(10) || CAST(id % 4 AS VARCHAR) || '  ' ELSE CAST(id % 4 AS VARCHAR) END AS token FROM log),
t AS (SELECT *, regexp_replace(token, '^\\s+|\\s+$', '', 'g') AS key FROM r),
k AS (SELECT *, row_number() OVER w AS rn, first(status) OVER w AS s, first(body) OVER w AS b FROM t WHERE key <> '' AND length(key) <= 200 WINDOW w AS (PARTITION BY actor_id, action, key ORDER BY created_at, id))
SELECT id, CASE WHEN rn = 1 THEN 'run' WHEN s = 0 THEN 'conflict' ELSE 'replay' END AS outcome, CASE WHEN rn = 1 THEN status WHEN s = 0 THEN 409 ELSE s END AS answered_status,
  CASE WHEN rn = 1 THEN body WHEN s <> 0 THEN b END AS answered_body FROM k
UNION ALL SELECT id, 'bypass', status, body FROM t WHERE key = '' OR length(key) > 200"""


def _requests(c: Catalog) -> DataFrame:
    i = F.col("id")
    token = F.when(i % 10 == 0, " \t").when(i % 10 == 1, "x" * 201).when(i % 10 == 2, F.concat(F.lit("\n"), (i % 4).cast("string"), F.lit("  "))).otherwise((i % 4).cast("string"))
    status = F.when(i % 6 == 0, 0).when(i % 7 == 0, 422).otherwise(200)
    return c.log.select("id", "actor_id", "action", "created_at", F.col("props").alias("body"), status.alias("status"), token.alias("token"))


@query(ANSWERS)
def idempotent_first_wins(c):
    return folds.first_wins(_requests(c), ["actor_id", "action"], "token", ["created_at", "id"]).select("id", "outcome", "answered_status", "answered_body")


@query(ANSWERS)
def idempotent_streamed(c):
    """The same requests as a stream of three batches, answers kept in state."""
    run = lambda s: stateful.first_wins(s, ["actor_id", "action"], "token", ["created_at", "id"])
    return replay.replayed(_requests(c), "created_at", run, name="answers").select("id", "outcome", "answered_status", "answered_body")


@query("SELECT id, row_number() OVER (PARTITION BY actor_id % 40 ORDER BY created_at, id) = 1 AS accepted FROM log")
def single_use_token(c):
    return folds.single_use(c.log.withColumn("token", F.col("actor_id") % 40), "token", ["created_at", "id"]).select("id", "accepted")


@query("""WITH d AS (SELECT source, doc_id, n_chars, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rn FROM documents),
f AS (SELECT source, doc_id, rn, CASE WHEN n_chars <= 20000 THEN n_chars ELSE 0 END AS used, n_chars <= 20000 AS kept FROM d WHERE rn = 1 UNION ALL
  SELECT d.source, d.doc_id, d.rn, CASE WHEN f.used + d.n_chars <= 20000 THEN f.used + d.n_chars ELSE f.used END, f.used + d.n_chars <= 20000 FROM f JOIN d ON d.source = f.source AND d.rn = f.rn + 1)
SELECT doc_id, kept FROM f""")
def greedy_pack(c):
    return folds.packed(c["documents"].select("source", "doc_id", "n_chars"), "source", ["doc_id"], "n_chars", 20000).select("doc_id", "kept")


@query(r"""SELECT conv_id AS stream_id, regexp_replace(string_agg(text, '' ORDER BY turn), '^\s+|\s+$', '', 'g') AS content, CAST(NULL AS VARCHAR) AS sources,
  CASE WHEN conv_id % 2 <> 0 THEN 'incomplete' END AS error, conv_id % 2 = 0 AS complete FROM conversations WHERE role = 'assistant' GROUP BY conv_id""")
def sse_fold(c):
    d = c["conversations"].where("role = 'assistant'").select(F.col("conv_id").alias("stream_id"), "turn", "text")
    frame = F.concat(F.lit("event: delta\ndata: "), F.to_json(F.struct(F.col("text"))), F.lit("\n\n"), F.when(F.col("stream_id") % 2 == 0, "event: done\ndata: {}\n\n").otherwise(""))
    cut = d.withColumn("frame", frame).select("stream_id", F.explode(F.array(F.struct((F.col("turn") * 2).alias("seq"), F.substring("frame", 1, 9).alias("chunk")),
        F.struct((F.col("turn") * 2 + 1).alias("seq"), F.expr("substring(frame, 10)").alias("chunk")))).alias("x"))
    return folds.frames(cut.select("stream_id", "x.seq", "x.chunk"))


# --- calendar, dates, numbers


@query("""SELECT CAST(moment AS DATE) AS day, count(*) AS n, min(label) AS first FROM (SELECT date AS moment, 'hearing ' || CAST(case_id AS VARCHAR) AS label FROM hearings
UNION ALL SELECT created_at, 'case ' || CAST(id AS VARCHAR) FROM cases) GROUP BY 1""")
def calendar_union_by_day(c):
    marks = c.hearings.select(F.col("date").alias("at"), F.concat(F.lit("hearing "), F.col("case_id").cast("string")).alias("label"))
    marks = marks.unionByName(c.cases.select(F.col("created_at").alias("at"), F.concat(F.lit("case "), F.col("id").cast("string")).alias("label")))
    return marks.groupBy(F.to_date("at").alias("day")).agg(F.count("*").alias("n"), F.min("label").alias("first"))


@query("""SELECT CAST(g.d AS DATE) AS day, count(h.case_id) AS n FROM generate_series({now}::DATE, {now}::DATE + INTERVAL 6 DAY, INTERVAL 1 DAY) g(d)
LEFT JOIN hearings h ON CAST(h.date AS DATE) = CAST(g.d AS DATE) GROUP BY 1""")
def week_ahead_spine(c):
    days = dates.spine(c.spark, AS_OF[:10], 7)
    marks = c.hearings.where(F.col("date").between(F.lit(AS_OF[:10]).cast("timestamp_ntz"), F.lit(AS_OF[:10]).cast("timestamp_ntz") + F.expr("interval 7 days")))
    n = marks.groupBy(F.to_date("date").alias("day")).agg(F.count("*").alias("n"))
    return days.join(n, "day", "left").select("day", F.coalesce("n", F.lit(0).cast("long")).alias("n"))


@query("SELECT DISTINCT CAST(date_trunc('month', created_at) AS DATE) AS month, CAST(dayofweek(date_trunc('month', created_at)) AS INT) AS blanks, CAST(day(last_day(created_at)) AS INT) AS days, CAST(date_trunc('month', created_at) + INTERVAL 1 MONTH AS DATE) AS next FROM cases")
def month_grid(c):
    m = c.cases.select(F.trunc("created_at", "month").alias("month")).distinct()
    g = dates.month_grid(F.col("month"))
    return m.select("month", g["blanks"].alias("blanks"), g["days"].alias("days"), F.add_months("month", 1).alias("next"))


@query("""SELECT id, CASE WHEN s < 60 THEN 'now' WHEN s < 3600 THEN CAST(s // 60 AS VARCHAR) || 'm' WHEN s < 86400 THEN CAST(s // 3600 AS VARCHAR) || 'h' ELSE CAST(s // 86400 AS VARCHAR) || 'd' END AS age
FROM (SELECT id, CAST(floor((epoch_us(TIMESTAMP '2024-03-01 00:00:00') - epoch_us(created_at)) / 1000000) AS BIGINT) AS s FROM log)""")
def relative_age_bucket(c):
    return c.log.select("id", dates.age(F.col("created_at"), F.lit("2024-03-01 00:00:00").cast("timestamp_ntz")).alias("age"))


@query("""SELECT DISTINCT minutes, CAST(minutes // 60 AS VARCHAR) || ':' || lpad(CAST(minutes % 60 AS VARCHAR), 2, '0') AS shown, minutes AS back,
  lpad(CAST(minutes * 61 // 3600 AS VARCHAR), 2, '0') || ':' || lpad(CAST(minutes * 61 // 60 % 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(minutes * 61 % 60 AS VARCHAR), 2, '0') AS clock FROM time_entries""")
def duration_format(c):
    d = c.time_entries.select("minutes").distinct()
    return d.select("minutes", dates.h_mm(F.col("minutes")).alias("shown"), dates.minutes_of(dates.h_mm(F.col("minutes"))).alias("back"), dates.hh_mm_ss(F.col("minutes") * 61).alias("clock"))


@query("""SELECT id, CASE WHEN s < 1024 THEN CAST(s AS VARCHAR) || ' B' WHEN s < 1048576 THEN CAST(CAST(floor(s / 1024 + 0.5) AS BIGINT) AS VARCHAR) || ' KB'
  ELSE CAST(CAST(floor(s / 1048576 * 10 + 0.5) AS BIGINT) // 10 AS VARCHAR) || '.' || CAST(CAST(floor(s / 1048576 * 10 + 0.5) AS BIGINT) % 10 AS VARCHAR) || ' MB' END AS shown FROM (SELECT id, size * (id % 3) * (id % 3) * 500 + size AS s FROM files)""")
def size_format(c):
    return c.files.select("id", dates.size_text(F.expr("size * (id % 3) * (id % 3) * 500 + size")).alias("shown"))


@query("SELECT id, CAST(floor(balance + 0.5) AS BIGINT) AS rounded FROM (SELECT id, balance FROM clients)")
def round_half_up(c):
    return c.clients.select("id", dates.half_up(F.col("balance")).alias("rounded"))


# --- text and data


@query(r"""SELECT id, length(s) AS n, md5(s) AS digest FROM (SELECT id, CASE WHEN length(t) > 2000 THEN substr(t, 1, 2000) || '…[+' || CAST(length(t) - 2000 AS VARCHAR) || ' chars]' ELSE t END AS s FROM (SELECT id,
  regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, 'eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+', '[redacted-token]', 'g'),
  '(ds_token=|token=|authorization:\s*bearer\s+|bearer\s+)[A-Za-z0-9._-]+', '\1[redacted-token]', 'gi'), '\b[a-f0-9]{32,}\b', '[redacted-hex]', 'gi'),
  '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}', '[redacted-email]', 'g') AS t FROM files))""")
def scrub_pii(c):
    s = text.scrub(F.col("text"))
    return c.files.select("id", s.alias("s")).select("id", F.length("s").cast("long").alias("n"), F.md5(F.col("s").cast("binary")).alias("digest"))


@query(r"SELECT id, substr(regexp_replace(regexp_replace(name, '[^A-Za-z0-9_.\x{0600}-\x{06FF}-]', '_', 'g'), '_+', '_', 'g'), 1, 120) AS safe FROM files")
def sanitize_name(c):
    return c.files.select("id", text.safe_name(F.col("name")).alias("safe"))


@query("""SELECT id, e AS extension, CASE e WHEN 'PDF' THEN 'pdf' WHEN 'DOCX' THEN 'word' WHEN 'XLS' THEN 'sheet' ELSE 'other' END AS kind,
  CASE WHEN lower(name) LIKE '%pdf%' THEN 'pdf' WHEN lower(name) LIKE '%doc%' THEN 'word' WHEN lower(name) LIKE '%xls%' OR lower(name) LIKE '%sheet%' THEN 'sheet' WHEN lower(name) LIKE '%image%' OR lower(name) LIKE '%.png%' THEN 'image' ELSE 'other' END AS kind_of_name FROM (SELECT id, name, upper(list_extract(string_split(name, '.'), -1)) AS e FROM files)""")
def extension_bucket(c):
    return c.files.select("id", text.extension(F.col("name")).alias("extension"), text.file_kind(text.extension(F.col("name"))).alias("kind"), text.file_kind(F.col("name")).alias("kind_of_name"))


@query("""SELECT id, CASE WHEN id % 2 = 0 THEN lang || ' - ' || source ELSE source END AS joined FROM files""")
def join_nonempty(c):
    return c.files.select("id", text.joined(" - ", F.when(F.col("id") % 2 == 0, F.col("lang")).otherwise("  "), F.lit(None).cast("string"), F.col("source")).alias("joined"))


@query("""SELECT page_id, md5(replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#39;')) AS escaped FROM pages""")
def escape_html(c):
    return c["pages"].select("page_id", F.md5(text.escape_html(F.col("html")).cast("binary")).alias("escaped"))


@query("""SELECT id, CASE WHEN id % 5 = 0 THEN NULL ELSE '10.0.0.' || CAST(id % 200 AS VARCHAR) END AS first, CASE WHEN id % 5 = 0 THEN NULL ELSE '172.16.0.' || CAST(id % 100 AS VARCHAR) END AS last FROM clients""")
def forwarded_hop(c):
    h = F.expr("case when id % 5 = 0 then ' , ,' else concat('10.0.0.', id % 200, ' , 192.168.0.1,172.16.0.', id % 100, ',') end")
    return c.clients.select("id", text.first_hop(h).alias("first"), text.last_hop(h).alias("last"))


@query("SELECT page_id, string_split(url, '?')[1] AS bare FROM pages")
def strip_query(c):
    return c["pages"].select("page_id", text.no_query(F.col("url")).alias("bare"))


@query("""SELECT id, 'k=' || json_extract_string(props, '$.k') AS shown, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM log""")
def json_props_dispatch(c):
    return c.log.select("id", data.summary(F.col("props")).alias("shown"), F.from_json("props", "k int")["k"].alias("k"))


@query("SELECT id, id % 3 = 0 AS valid FROM log")
def json_validate(c):
    body = F.expr("""case id % 3 when 0 then '{"summary":"s","parties":["a"],"risks":[{"level":"low","text":"t"}]}' when 1 then '{"summary":"s","parties":["a"],"risks":[{"level":"odd","text":"t"}]}' else '{"summary":' end""")
    return c.log.select("id", data.valid_review(body).alias("valid"))


@query("""SELECT id, CASE WHEN id % 7 = 0 THEN NULL ELSE id % 5 <> 0 END AS untouched FROM files""")
def sha256_tamper(c):
    stored = F.when(F.col("id") % 5 == 0, F.sha2(F.lit("other"), 256)).otherwise(data.sha256(F.col("text")))
    content = F.when(F.col("id") % 7 != 0, F.col("text"))
    return c.files.select("id", data.untampered(stored, content).alias("untouched"))


@query("""SELECT id, concat_ws(',', CASE WHEN id % 2 = 0 THEN 'status' END, CASE WHEN id % 3 = 0 THEN 'type' END) AS supplied FROM cases""")
def changed_fields(c):
    one = lambda k, v: F.create_map(F.lit(k), v)
    none = F.create_map().cast("map<string,string>")
    patch = F.map_concat(one("other", F.lit("x")), F.when(F.col("id") % 2 == 0, one("status", F.col("status"))).otherwise(none), F.when(F.col("id") % 3 == 0, one("type", F.lit("NEW"))).otherwise(none))
    return c.cases.select("id", F.array_join(data.supplied(patch, ["status", "type"]), ",").alias("supplied"))


@query("SELECT id, replace(replace(rtrim(to_base64(encode(name)), '='), '+', '-'), '/', '_') AS coded, name AS back FROM files")
def base64url_codec(c):
    coded = data.to_base64url(F.col("name"))
    return c.files.select("id", coded.alias("coded"), data.from_base64url(coded).cast("string").alias("back"))


@query()
def line_diff(c):
    """Every document against the one whose number follows."""
    d = c["documents"].select("doc_id", F.col("text").alias("a"))
    pairs = d.join(c["documents"].select((F.col("doc_id") - 1).alias("doc_id"), F.col("text").alias("b")), "doc_id")
    found = documents.line_diffs(pairs, "a", "b").groupBy("doc_id")
    n = found.agg(*[F.count_if(F.col("kind") == k).alias(k) for k in ("add", "del", "same")])
    return pairs.select("doc_id").join(n, "doc_id", "left").select("doc_id", *[F.coalesce(k, F.lit(0).cast("long")).alias(k) for k in ("add", "del", "same")])


@query("""WITH t AS (SELECT doc_id, regexp_replace(replace(replace(text, chr(13), ''), chr(10), chr(10) || chr(10)), '^\\s+|\\s+$', '', 'g') AS t FROM documents)
SELECT doc_id, CASE WHEN length(t) >= 20 THEN md5(t) END AS digest, CASE WHEN length(t) >= 20 THEN 'docx' ELSE 'too_little' END AS method FROM t""")
def docx_round_trip(c):
    """Every document as a DOCX file of its lines, read back."""
    x = documents.extract(F.lit("docx"), documents.as_docx(F.split("text", "\n")))
    return c["documents"].select("doc_id", x.alias("x")).select("doc_id", F.md5(F.col("x.text").cast("binary")).alias("digest"), F.col("x.method").alias("method"))


@query()
def html_extract_tagged(c):
    x = documents.extract(F.lit("html"), F.col("html"))
    return c["pages"].select("page_id", x.alias("x")).select("page_id", F.col("x.method").alias("method"), F.length("x.text").alias("n"))


BODIES = (
    ("PDF", "255044462D31"), ("PDF", "0050444600"), ("PNG", "89504E470D0A"), ("PNG", "89504E"), ("JPG", "FFD8FFE0"), ("JPEG", "FFD8FFE1"), ("JPEG", "89504E47"),
    ("DOC", "D0CF11E0A1B11AE100"), ("XLS", "D0CF11E0A1B11AE1"), ("DOC", "D0CF11E000000000"), ("DOCX", "504B0304"), ("XLSX", "504B"), ("XLSX", "5041"), ("TXT", "255044462D31"),
    ("TXT", "706C61696E"), ("TXT", "610062"), ("EXE", "4D5A"), ("TXT", ""),
)


@query(f"""WITH b(i, kind, body) AS (VALUES {", ".join(f"({i}, '{k}', from_hex('{h}'))" for i, (k, h) in enumerate(BODIES))})
SELECT f.id, b.kind, CASE WHEN kind IN ('PDF', 'PNG') THEN starts_with(hex(body), CASE kind WHEN 'PDF' THEN '25504446' ELSE '89504E47' END)
  WHEN kind IN ('JPG', 'JPEG') THEN starts_with(hex(body), 'FFD8FF') WHEN kind IN ('DOC', 'XLS') THEN starts_with(hex(body), 'D0CF11E0A1B11AE1')
  WHEN kind IN ('DOCX', 'XLSX') THEN starts_with(hex(body), '504B') WHEN kind = 'TXT' THEN NOT regexp_matches(hex(body), '^(..)*00') ELSE false END AS fits FROM files f JOIN b ON b.i = f.id % {len(BODIES)}""")
def magic_bytes(c):
    bodies = F.array(*[F.struct(F.lit(k).alias("kind"), F.unhex(F.lit(h)).alias("body")) for k, h in BODIES])
    d = c.files.select("id", F.element_at(bodies, (F.col("id") % len(BODIES) + 1).cast("int")).alias("b"))
    return d.select("id", "b.kind", data.signature_fits(F.col("b.kind"), F.col("b.body")).alias("fits"))


# --- writes


@query("""SELECT id, CASE WHEN id % 4 = 0 THEN NULL WHEN id % 4 = 1 THEN 'PATCHED' ELSE type END AS type, status FROM cases""")
def sparse_patch(c):
    patch = c.cases.where("id % 4 < 3").select(
        "id", F.when(F.col("id") % 4 == 1, F.lit("PATCHED")).alias("type"), (F.col("id") % 4 < 2).alias("has_type"), F.lit(None).cast("string").alias("status"), F.lit(False).alias("has_status")
    )
    return dml.patched(c.cases, patch, "id", ["type", "status"]).select("id", "type", "status")


CASCADE = "(SELECT id FROM cases WHERE id % 10 = 3)"


@query(f"""SELECT 'files' AS name, count(*) AS n FROM files WHERE case_id IN {CASCADE} UNION ALL SELECT 'hearings', count(*) FROM hearings WHERE case_id IN {CASCADE}
UNION ALL SELECT 'invoices', count(*) FROM invoices WHERE case_id IN {CASCADE}""")
def cascade_counts(c):
    gone = c.cases.where("id % 10 = 3").select("id")
    return dml.detached(gone, {"files": c.files, "hearings": c.hearings}, {"invoices": c.invoices})[1]


@query(f"SELECT id, CASE WHEN case_id IN {CASCADE} THEN NULL ELSE case_id END AS case_id FROM invoices")
def cascade_detach(c):
    gone = c.cases.where("id % 10 = 3").select("id")
    return dml.detached(gone, {"files": c.files}, {"invoices": c.invoices})[0]["invoices"].select("id", "case_id")


@query("""SELECT id, name FROM offices WHERE id >= 5 UNION ALL SELECT * FROM (VALUES (CAST(1 AS INT), 'one'), (CAST(4 AS INT), 'four'), (CAST(99 AS INT), 'new')) v(id, name)
UNION ALL SELECT id, name FROM offices WHERE id IN (0, 2, 3)""")
def upsert_merge(c):
    rows = c.spark.createDataFrame([(1, "one"), (4, "four"), (99, "new")], "id int, name string")
    return dml.upserted(c.offices.select("id", "name"), rows, "id")


@query("""SELECT owner_id AS user_id, id AS case_id, 'status' AS kind FROM cases WHERE owner_id <> id % 5 AND id % 2 = 0
UNION ALL SELECT owner_id, id, 'assignment' FROM cases WHERE owner_id <> id % 5 AND id % 3 = 0 AND coalesce(lawyer_id, -1) <> 99""")
def notify_fanout(c):
    ch = c.cases.select(
        F.col("id").alias("case_id"), "owner_id", (F.col("id") % 5).alias("actor_id"), F.col("status").alias("old_status"), F.when(F.col("id") % 2 == 0, "X").otherwise(F.col("status")).alias("new_status"),
        F.col("lawyer_id").alias("old_lawyer_id"), F.when(F.col("id") % 3 == 0, F.lit(99).cast("long")).otherwise(F.col("lawyer_id")).alias("new_lawyer_id"),
    )
    return dml.notices(ch)


@query("SELECT id, active AND id % 9 <> 0 AS active FROM clients")
def soft_delete(c):
    return dml.updated(c.clients, F.col("id") % 9 == 0, active=F.lit(False)).select("id", "active")


@query("SELECT id FROM files WHERE id % 6 <> 0")
def hard_delete(c):
    return dml.deleted(c.files, c.files.where("id % 6 = 0")).select("id")


# --- smaller shapes


@query("""SELECT id, CASE action WHEN 'purchase' THEN 'ACTIVE' WHEN 'signup' THEN 'TRIALING' WHEN 'logout' THEN 'CANCELED' END AS status, action = 'logout' AS ends
FROM log WHERE action IN ('purchase', 'signup', 'logout')""")
def webhook_dispatch(c):
    to = rules.dispatched(F.col("action"), {"purchase": ("ACTIVE", False), "signup": ("TRIALING", False), "logout": ("CANCELED", True)})
    return c.log.select("id", to.alias("x")).where("x is not null").select("id", "x.*")


@query("""SELECT d.id AS document_id, d.name AS document, i.name AS image, s.name AS signer FROM files d LEFT JOIN files i ON i.id = d.id + 1 LEFT JOIN staff s ON s.id = d.id WHERE d.id % 5 = 0""")
def signature_history(c):
    signed = c.files.where("id % 5 = 0").select(F.col("id").alias("document_id"), (F.col("id") + 1).alias("image_id"), F.col("id").alias("signer_id"), F.lit(AS_OF).alias("signed_at"))
    return nested.signatures(signed, c.files, c.staff).select("document_id", "document", "image", "signer")


@query("""WITH a AS (SELECT id, 'u' || CAST(id AS VARCHAR) || '@x.org' AS email FROM clients),
l AS (SELECT id FROM clients WHERE office_id = {o} AND owner_id = 3), s AS (SELECT id FROM staff WHERE office_id = {o} AND active)
SELECT a.id, a.id IN (SELECT id FROM l) AS client, a.id IN (SELECT id FROM s) AS colleague FROM a WHERE a.id IN (SELECT id FROM l) OR a.id IN (SELECT id FROM s)""")
def mail_recipients(c):
    mail = lambda df: df.withColumn("email", F.concat(F.lit("U"), F.col("id").cast("string"), F.lit("@x.org")))
    addresses = c.clients.select("id", F.concat(F.lit("u"), F.col("id").cast("string"), F.lit("@x.org")).alias("email"))
    near = c.staff.where(F.col("office_id") == c.first_office)
    return scope.may_receive(addresses, mail(scope.clients_owned(lawyer(c), c.clients)), mail(near)).select("id", "client", "colleague")


@query("SELECT k.id FROM cases k WHERE k.client_id = 1")
def dependent_choice(c):
    return c.cases.where(rules.chosen(F.col("client_id"), 1)).select("id")


@query("""SELECT k.id, CAST(row_number() OVER (PARTITION BY k.office_id ORDER BY k.created_at DESC, k.id DESC) AS INT) AS place FROM cases k JOIN clients l ON l.id = k.client_id
WHERE k.status = 'ACTIVE' AND k.type IN ('1-URGENT', '3-MEDIUM') AND (contains(lower(l.name), '00') OR contains(CAST(k.id AS VARCHAR), '00'))""")
def filtered_ordinal(c):
    """Places of an office's cases as a list shows them once it is filtered by status, kinds and a text."""
    named = c.cases.join(c.clients.select(F.col("id").alias("client_id"), "name"), "client_id")
    shown = named.where(scope.every(F.col("status") == "ACTIVE", F.col("type").isin("1-URGENT", "3-MEDIUM"), scope.some(search.holds("name", "00"), search.holds(F.col("id").cast("string"), "00"))))
    return nested.numbered(shown, ["office_id"], [F.col("created_at").desc(), F.col("id").desc()]).select("id", "place")


@query("""SELECT i.id FROM invoices i WHERE EXISTS (SELECT 1 FROM cases k WHERE k.id = i.case_id AND k.client_id = i.client_id)""")
def composite_reference(c):
    return c.invoices.join(c.cases.select(F.col("id").alias("case_id"), "client_id"), ["case_id", "client_id"], "left_semi").select("id")


@query("SELECT count(*) FILTER (role = 'user') AS said, count(*) FILTER (role = 'assistant') AS answered, count(*) FILTER (role NOT IN ('user', 'assistant')) AS other FROM conversations")
def role_tabs(c):
    known = F.col("role").isin("user", "assistant")
    return c["conversations"].agg(F.count_if(F.col("role") == "user").alias("said"), F.count_if(F.col("role") == "assistant").alias("answered"), F.count_if(~known).alias("other"))


@query("SELECT page_id, upper(substr(md5(url), 1, 4)) || ' ' || upper(substr(md5(url), 5, 4)) AS shown FROM pages")
def grouped_code(c):
    code = F.upper(F.substring(F.md5(F.col("url").cast("binary")), 1, 8))
    return c["pages"].select("page_id", text.in_fours(code).alias("shown"))


@query("SELECT id, coalesce(CASE status WHEN 'ACTIVE' THEN 'Open' WHEN 'CLOSED' THEN 'Done' END, status) AS shown, 'No. ' || lpad(CAST(id AS VARCHAR), CAST(greatest(6, length(CAST(id AS VARCHAR))) AS INT), '0') AS number FROM cases")
def labels_and_numbers(c):
    names = {"ACTIVE": "Open", "CLOSED": "Done"}
    return c.cases.select("id", text.label(F.col("status"), names).alias("shown"), F.concat(F.lit("No. "), text.padded(F.col("id"), 6)).alias("number"))


@query("SELECT id, 'Contract of ' || name || ' for ........' AS filled FROM clients")
def template_fill(c):
    return c.clients.select("id", text.filled("Contract of {name} for {what}", name=F.col("name"), what=F.lit("")).alias("filled"))


@query("SELECT id, CAST(len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\s\\x0B\\p{Z}]'))) AS INT) AS n FROM files")
def line_counts(c):
    return c.files.select("id", F.size(text.filled_lines(F.col("text"))).alias("n"))


@query("SELECT id, length(text) > 4000 AS cut, length(substr(text, 1, 4000)) AS kept FROM files")
def truncation_flag(c):
    return c.files.select("id", (F.length("text") > 4000).alias("cut"), F.length(text.cut(F.col("text"), 4000)).cast("long").alias("kept"))


from . import lookups, operations  # noqa: E402, F401  registers its queries too
