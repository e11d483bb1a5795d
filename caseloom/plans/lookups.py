"""Further registered queries: lookups, new rows, changes, chains and the small functions of texts, dates and data."""

from __future__ import annotations

from pyspark.sql import Window as W, functions as F

from ..functions import data, dates, text
from ..operators import dml, integrity, lookup, paging, rules, scope
from .queries import ORACLE, QUERIES, Catalog, lawyer, now, query

# --- lookups


@query("SELECT id, status, type FROM cases WHERE id = 7")
def point_lookup(c):
    return lookup.by_key(c.cases, id=7).select("id", "status", "type")


@query("SELECT case_id, line, room, status FROM hearings WHERE case_id = 7 AND line = 1")
def compound_lookup(c):
    return lookup.by_key(c.hearings, case_id=7, line=1).select("case_id", "line", "room", "status")


@query("SELECT id, status, type FROM cases WHERE office_id = {o} AND owner_id = 3 AND status = 'ACTIVE' ORDER BY id LIMIT 1")
def scoped_first(c):
    return lookup.first_match(scope.cases(lawyer(c), c.cases), F.col("status") == "ACTIVE", "id").select("id", "status", "type")


@query("SELECT id, name FROM offices WHERE id = {o}")
def throwing_lookup(c):
    return lookup.required(lookup.by_key(c.offices, id=c.first_office).select("id", "name"))


@query("""SELECT id, replace(replace(rtrim(to_base64(encode('{"v":"' || strftime(created_at, '%Y-%m-%dT%H:%M:%S.%g') || '","id":' || id || '}')), '='), '+', '-'), '/', '_') AS cursor FROM cases""")
def cursors(c):
    """The cursor with which a page would go on after each case."""
    return c.cases.select("id", paging.cursor_column(F.col("created_at"), F.col("id")).alias("cursor"))


# --- writes

RAW = "SELECT id, CASE WHEN id % 7 = 0 THEN '  ' ELSE concat(' ', name, '  ') END AS name, CASE id % 3 WHEN 0 THEN ' ' WHEN 1 THEN concat(' A', CAST(id AS VARCHAR(20)), '@X.Org ') END AS email, CASE WHEN id % 2 = 0 THEN ' 12 34 ' END AS phone FROM clients"


@query(f"""SELECT id, trim(name) AS name, lower(nullif(trim(email), '')) AS email, nullif(trim(phone), '') AS phone, 5 AS office_id, true AS active FROM ({RAW}) r WHERE trim(name) <> ''""")
def insert_with_defaults(c):
    raw = c.spark.sql(RAW.replace("FROM clients", "FROM {clients}"), clients=c.clients)
    return dml.inserted(raw, ["name"], ["email", "phone"], lower=("email",), office_id=F.lit(5), active=F.lit(True))


@query("""SELECT id, CASE WHEN a <= 0 THEN 'amount' WHEN p < 0 THEN 'paid' WHEN coalesce(p, paid) > coalesce(a, amount) THEN 'over' END AS refused FROM
(SELECT id, amount, paid, CASE id % 4 WHEN 0 THEN 0.0 WHEN 1 THEN amount / 4 END AS a, CASE id % 5 WHEN 0 THEN -1.0 WHEN 1 THEN amount / 2 END AS p FROM invoices) i""")
def partial_amounts(c):
    i = F.col("id")
    a = F.when(i % 4 == 0, 0.0).when(i % 4 == 1, F.col("amount") / 4)
    p = F.when(i % 5 == 0, -1.0).when(i % 5 == 1, F.col("amount") / 2)
    return c.invoices.select("id", rules.patched_amounts(F.col("amount"), F.col("paid"), a, p).alias("refused"))


@query("SELECT id, slot + CASE WHEN active THEN 1 ELSE 0 END AS version FROM staff")
def increment(c):
    return dml.updated(c.staff, F.col("active"), slot=F.col("slot") + 1).select("id", F.col("slot").alias("version"))


@query("""SELECT id, active, id IN (SELECT id FROM clients WHERE active) AS listed FROM clients WHERE id % 3 = 0 OR active""")
def soft_deleted_by_id(c):
    by_id = c.clients.where((F.col("id") % 3 == 0) | F.col("active"))
    listed = c.clients.where("active").select("id", F.lit(True).alias("listed"))
    return by_id.join(listed, "id", "left").select("id", "active", F.coalesce("listed", F.lit(False)).alias("listed"))


# --- joins


@query("""SELECT o.id, o.name, coalesce(s.status, 'none') AS status, coalesce(r.r_name, 'none') AS plan FROM offices o
LEFT JOIN (SELECT office_id, id % 7 AS plan_id, CASE WHEN active THEN 'ACTIVE' ELSE 'PAST_DUE' END AS status FROM staff WHERE role = 'OFFICE_MANAGER') s ON s.office_id = o.id
LEFT JOIN region r ON r.r_regionkey = s.plan_id""")
def office_plan_chain(c):
    subs = c.staff.where("role = 'OFFICE_MANAGER'").select(F.col("office_id").alias("id"), (F.col("id") % 7).alias("plan_id"), F.when(F.col("active"), "ACTIVE").otherwise("PAST_DUE").alias("status"))
    plans = c["region"].select(F.col("r_regionkey").cast("long").alias("plan_id"), F.col("r_name").alias("plan"))
    out = c.offices.select("id", "name").join(subs, "id", "left").join(plans, "plan_id", "left")
    return out.select("id", "name", F.coalesce("status", F.lit("none")).alias("status"), F.coalesce("plan", F.lit("none")).alias("plan"))


@query("SELECT l.id, l.name, u.id AS user_id, u.name AS user_name FROM clients l LEFT JOIN staff u ON u.id * 3 = l.id")
def client_account(c):
    users = c.staff.select((F.col("id") * 3).alias("id"), F.col("id").alias("user_id"), F.col("name").alias("user_name"))
    return c.clients.select("id", "name").join(users, "id", "left")


CHECKS = """SELECT 'case_client_office' AS name, count(*) AS n FROM cases k JOIN clients l ON l.id = k.client_id WHERE k.office_id <> l.office_id
UNION ALL SELECT 'entry_user_case_office', count(*) FROM time_entries t JOIN staff s ON s.id = t.user_id JOIN cases k ON k.id = t.case_id WHERE s.office_id <> k.office_id
UNION ALL SELECT 'file_case_owner', count(*) FROM files f JOIN cases k ON k.id = f.case_id WHERE f.owner_id <> k.owner_id
UNION ALL SELECT 'invoice_client_case_office', count(*) FROM invoices i JOIN clients l ON l.id = i.client_id JOIN cases k ON k.id = i.case_id WHERE l.office_id <> k.office_id
UNION ALL SELECT 'case_lawyer_owner', count(*) FROM cases k JOIN clients l ON l.id = k.client_id WHERE k.lawyer_id <> l.owner_id"""


@query(CHECKS)
def audit_tenant_mismatch_more(c):
    entries = c.time_entries.join(c.staff.select(F.col("id").alias("user_id"), "office_id"), "user_id")
    bills = c.invoices.join(c.clients.select(F.col("id").alias("client_id"), "office_id"), "client_id")
    return integrity.violations({
        "case_client_office": integrity.mismatches(c.cases, c.clients, "client_id", "office_id", "office_id"),
        "entry_user_case_office": integrity.mismatches(entries, c.cases, "case_id", "office_id", "office_id"),
        "file_case_owner": integrity.mismatches(c.files, c.cases, "case_id", "owner_id", "owner_id"),
        "invoice_client_case_office": integrity.mismatches(bills, c.cases, "case_id", "office_id", "office_id"),
        "case_lawyer_owner": integrity.mismatches(c.cases, c.clients, "client_id", "lawyer_id", "owner_id"),
    })


CITIZEN = "(SELECT min(id) FROM clients WHERE office_id = {o})"


def _citizen(c: Catalog) -> scope.Principal:
    first = c.clients.where(F.col("office_id") == c.first_office).agg(F.min("id")).first()[0]
    return scope.Principal(scope.CITIZEN, c.first_office, client=first)


@query(f"SELECT i.id, i.amount, i.paid, i.status FROM invoices i JOIN clients l ON l.id = i.client_id WHERE i.client_id = {CITIZEN} AND l.office_id = {{o}}")
def citizen_invoices(c):
    bills = c.invoices.join(c.clients.select(F.col("id").alias("client_id"), "office_id"), "client_id")
    return scope.citizen(_citizen(c), bills).select("id", "amount", "paid", "status")


@query(f"SELECT h.case_id, h.line, h.status FROM hearings h WHERE h.case_id IN (SELECT id FROM cases WHERE client_id = {CITIZEN} AND office_id = {{o}})")
def citizen_hearings(c):
    own = scope.citizen(_citizen(c), c.cases).select(F.col("id").alias("case_id"))
    return c.hearings.join(own, "case_id", "left_semi").select("case_id", "line", "status")


@query("SELECT f.id, f.name FROM files f WHERE suffix(f.name, '.png') OR starts_with(f.name, 'src1/')")
def starts_and_ends(c):
    return c.files.where(F.col("name").endswith(".png") | F.col("name").startswith("src1/")).select("id", "name")


# --- totals and orders


@query(f"SELECT count(*) AS total FROM ({ORACLE['search_federated']}) s")
def search_total(c):
    return QUERIES["search_federated"](c.spark, c.dir).agg(F.count("*").alias("total"))


@query("SELECT id, name, row_number() OVER (ORDER BY lower(name), id) AS place FROM offices")
def collated_order(c):
    return c.offices.select("id", "name", F.row_number().over(W.orderBy(F.collate("name", "UNICODE_CI"), "id")).alias("place"))


@query("""SELECT office_id, count(*) FILTER (status = 'ACTIVE') AS active, count(*) FILTER (status = 'CLOSED') AS closed, count(*) FILTER (status = 'PENDING') AS pending FROM cases GROUP BY office_id""")
def entries_as_map(c):
    n = c.cases.groupBy("office_id", "status").agg(F.count("*").alias("n"))
    entries = F.array_sort(F.collect_list(F.struct(F.col("status").alias("key"), F.col("n").alias("value"))))  # one entry a status
    m = n.groupBy("office_id").agg(data.entries_map(entries).alias("m"))
    return m.select("office_id", *[F.coalesce(F.try_element_at("m", F.lit(k)).cast("long"), F.lit(0)).cast("long").alias(k.lower()) for k in ("ACTIVE", "CLOSED", "PENDING")])


@query("""SELECT client_id, CAST(sum(CAST(amount AS DECIMAL(18, 2))) AS DOUBLE) AS total, CAST(sum(CAST(paid AS DECIMAL(18, 2))) AS DOUBLE) AS paid,
  CAST(sum(CAST(amount AS DECIMAL(18, 2))) - sum(CAST(paid AS DECIMAL(18, 2))) AS DOUBLE) AS remaining, count(*) FILTER (status = 'PAID') AS n_paid FROM invoices GROUP BY client_id""")
def client_balance(c):
    money = lambda name: F.sum(F.col(name).cast("decimal(18,2)"))
    return c.invoices.groupBy("client_id").agg(
        money("amount").cast("double").alias("total"), money("paid").cast("double").alias("paid"), (money("amount") - money("paid")).cast("double").alias("remaining"),
        F.count_if(F.col("status") == "PAID").alias("n_paid"),
    )


@query("""SELECT CAST(date AS DATE) AS day, string_agg(CAST(case_id AS VARCHAR) || '/' || CAST(line AS VARCHAR), ',' ORDER BY case_id, line) AS items FROM hearings WHERE status = 'UPCOMING' GROUP BY 1""")
def calendar_day_lists(c):
    item = F.struct("case_id", "line")
    d = c.hearings.where("status = 'UPCOMING'").groupBy(F.to_date("date").alias("day")).agg(F.sort_array(F.collect_list(item)).alias("x"))
    return d.select("day", F.array_join(F.transform("x", lambda x: F.concat_ws("/", x["case_id"], x["line"])), ",").alias("items"))


@query("""SELECT id, created_at FROM cases WHERE created_at > TIMESTAMP '1998-01-01 00:00:00' OR (created_at = TIMESTAMP '1998-01-01 00:00:00' AND id > 50) ORDER BY created_at, id LIMIT 6""")
def page_after_cursor(c):
    from datetime import datetime

    at = paging.decode_cursor(paging.encode_cursor(datetime(1998, 1, 1), 50))
    return paging.window(c.cases, paging.limit("5"), cursor=at, ascending=True).select("id", "created_at")


# --- small functions

ODD = "SELECT id, concat(chr(9), ' ', CASE WHEN id % 5 = 0 THEN '' ELSE name END, ' ') AS s, CASE id % 4 WHEN 0 THEN concat(' Me', CAST(id AS VARCHAR(20)), '@Host.org ') WHEN 1 THEN 'no at.org' WHEN 2 THEN 'a@b' ELSE 'a b@c.d' END AS mail, CASE id % 3 WHEN 0 THEN '#aB12ff' WHEN 1 THEN '#12345' ELSE 'red' END AS colour, CASE id % 3 WHEN 0 THEN '+1 (555) 123-4567' WHEN 1 THEN '1234567' ELSE '1234567890123456' END AS phone FROM clients"


@query(rf"""SELECT id, regexp_replace(s, '^\s+|\s+$', '', 'g') AS trimmed, nullif(regexp_replace(s, '^\s+|\s+$', '', 'g'), '') AS or_null, lower(trim(mail)) AS key, substr(s, 1, 7) AS head,
  regexp_matches(trim(mail), '^[^\s@]+@[^\s@]+\.[^\s@]+$') AS is_mail, colour = '#aB12ff' AS is_colour, regexp_replace(phone, '[^0-9]', '', 'g') AS digits, id % 3 = 0 AS is_phone FROM ({ODD}) o""")
def text_checks(c):
    d = c.spark.sql(ODD.replace("FROM clients", "FROM {clients}"), clients=c.clients)
    s, mail = F.col("s"), F.col("mail")
    return d.select(
        "id", text.trim_all(s).alias("trimmed"), text.blank_to_null(s).alias("or_null"), text.email_key(mail).alias("key"), text.cut(s, 7).alias("head"),
        text.is_email(text.trim_all(mail)).alias("is_mail"), text.is_colour(F.col("colour")).alias("is_colour"), text.digits(F.col("phone")).alias("digits"), text.is_phone(F.col("phone")).alias("is_phone"),
    )


ADDRESSES = """SELECT page_id, CASE page_id % 8 WHEN 0 THEN concat('https://www.youtube.com/watch?v=abc_', substr(url, length(url) - 6, 7), '&t=1') WHEN 1 THEN concat('https://youtu.be/', substr(url, 9, 11), '?x')
  WHEN 2 THEN concat('https://youtube.com/embed/ab-', substr(url, 9, 8)) WHEN 3 THEN concat('https://youtube.com/shorts/', substr(url, 9, 12)) WHEN 4 THEN concat('ftp://evil.example/?v=', substr(url, 9, 11))
  WHEN 5 THEN concat('http://youtube.com/watch?v=', substr(url, 9, 11)) WHEN 6 THEN 'https://youtube.com/watch?v=short' ELSE url END AS u FROM pages"""


@query(rf"""SELECT page_id, regexp_extract(u, '(youtu\.be/|youtube\.com/(watch\?v=|embed/|shorts/))([A-Za-z0-9_-]{{11}})', 3) AS video,
  starts_with(u, 'https://youtube.com/') OR starts_with(u, 'https://www.youtube.com/') OR starts_with(u, 'https://youtu.be/') OR starts_with(u, 'https://www.youtu.be/') AS is_video FROM ({ADDRESSES}) a""")
def video_ids(c):
    d = c.spark.sql(ADDRESSES.replace("FROM pages", "FROM {pages}"), pages=c["pages"])
    return d.select("page_id", text.video_id(F.col("u")).alias("video"), text.is_video(F.col("u")).alias("is_video"))


@query("""SELECT id, array_to_string(list_slice(string_split(name, ' '), 1, 1), ' ') AS first, CASE WHEN id % 2 = 0 THEN 'kept' ELSE '' END AS excerpt, length(name) >= 32 AND lower(name) NOT IN ('changeme', 'secret', 'password') AS strong,
  string_split(name, ' ')[-1] AS last FROM files""")
def words_and_excerpts(c):
    excerpts = F.array(F.when(F.col("id") % 2 == 0, F.lit("kept")).otherwise(F.lit("gone")))
    return c.files.select(
        "id", text.first_words(F.col("name"), 1).alias("first"), text.quoted_only(excerpts, F.lit("words kept in the source"))[0].alias("excerpt"),
        text.strong_secret(F.col("name")).alias("strong"), F.array_join(text.last_items(F.split("name", " "), 1), " ").alias("last"),
    )


@query("""SELECT id, CASE WHEN id % 3 <> 0 THEN created_at END AS moment, abs(epoch_us(created_at) - epoch_us({now})) <= 18000000000 AS near FROM cases""")
def moments(c):
    written = F.when(F.col("id") % 3 != 0, F.date_format("created_at", "yyyy-MM-dd HH:mm:ss")).otherwise("no day")
    return c.cases.select("id", dates.valid_moment(written).cast("timestamp_ntz").alias("moment"), dates.recent(F.col("created_at"), now(), 300).alias("near"))


@query("""SELECT id, CASE WHEN id % 3 = 0 THEN 2 END AS n, CASE WHEN id % 2 = 0 THEN 'a' ELSE '' END AS kept, '{"m":"[redacted-email]"}' AS scrubbed, id % 5 = 0 AS signed FROM log""")
def data_checks(c):
    i = F.col("id")
    body = F.when(i % 3 == 0, F.lit('["x","y"]')).when(i % 3 == 1, F.lit('["x",null]')).otherwise(F.lit("{"))
    m = F.create_map(F.when(i % 2 == 0, F.lit("a")).otherwise(F.lit("z")), F.lit("1"))
    secret = "key"
    import hashlib
    import hmac

    right = hmac.new(secret.encode(), b"body", hashlib.sha256).hexdigest()
    return c.log.select(
        "id", F.size(data.text_list(body)).alias("n"), F.array_join(F.map_keys(data.known_keys(m, ["a", "b"])), ",").alias("kept"),
        data.scrub_json(F.concat(F.lit('{"m":"u'), i.cast("string"), F.lit('@x.org"}'))).alias("scrubbed"),
        data.signed(F.lit("body"), F.when(i % 5 == 0, F.lit(right)).otherwise(F.lit("0" * 64)), secret).alias("signed"),
    )


@query("""SELECT id, CASE id % 6 WHEN 0 THEN 'a,b' WHEN 1 THEN 'why' WHEN 2 THEN 'done' WHEN 3 THEN 'odd' WHEN 4 THEN 'x=1, y=2, z=3' END AS shown FROM log""")
def metadata_summary(c):
    bodies = ('{"fields":"a,b","reason":"r"}', '{"reason":"why","status":"s"}', '{"type":"t","status":"done"}', '{"type":"odd","q":"1"}', '{"x":"1","y":"2","z":"3","w":"4"}')
    meta = F.lit(None).cast("string")
    for k, b in enumerate(bodies):
        meta = F.when(F.col("id") % 6 == k, F.lit(b)).otherwise(meta)
    return c.log.select("id", data.summary(meta).alias("shown"))


@query("""SELECT id, concat_ws(',', CASE WHEN id % 2 = 0 THEN 'court' END, CASE WHEN id % 3 = 0 THEN 'judge' END) AS missing FROM cases""")
def missing_fields(c):
    d = c.cases.select("id", F.when(F.col("id") % 2 == 0, F.lit(" ")).otherwise("x").alias("court"), F.when(F.col("id") % 3 != 0, F.lit("y")).alias("judge"))
    return d.select("id", F.array_join(rules.missing_fields(["court", "judge"]), ",").alias("missing"))


@query("""SELECT id, status FROM cases WHERE (status = 'ACTIVE' OR owner_id = 2) AND office_id = 4""")
def composed_filters(c):
    picked = scope.every(scope.some(F.col("status") == "ACTIVE", F.col("owner_id") == 2), None, F.col("office_id") == 4)
    return c.cases.where(picked).select("id", "status")


@query("""SELECT user_id, day, count(*) AS n FROM (SELECT actor_id AS user_id, CAST(created_at AS DATE) AS day FROM log) x GROUP BY user_id, day""")
def audit_days(c):
    return c.log.groupBy(F.col("actor_id").alias("user_id"), F.to_date("created_at").alias("day")).agg(F.count("*").alias("n"))
