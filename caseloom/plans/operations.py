"""Registered queries of operations: error reports, restore proofs, log rows, exports."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import tables
from ..functions import data
from ..operators import exports, proof
from ..sources import archive
from ..streaming import logs
from .queries import query

# --- error reports

REPORTS = """CASE id % 8 WHEN 0 THEN '{{"message":"mail ' || actor_id || '@x.org", "user": {{"id":1}}, "extra":{{"k":["Bearer abc.def"]}}}}' WHEN 1 THEN '{{"breadcrumbs":[' || id || ']}}'
  WHEN 2 THEN '{{"exception":"' || action || '"}}' WHEN 3 THEN '{{"request":{{"headers":["a"],"url":"http://h/' || id || '?t=1","data":1}}}}' WHEN 4 THEN repeat('[', 100)
  WHEN 5 THEN '{{"x":' || repeat('[', 100) || repeat(']', 100) || '}}' WHEN 6 THEN '{{"contexts":[[[[[[["a@b.org"]]]]]]]}}' ELSE props END""".replace("{{", "{").replace("}}", "}")


@query("""SELECT id, CASE id % 8 WHEN 0 THEN '{"message":"mail [redacted-email]","extra":{"k":["Bearer [redacted-token]"]}}' WHEN 1 THEN '{"breadcrumbs":[' || id || ']}' WHEN 2 THEN '{"exception":"' || action || '"}'
  WHEN 3 THEN '{"request":{"headers":["a"],"url":"http://h/' || id || '"}}' WHEN 4 THEN NULL WHEN 5 THEN '{"x":' || repeat('[', 100) || repeat(']', 100) || '}' WHEN 6 THEN '{"contexts":[[[[[[["[max-depth]"]]]]]]]}'
  ELSE replace(props, ' ', '') END AS report, CASE id % 8 WHEN 2 THEN '{"exception":"' || action || '"}' WHEN 5 THEN '{"x":[[[[[["[max-depth]"]]]]]]}' WHEN 7 THEN replace(props, ' ', '') END AS value FROM log""")
def scrub_reports(c):
    """Reports of odd shapes and depths; as plain values where nothing but texts and depth matters."""
    d = c.log.select("id", F.expr(REPORTS.replace("actor_id ||", "cast(actor_id as string) ||").replace("|| id ||", "|| cast(id as string) ||")).alias("body"))
    return d.select("id", data.scrub_event("body").alias("report"), F.when((F.col("id") % 8).isin(2, 5, 7), data.scrub_json("body")).alias("value"))


# --- restore proofs

LINE = ["l_orderkey", "l_linenumber", "l_partkey", "quantity", "day"]
DIGEST = "md5(concat(" + ", ".join(f"coalesce(strlen({c}::VARCHAR)::VARCHAR || ':' || {c}::VARCHAR, '-')" for c in LINE) + "))"
LINES = "(SELECT *, CAST(l_quantity AS DECIMAL(12,2)) AS quantity, CAST(l_shipdate AS DATE) AS day FROM lineitem)"


def _lines(c):
    return c["lineitem"].select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_quantity").cast("decimal(12,2)").alias("quantity"), F.to_date("l_shipdate").alias("day"))


@query(f"""SELECT substr(md5(concat(strlen(l_orderkey::VARCHAR), ':', l_orderkey, strlen(l_linenumber::VARCHAR), ':', l_linenumber)), 1, 2) AS bucket, count(*) AS n,
  {", ".join(f"CAST(sum(('0x' || substr(d, {8 * k + 1}, 8))::BIGINT) AS DECIMAL(38,0)) AS {p}" for k, p in enumerate(proof.PARTS))} FROM (SELECT *, {DIGEST} AS d FROM {LINES} l) x GROUP BY 1""")
def restore_digests(c):
    return proof.digests(proof.bucketed(_lines(c), ["l_orderkey", "l_linenumber"], [F.col(x) for x in LINE]), "_bucket").withColumnRenamed("_bucket", "bucket")


@query("""WITH l AS (SELECT l_orderkey, l_linenumber FROM lineitem) SELECT l_orderkey, l_linenumber, 1::BIGINT AS in_left, 0::BIGINT AS in_right FROM l WHERE (l_orderkey % 997 = 5 AND l_linenumber = 1) OR l_orderkey % 991 = 3
UNION ALL SELECT l_orderkey, l_linenumber, 0, 1 FROM l WHERE l_orderkey % 997 = 5 AND l_linenumber = 1 AND l_orderkey % 991 <> 3""")
def restore_differences(c):
    """A copy of the lines with one changed for some orders, and all lost for others, against the lines."""
    d = _lines(c)
    changed = F.when((F.col("l_orderkey") % 997 == 5) & (F.col("l_linenumber") == 1), F.col("quantity") + 1).otherwise(F.col("quantity"))
    copy = d.where("l_orderkey % 991 <> 3").withColumn("quantity", changed.cast("decimal(12,2)"))
    return proof.differences(d, copy, ["l_orderkey", "l_linenumber"], LINE)


# --- log rows


@query("""SELECT CASE WHEN id % 3 = 0 THEN id % 25 ELSE actor_id % 25 END AS office_id, actor_id, CASE WHEN id % 4 = 0 THEN 'g' || id || '@x.org' ELSE 'a' || actor_id || '@x.org' END AS actor_email, 'LAWYER' AS actor_role, action,
  'case' AS entity_type, CAST(id AS VARCHAR) AS entity_id, CASE id % 4 WHEN 0 THEN '10.0.0.' || (id % 200) WHEN 1 THEN '172.16.0.1' ELSE 'local' END AS ip_address, 'agent' AS user_agent, props AS metadata, created_at FROM log""")
def audit_log_rows(c):
    i = F.col("id")
    forwarded = F.when(i % 4 == 0, F.concat(F.lit("\t10.0.0."), (i % 200).cast("string"), F.lit(" , 192.168.0.1"))).when(i % 4 == 1, " ,10.9.9.9")
    requests = c.log.select(
        F.when(i % 3 == 0, i % 25).alias("office_id"), (F.col("actor_id") % 25).alias("actor_office_id"), "actor_id", F.when(i % 4 != 0, F.concat(F.lit("a"), F.col("actor_id").cast("string"), F.lit("@x.org"))).alias("actor_email"),
        F.concat(F.lit("g"), i.cast("string"), F.lit("@x.org")).alias("given_email"), F.lit("LAWYER").alias("actor_role"), "action", F.lit("case").alias("entity_type"), i.alias("entity_id"), forwarded.alias("forwarded"),
        F.when(i % 4 == 1, "172.16.0.1").when(i % 4 == 2, "").alias("real_ip"), F.lit("agent").alias("user_agent"), F.col("props").alias("metadata"), F.col("created_at").alias("at"),
    )
    return logs.audit_rows(requests)


CODES = ", ".join(f"({i}, '{a}')" for i, a in enumerate(logs.ACTIONS))


@query(f"""WITH c(i, code) AS (VALUES {CODES}), l AS (SELECT coalesce(code, action) AS action FROM log LEFT JOIN c ON c.i = CAST(json_extract_string(props, '$.k') AS INT))
SELECT action, contains(action, '.') AS known, string_split(action, '.')[1] AS entity, coalesce(string_split(action, '.')[2], '') AS deed,
  action LIKE '%\\_blocked' ESCAPE '\\' OR action LIKE '%\\_failed' ESCAPE '\\' AS refused, count(*) AS n FROM l GROUP BY ALL""")
def audit_actions(c):
    """Actions of the log by what they were done to: the code that an entry's number stands for, or else its own word."""
    codes = F.array(*map(F.lit, logs.ACTIONS))
    d = c.log.select(F.coalesce(F.get(codes, F.from_json("props", "k int")["k"]), F.col("action")).alias("action"))
    kind = logs.action_kind(F.col("action"))
    return d.groupBy("action").agg(F.count("*").alias("n")).select("action", kind["known"].alias("known"), kind["entity"].alias("entity"), kind["deed"].alias("deed"), kind["refused"].alias("refused"), "n")


# --- exports

EXPORTED = """f AS (SELECT id, office_id, name, text, strlen(text) AS size, CASE WHEN id % 11 = 0 THEN 'no file attached' WHEN id % 13 = 0 THEN 'legacy storage path — file not bundled' WHEN id % 17 = 0 THEN 'file not found on disk' END AS state FROM files),
d AS (SELECT *, row_number() OVER (PARTITION BY office_id ORDER BY id) AS rn FROM f WHERE state IS NULL),
p AS (SELECT office_id, id, rn, CASE WHEN size <= 20000 THEN size ELSE 0 END AS used, size <= 20000 AS kept FROM d WHERE rn = 1 UNION ALL
  SELECT d.office_id, d.id, d.rn, CASE WHEN p.used + d.size <= 20000 THEN p.used + d.size ELSE p.used END, p.used + d.size <= 20000 FROM p JOIN d ON d.office_id = p.office_id AND d.rn = p.rn + 1),
n AS (SELECT f.id, f.office_id, f.name, f.text, CASE WHEN kept THEN 'documents/' || substr(regexp_replace(f.id || '-' || f.name, '[^A-Za-z0-9_.\\x{0600}-\\x{06FF}-]', '_', 'g'), 1, 150) END AS file,
  coalesce(state, CASE WHEN NOT kept THEN 'not embedded — export size cap reached' END) AS note FROM f LEFT JOIN p ON p.id = f.id)"""


def _documents(c):
    i = F.col("id")
    url = F.when(i % 11 == 0, None).when(i % 13 == 0, "/uploads/old").otherwise("store")
    return c.files.select("id", F.col("office_id").alias("tenant"), "name", url.alias("url"), F.when(i % 17 != 0, F.col("text").cast("binary")).alias("content"), i.alias("created_at"))


@query(f"WITH {EXPORTED} SELECT id, file, note FROM n")
def export_notes(c):
    return exports.noted(_documents(c), 20_000).select("id", "file", "note")


@query(f"""WITH {EXPORTED},
e AS (SELECT office_id AS tenant, 'documents.json' AS entry, id, '{{"id":' || id || ',"name":"' || name || '","created_at":' || id || CASE WHEN file IS NULL THEN ',"note":"' || note ELSE ',"file":"' || file END || '"}}' || chr(10) AS s FROM n
  UNION ALL SELECT office_id, file, id, text FROM n WHERE file IS NOT NULL UNION ALL SELECT office_id, 'clients.json', id, '{{"id":' || id || ',"name":"' || name || '"}}' || chr(10) FROM clients),
r AS (SELECT tenant, string_agg(line, chr(10) ORDER BY line) AS lines FROM (SELECT office_id AS tenant, '  clients.json  ' || count(*) AS line FROM clients GROUP BY 1
  UNION ALL SELECT office_id, '  documents.json  ' || count(*) || ', ' || count(file) || ' with their file' FROM n GROUP BY 1) x GROUP BY 1)
SELECT CAST(tenant AS VARCHAR) AS tenant, entry, md5(string_agg(s, '' ORDER BY id)) AS digest FROM e GROUP BY ALL
UNION ALL SELECT CAST(tenant AS VARCHAR), 'README.txt', md5('Office data export' || chr(10) || 'Office:     ' || tenant || chr(10) || 'Generated:  1999-06-15T12:00:00Z' || chr(10) || chr(10) || lines || chr(10)) FROM r""")
def export_archives(c):
    """The archives of all offices, written and read back: a digest of every entry."""
    clients = c.clients.select("id", F.col("office_id").alias("tenant"), "name")
    found = exports.entries({"clients": (clients, ["id", "name"])}, _documents(c), "1999-06-15T12:00:00Z", 20_000)
    path = tables.place(c.spark, "export")
    archive.write(found, path)
    return archive.read(c.spark, path).select("tenant", "entry", F.md5("content").alias("digest"))
