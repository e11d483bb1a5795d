"""Tables, their expected schemas, and the practice domain bound to them.

The domain (offices, staff, clients, cases, hearings, invoices, time entries,
documents, log) is a set of projections of the star schema and the event table.
Each is a SQL select that both Spark and a plain SQL engine understand, so that
a query and its oracle start from the same definition.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": (
        "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, l_extendedprice double, "
        "l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz"
    ),
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
    "pages": "page_id bigint, url string, html string",
    "labels": "doc_id bigint, quality int, toxic int",
}

#: Owners and staff meet on small numbers: a row's owner is its key modulo this.
SLOTS = 7

DOMAIN = {
    "offices": "SELECT n_nationkey AS id, n_name AS name, n_regionkey AS platform_id, n_nationkey % 6 <> 5 AS active FROM nation",
    "staff": f"""SELECT s_suppkey AS id, s_name AS name, s_nationkey AS office_id, s_suppkey % {SLOTS} AS slot, s_acctbal >= 0 AS active,
        CASE WHEN s_suppkey = min(s_suppkey) OVER (PARTITION BY s_nationkey) THEN 'OFFICE_MANAGER' ELSE 'LAWYER' END AS role FROM supplier""",
    "clients": f"""SELECT c_custkey AS id, c_name AS name, c_nationkey AS office_id, c_custkey % {SLOTS} AS owner_id, c_acctbal >= 0 AS active,
        c_mktsegment AS segment, c_acctbal AS balance FROM customer""",
    "cases": f"""SELECT o_orderkey AS id, o_custkey AS client_id, c_nationkey AS office_id, o_orderkey % {SLOTS} AS owner_id,
        CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE (o_orderkey + 1) % {SLOTS} END AS lawyer_id, o_orderpriority AS type,
        CASE o_orderstatus WHEN 'O' THEN 'ACTIVE' WHEN 'F' THEN 'CLOSED' ELSE 'PENDING' END AS status,
        o_orderdate AS created_at, o_totalprice AS amount FROM orders JOIN customer ON o_custkey = c_custkey""",
    "hearings": """SELECT l_orderkey AS case_id, l_linenumber AS line, l_partkey AS room, l_shipdate AS date,
        CASE l_linestatus WHEN 'O' THEN 'UPCOMING' ELSE 'DONE' END AS status FROM lineitem""",
    "invoices": """SELECT o_orderkey AS id, o_custkey AS client_id, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderkey END AS case_id,
        o_totalprice AS amount, CASE o_orderstatus WHEN 'F' THEN o_totalprice WHEN 'P' THEN floor(o_totalprice * 40) / 100 ELSE 0.0 END AS paid,
        CASE o_orderstatus WHEN 'F' THEN 'PAID' WHEN 'P' THEN 'PARTIAL' ELSE CASE WHEN o_orderkey % 2 = 0 THEN 'UNPAID' ELSE 'OVERDUE' END END AS status,
        o_orderdate AS created_at FROM orders""",
    "time_entries": """SELECT l_orderkey AS case_id, l_suppkey AS user_id, l_linenumber AS line, CAST(l_quantity AS INT) AS minutes,
        l_returnflag <> 'N' AS billable, l_returnflag = 'R' AS invoiced, l_shipdate AS date FROM lineitem""",
    "files": f"""SELECT doc_id AS id, concat(source, '/', lang, ' ', CAST(doc_id AS VARCHAR(20)), CASE doc_id % 4 WHEN 0 THEN '.pdf' WHEN 1 THEN '.DOCX' WHEN 2 THEN '.png' ELSE '.xls' END) AS name,
        CAST(doc_id % 25 AS INT) AS office_id, doc_id % {SLOTS} AS owner_id, CASE WHEN doc_id % 2 = 0 THEN doc_id ELSE NULL END AS case_id,
        n_chars AS size, text, lang, source FROM documents""",
    "log": "SELECT event_id AS id, ts AS created_at, user_id AS actor_id, event_type AS action, value, props FROM events",
}

#: The moment that queries about the practice take for now.
AS_OF = "1999-06-15 12:00:00"
#: The moment that queries about the log take for now.
LOG_AS_OF = "2024-01-20 12:00:00"


class Catalog:
    """The tables of one folder; domain tables by attribute, raw ones by index."""

    def __init__(self, spark: SparkSession, sf_dir: str, check: bool = True):
        self.spark, self.dir, self.check = spark, sf_dir, check

    def __getitem__(self, name: str) -> DataFrame:
        df = self.spark.read.parquet(f"{self.dir}/{name}.parquet")
        if self.check and name in SCHEMAS:
            want = [tuple(c.split()) for c in SCHEMAS[name].split(", ")]
            have = dict(df.dtypes)
            if wrong := [c for c, t in want if have.get(c) != t]:
                raise TypeError(f"{name}: columns {wrong} are missing or of another type")
        return df

    def __getattr__(self, name: str) -> DataFrame:
        if name not in DOMAIN:
            raise AttributeError(name)
        text = DOMAIN[name]
        used = {t: self[t] for t in SCHEMAS if f" {t}" in text}
        for t in used:
            text = text.replace(f"FROM {t}", f"FROM {{{t}}}").replace(f"JOIN {t}", f"JOIN {{{t}}}")
        return self.spark.sql(text, **{t: df for t, df in used.items() if f"{{{t}}}" in text})

    @cached_property
    def first_office(self) -> int:
        """The office of the principal in examples: the lowest that has staff."""
        return self["supplier"].selectExpr("min(s_nationkey)").first()[0] or 0


def with_domain(sql: str) -> str:
    """A standalone SQL text whose domain tables are common table expressions."""
    used = [n for n in DOMAIN if n in sql]
    head = ", ".join(f"{n} AS ({DOMAIN[n]})" for n in used)
    if sql.startswith("WITH "):
        return f"WITH RECURSIVE {head}{', ' if used else ''}{sql[5:]}"
    return f"WITH {head} {sql}" if used else sql
