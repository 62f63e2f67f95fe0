"""The library's tables, derived from the driver's tables.

Every view is one SQL text that Spark and DuckDB both understand, so both
engines start from the same rows.
"""

from __future__ import annotations

import re
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contactmill.sources.tables import Tables, hydrate_json_columns

BASE = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "pages", "labels", "conversations",
)
N = "(SELECT count(*) FROM {customer})"

VIEWS = {
    "leads": """
SELECT c.c_custkey AS id,
  concat(c.c_name, CASE c.c_custkey % 9 WHEN 0 THEN ' Shopify Plus Agency' WHEN 1 THEN ' Studio'
    WHEN 2 THEN ' & Co.' WHEN 3 THEN ' Consulting' WHEN 4 THEN ' Plus' ELSE '' END) AS company_name,
  replace(lower(concat(c.c_name, CASE c.c_custkey % 9 WHEN 0 THEN ' Shopify Plus Agency'
    WHEN 1 THEN ' Studio' WHEN 2 THEN ' & Co.' WHEN 3 THEN ' Consulting' WHEN 4 THEN ' Plus'
    ELSE '' END)), '#', ' ') AS normalized_name,
  CASE c.c_custkey % 6 WHEN 0 THEN NULL WHEN 1 THEN ''
    WHEN 2 THEN concat('https://www.d', c.c_custkey % 200, '.example.com/about')
    WHEN 3 THEN concat('d', c.c_custkey % 200, '.example.com')
    WHEN 4 THEN concat('http://D', c.c_custkey % 200, '.Example.com:8080/x?y=1')
    ELSE concat('  https://d', c.c_custkey % 200, '.example.com#top ') END AS website,
  CASE c.c_custkey % 6 WHEN 0 THEN NULL WHEN 1 THEN NULL
    WHEN 4 THEN concat('d', c.c_custkey % 200, '.example.com:8080')
    ELSE concat('d', c.c_custkey % 200, '.example.com') END AS domain,
  CASE c.c_custkey % 5 WHEN 0 THEN NULL WHEN 1 THEN '  '
    WHEN 2 THEN concat('c', c.c_custkey, '@d', c.c_custkey % 200, '.example.com')
    WHEN 3 THEN concat('C', c.c_custkey, '@Gmail.com') ELSE NULL END AS company_email,
  CASE c.c_custkey % 4 WHEN 0 THEN concat('+381 11 555 ', c.c_custkey + 1000) WHEN 1 THEN '' ELSE NULL END AS company_phone,
  CASE c.c_custkey % 8 WHEN 0 THEN 'Shopify Plus Partner' WHEN 1 THEN 'Premier Partner'
    WHEN 2 THEN 'Service partner' WHEN 3 THEN 'Platinum' ELSE NULL END AS partner_tier,
  CASE WHEN c.c_custkey % 8 = 0 THEN 1 ELSE 0 END AS plus_partner_signal,
  CAST(c.c_custkey % 50 AS DOUBLE) / 10 AS rating,
  CAST(c.c_custkey % 70 AS BIGINT) AS review_count,
  CASE WHEN c.c_custkey % 3 = 0 THEN 'March 2019' ELSE NULL END AS partner_since,
  n.n_name AS primary_location,
  concat('["', r.r_name, '"]') AS supported_locations_json,
  CASE WHEN c.c_custkey % 2 = 0 THEN '["English","French"]' ELSE NULL END AS languages_json,
  CASE WHEN c.c_custkey % 4 = 0 THEN '[{"title":"Shop","url":"https://shop.example"}]' ELSE '' END AS featured_work_json,
  CASE c.c_custkey % 7 WHEN 0 THEN '["Store setup","Migration"]' WHEN 1 THEN '["SEO","Theme customization"]'
    WHEN 2 THEN '["Catalog governance","Content","CRO"]' WHEN 3 THEN '[]' WHEN 4 THEN 'not json'
    WHEN 5 THEN '' ELSE NULL END AS services_json,
  concat('["', n.n_name, '","', r.r_name, '"]') AS locations_json,
  concat('["', c.c_mktsegment, '"]') AS industries_json,
  CASE c.c_custkey % 13 WHEN 0 THEN 'Managed services and product data for e-commerce brands'
    WHEN 1 THEN 'Shopify development, conversion and compliance' WHEN 2 THEN 'PIM  and merchandising ops'
    WHEN 3 THEN 'Direct to consumer shops with product descriptions' WHEN 4 THEN '' ELSE NULL END AS description,
  CASE WHEN c.c_custkey % 97 = 5 THEN NULL ELSE CAST(c.c_custkey % 101 AS INT) END AS fit_score,
  CASE WHEN c.c_custkey % 53 = 7 THEN NULL ELSE CASE c.c_custkey % 7 WHEN 0 THEN 'new'
    WHEN 1 THEN 'researching' WHEN 2 THEN 'qualified' WHEN 3 THEN 'contacted' WHEN 4 THEN 'active'
    WHEN 5 THEN 'closed' ELSE 'archived' END END AS status,
  CAST(0.5 AS DOUBLE) AS confidence,
  CASE c.c_custkey % 3 WHEN 0 THEN 'ok' WHEN 1 THEN 'fallback' ELSE 'needs_review' END AS extraction_status,
  c.c_custkey % 11 = 0 AS possible_duplicate,
  CAST(DATE '1996-01-01' + CAST(c.c_custkey % 900 AS INT) AS TIMESTAMP) AS created_at,
  CAST(DATE '1998-07-01' + CAST(c.c_custkey % 37 AS INT) AS TIMESTAMP) AS updated_at
FROM {customer} c JOIN {nation} n ON c.c_nationkey = n.n_nationkey
  JOIN {region} r ON n.n_regionkey = r.r_regionkey""",
    "people": """
SELECT p.p_partkey AS id,
  (p.p_partkey * p.p_partkey) % (2 * """ + N + """) AS lead_id,
  p.p_name AS name,
  CASE p.p_partkey % 11 WHEN 0 THEN 'CEO' WHEN 1 THEN 'Director of Sales' WHEN 2 THEN 'Head of Ecommerce'
    WHEN 3 THEN 'Account Manager' WHEN 4 THEN ' Owner ' WHEN 5 THEN 'VP Ecommerce' WHEN 6 THEN 'Intern'
    WHEN 7 THEN 'COO' WHEN 8 THEN '' WHEN 9 THEN NULL ELSE 'Co-Founder & Partner' END AS title,
  CASE WHEN p.p_partkey % 2 = 0 THEN 'Sales' ELSE NULL END AS department,
  CAST(NULL AS STRING) AS seniority,
  CASE p.p_partkey % 3 WHEN 0 THEN NULL WHEN 1 THEN concat('p', p.p_partkey, '@gmail.com')
    ELSE concat('P', p.p_partkey, '@d', p.p_partkey % 200, '.example.com') END AS email,
  CASE WHEN p.p_partkey % 4 = 0 THEN concat('https://www.linkedin.com/in/p', p.p_partkey % 300) ELSE NULL END AS linkedin_url,
  p.p_partkey % 11 IN (0, 2, 5, 10) AS is_decision_maker,
  p.p_partkey % 11 IN (0, 1, 2, 4, 5, 7, 10) AS is_relevant_contact,
  CAST(NULL AS STRING) AS relevance_reason,
  CAST(0.5 AS DOUBLE) AS confidence,
  CAST(NULL AS BIGINT) AS raw_source_id,
  CAST(DATE '1997-01-01' + CAST(p.p_partkey % 365 AS INT) AS TIMESTAMP) AS created_at
FROM {part} p""",
    "interactions": """
SELECT o.o_orderkey AS id, o.o_custkey AS lead_id, CAST(NULL AS BIGINT) AS person_id,
  CASE o.o_orderkey % 3 WHEN 0 THEN 'email' WHEN 1 THEN 'Email' ELSE 'call' END AS type,
  concat('Order ', o.o_orderkey) AS subject, CAST(NULL AS STRING) AS body,
  concat('Total ', CAST(CAST(floor(o.o_totalprice) AS BIGINT) AS STRING)) AS summary,
  o.o_orderkey % 4 = 0 AS reply_needed,
  CASE WHEN o.o_orderkey % 3 = 1 THEN NULL ELSE CAST(CAST(o.o_orderdate AS DATE) + 14 AS STRING) END AS deadline,
  o.o_orderpriority AS priority, CAST(NULL AS STRING) AS next_action,
  CASE WHEN o.o_orderstatus = 'O' THEN 'open' ELSE 'done' END AS status,
  CAST(NULL AS BIGINT) AS raw_source_id, CAST(o.o_orderdate AS TIMESTAMP) AS created_at
FROM {orders} o""",
    "tasks": """
SELECT l.l_orderkey * 10000000 + l.l_partkey * 8 + l.l_linenumber AS id, o.o_custkey AS lead_id,
  CAST(NULL AS BIGINT) AS person_id, concat('Ship ', l.l_partkey) AS title,
  CASE WHEN l.l_linenumber % 4 = 0 THEN NULL ELSE CAST(CAST(l.l_shipdate AS DATE) AS STRING) END AS due_date,
  CASE WHEN l.l_returnflag = 'R' THEN 'high' ELSE 'normal' END AS priority,
  CASE WHEN l.l_linestatus = 'O' THEN 'open' ELSE 'done' END AS status,
  l.l_orderkey AS source_interaction_id, CAST(l.l_shipdate AS TIMESTAMP) AS created_at
FROM {lineitem} l JOIN {orders} o ON l.l_orderkey = o.o_orderkey""",
    "raw_sources": """
SELECT s.id, CASE WHEN s.id % 10 = 9 THEN NULL ELSE s.id % """ + N + """ END AS lead_id,
  CASE s.id % 6 WHEN 0 THEN 'note' WHEN 1 THEN 'website' WHEN 2 THEN 'email' WHEN 3 THEN 'linkedin_company'
    WHEN 4 THEN 'linkedin_person' ELSE 'fax' END AS source_type,
  s.source_url,
  CASE s.id % 5 WHEN 0 THEN 'tier_plus' WHEN 1 THEN '' ELSE NULL END AS source_filter_tier,
  s.raw_text,
  CASE WHEN s.id % 4 = 0 THEN concat('{"company_email": "x', s.id % 50, '@Mail.example.com"}') ELSE NULL END AS parsed_json,
  CASE s.id % 3 WHEN 0 THEN 'ok' WHEN 1 THEN 'fallback' ELSE 'needs_review' END AS extraction_status,
  CAST(0.4 AS DOUBLE) AS confidence,
  CAST(DATE '1999-01-01' + CAST(s.id % 500 AS INT) AS TIMESTAMP) AS created_at
FROM (
  SELECT doc_id * 3 AS id, CAST(NULL AS STRING) AS source_url, text AS raw_text FROM {documents}
  UNION ALL SELECT page_id * 3 + 1, url, html FROM {pages}
  UNION ALL SELECT (conv_id * 1000 + turn) * 3 + 2, CAST(NULL AS STRING), text FROM {conversations}
) s""",
    "command_events": """
SELECT e.event_id, e.user_id AS command_id, CAST(e.ts AS TIMESTAMP) AS ts,
  CASE e.event_type WHEN 'signup' THEN 'received' WHEN 'view' THEN 'planned' WHEN 'click' THEN 'executing'
    WHEN 'purchase' THEN 'succeeded' ELSE 'failed' END AS status
FROM {events} e""",
    "command_log": """
SELECT concat('cmd-', e.event_id) AS id, concat('do ', e.event_id) AS command_text,
  CASE e.event_id % 5 WHEN 4 THEN 'other_tool' WHEN 0 THEN 'propose_create_followup' WHEN 1 THEN 'propose_create_followup'
    ELSE 'propose_contact_update' END AS tool_name,
  CASE e.event_id % 3 WHEN 0 THEN 'succeeded' ELSE 'awaiting_approval' END AS status,
  e.event_id % 7 <> 0 AS requires_approval,
  CASE WHEN e.event_id % 2 = 0 THEN CAST(e.ts AS TIMESTAMP) ELSE NULL END AS approved_at,
  CASE
    WHEN e.event_id % 11 = 3 THEN NULL
    WHEN e.event_id % 11 = 4 THEN '{"proposal": "text"}'
    WHEN e.event_id % 11 = 5 THEN '{"proposal": {"lead_id": "7", "title": "T", "field": "website", "value": "x.com"}}'
    WHEN e.event_id % 5 IN (0, 1) THEN concat('{"proposal": {"action": "', CASE WHEN e.event_id % 11 = 6 THEN 'drop' ELSE 'create_followup' END,
      '", "lead_id": ', e.user_id * 17, ', "title": "', CASE WHEN e.event_id % 11 = 7 THEN ' ' ELSE concat('Call ', e.event_id) END,
      '", "due_date": "2024-02-01", "priority": "high"}, "proposal_preview": {"summary": "call"}}')
    ELSE concat('{"proposal": {"action": "update_contact_field", "lead_id": ', e.user_id * 17, ', "field": "',
      CASE e.event_id % 11 WHEN 6 THEN 'status' WHEN 7 THEN 'website' WHEN 8 THEN 'company_phone' ELSE 'company_email' END,
      '", "value": "', CASE e.event_id % 13 WHEN 0 THEN '' ELSE concat(' www.New', e.event_id, '.example.com ') END, '"}}')
  END AS result_summary_json,
  CAST(e.ts AS TIMESTAMP) AS created_at
FROM {events} e""",
    "companies": """
SELECT c.c_custkey AS id, c.c_name AS name, lower(c.c_name) AS normalized_name,
  CASE WHEN c.c_custkey % 4 = 0 THEN NULL ELSE concat('https://c', c.c_custkey, '.example.com') END AS website,
  c.c_mktsegment AS industry, n.n_name AS country,
  CASE c.c_custkey % 6 WHEN 0 THEN NULL WHEN 1 THEN 'closed' WHEN 2 THEN 'archived' ELSE 'new' END AS status,
  CASE WHEN c.c_custkey % 5 = 0 THEN NULL ELSE CAST(c.c_custkey % 101 AS INT) END AS fit_score,
  CAST(NULL AS STRING) AS extra,
  CAST(DATE '1996-01-01' + CAST(c.c_custkey % 900 AS INT) AS TIMESTAMP) AS created_at,
  CASE WHEN c.c_custkey % 10 = 3 THEN NULL ELSE CAST(DATE '1998-01-01' + CAST(c.c_custkey % 40 AS INT) AS TIMESTAMP) END AS updated_at
FROM {customer} c JOIN {nation} n ON c.c_nationkey = n.n_nationkey""",
    "contacts": """
SELECT p.p_partkey AS id, (p.p_partkey * p.p_partkey) % (2 * """ + N + """) AS company_id, p.p_name AS full_name,
  CASE p.p_partkey % 3 WHEN 0 THEN NULL ELSE concat('p', p.p_partkey, '@d', p.p_partkey % 200, '.example.com') END AS email,
  CASE p.p_partkey % 4 WHEN 0 THEN 'CEO' WHEN 1 THEN 'Sales Manager' ELSE NULL END AS role,
  CAST(NULL AS STRING) AS linkedin_url, 'not_contacted' AS status, CAST(NULL AS STRING) AS extra,
  CAST(DATE '1997-01-01' + CAST(p.p_partkey % 365 AS INT) AS TIMESTAMP) AS created_at
FROM {part} p""",
}


class Views:
    """Spark side of the views; each is built once per query."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def base(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def view(self, name: str) -> DataFrame:
        return self.sql(VIEWS[name])

    def sql(self, text: str) -> DataFrame:
        """A SQL text over driver tables (``{name}``), run by Spark."""
        used = set(re.findall(r"\{(\w+)\}", text))
        # Braces of JSON literals are doubled for Spark's formatter; table names are not.
        parts = re.split(r"(\{\w+\})", text)
        safe = "".join(
            p if i % 2 else p.replace("{", "{{").replace("}", "}}") for i, p in enumerate(parts)
        )
        return self.spark.sql(safe, **{n: self.base(n) for n in used})

    def texts(self, text: str, key: str = "id") -> DataFrame:
        """The rows of a SQL text, dealt out by key for text work (one small file is one partition)."""
        return self.sql(text).repartition(self.spark.sparkContext.defaultParallelism, key)

    @cached_property
    def stored_leads(self) -> DataFrame:
        return self.view("leads")

    @cached_property
    def leads(self) -> DataFrame:
        return hydrate_json_columns(self.stored_leads)

    def __getattr__(self, name: str) -> DataFrame:
        if name in VIEWS:
            return self.view(name)
        raise AttributeError(name)

    @cached_property
    def raw_texts(self) -> DataFrame:
        return self.view("raw_sources").repartition(self.spark.sparkContext.defaultParallelism, "id")

    @cached_property
    def tables(self) -> Tables:
        return Tables(
            self.leads, self.people, self.raw_sources, self.interactions, self.tasks,
            self.command_log,
        )


LIST_COLUMNS = ("services", "locations", "industries", "supported_locations", "languages")
LISTS = {
    "leads_h": "SELECT *, " + ", ".join(
        f"CASE WHEN json_valid({c}_json) THEN json_extract_string({c}_json, '$[*]') ELSE CAST([] AS VARCHAR[]) END AS {c}"
        for c in LIST_COLUMNS
    ) + " FROM leads",
    "open_children": """
SELECT l.id AS lead_id,
  (SELECT count(*) FROM people p WHERE p.lead_id = l.id) AS people_count,
  (SELECT count(*) FROM people p WHERE p.lead_id = l.id AND p.is_decision_maker) > 0 AS has_decision_maker,
  (SELECT max(i.created_at) FROM interactions i WHERE i.lead_id = l.id) AS last_interaction,
  nd.next_deadline
FROM leads l LEFT JOIN (
  SELECT l2.id, min(coalesce(t.due_date, i.deadline)) AS next_deadline FROM leads l2
  LEFT JOIN tasks t ON t.lead_id = l2.id AND t.status = 'open'
  LEFT JOIN interactions i ON i.lead_id = l2.id AND i.status = 'open' AND i.deadline IS NOT NULL
  GROUP BY l2.id) nd ON nd.id = l.id""",
}
NAMED = {**VIEWS, **LISTS}


def oracle(body: str) -> str:
    """DuckDB SQL: the body with the views it uses as leading CTEs."""
    needed: list[str] = []

    def add(text: str) -> None:
        for name in re.findall(r"\b[a-z_]+\b", text):
            if name in NAMED and name not in needed:
                inner = NAMED[name].replace("{", "").replace("}", "") if name in VIEWS else NAMED[name]
                if name in VIEWS:
                    inner = VIEWS[name]
                    for b in BASE:
                        inner = inner.replace("{" + b + "}", b)
                add_views(name, inner)

    def add_views(name: str, inner: str) -> None:
        if name in LISTS:
            add(LISTS[name])
        needed.append(name)
        bodies[name] = inner

    bodies: dict[str, str] = {}
    add(body)
    ctes = ",\n".join(f"{n} AS ({bodies[n]}\n)" for n in needed)
    body = body.strip()
    if not ctes:
        return body
    if body[:15].upper() == "WITH RECURSIVE ":
        return f"WITH RECURSIVE {ctes},\n{body[15:]}"
    if body[:5].upper() == "WITH ":
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{body}"


def stamp(name: str):
    """A timestamp as text, the same in both engines."""
    return F.date_format(name, "yyyy-MM-dd HH:mm:ss").alias(name)


def duck_stamp(expr: str, name: str | None = None) -> str:
    return f"strftime({expr}, '%Y-%m-%d %H:%M:%S') AS {name or expr.split('.')[-1]}"
