"""Matching, linkage, merging."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F


from checks.extracts import MAILS
from checks.registry import query
from contactmill.functions.text import slugify
from contactmill.operators import extraction, linkage, merge, numbering
from contactmill.plans import legacy
from contactmill.session import shared_dir
from contactmill.sources import evidence

RECORDS = """
SELECT o_orderkey AS record_id, CASE o_orderkey % 4 WHEN 0 THEN concat('CUSTOMER  #', lpad(CAST(o_custkey AS STRING), 9, '0')) WHEN 1 THEN concat('Nobody ', o_orderkey)
  WHEN 2 THEN NULL ELSE concat('customer-', o_custkey) END AS company_name,
  CASE o_orderkey % 3 WHEN 0 THEN concat('http://www.D', o_orderkey % 250, '.example.com/x') WHEN 1 THEN '' ELSE NULL END AS website,
  CASE o_orderkey % 5 WHEN 0 THEN concat('https://www.linkedin.com/in/P', o_orderkey % 400, '/') ELSE NULL END AS linkedin_url
FROM {orders}"""
RECORDS_SQL = RECORDS.replace("{orders}", "orders")
KEYS = f"""SELECT record_id, CASE record_id % 4 WHEN 0 THEN replace(lower(company_name), '  #', ' ') WHEN 1 THEN lower(company_name) WHEN 3 THEN company_name END AS name_key,
CASE record_id % 3 WHEN 0 THEN concat('d', record_id % 250, '.example.com') END AS domain_key,
CASE record_id % 5 WHEN 0 THEN concat('https://www.linkedin.com/in/p', record_id % 400) END AS profile_key FROM ({RECORDS_SQL}) r"""


@query(
    "match_leads",
    f"""WITH k AS ({KEYS}) SELECT k.record_id, min(l.id) AS lead_id, count(DISTINCT l.id) AS match_count
FROM k JOIN leads l ON l.normalized_name = k.name_key OR l.domain = k.domain_key GROUP BY k.record_id""",
)
def _(v):
    return linkage.match_leads(v.sql(RECORDS), v.leads)


@query(
    "match_leads_with_profiles",
    f"""WITH k AS ({KEYS}), nd AS (SELECT k.record_id, l.id FROM k JOIN leads l ON l.normalized_name = k.name_key OR l.domain = k.domain_key),
li AS (SELECT DISTINCT k.record_id, p.lead_id AS id FROM k JOIN people p ON p.linkedin_url = k.profile_key JOIN leads l ON l.id = p.lead_id WHERE k.name_key IS NOT NULL OR k.domain_key IS NOT NULL),
u AS (SELECT record_id, id, 0 AS late FROM nd UNION SELECT record_id, id, 1 FROM li WHERE (record_id, id) NOT IN (SELECT record_id, id FROM nd))
SELECT record_id, arg_min(id, late * 1000000000 + id) AS lead_id, count(DISTINCT id) AS match_count FROM u GROUP BY record_id""",
)
def _(v):
    return linkage.match_leads(v.sql(RECORDS), v.leads, v.people)


ADDRESSES = """
SELECT o_orderkey AS record_id, CASE o_orderkey % 5 WHEN 0 THEN concat('Joe <Joe@D', o_orderkey % 250, '.example.com>') WHEN 1 THEN concat('c', o_custkey, '@gmail.com')
  WHEN 2 THEN concat('c', o_custkey, '@d', o_custkey % 200, '.example.com') WHEN 3 THEN NULL ELSE 'x@nowhere.example' END AS email FROM {orders}"""


@query(
    "match_leads_by_email",
    """WITH k AS (SELECT o_orderkey AS record_id, CASE o_orderkey % 5 WHEN 0 THEN concat('joe@d', o_orderkey % 250, '.example.com')
  WHEN 2 THEN concat('c', o_custkey, '@d', o_custkey % 200, '.example.com') WHEN 4 THEN 'x@nowhere.example' END AS email FROM orders)
SELECT k.record_id, min(l.id) AS lead_id, count(DISTINCT l.id) AS match_count FROM k JOIN leads l
ON lower(l.domain) = str_split(k.email, '@')[2] OR lower(l.company_email) = k.email GROUP BY k.record_id""",
)
def _(v):
    return linkage.match_leads_by_email(v.sql(ADDRESSES), v.leads)


@query(
    "people_by_linkedin_semi",
    f"""WITH k AS ({KEYS}) SELECT id, company_name FROM leads WHERE id IN (SELECT lead_id FROM people WHERE linkedin_url IN (SELECT profile_key FROM k))
AND id NOT IN (SELECT l.id FROM k JOIN leads l ON l.normalized_name = k.name_key)""",
)
def _(v):
    by_name = linkage.match_leads(v.sql(RECORDS).withColumn("website", F.lit(None).cast("string")), v.leads)
    return linkage.people_by_linkedin_semi(v.leads, v.people, v.sql(RECORDS), by_name).select("id", "company_name")


ASKED = """
SELECT p_partkey AS id, CASE p_partkey % 4 WHEN 0 THEN concat('Customer#', lpad(CAST(p_partkey AS STRING), 9, '0')) WHEN 1 THEN lpad(CAST(p_partkey AS STRING), 5, '0')
  WHEN 2 THEN concat('The Customer ', lpad(CAST(p_partkey AS STRING), 9, '0'), ' group') ELSE concat('zzz ', p_partkey) END AS asked FROM {part}"""


@query(
    "slug_contains_join",
    """WITH q AS (SELECT p_partkey AS id, CASE p_partkey % 4 WHEN 0 THEN concat('customer-', lpad(CAST(p_partkey AS VARCHAR), 9, '0')) WHEN 1 THEN lpad(CAST(p_partkey AS VARCHAR), 5, '0')
  WHEN 2 THEN concat('the-customer-', lpad(CAST(p_partkey AS VARCHAR), 9, '0'), '-group') ELSE concat('zzz-', p_partkey) END AS slug FROM part),
c AS (SELECT lower(replace(c_name, '#', '-')) AS s FROM customer)
SELECT q.id, q.slug, CASE WHEN q.slug IN (SELECT s FROM c) THEN q.slug ELSE (SELECT min(s) FROM c WHERE contains(c.s, q.slug) OR contains(q.slug, c.s)) END AS company_slug FROM q""",
)
def _(v):
    asked = v.sql(ASKED).select("id", slugify(F.col("asked")).alias("slug"))
    held = v.base("customer").select(slugify(F.col("c_name")).alias("slug"))
    return linkage.slug_contains_join(asked, held).select("id", "slug", "company_slug")


@query(
    "next_surrogate_id",
    """SELECT o_orderkey, (SELECT max(id) FROM leads) + row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS id FROM orders""",
)
def _(v):
    fresh = v.base("orders").select("o_orderkey", "o_orderdate")
    return numbering.next_surrogate_ids(v.leads, fresh, ["o_orderdate", "o_orderkey"]).select("o_orderkey", "id")


# Firms of three orders; every fifth order also names a site shared within ten orders.
FIRMS = """
SELECT o_orderkey AS record_id, CAST(o_orderdate AS TIMESTAMP) AS arrived, 'website' AS source_type, CAST(NULL AS STRING) AS source_url,
  CAST(NULL AS BIGINT) AS attach_lead_id, concat('Firm ', CAST(floor(o_orderkey / 3) AS BIGINT)) AS company_name,
  CASE WHEN o_orderkey % 5 = 0 THEN concat('https://f', CAST(floor(o_orderkey / 10) AS BIGINT), '.example') ELSE NULL END AS website,
  CAST(NULL AS STRING) AS company_email
FROM {orders}"""


def firms(v, text=FIRMS):
    raw = v.sql(text).withColumn("emails", F.array().cast("array<string>"))
    return linkage.linkage_records(raw)


@query(
    "lead_components",
    """WITH RECURSIVE r AS (SELECT o_orderkey AS id, o_orderkey // 3 AS firm, CASE WHEN o_orderkey % 5 = 0 THEN o_orderkey // 10 END AS site FROM orders),
e AS (SELECT a.id AS a, b.id AS b FROM r a JOIN r b ON a.firm = b.firm UNION SELECT a.id, b.id FROM r a JOIN r b ON a.site = b.site),
w AS (SELECT id AS start, id AS node FROM r UNION SELECT w.start, e.b FROM w JOIN e ON e.a = w.node)
SELECT start AS record_id, 2 * min(node) + 1 AS component FROM w GROUP BY start""",
)
def _(v):
    return linkage.lead_components(firms(v), v.leads)


NAMED = """
SELECT o_orderkey AS record_id, CAST(o_orderdate AS TIMESTAMP) AS arrived, CASE WHEN o_orderkey % 7 = 0 THEN 'note' ELSE 'linkedin_company' END AS source_type,
  CAST(NULL AS STRING) AS source_url, CAST(NULL AS BIGINT) AS attach_lead_id,
  CASE WHEN o_orderkey % 7 = 0 THEN NULL WHEN o_orderkey % 3 = 0 THEN 'Hot Firm' WHEN o_orderkey % 3 = 1 THEN concat('Customer#', lpad(CAST(o_custkey AS STRING), 9, '0'))
    ELSE concat('Fresh ', CAST(floor(o_orderkey / 6) AS BIGINT)) END AS company_name, CAST(NULL AS STRING) AS website, CAST(NULL AS STRING) AS company_email
FROM {orders}"""
RESOLVED_SQL = """WITH k AS (SELECT o_orderkey AS record_id, o_orderdate AS arrived, CASE WHEN o_orderkey % 7 = 0 THEN 'unknown note' WHEN o_orderkey % 3 = 0 THEN 'hot firm'
  WHEN o_orderkey % 3 = 1 THEN concat('customer ', lpad(CAST(o_custkey AS VARCHAR), 9, '0')) ELSE concat('fresh ', o_orderkey // 6) END AS name_key FROM orders),
h AS (SELECT normalized_name, min(id) AS old FROM leads GROUP BY 1),
f AS (SELECT name_key, min(place) AS place FROM (SELECT *, row_number() OVER (ORDER BY arrived, record_id) AS place FROM k) WHERE name_key NOT IN (SELECT normalized_name FROM h) GROUP BY 1),
n AS (SELECT name_key, (SELECT max(id) FROM leads) + row_number() OVER (ORDER BY place) AS new FROM f)
SELECT k.record_id, coalesce(h.old, n.new) AS lead_id, n.new IS NOT NULL AS is_new FROM k LEFT JOIN h ON h.normalized_name = k.name_key LEFT JOIN n ON n.name_key = k.name_key"""


@query("resolve_leads", RESOLVED_SQL)
def _(v):
    return linkage.resolve_leads(firms(v, NAMED), v.leads).drop("possible_duplicate", "creates")


# Names and sites disagree here, so components are replayed in arrival order.
@query("resolve_leads_mixed")
def _(v):
    return linkage.resolve_leads(firms(v), v.leads)


@query("placeholder_leads", f"SELECT record_id, lead_id FROM ({RESOLVED_SQL}) WHERE record_id % 7 = 0")
def _(v):
    linked = linkage.resolve_leads(firms(v, NAMED), v.leads)
    nameless = v.sql(NAMED).filter("company_name IS NULL").select("record_id")
    return linked.join(nameless, "record_id").select("record_id", "lead_id")


@query(
    "possible_duplicate",
    f"""WITH k AS ({KEYS}) SELECT k.record_id, count(DISTINCT l.id) > 1 AS possible_duplicate FROM k LEFT JOIN leads l
ON l.normalized_name = k.name_key OR l.domain = k.domain_key GROUP BY k.record_id""",
)
def _(v):
    found = linkage.match_leads(v.sql(RECORDS), v.leads)
    return v.sql(RECORDS).select("record_id").join(found, "record_id", "left").select(
        "record_id", (F.coalesce("match_count", F.lit(0)) > 1).alias("possible_duplicate")
    )


# --- merging ----------------------------------------------------------------------------------
WRITES = """
SELECT o_orderkey AS record_id, CAST(o_orderdate AS TIMESTAMP) AS arrived, CASE WHEN o_orderkey % 5 = 0 THEN o_custkey + 100000000 ELSE o_custkey END AS lead_id,
  CASE WHEN o_orderkey % 6 = 0 THEN 'email' ELSE 'website' END AS source_type, false AS creates,
  CASE o_orderkey % 4 WHEN 0 THEN NULL ELSE concat('Name ', o_orderkey) END AS company_name,
  CASE o_orderkey % 3 WHEN 0 THEN concat('https://www.n', o_orderkey, '.example/x') ELSE NULL END AS website,
  CASE o_orderkey % 7 WHEN 0 THEN concat('m', o_orderkey, '@n.example') ELSE NULL END AS company_email,
  CASE o_orderkey % 8 WHEN 0 THEN 'Premier Partner' ELSE NULL END AS partner_tier,
  CAST(NULL AS STRING) AS company_phone, CASE WHEN o_orderkey % 9 = 0 THEN true ELSE NULL END AS plus_partner_signal, CAST(NULL AS DOUBLE) AS rating, CAST(NULL AS BIGINT) AS review_count,
  CAST(NULL AS STRING) AS partner_since, CAST(NULL AS STRING) AS primary_location, CAST(NULL AS STRING) AS description,
  CASE WHEN o_orderkey % 2 = 0 THEN split(concat('s', o_orderkey % 10, ',t'), ',') ELSE NULL END AS services,
  CAST(0.5 AS DOUBLE) AS confidence, 'ok' AS extraction_status, false AS possible_duplicate
FROM {orders}"""


def writes(v):
    empty = F.array().cast("array<string>")
    rows = v.sql(WRITES).withColumns({c: empty for c in ("supported_locations", "languages", "locations", "industries")})
    return merge.lead_changes(rows.withColumn("featured_work", F.array().cast("array<struct<title:string,url:string>>")))


def last(expr: str) -> str:
    return f"arg_max({expr}, ord) FILTER (WHERE {expr} IS NOT NULL)"


MERGED = f"""WITH w AS (SELECT *, epoch_ms(arrived) * 1000000 + record_id AS ord, CASE WHEN source_type = 'email' THEN NULL ELSE company_name END AS wname,
  CASE record_id % 3 WHEN 0 THEN concat('n', record_id, '.example') END AS wdomain FROM ({WRITES.replace('{orders}', 'orders')}) x),
b AS (SELECT lead_id, {last('wname')} AS n, {last('website')} AS site, {last('wdomain')} AS dom, {last('company_email')} AS mail, {last('partner_tier')} AS tier,
  arg_max(coalesce(plus_partner_signal, false), ord) AS plus, arg_max(coalesce(array_to_string(services, '|'), ''), ord) AS services FROM w GROUP BY lead_id)
SELECT coalesce(l.id, b.lead_id) AS id, coalesce(b.n, l.company_name) AS company_name, coalesce(lower(b.n), l.normalized_name, '') AS normalized_name,
coalesce(b.site, l.website) AS website, coalesce(b.dom, l.domain) AS domain, coalesce(b.mail, l.company_email) AS company_email, coalesce(b.tier, l.partner_tier) AS partner_tier,
coalesce(b.plus, l.plus_partner_signal) AS plus_partner_signal, CASE WHEN b.lead_id IS NULL THEN array_to_string(l.services, '|') ELSE b.services END AS services,
CASE WHEN b.lead_id IS NULL THEN l.status ELSE 'new' END AS status, CASE WHEN b.lead_id IS NULL THEN l.fit_score ELSE 0 END AS fit_score
FROM (SELECT * REPLACE (plus_partner_signal = 1 AS plus_partner_signal) FROM leads_h) l FULL JOIN b ON b.lead_id = l.id"""


@query("merge_leads", MERGED)
def _(v):
    return merge.merge_leads(v.leads, writes(v)).select(
        "id", "company_name", "normalized_name", "website", "domain", "company_email", "partner_tier", "plus_partner_signal",
        F.array_join("services", "|").alias("services"), "status", "fit_score",
    )


PERSONS = """
SELECT o_orderkey AS record_id, 0 AS person_no, CAST(o_orderdate AS TIMESTAMP) AS arrived, o_custkey AS lead_id,
  CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE concat('Person ', o_orderkey) END AS name, CASE o_orderkey % 4 WHEN 0 THEN 'CEO' WHEN 1 THEN 'Intern' ELSE NULL END AS title,
  CAST(NULL AS STRING) AS department, CAST(NULL AS STRING) AS seniority,
  CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE concat('E', o_orderkey % 3, '@X.example ') END AS email, CAST(NULL AS STRING) AS linkedin_url,
  CAST(0.5 AS DOUBLE) AS confidence, o_orderkey AS raw_source_id
FROM {orders}"""


@query(
    "merge_people",
    f"""WITH w AS (SELECT *, row_number() OVER (ORDER BY arrived, record_id) AS ord, lower(trim(email)) AS mail, coalesce(title = 'CEO', false) AS dm FROM ({PERSONS.replace('{orders}', 'orders')}) x),
b AS (SELECT lead_id, mail, CASE WHEN mail IS NULL THEN record_id END AS k, min(ord) AS first, {last('name')} AS name, {last('title')} AS title, arg_max(dm, ord) AS dm, max(ord) AS o FROM w GROUP BY 1, 2, 3)
SELECT (SELECT max(id) FROM people) + row_number() OVER (ORDER BY first) AS id, lead_id, name, title, mail AS email, dm AS is_decision_maker FROM b
UNION ALL SELECT id, lead_id, name, title, email, is_decision_maker FROM people""",
)
def _(v):
    return merge.merge_people(v.people, v.sql(PERSONS)).select("id", "lead_id", "name", "title", "email", "is_decision_maker")


COMPANY_CHANGES = """
SELECT o_orderkey AS ord, CASE WHEN o_orderkey % 4 = 0 THEN concat(' New  Firm ', o_orderkey % 500, ' ') ELSE concat('CUSTOMER#', lpad(CAST(o_custkey AS STRING), 9, '0')) END AS name,
  CASE WHEN o_orderkey % 3 = 0 THEN concat('w', o_orderkey) ELSE NULL END AS website, CASE WHEN o_orderkey % 5 = 0 THEN 'Retail' ELSE NULL END AS industry,
  CAST(NULL AS STRING) AS country, CASE WHEN o_orderkey % 7 = 0 THEN 'active' ELSE NULL END AS status, CAST(NULL AS INT) AS fit_score, CAST(NULL AS STRING) AS extra
FROM {orders}"""


@query(
    "upsert_companies_legacy",
    f"""WITH c AS (SELECT *, lower(trim(regexp_replace(name, ' +', ' ', 'g'))) AS k FROM ({COMPANY_CHANGES.replace('{orders}', 'orders')}) x),
b AS (SELECT k, {last('name')} AS name, {last('website')} AS website, {last('industry')} AS industry, {last('status')} AS status FROM c GROUP BY k)
SELECT t.id, coalesce(t.normalized_name, b.k) AS normalized_name, coalesce(b.name, t.name) AS name, coalesce(b.website, t.website) AS website,
coalesce(b.industry, t.industry) AS industry, coalesce(b.status, t.status) AS status, b.k IS NOT NULL AS touched FROM companies t FULL JOIN b ON b.k = t.normalized_name""",
)
def _(v):
    done = legacy.upsert_companies_legacy(v.companies, v.sql(COMPANY_CHANGES))
    return done.select("id", "normalized_name", "name", "website", "industry", "status", "touched")


CONTACT_CHANGES = """
SELECT o_orderkey AS ord, o_custkey AS company_id, CASE WHEN o_orderkey % 2 = 0 THEN concat('N ', o_orderkey) ELSE NULL END AS full_name,
  CASE o_orderkey % 4 WHEN 0 THEN NULL WHEN 1 THEN concat('p', o_orderkey % 3000, '@d', (o_orderkey % 3000) % 200, '.example.com') ELSE concat('q', o_orderkey % 700, '@x.example') END AS email,
  CASE WHEN o_orderkey % 3 = 0 THEN 'CTO' ELSE NULL END AS role, CAST(NULL AS STRING) AS linkedin_url, CAST(NULL AS STRING) AS status, CAST(NULL AS STRING) AS extra
FROM {orders}"""


@query(
    "upsert_contacts_legacy",
    f"""WITH c AS ({CONTACT_CHANGES.replace('{orders}', 'orders')}), b AS (SELECT email, {last('company_id')} AS company_id, {last('full_name')} AS full_name, {last('role')} AS role FROM c WHERE email IS NOT NULL GROUP BY email)
SELECT t.id, coalesce(t.email, b.email) AS email, coalesce(b.full_name, t.full_name) AS full_name, coalesce(b.role, t.role) AS role, coalesce(b.company_id, t.company_id) AS company_id FROM (SELECT * FROM contacts WHERE email IS NOT NULL) t FULL JOIN b ON b.email = t.email
UNION ALL SELECT id, email, full_name, role, company_id FROM contacts WHERE email IS NULL
UNION ALL SELECT NULL, NULL, full_name, role, company_id FROM c WHERE email IS NULL""",
)
def _(v):
    done = legacy.upsert_contacts_legacy(v.contacts, v.sql(CONTACT_CHANGES))
    return done.select("id", "email", "full_name", "role", "company_id")


@query(
    "append_legacy_rows",
    "SELECT id, lead_id, type FROM interactions UNION ALL SELECT id, lead_id, 'task' FROM tasks",
)
def _(v):
    rows = v.tasks.select("id", "lead_id", F.lit("task").alias("type"))
    return legacy.append_legacy_rows(v.interactions, rows).select("id", "lead_id", "type")


INDEX = """
SELECT lower(concat('p', p_partkey, '@x.example')) AS key, concat('p', p_partkey, '@x.example') AS email, p_name AS name, 'CEO' AS role, CAST(NULL AS STRING) AS company FROM {part}"""
ARRIVALS = """
SELECT o_orderkey AS ord, CASE o_orderkey % 3 WHEN 0 THEN concat(' P', o_orderkey % 2500, '@X.example') WHEN 1 THEN '' ELSE NULL END AS email,
  CASE WHEN o_orderkey % 11 = 0 THEN '' ELSE concat('N', o_orderkey % 900) END AS name, CASE WHEN o_orderkey % 2 = 0 THEN concat('R', o_orderkey) ELSE '' END AS role,
  CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE concat('Co ', o_orderkey % 7) END AS company FROM {orders}"""


@query(
    "merge_contacts_index",
    f"""WITH c AS (SELECT *, CASE WHEN coalesce(trim(email), '') <> '' THEN lower(trim(email)) WHEN coalesce(name, '') = '' AND company IS NULL THEN NULL
  ELSE trim(regexp_replace(lower(concat(name, '-', coalesce(company, ''))), '[^a-z0-9]+', '-', 'g'), '-') END AS k FROM ({ARRIVALS.replace('{orders}', 'orders')}) x),
b AS (SELECT k, {last("nullif(email, '')")} AS email, {last("nullif(name, '')")} AS name, {last("nullif(role, '')")} AS role, {last("nullif(company, '')")} AS company FROM c WHERE k IS NOT NULL GROUP BY k)
SELECT coalesce(b.k, i.key) AS key, coalesce(b.email, i.email) AS email, coalesce(b.name, i.name) AS name, coalesce(b.role, i.role) AS role, coalesce(b.company, i.company) AS company
FROM ({INDEX.replace('{part}', 'part')}) i FULL JOIN b ON b.k = i.key""",
)
def _(v):
    return merge.merge_contacts_index(v.sql(INDEX), v.sql(ARRIVALS))


def talks(v):
    docs = extraction.extract_email_message(v.texts(MAILS), "raw_text", "parsed")
    return merge.emit_interactions(docs.select(
        F.col("id").alias("record_id"), F.col("o_custkey").alias("lead_id"), F.lit("email").alias("source_type"), "raw_text",
        F.col("o_orderdate").cast("timestamp").alias("arrived"), F.col("parsed.interaction").alias("interaction"),
    ))


@query(
    "emit_interactions",
    """SELECT o_orderkey AS raw_source_id, o_custkey AS lead_id, 'email' AS type, CASE WHEN o_orderkey % 3 = 0 THEN 'high' ELSE 'normal' END AS priority,
CASE WHEN o_orderkey % 3 = 0 THEN 'Reply to email' END AS next_action, 'open' AS status FROM orders""",
)
def _(v):
    return talks(v).select("raw_source_id", "lead_id", "type", "priority", "next_action", "status")


@query(
    "emit_tasks",
    """SELECT o_orderkey AS raw_source_id, o_custkey AS lead_id, CASE WHEN o_orderkey % 3 = 0 THEN 'Reply to email' WHEN o_orderkey % 4 = 0 THEN
concat('From: "Jane ', o_custkey, '" <Jane', o_custkey, '@Big-shop', o_orderkey % 50, '.example.com>') ELSE concat('Order ', o_orderkey, ': news') END AS title,
CASE WHEN o_orderkey % 5 = 0 THEN CAST(CAST(o_orderdate AS DATE) AS VARCHAR) END AS due_date, CASE WHEN o_orderkey % 3 = 0 THEN 'high' ELSE 'normal' END AS priority
FROM orders WHERE o_orderkey % 3 = 0 OR o_orderkey % 5 = 0""",
)
def _(v):
    return merge.emit_tasks(talks(v)).select("raw_source_id", "lead_id", "title", "due_date", "priority")


@query(
    "link_raw_sources",
    "SELECT r.id, coalesce(k.lead_id, r.lead_id) AS lead_id FROM raw_sources r LEFT JOIN (SELECT doc_id * 3 AS id, doc_id % 77 AS lead_id FROM documents) k ON k.id = r.id",
)
def _(v):
    links = v.sql("SELECT doc_id * 3 AS record_id, doc_id % 77 AS lead_id FROM {documents}")
    return merge.link_raw_sources(v.raw_sources, links).select("id", "lead_id")


@query(
    "append_evidence",
    """SELECT id, lead_id, extraction_status FROM raw_sources UNION ALL
SELECT o_orderkey + 1000000000, CASE WHEN o_orderkey % 2 = 0 THEN o_custkey END, 'fallback' FROM orders""",
)
def _(v):
    fresh = v.sql("""SELECT o_orderkey + 1000000000 AS id, CASE WHEN o_orderkey % 2 = 0 THEN o_custkey ELSE NULL END AS lead_id, 'note' AS source_type,
CAST(NULL AS STRING) AS source_url, CAST(NULL AS STRING) AS source_filter_tier, 'text' AS raw_text, CAST(NULL AS STRING) AS parsed_json, 'fallback' AS extraction_status,
CAST(0.3 AS DOUBLE) AS confidence, CAST(o_orderdate AS TIMESTAMP) AS created_at FROM {orders}""")
    return merge.append_evidence(v.raw_sources, fresh).select("id", "lead_id", "extraction_status")


# Three appends: every order as a note, those of even number again, then all again with a new one for each customer.
@query(
    "append_evidence_once",
    """WITH t AS (SELECT o_orderdate AS day, concat('Order of ', o_custkey, ' at ', o_orderpriority) AS raw_text FROM orders),
a AS (SELECT raw_text, min(day) AS day FROM t GROUP BY 1), n AS (SELECT count(*) AS n FROM a)
SELECT raw_text, row_number() OVER (ORDER BY day, sha256(concat('4:note0:', length(raw_text), ':', raw_text))) AS id FROM a
UNION ALL SELECT concat('Greeting of ', c_custkey), n + row_number() OVER (ORDER BY sha256(concat('4:note0:', length(concat('Greeting of ', c_custkey)), ':Greeting of ', c_custkey))) FROM customer, n""",
)
def _(v):
    root = f"{shared_dir(v.spark)}/check-{uuid.uuid4().hex}"
    head = "CAST(NULL AS BIGINT) AS lead_id, 'note' AS source_type, CAST(NULL AS STRING) AS source_url, CAST(NULL AS STRING) AS source_filter_tier"
    tail = "CAST(NULL AS STRING) AS parsed_json, 'ok' AS extraction_status, CAST(0.5 AS DOUBLE) AS confidence"
    orders = v.sql(f"SELECT o_orderkey AS id, {head}, concat('Order of ', o_custkey, ' at ', o_orderpriority) AS raw_text, {tail}, CAST(o_orderdate AS TIMESTAMP) AS created_at FROM {{orders}}")
    greetings = v.sql(f"SELECT c_custkey AS id, {head}, concat('Greeting of ', c_custkey) AS raw_text, {tail}, CAST(DATE '2030-01-01' AS TIMESTAMP) AS created_at FROM {{customer}}")
    for batch in (orders, orders.where("id % 2 = 0"), orders.unionByName(greetings)):
        evidence.append_evidence_once(v.spark, root, batch)
    return evidence.read_evidence(v.spark, root).select("raw_text", "id")


@query(
    "merge_duplicate_preview",
    """WITH p AS (SELECT id AS duplicate_id, id % 100 AS canonical_id FROM leads WHERE id >= 100),
m AS (SELECT lead_id, 'person' AS item_type FROM people UNION ALL SELECT lead_id, 'raw_source' FROM raw_sources UNION ALL SELECT lead_id, 'interaction' FROM interactions UNION ALL SELECT lead_id, 'task' FROM tasks)
SELECT p.canonical_id, p.duplicate_id, m.item_type, count(*) AS rows_moved FROM p JOIN m ON m.lead_id = p.duplicate_id GROUP BY 1, 2, 3""",
)
def _(v):
    pairs = v.leads.filter("id >= 100").select(F.col("id").alias("duplicate_id"), (F.col("id") % 100).alias("canonical_id"))
    return merge.merge_duplicate_preview(pairs, v.people, v.raw_sources, v.interactions, v.tasks)
