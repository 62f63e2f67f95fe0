"""Projections, joins, aggregates, reports, sorts and search."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from checks.bind import duck_stamp, stamp
from checks.registry import query
from contactmill.functions.text import has_text
from contactmill.operators import linkage, numbering, quality
from contactmill.plans import legacy, lookup, ordering, reports, search
from contactmill.session import shared_dir
from contactmill.sources import tables as src

AS_OF = "1998-06-01"
MAIL = "({0} IS NOT NULL AND trim({0}) <> '')"
ACTIVE = "status NOT IN ('closed', 'archived')"
RANK = "fit_score DESC NULLS LAST, updated_at DESC NULLS LAST, id"


# --- sources -------------------------------------------------------------------
@query("read_tables", "SELECT id, company_name, website, fit_score, status, " + duck_stamp("created_at") + " FROM leads")
def _(v):
    root = f"{shared_dir(v.spark)}/tables-{uuid.uuid4().hex}"
    stored = {"leads": v.stored_leads, "people": v.people, "raw_sources": v.raw_sources, "interactions": v.interactions, "tasks": v.tasks}
    for name, df in stored.items():
        src.upgrade_schema(df, src.SCHEMAS[name]).select(*[f.name for f in src.struct_of(src.SCHEMAS[name])]).write.parquet(f"{root}/{name}")
    v.spark.createDataFrame([], src.struct_of(src.SCHEMAS["command_log"])).write.parquet(f"{root}/command_log")
    return src.read_tables(v.spark, root).leads.select("id", "company_name", "website", "fit_score", "status", stamp("created_at"))


@query(
    "upgrade_schema",
    "SELECT id, company_name, CAST(NULL AS VARCHAR) AS company_email, false AS plus_partner_signal, "
    "CAST(NULL AS DOUBLE) AS rating FROM leads",
)
def _(v):
    old = v.stored_leads.select("id", "company_name")
    wanted = "id long, company_name string, company_email string, plus_partner_signal boolean, rating double"
    return src.upgrade_schema(old, wanted)


@query(
    "hydrate_json_columns",
    """SELECT id, array_to_string(services, '|') AS services, len(services) AS n_services,
    array_to_string(languages, '|') AS languages, array_to_string(locations, '|') AS locations,
    CASE WHEN json_valid(featured_work_json) THEN json_array_length(featured_work_json) ELSE 0 END AS n_work,
    plus_partner_signal = 1 AS plus FROM leads_h""",
)
def _(v):
    return v.leads.select(
        "id",
        F.array_join("services", "|").alias("services"),
        F.size("services").cast("long").alias("n_services"),
        F.array_join("languages", "|").alias("languages"),
        F.array_join("locations", "|").alias("locations"),
        F.size("featured_work").cast("long").alias("n_work"),
        F.col("plus_partner_signal").alias("plus"),
    )


# --- projections and filters -----------------------------------------------------
@query("leads_simple", "SELECT id, company_name FROM leads ORDER BY company_name NULLS FIRST, id")
def _(v):
    return reports.leads_simple(v.leads)


@query("active_leads", f"SELECT id, status FROM leads WHERE {ACTIVE}")
def _(v):
    return reports.active_leads(v.leads).select("id", "status")


@query("active_companies_legacy", f"SELECT id, status FROM companies WHERE status IS NULL OR {ACTIVE}")
def _(v):
    return legacy.active_companies_legacy(v.companies).select("id", "status")


@query("has_nonblank_email", "SELECT id FROM leads WHERE " + MAIL.format("company_email"))
def _(v):
    return v.leads.filter(has_text(F.col("company_email"))).select("id")


INTAKE = """
SELECT d.doc_id AS id,
  CASE d.doc_id % 9 WHEN 0 THEN 'fax' WHEN 1 THEN ' note ' ELSE 'email' END AS source_type,
  CASE WHEN d.doc_id % 9 = 2 THEN '   ' ELSE d.text END AS raw_text,
  CASE d.doc_id % 9 WHEN 3 THEN 'ftp://x.example' WHEN 4 THEN 'https://' WHEN 5 THEN ' https://ok.example/p ' ELSE NULL END AS source_url,
  CASE d.doc_id % 9 WHEN 6 THEN 'abc' WHEN 7 THEN CAST(d.doc_id AS STRING) WHEN 8 THEN '99999999' ELSE '' END AS attach_to_lead_id
FROM {documents} d"""


@query(
    "validate_intake",
    "WITH raw AS (" + INTAKE.replace("{documents}", "documents") + """)
SELECT r.id, CASE
  WHEN trim(source_type) NOT IN ('shopify_directory','linkedin_company','linkedin_person','website','email','note') THEN 'invalid_source_type'
  WHEN trim(raw_text) = '' THEN 'empty_raw_text'
  WHEN length(trim(raw_text)) > 5000 THEN 'raw_text_too_long'
  WHEN source_url IS NOT NULL AND NOT regexp_matches(trim(source_url), '^https?://[^/?#]+') THEN 'invalid_source_url'
  WHEN attach_to_lead_id <> '' AND NOT regexp_full_match(attach_to_lead_id, '[0-9]+') THEN 'invalid_attach_lead_id'
  WHEN attach_to_lead_id <> '' AND l.id IS NULL THEN 'lead_not_found' END AS error_code
FROM raw r LEFT JOIN leads l ON try_cast(r.attach_to_lead_id AS BIGINT) = l.id""",
)
def _(v):
    return quality.validate_intake(v.sql(INTAKE), v.leads, max_chars=5000).select("id", "error_code")


@query(
    "model_quality_checks",
    """SELECT 'people.lead_id' AS rule, CAST(id AS VARCHAR) AS key FROM people WHERE lead_id NOT IN (SELECT id FROM leads)
UNION ALL SELECT 'raw_sources.lead_id', CAST(id AS VARCHAR) FROM raw_sources WHERE lead_id IS NOT NULL AND lead_id NOT IN (SELECT id FROM leads)
UNION ALL SELECT 'interactions.lead_id', CAST(id AS VARCHAR) FROM interactions WHERE lead_id NOT IN (SELECT id FROM leads)
UNION ALL SELECT 'tasks.lead_id', CAST(id AS VARCHAR) FROM tasks WHERE lead_id NOT IN (SELECT id FROM leads)
UNION ALL SELECT 'leads.id', CAST(id AS VARCHAR) FROM leads GROUP BY id HAVING count(*) > 1
UNION ALL SELECT 'people.id', CAST(id AS VARCHAR) FROM people GROUP BY id HAVING count(*) > 1""",
)
def _(v):
    return quality.model_quality_checks(v.tables)


METHODS = """
SELECT p_partkey AS id,
  CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE p_size END AS organization_id,
  CASE WHEN p_partkey % 5 IN (0, 1) THEN p_size * 100 ELSE NULL END AS person_id,
  CASE WHEN p_partkey % 2 = 0 THEN 'email' ELSE 'phone' END AS kind,
  CASE WHEN p_partkey % 17 = 0 THEN 1.5 ELSE 0.5 END AS confidence,
  CASE WHEN p_partkey % 3 = 0 THEN 'verified' ELSE 'unverified' END AS verification_status,
  CASE WHEN p_partkey % 4 = 0 THEN TIMESTAMP '2020-01-01 00:00:00' ELSE NULL END AS verified_at,
  p_partkey % 6 = 2 AS is_primary
FROM {part}"""


@query(
    "contact_method_checks",
    "WITH m AS (" + METHODS.replace("{part}", "part") + """)
SELECT 'single_owner' AS rule, CAST(id AS VARCHAR) AS key FROM m WHERE (organization_id IS NULL) = (person_id IS NULL)
UNION ALL SELECT 'confidence_range', CAST(id AS VARCHAR) FROM m WHERE confidence < 0 OR confidence > 1
UNION ALL SELECT 'verified_at_without_verified', CAST(id AS VARCHAR) FROM m WHERE verified_at IS NOT NULL AND verification_status <> 'verified'
UNION ALL SELECT 'one_primary', concat(coalesce(organization_id, person_id), '|', kind) FROM m WHERE is_primary
  GROUP BY coalesce(organization_id, person_id), kind HAVING count(*) > 1""",
)
def _(v):
    return quality.contact_method_checks(v.sql(METHODS))


CHANGES = """
SELECT o_orderkey AS id, o_custkey AS lead_id,
  CASE o_orderkey % 5 WHEN 0 THEN 'company_email' WHEN 1 THEN 'company_phone' WHEN 2 THEN 'website'
    WHEN 3 THEN 'status' ELSE NULL END AS field,
  CASE WHEN o_orderkey % 7 = 0 THEN '  ' ELSE concat(' v', o_orderkey, ' ') END AS value
FROM {orders}"""


@query(
    "contact_field_whitelist",
    "SELECT * FROM (" + CHANGES.replace("{orders}", "orders") + ") WHERE field IN ('company_email','company_phone','website')",
)
def _(v):
    return quality.contact_field_whitelist(v.sql(CHANGES))


# --- joins -------------------------------------------------------------------------
@query(
    "people_with_lead",
    "SELECT p.id AS person_id, p.lead_id, p.name, p.title, p.email, l.company_name, l.status "
    "FROM people p JOIN leads l ON l.id = p.lead_id",
)
def _(v):
    return reports.people_with_lead(v.tables)


FOLLOW = f"""
SELECT l.company_name, l.id AS lead_id, t.title, t.due_date, t.priority, 'task' AS item_type, t.id
FROM tasks t JOIN leads l ON l.id = t.lead_id WHERE t.status = 'open' AND t.due_date IS NOT NULL AND t.due_date <= '{AS_OF}'
UNION ALL
SELECT l.company_name, l.id, i.subject, i.deadline, i.priority, 'interaction', i.id
FROM interactions i JOIN leads l ON l.id = i.lead_id WHERE i.status = 'open' AND i.deadline IS NOT NULL AND i.deadline <= '{AS_OF}'"""


@query("followup_joins", f"SELECT item_type, count(*) AS n, count(DISTINCT lead_id) AS leads FROM ({FOLLOW}) GROUP BY item_type")
def _(v):
    items = reports.followups_due(v.tables, AS_OF)
    return items.groupBy("item_type").agg(F.count("*").alias("n"), F.count_distinct("lead_id").alias("leads"))


@query("lead_deadline_join", "SELECT l.id, o.next_deadline FROM leads l LEFT JOIN open_children o ON o.lead_id = l.id")
def _(v):
    ahead = reports.next_deadline(v.tasks, v.interactions).withColumnRenamed("lead_id", "_lead")
    return v.leads.join(ahead, F.col("id") == F.col("_lead"), "left").select("id", "next_deadline")


@query(
    "leads_without_contacts",
    "SELECT id, company_name, fit_score FROM leads l WHERE NOT EXISTS (SELECT 1 FROM people p WHERE p.lead_id = l.id)",
)
def _(v):
    return reports.leads_without_contacts(v.tables).select("id", "company_name", "fit_score")


@query(
    "companies_without_contacts",
    f"""SELECT id, name, fit_score FROM companies c WHERE NOT EXISTS (SELECT 1 FROM contacts t WHERE t.company_id = c.id)
AND (status IS NULL OR {ACTIVE}) ORDER BY {RANK} LIMIT 25""",
)
def _(v):
    return legacy.companies_without_contacts(v.companies, v.contacts).select("id", "name", "fit_score")


NO_MAIL = f"""NOT EXISTS (SELECT 1 FROM people p WHERE p.lead_id = l.id AND {MAIL.format('p.email')})"""


@query(
    "leads_without_email",
    f"SELECT id, fit_score FROM leads l WHERE {ACTIVE} AND NOT coalesce({MAIL.format('company_email')}, false) AND {NO_MAIL}",
)
def _(v):
    return reports.leads_without_email(v.tables).select("id", "fit_score")


@query(
    "leads_with_any_email",
    f"SELECT id FROM leads l WHERE {ACTIVE} AND (coalesce({MAIL.format('company_email')}, false) OR NOT {NO_MAIL})",
)
def _(v):
    return reports.leads_with_any_email(v.tables).select("id")


@query(
    "search_lead_by_name",
    "SELECT id, company_name FROM leads WHERE normalized_name LIKE '%00012%' OR company_name ILIKE '%#00012%'",
)
def _(v):
    return search.search_lead_by_name(v.leads, "00012").select("id", "company_name")


# --- aggregates ----------------------------------------------------------------------
@query("count_potential_clients", f"SELECT count(*) AS potential_clients FROM leads WHERE {ACTIVE}")
def _(v):
    return reports.count_potential_clients(v.leads)


@query("count_companies_legacy", f"SELECT count(*) AS companies FROM companies WHERE status IS NULL OR {ACTIVE}")
def _(v):
    return legacy.count_companies_legacy(v.companies)


SUMMARY = f"""
SELECT companies, with_company_email, with_people, with_person_email, with_any_email,
  companies - with_any_email AS without_email, email_interactions FROM (SELECT
  (SELECT count(*) FROM leads WHERE {ACTIVE}) AS companies,
  (SELECT count(*) FROM leads WHERE {ACTIVE} AND {MAIL.format('company_email')}) AS with_company_email,
  (SELECT count(DISTINCT l.id) FROM leads l JOIN people p ON p.lead_id = l.id WHERE {ACTIVE}) AS with_people,
  (SELECT count(DISTINCT l.id) FROM leads l JOIN people p ON p.lead_id = l.id WHERE {ACTIVE} AND {MAIL.format('p.email')}) AS with_person_email,
  (SELECT count(*) FROM leads l WHERE {ACTIVE} AND (coalesce({MAIL.format('company_email')}, false) OR NOT {NO_MAIL})) AS with_any_email,
  (SELECT count(*) FROM interactions WHERE lower(type) = 'email') AS email_interactions)"""


@query("contact_summary", SUMMARY)
def _(v):
    return reports.contact_summary(v.tables)


@query(
    "pipeline_metric",
    f"""WITH s AS ({SUMMARY}), f AS ({FOLLOW})
SELECT 'organization_count' AS metric, CAST(companies AS DOUBLE) AS value FROM s
UNION ALL SELECT 'contact_coverage_percent', CASE WHEN companies = 0 THEN 0.0::DOUBLE ELSE
  CAST(round(CAST(with_any_email * 100.0::DOUBLE / companies AS DECIMAL(38,15)), 2) AS DOUBLE) END FROM s
UNION ALL SELECT 'verified_email_coverage_percent', 0.0::DOUBLE
UNION ALL SELECT 'overdue_task_count', CAST((SELECT count(*) FROM f) AS DOUBLE)""",
)
def _(v):
    return reports.pipeline_metric(v.tables, AS_OF)


@query("people_count", "SELECT lead_id, count(*) AS people_count FROM people GROUP BY lead_id")
def _(v):
    return reports.people_rollup(v.people).select("lead_id", "people_count")


@query("has_decision_maker", "SELECT lead_id, bool_or(is_decision_maker) AS has_decision_maker FROM people GROUP BY lead_id")
def _(v):
    return reports.people_rollup(v.people).select("lead_id", "has_decision_maker")


@query("last_interaction", f"SELECT lead_id, {duck_stamp('max(created_at)', 'last_interaction')} FROM interactions GROUP BY lead_id")
def _(v):
    return reports.last_interaction(v.interactions).select("lead_id", stamp("last_interaction"))


@query("next_deadline", "SELECT lead_id, next_deadline FROM open_children WHERE next_deadline IS NOT NULL")
def _(v):
    return reports.next_deadline(v.tasks, v.interactions).filter("next_deadline IS NOT NULL")


@query(
    "coverage_by_relevance_tier",
    f"""SELECT CASE WHEN coalesce(fit_score, 0) >= 70 THEN 'high' WHEN coalesce(fit_score, 0) >= 40 THEN 'medium' ELSE 'low' END AS band,
count(*) AS companies, count(*) FILTER (WHERE EXISTS (SELECT 1 FROM people p WHERE p.lead_id = l.id)) AS with_people,
count(*) FILTER (WHERE coalesce({MAIL.format('company_email')}, false) OR NOT {NO_MAIL}) AS with_any_email
FROM leads l WHERE {ACTIVE} GROUP BY 1""",
)
def _(v):
    return reports.coverage_by_relevance_tier(v.tables)


@query(
    "relevance_distribution",
    "SELECT CAST(least(9, coalesce(fit_score, 0) // 10) * 10 AS INTEGER) AS score_from, count(*) AS companies FROM leads GROUP BY 1",
)
def _(v):
    return reports.relevance_distribution(v.leads)


# --- reports ---------------------------------------------------------------------------
@query(
    "list_leads",
    f"""SELECT l.id, l.fit_score, o.people_count, o.has_decision_maker,
{duck_stamp('o.last_interaction')}, o.next_deadline FROM leads l JOIN open_children o ON o.lead_id = l.id""",
)
def _(v):
    return reports.list_leads(v.tables).select(
        "id", "fit_score", "people_count", "has_decision_maker", stamp("last_interaction"), "next_deadline"
    )


@query(
    "top_leads",
    f"""SELECT l.id, l.company_name, l.fit_score, o.people_count, o.next_deadline
FROM leads l JOIN open_children o ON o.lead_id = l.id ORDER BY {RANK} LIMIT 10""",
)
def _(v):
    return reports.top_leads(v.tables).select("id", "company_name", "fit_score", "people_count", "next_deadline")


DETAIL = """
SELECT lead_id, 1 AS section, 'person' AS item_type, id AS item_id, name AS label, created_at AS at_, concat_ws('|', email, title, relevance_reason) AS more FROM people
UNION ALL SELECT lead_id, 2, 'interaction', id, subject, created_at, concat_ws('|', type, status, deadline, priority) FROM interactions
UNION ALL SELECT lead_id, 3, 'task', id, title, created_at, concat_ws('|', status, due_date, priority) FROM tasks
UNION ALL SELECT lead_id, 4, 'raw_source', id, source_type, created_at, concat_ws('|', source_url, extraction_status, raw_text) FROM raw_sources
UNION ALL SELECT l.id, 0, 'lead', l.id, l.company_name, l.created_at, concat_ws('|', l.status, l.domain, o.people_count,
  (SELECT arg_max(r.id, (r.created_at, r.id)) FROM raw_sources r WHERE r.lead_id = l.id),
  (SELECT arg_max(r.source_filter_tier, (r.created_at, r.id)) FROM raw_sources r WHERE r.lead_id = l.id AND r.source_filter_tier <> ''))
  FROM leads l JOIN open_children o ON o.lead_id = l.id"""


@query(
    "lead_detail",
    f"SELECT d.lead_id, l.company_name, section, item_type, item_id, label, {duck_stamp('at_', 'at')}, more FROM ({DETAIL}) d JOIN leads l ON l.id = d.lead_id",
)
def _(v):
    shown = {
        "person": ("email", "title", "relevance_reason"), "interaction": ("type", "status", "deadline", "priority"),
        "task": ("status", "due_date", "priority"), "raw_source": ("source_url", "extraction_status", "raw_text"),
        "lead": ("status", "domain", "people_count", "canonical_source_id", "lead_filter_tier"),
    }
    more = F.concat_ws("|", *[F.col(f"{kind}.{name}").cast("string") for kind, names in shown.items() for name in names])
    rows = reports.lead_detail(v.tables)
    return rows.select("lead_id", "company_name", "section", "item_type", "item_id", "label", stamp("at"), more.alias("more"))


@query(
    "canonical_source",
    f"""SELECT r.id, r.lead_id, r.source_type, t.lead_filter_tier FROM (
  SELECT *, row_number() OVER (PARTITION BY lead_id ORDER BY created_at DESC, id DESC) AS rn FROM raw_sources WHERE lead_id IS NOT NULL) r
LEFT JOIN (SELECT lead_id, source_filter_tier AS lead_filter_tier FROM (SELECT *, row_number() OVER
  (PARTITION BY lead_id ORDER BY created_at DESC, id DESC) AS rn FROM raw_sources WHERE source_filter_tier <> '') WHERE rn = 1) t
ON t.lead_id = r.lead_id WHERE rn = 1""",
)
def _(v):
    return reports.canonical_source(v.raw_sources).select("id", "lead_id", "source_type", "lead_filter_tier")


@query(
    "source_history",
    """SELECT id, lead_id FROM (SELECT *, row_number() OVER (PARTITION BY lead_id ORDER BY created_at DESC, id DESC) AS rn
FROM raw_sources WHERE lead_id IS NOT NULL) WHERE rn > 1""",
)
def _(v):
    return reports.source_history(v.raw_sources).select("id", "lead_id")


@query(
    "top_companies_legacy",
    f"SELECT id, name, fit_score FROM companies WHERE status IS NULL OR {ACTIVE} ORDER BY {RANK} LIMIT 25",
)
def _(v):
    return legacy.top_companies_legacy(v.companies, 25).select("id", "name", "fit_score")


BLOCKS = f"""
SELECT 0 AS block, id AS tie, id AS lead_id, company_name, company_email AS email, CAST(NULL AS VARCHAR) AS person_name, 'company' AS source
FROM leads WHERE {MAIL.format('company_email')}
UNION ALL SELECT 1, p.id, l.id, l.company_name, p.email, p.name, 'person' FROM people p JOIN leads l ON l.id = p.lead_id
WHERE {MAIL.format('p.email')}"""
BLOCK_ORDER = "block, lower(company_name), lower(coalesce(person_name, '')), tie"


@query(
    "list_contact_emails",
    f"SELECT lead_id, company_name, email, person_name, source FROM ({BLOCKS}) ORDER BY {BLOCK_ORDER} LIMIT 100",
)
def _(v):
    return reports.list_contact_emails(v.tables, 100)


@query("followups_due", FOLLOW)
def _(v):
    return reports.followups_due(v.tables, AS_OF)


@query(
    "due_followups_filtered",
    f"""WITH f AS ({FOLLOW}) SELECT id, lead_id, title, due_date, item_type, (SELECT count(*) FROM f WHERE priority = 'high') AS record_count
FROM f WHERE priority = 'high' ORDER BY due_date, item_type, id LIMIT 200""",
)
def _(v):
    page = reports.due_followups_filtered(v.tables, AS_OF, status="open", priority="high", limit=200)
    return page.select("id", "lead_id", "title", "due_date", "item_type", "record_count")


@query(
    "companies_missing_email",
    f"""WITH m AS (SELECT * FROM leads l WHERE coalesce(fit_score, 0) >= 20 AND NOT coalesce({MAIL.format('company_email')}, false) AND {NO_MAIL})
SELECT id, fit_score, (SELECT count(*) FROM m) AS record_count FROM m ORDER BY {RANK} LIMIT 50""",
)
def _(v):
    return reports.companies_missing_email(v.tables, min_fit=20).select("id", "fit_score", "record_count")


@query(
    "companies_missing_email_verified",
    f"""WITH m AS (SELECT * FROM leads WHERE status = 'new' AND NOT coalesce({MAIL.format('company_email')}, false))
SELECT id, fit_score, (SELECT count(*) FROM m) AS record_count FROM m ORDER BY {RANK} LIMIT 50""",
)
def _(v):
    page = reports.companies_missing_email(v.tables, definition="verified", status="new")
    return page.select("id", "fit_score", "record_count")


@query(
    "company_summary_legacy",
    """WITH best AS (SELECT id AS company_id, name AS company_name FROM companies WHERE name ILIKE '%00001%' OR normalized_name ILIKE '%00001%'
ORDER BY fit_score DESC NULLS LAST, id LIMIT 1)
SELECT * FROM (SELECT b.company_id, b.company_name, 'contact' AS item_type, c.id AS item_id, c.full_name AS label
  FROM contacts c JOIN best b ON c.company_id = b.company_id ORDER BY c.created_at DESC, c.id LIMIT 20)
UNION ALL SELECT * FROM (SELECT b.company_id, b.company_name, 'interaction', i.id, i.type
  FROM interactions i JOIN best b ON i.lead_id = b.company_id ORDER BY i.created_at DESC, i.id LIMIT 10)""",
)
def _(v):
    talks = v.interactions.select("id", F.col("lead_id").alias("company_id"), F.col("type").alias("kind"), "created_at")
    return legacy.company_summary_legacy(v.companies, v.contacts, talks, "00001")


@query(
    "lead_summary",
    """SELECT l.id AS lead_id, l.company_name, coalesce(l.website, 'n/a') AS website, coalesce(l.company_email, 'n/a') AS email,
coalesce(l.partner_tier, 'n/a') AS partner_tier, l.fit_score, l.status,
coalesce(nullif(array_to_string(l.services, ', '), ''), 'n/a') AS services,
o.people_count, (SELECT count(*) FROM people p WHERE p.lead_id = l.id AND p.is_decision_maker) AS decision_makers,
(SELECT count(*) FROM interactions i WHERE i.lead_id = l.id) AS interaction_count,
(SELECT count(*) FROM tasks t WHERE t.lead_id = l.id AND t.status = 'open') AS open_tasks,
l.description
FROM leads_h l JOIN open_children o ON o.lead_id = l.id""",
)
def _(v):
    return reports.lead_summary(v.tables)


@query("decision_maker_names", "SELECT lead_id, name FROM people WHERE is_decision_maker")
def _(v):
    return reports.decision_maker_names(v.people)


@query(
    "high_relevance_no_open_followup",
    f"""SELECT id, fit_score FROM leads l WHERE {ACTIVE} AND fit_score >= 0
AND NOT EXISTS (SELECT 1 FROM tasks t WHERE t.lead_id = l.id AND t.status = 'open')""",
)
def _(v):
    return reports.high_relevance_no_open_followup(v.tables, 0).select("id", "fit_score")


# --- sorts, limits, set operations -------------------------------------------------------
def _placed(df, *order):
    """Row order made visible, so that the comparison sees it."""
    from contactmill.operators.numbering import number_rows

    return number_rows(df, list(order), "place")


@query(
    "sort_multi_key",
    f"SELECT id, row_number() OVER (ORDER BY {RANK}) AS place FROM leads",
)
def _(v):
    return _placed(v.leads.select("id", "fit_score", "updated_at"), *reports.by_rank()).select("id", "place")


@query("sort_nocase", "SELECT id, row_number() OVER (ORDER BY lower(company_name), id) AS place FROM leads")
def _(v):
    return _placed(v.leads.select("id", "company_name"), *ordering.nocase("company_name", "id")).select("id", "place")


@query(
    "sort_nulls_last",
    "SELECT id, row_number() OVER (ORDER BY due_date IS NULL, due_date, id, title) AS place FROM tasks",
)
def _(v):
    rows = v.tasks.select("id", "due_date", "title")
    return _placed(rows, *ordering.nulls_last("due_date", "id", "title")).select("id", "place")


@query(
    "sort_desc_nulls_last",
    "SELECT id, row_number() OVER (ORDER BY fit_score DESC NULLS LAST, id) AS place FROM companies",
)
def _(v):
    return _placed(v.companies.select("id", "fit_score"), *ordering.desc_nulls_last("fit_score", "id")).select("id", "place")


@query(
    "limit_offset",
    f"SELECT id, (SELECT count(*) FROM leads WHERE status = 'new') AS record_count FROM leads WHERE status = 'new' ORDER BY {RANK} LIMIT 25 OFFSET 50",
)
def _(v):
    return search.search_contacts(v.tables, status="new", limit=25, offset=50).select("id", "record_count")


# Half the tasks lie before the page; it is numbered through the ranges of the sort.
@query(
    "deep_page",
    """SELECT id, title FROM tasks ORDER BY due_date IS NULL, due_date, id, title LIMIT 40 OFFSET (SELECT count(*) // 2 FROM tasks)""",
)
def _(v):
    rows = v.tasks.select("id", "due_date", "title")
    return numbering.page_of(rows, ordering.nulls_last("due_date", "id", "title"), 40, rows.count() // 2).select("id", "title")


@query(
    "top_n_per_group",
    """SELECT lead_id, id, place FROM (SELECT lead_id, id, row_number() OVER (PARTITION BY lead_id ORDER BY created_at DESC, id) AS place
FROM interactions) WHERE place <= 10""",
)
def _(v):
    best = legacy.top_n_per_group(v.interactions, ["lead_id"], [F.desc("created_at"), F.asc("id")], 10)
    return best.select("lead_id", "id", F.col("place").cast("long").alias("place"))


@query(
    "union_all",
    """SELECT lead_id, due_date, 'task' AS item_type FROM tasks WHERE status = 'open'
UNION ALL SELECT lead_id, deadline, 'interaction' FROM interactions WHERE status = 'open'""",
)
def _(v):
    return ordering.open_items(v.tables)


@query(
    "concat_blocks",
    f"SELECT lead_id, email, source, row_number() OVER (ORDER BY {BLOCK_ORDER}) AS place FROM ({BLOCKS})",
)
def _(v):
    whole = v.tables.leads.filter(has_text(F.col("company_email"))).select(
        F.lit(0).alias("block"), F.col("id").alias("tie"), F.col("id").alias("lead_id"), "company_name",
        F.col("company_email").alias("email"), F.lit("").alias("person_name"), F.lit("company").alias("source"),
    )
    people = reports.people_with_lead(v.tables).filter(has_text(F.col("email"))).select(
        F.lit(1).alias("block"), F.col("person_id").alias("tie"), "lead_id", "company_name", "email",
        F.col("name").alias("person_name"), F.lit("person").alias("source"),
    )
    return _placed(
        whole.unionByName(people), "block", F.lower("company_name"), F.lower("person_name"), "tie"
    ).select("lead_id", "email", "source", "place")


@query(
    "dedupe_first_seen",
    r"""SELECT doc_id, array_to_string(list_distinct_first, ' ') AS words FROM (SELECT doc_id,
list_transform(list_filter(list_transform(w, lambda x, i: CASE WHEN list_position(w, x) = i THEN x END), lambda x: x IS NOT NULL), lambda x: x) AS list_distinct_first
FROM (SELECT doc_id, str_split(substr(text, 1, 400), ' ') AS w FROM documents))""".replace("substr(text, 1, 400)", "text"),
)
def _(v):
    words = ordering.dedupe_first_seen(F.split("text", " "))
    return v.base("documents").select("doc_id", F.array_join(words, " ").alias("words"))


@query(
    "set_difference",
    "SELECT id FROM leads WHERE id NOT IN (SELECT lead_id FROM people)",
)
def _(v):
    return ordering.id_difference(v.leads, v.people, "lead_id")


# --- search --------------------------------------------------------------------------------
@query(
    "search_contacts",
    f"""WITH m AS (SELECT * FROM leads l WHERE fit_score >= 30 AND EXISTS (SELECT 1 FROM people p WHERE p.lead_id = l.id)
AND (contains(lower(company_name), 'd1') OR contains(lower(website), 'd1') OR contains(lower(company_email), 'd1')))
SELECT id, fit_score, (SELECT count(*) FROM m) AS record_count FROM m ORDER BY {RANK} LIMIT 100""",
)
def _(v):
    page = search.search_contacts(v.tables, text="D1", min_fit=30, has_person=True, limit=100)
    return page.select("id", "fit_score", "record_count")


BLOB = r"""trim(regexp_replace(lower(concat_ws(' ', nullif(company_name, ''), nullif(website, ''), nullif(company_email, ''),
nullif(partner_tier, ''), nullif(primary_location, ''), nullif(description, ''), nullif(status, ''),
CASE WHEN len(services) > 0 THEN array_to_string(services, ' ') ELSE '' END, array_to_string(locations, ' '),
array_to_string(industries, ' '), array_to_string(supported_locations, ' '),
CASE WHEN len(languages) > 0 THEN array_to_string(languages, ' ') ELSE '' END)), '\s+', ' ', 'g'))"""


@query("search_blob", f"SELECT id, {BLOB} AS blob FROM leads_h")
def _(v):
    return v.leads.select("id", search.search_blob().alias("blob"))


QUESTION = "Which agency does shopify plus migration and SEO for catalog content in ASIA?"
TERMS = "['shopify plus', 'does', 'shopify', 'plus', 'migration', 'seo', 'catalog', 'content', 'asia']"
SCORED = f"""SELECT id, company_name, fit_score, list_sum(list_transform({TERMS}, lambda t: CASE WHEN contains({BLOB}, t)
THEN CASE WHEN contains(t, ' ') THEN 3 ELSE 1 END ELSE 0 END)) AS score FROM leads_h"""


@query(
    "search_leads_ranked",
    f"""SELECT id, CAST(score AS INTEGER) AS score FROM ({SCORED}) WHERE score > 0
ORDER BY score DESC, coalesce(fit_score, 0) DESC, lower(company_name), id LIMIT 25""",
)
def _(v):
    return search.search_leads_ranked(v.tables, QUESTION, limit=25).select("id", "score")


@query(
    "search_leads_many",
    f"""SELECT 0 AS query_id, CAST(row_number() OVER (ORDER BY score DESC, coalesce(fit_score, 0) DESC, lower(company_name), id) AS INTEGER) AS place,
id AS lead_id, company_name, CAST(score AS INTEGER) AS score FROM ({SCORED}) WHERE score > 0 QUALIFY place <= 10
UNION ALL SELECT 1, CAST(row_number() OVER (ORDER BY coalesce(fit_score, 0) DESC, lower(company_name), id) AS INTEGER) AS p,
id, company_name, 1 FROM leads_h WHERE contains({BLOB}, 'europe') QUALIFY p <= 10""",
)
def _(v):
    return search.search_leads_many(v.tables, [QUESTION, "Show leads in Europe"])


ASKED = """SELECT conv_id * 1000 + turn AS id, text FROM {conversations} WHERE role = 'user'
UNION ALL SELECT -1 - s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN concat('Agencies in ', n_name, ' for shopify plus migration, SEO and shopify content')
  WHEN 1 THEN concat('Who in ', n_name, ' sells product descriptions, partner ', s_suppkey, '?') WHEN 2 THEN concat(s_name, ' new new store')
  ELSE concat('Find the agency ', CASE WHEN s_suppkey % 8 = 3 THEN lower(n_name) ELSE '' END) END
FROM {supplier} JOIN {nation} ON s_nationkey = n_nationkey"""


@query(
    "search_leads_by_questions",
    rf"""WITH q AS (SELECT id AS query_id, trim(regexp_replace(lower(text), '[\s\v]+', ' ', 'g')) AS q FROM ({ASKED.replace('{', '').replace('}', '')})),
w AS (SELECT query_id, list_concat(list_filter(['product descriptions', 'product description', 'shopify plus'], lambda p: contains(q, p)),
  list_slice(list_filter(regexp_extract_all(q, '[a-z0-9ćčžšđ]+'), lambda w: length(w) >= 3 AND w NOT IN (
'and','are','for','from','that','the','with','who','which','what','find','show','list','give','lead','leads','agency','agencies',
'company','companies','koje','koja','koji','rade','radi','agencije','agencija','kompanije','klijenti','daj','nadji','prikazi','imamo',
'ima','bazi','preko','iznad','mail','email','kontakt','contact')), 1, 8)) AS terms FROM q),
b AS (SELECT id, company_name, fit_score, {BLOB} AS blob FROM leads_h),
e AS (SELECT query_id, unnest(terms) AS term FROM w),
h AS (SELECT d.term, b.id FROM (SELECT DISTINCT term FROM e) d JOIN b ON contains(b.blob, d.term)),
s AS (SELECT e.query_id, h.id, sum(CASE WHEN contains(e.term, ' ') THEN 3 ELSE 1 END) AS score FROM e JOIN h ON e.term = h.term GROUP BY ALL
UNION ALL SELECT query_id, b.id, 0 FROM w, b WHERE len(terms) = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, coalesce(fit_score, 0) DESC, lower(company_name), id) AS INTEGER) AS place,
id AS lead_id, company_name, CAST(score AS INTEGER) AS score FROM s JOIN b USING (id) QUALIFY place <= 10""",
)
def _(v):
    return lookup.search_leads_by_questions(v.tables, v.sql(ASKED))


NEEDLES = """SELECT p_partkey AS needle_id, CASE p_partkey % 7 WHEN 0 THEN p_name WHEN 1 THEN concat('00', p_partkey)
  WHEN 2 THEN concat('R#0%', p_partkey, ' ') WHEN 3 THEN concat(p_partkey, ' Shopify_Plus') WHEN 4 THEN concat('omer_', '0000', p_partkey)
  WHEN 5 THEN concat(p_partkey, ' & co') ELSE concat('MER#', p_partkey, p_brand) END AS name FROM {part}"""


@query(
    "search_leads_by_names",
    rf"""WITH f AS (SELECT *, trim(regexp_replace(lower(name), '[^\p{{L}}\p{{N}}_&.\-]+', ' ', 'g')) AS normal FROM ({NEEDLES.replace('{', '').replace('}', '')}))
SELECT needle_id, name, l.id AS lead_id, company_name FROM f JOIN leads l
ON l.normalized_name ILIKE concat('%', normal, '%') OR l.company_name ILIKE concat('%', name, '%')""",
)
def _(v):
    return lookup.search_leads_by_names(v.leads, v.sql(NEEDLES))


@query(
    "search_filters",
    """SELECT l.id FROM leads_h l JOIN open_children o ON o.lead_id = l.id WHERE fit_score >= 20
AND (contains(lower(array_to_string(services, ' ')), 'migration') OR contains(lower(array_to_string(services, ' ')), 'seo'))
AND (contains(lower(concat_ws(' ', array_to_string(locations, ' '), primary_location)), 'asia')
  OR contains(lower(concat_ws(' ', array_to_string(locations, ' '), primary_location)), 'europe'))
AND contains(lower(coalesce(partner_tier, '')), 'p') AND NOT contains(coalesce(status, ''), 'zzz')
AND contains(lower(coalesce(status, '')), 'e') AND o.people_count > 0""",
)
def _(v):
    rows = reports.leads_with_rollup(v.tables)
    wanted = {
        "min_fit_score": 20, "services": ["Migration", "SEO"], "locations": ["Asia", " EUROPE "],
        "partner_tier": "P", "status": "E", "has_contacts": True,
    }
    return rows.filter(search.passes_filters(wanted)).select("id")


@query(
    "search_terms",
    r"""SELECT conv_id, turn, array_to_string(list_concat(
  list_filter(['product descriptions', 'product description', 'shopify plus'], lambda p: contains(q, p)),
  list_slice(list_filter(regexp_extract_all(q, '[a-z0-9ćčžšđ]+'), lambda w: length(w) >= 3 AND w NOT IN (
'and','are','for','from','that','the','with','who','which','what','find','show','list','give','lead','leads','agency','agencies',
'company','companies','koje','koja','koji','rade','radi','agencije','agencija','kompanije','klijenti','daj','nadji','prikazi','imamo',
'ima','bazi','preko','iznad','mail','email','kontakt','contact')), 1, 8)), '|') AS terms
FROM (SELECT conv_id, turn, trim(regexp_replace(lower(text), '[\s\v]+', ' ', 'g')) AS q FROM conversations)""",
)
def _(v):
    return v.base("conversations").select(
        "conv_id", "turn", F.array_join(search.search_terms(F.col("text")), "|").alias("terms")
    )


@query(
    "search_companies_legacy",
    """SELECT id, name FROM companies WHERE name ILIKE '%0007%' OR normalized_name ILIKE '%0007%' OR website ILIKE '%0007%'
ORDER BY fit_score DESC NULLS LAST, created_at DESC, id LIMIT 20""",
)
def _(v):
    return legacy.search_companies_legacy(v.companies, "0007").select("id", "name")


@query(
    "search_contacts_legacy",
    """SELECT id, email FROM contacts WHERE full_name ILIKE '%d10.example%' OR email ILIKE '%d10.example%' OR role ILIKE '%d10.example%'
ORDER BY created_at DESC, id LIMIT 20""",
)
def _(v):
    return legacy.search_contacts_legacy(v.contacts, "D10.example").select("id", "email")


QUESTIONS = """
SELECT conv_id * 1000 + turn AS id, concat(CASE (conv_id + turn) % 16 WHEN 0 THEN 'How many leads? ' WHEN 1 THEN 'Koliko email kontakata ' WHEN 2 THEN 'List emails 7 '
  WHEN 3 THEN 'Contact summary ' WHEN 4 THEN 'leads without email ' WHEN 5 THEN 'Show top leads 40 ' WHEN 6 THEN 'leads without contact '
  WHEN 7 THEN 'follow ups ' WHEN 8 THEN 'Summarize company ' WHEN 9 THEN 'SEO with score over 60 ' WHEN 10 THEN 'show 12 copywriting agencies '
  WHEN 11 THEN 'mail ' ELSE '' END, text) AS text
FROM {conversations}"""
ANY = "list_bool_or(list_transform({words}, lambda w: contains(q, w)))"


def _any(*words: str) -> str:
    return "(" + " OR ".join(f"contains(q, '{w}')" for w in words) + ")"


@query(
    "question_intents",
    "WITH t AS (SELECT id, text, trim(regexp_replace(lower(text), '[\\s\\v]+', ' ', 'g')) AS q FROM ("
    + QUESTIONS.replace("{conversations}", "conversations") + """)),
i AS (SELECT *, CASE
  WHEN """ + _any("how many", "koliko", "count", "broj") + " AND " + _any("email", "contact", "kontakt") + """ THEN 'contact_summary'
  WHEN """ + _any("how many", "koliko", "count", "broj") + """ THEN 'count_leads'
  WHEN """ + _any("all email", "list email", "print email", "show email", "email addresses", "emails from", "svi email", "prikazi email", "ispisi email") + """ THEN 'list_emails'
  WHEN """ + _any("contact summary", "contact info", "available contact", "kontakt", "email coverage", "contact overview") + """ THEN 'contact_summary'
  WHEN """ + _any("without email", "no email", "missing email", "bez email", "bez maila") + """ THEN 'leads_without_email'
  WHEN """ + _any("top leads", "best leads", "najbolj", "top klijenti", "top leadove") + """ THEN 'top_leads'
  WHEN """ + _any("without contact", "bez kontakt") + """ THEN 'leads_without_contacts'
  WHEN """ + _any("follow", "deadline", "rok") + """ THEN 'followups_due'
  WHEN starts_with(q, 'summarize company ') OR starts_with(q, 'summary company ') OR starts_with(q, 'rezimiraj kompaniju ') OR starts_with(q, 'sumiraj kompaniju ') THEN 'summarize_company'
  ELSE 'search_leads' END AS intent,
  """ + _any("product description", "opis proizvoda", "opisi proizvoda", "seo", "copywriting", "content", "email", "mail", "contact", "kontakt") + """ AS sure,
  nullif(regexp_extract(q, '(?:^|[^\\p{L}\\p{N}_])([0-9]{1,2})(?:$|[^\\p{L}\\p{N}_])', 1), '') AS num FROM t)
SELECT id, intent, CASE WHEN intent = 'list_emails' THEN CASE WHEN num IS NULL THEN 50 ELSE greatest(1, least(25, CAST(num AS INTEGER))) END
  WHEN intent IN ('top_leads', 'search_leads') THEN CASE WHEN num IS NULL THEN 10 ELSE greatest(1, least(25, CAST(num AS INTEGER))) END ELSE 10 END AS "limit",
  CASE WHEN intent = 'search_leads' THEN array_to_string(list_filter([
    CASE WHEN """ + _any("product description", "opis proizvoda", "opisi proizvoda") + """ THEN 'product descriptions' END,
    CASE WHEN contains(q, 'seo') THEN 'seo' END, CASE WHEN contains(q, 'copy') THEN 'copywriting' END,
    CASE WHEN """ + _any("content", "sadrzaj", "sadržaj") + """ THEN 'content' END], lambda x: x IS NOT NULL), '|') ELSE '' END AS services,
  CASE WHEN intent = 'search_leads' THEN CAST(nullif(regexp_extract(q, '(?:score|fit|preko|iznad)[^0-9]{0,12}([0-9]{1,3})', 1), '') AS INTEGER) END AS min_fit_score,
  CASE WHEN intent = 'search_leads' THEN CASE WHEN sure THEN 0.75::DOUBLE ELSE 0.5::DOUBLE END ELSE 1.0::DOUBLE END AS confidence
FROM i""",
)
def _(v):
    tagged = search.question_intents(v.sql(QUESTIONS))
    return tagged.select(
        "id", "intent", "limit", F.array_join("services", "|").alias("services"), "min_fit_score",
        F.col("confidence").cast("double").alias("confidence"),
    )


@query(
    "collect_lead_emails",
    r"""WITH a AS (
  SELECT id AS lead_id, 0 AS later, TIMESTAMP '2100-01-01' AS seen_at, 0 AS back, 0 AS step, unnest(regexp_extract_all(company_email, '[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}')) AS email FROM leads
  UNION ALL SELECT lead_id, 1, created_at, id, 1, unnest(regexp_extract_all(raw_text, '[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}')) FROM raw_sources WHERE lead_id IS NOT NULL
  UNION ALL SELECT lead_id, 1, created_at, id, 2, unnest(regexp_extract_all(parsed_json, '[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}')) FROM raw_sources WHERE lead_id IS NOT NULL),
f AS (SELECT lead_id, email, row_number() OVER (PARTITION BY lead_id, lower(email) ORDER BY later, seen_at DESC, back DESC, step) AS rn
  FROM a WHERE NOT ends_with(lower(email), 'shopify.com'))
SELECT l.id AS lead_id, coalesce(f.email, 'n/a') AS email FROM leads l LEFT JOIN f ON f.lead_id = l.id AND f.rn = 1""",
)
def _(v):
    return search.collect_lead_emails(v.tables)
