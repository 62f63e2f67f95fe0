"""Model conversion, command log, files and streams."""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyspark.sql import functions as F

from checks.registry import query
from contactmill.operators import audit, convert
from contactmill.session import shared_dir
from contactmill.sources import files
from contactmill.sources.tables import SCHEMAS, Tables, struct_of, upgrade_schema, write_tables
from contactmill.streaming import commands
from contactmill.streaming.intake import apply_batch, open_store, read_stored, stream_intake


# --- conversion ------------------------------------------------------------------------
@query(
    "to_organizations",
    """SELECT id AS legacy_lead_id, company_name AS name, website, domain AS normalized_domain, coalesce(status, 'new') AS status, coalesce(fit_score, 0) AS relevance_score,
partner_tier, array_to_string(services, '|') AS services FROM leads_h WHERE id NOT IN (SELECT n_nationkey FROM nation)""",
)
def _(v):
    held = v.base("nation").select(F.col("n_nationkey").cast("long").alias("legacy_lead_id"))
    return convert.to_organizations(v.leads, held).select(
        "legacy_lead_id", "name", "website", "normalized_domain", "status", "relevance_score",
        F.col("metadata.partner_tier").alias("partner_tier"), F.array_join("metadata.services", "|").alias("services"),
    )


METHODS = """
SELECT 'organization' AS owner, 'email' AS kind, company_email AS value, CASE WHEN contains(company_email, '@') THEN lower(trim(company_email)) END AS normalized_value FROM leads WHERE company_email <> ''
UNION ALL SELECT 'organization', 'phone', company_phone, trim(company_phone) FROM leads WHERE company_phone <> ''
UNION ALL SELECT 'person', 'email', email, lower(email) FROM people WHERE email <> '' AND lead_id IN (SELECT id FROM leads)
UNION ALL SELECT 'person', 'linkedin', linkedin_url, linkedin_url FROM people WHERE linkedin_url <> '' AND lead_id IN (SELECT id FROM leads)"""


@query("to_contact_methods", METHODS)
def _(v):
    owner = F.when(F.col("organization_id").isNotNull(), "organization").otherwise("person")
    return convert.to_contact_methods(v.leads, v.people).select(owner.alias("owner"), "kind", "value", "normalized_value")


@query("list_unverified_contact_methods", f"SELECT owner, value FROM ({METHODS}) WHERE kind = 'email'")
def _(v):
    owner = F.when(F.col("organization_id").isNotNull(), "organization").otherwise("person")
    rows = convert.list_unverified_contact_methods(convert.to_contact_methods(v.leads, v.people), "email")
    return rows.select(owner.alias("owner"), "value")


@query(
    "list_unverified_contact_methods_by_source",
    f"""SELECT m.lead_id, m.value FROM (SELECT id AS lead_id, company_email AS value FROM leads WHERE company_email <> '') m
WHERE EXISTS (SELECT 1 FROM raw_sources r WHERE r.lead_id = m.lead_id AND r.source_type = 'note' AND trim(r.raw_text) <> '' AND r.created_at < TIMESTAMP '2000-01-01')""",
)
def _(v):
    rows = convert.list_unverified_contact_methods(
        convert.to_contact_methods(v.leads, v.people), "email", sources=convert.to_sources(v.raw_sources, v.leads),
        source_type="note", captured_before="2000-01-01",
    )
    owners = v.leads.select(F.col("id").alias("lead_id"), convert.organization_id(F.col("id")).alias("organization_id"))
    return rows.join(owners, "organization_id").select("lead_id", "value")


@query(
    "to_people",
    r"""SELECT id AS legacy_person_id, name, trim(regexp_replace(lower(name), '[^a-z0-9_&.\-]+', ' ', 'g')) AS normalized_name, title, is_decision_maker
FROM people WHERE lead_id IN (SELECT id FROM leads)""",
)
def _(v):
    return convert.to_people(v.people, v.leads).select(
        F.col("metadata.legacy_person_id").alias("legacy_person_id"), "name", "normalized_name", "title", "is_decision_maker"
    )


@query(
    "to_sources",
    """SELECT r.id AS legacy_source_id, r.source_type, sha256(r.raw_text) AS content_hash, l.id IS NOT NULL AS linked
FROM raw_sources r LEFT JOIN leads l ON l.id = r.lead_id WHERE trim(r.raw_text) <> ''""",
)
def _(v):
    return convert.to_sources(v.raw_sources, v.leads).select(
        "legacy_source_id", "source_type", "content_hash", F.col("organization_id").isNotNull().alias("linked")
    )


@query(
    "to_extractions",
    """SELECT id AS legacy_source_id, CASE WHEN extraction_status IN ('ok', 'fallback') THEN 'approved' ELSE 'proposed' END AS status, confidence,
extraction_status IN ('ok', 'fallback') AS is_approved FROM raw_sources WHERE trim(raw_text) <> ''""",
)
def _(v):
    return convert.to_extractions(v.raw_sources).select(
        "legacy_source_id", "status", "confidence", F.col("approved_at").isNotNull().alias("is_approved")
    )


@query(
    "extraction_review",
    """SELECT d.doc_id, CASE WHEN l.quality = 1 AND l.toxic = 0 THEN 'approved' ELSE 'proposed' END AS status
FROM documents d JOIN labels l ON l.doc_id = d.doc_id WHERE trim(d.text) <> ''""",
)
def _(v):
    reviewed = v.sql("""SELECT d.doc_id AS id, d.text AS raw_text, CASE WHEN l.quality = 1 AND l.toxic = 0 THEN 'ok' ELSE 'needs_review' END AS extraction_status,
CAST(0.5 AS DOUBLE) AS confidence, CAST(NULL AS STRING) AS parsed_json, TIMESTAMP '2024-01-01 00:00:00' AS created_at FROM {documents} d JOIN {labels} l ON l.doc_id = d.doc_id""")
    return convert.to_extractions(reviewed).select(F.col("legacy_source_id").alias("doc_id"), "status")


@query(
    "to_interactions",
    "SELECT id AS legacy_interaction_id, type AS kind, summary, reply_needed AS requires_followup, subject FROM interactions WHERE lead_id IN (SELECT id FROM leads)",
)
def _(v):
    return convert.to_interactions(v.interactions, v.leads).select(
        "legacy_interaction_id", "kind", "summary", "requires_followup", F.col("metadata.subject").alias("subject")
    )


@query(
    "to_tasks",
    "SELECT id AS legacy_task_id, title, status, CAST(due_date AS DATE) AS due FROM tasks WHERE lead_id IN (SELECT id FROM leads)",
)
def _(v):
    return convert.to_tasks(v.tasks, v.leads).select("legacy_task_id", "title", "status", F.to_date("due_at").alias("due"))


REPORT = f"""
SELECT 'organization' AS entity, 'migrated' AS outcome, '' AS reason, count(*) AS n FROM leads
UNION ALL SELECT 'organization', 'skipped', 'missing_id', count(*) FROM leads WHERE id IS NULL
UNION ALL SELECT 'contact_method', 'migrated', '', count(*) FROM ({METHODS})
UNION ALL SELECT 'source', 'migrated', '', count(*) FROM raw_sources WHERE trim(raw_text) <> ''
UNION ALL SELECT 'source', 'skipped', 'empty_text', count(*) FROM raw_sources WHERE trim(raw_text) = ''
UNION ALL SELECT 'person', 'migrated', '', count(*) FROM people WHERE lead_id IN (SELECT id FROM leads)
UNION ALL SELECT 'person', 'skipped', 'missing_org', count(*) FROM people WHERE lead_id NOT IN (SELECT id FROM leads)
UNION ALL SELECT 'interaction', 'migrated', '', count(*) FROM interactions WHERE lead_id IN (SELECT id FROM leads)
UNION ALL SELECT 'interaction', 'skipped', 'missing_org', count(*) FROM interactions WHERE lead_id NOT IN (SELECT id FROM leads)
UNION ALL SELECT 'task', 'migrated', '', count(*) FROM tasks WHERE lead_id IN (SELECT id FROM leads)
UNION ALL SELECT 'task', 'skipped', 'missing_org', count(*) FROM tasks WHERE lead_id NOT IN (SELECT id FROM leads)"""


@query("reconciliation_report", REPORT)
def _(v):
    return convert.convert(v.tables)[1]


@query("migration_dry_run", REPORT)
def _(v):
    return convert.reconciliation_report(v.tables)


@query(
    "migration_lookup",
    "SELECT concat('person:', id, ':missing_org') AS item FROM people WHERE lead_id NOT IN (SELECT id FROM leads) "
    "UNION ALL SELECT concat('source:', id, ':empty_text') FROM raw_sources WHERE trim(raw_text) = ''",
)
def _(v):
    return convert.migration_skips(v.tables)


@query(
    "org_to_lead_view",
    """SELECT id, company_name, website, domain, nullif(company_email, '') AS company_email, nullif(company_phone, '') AS company_phone, partner_tier, rating,
array_to_string(services, '|') AS services, array_to_string(locations, '|') AS locations, coalesce(fit_score, 0) AS fit_score, coalesce(status, 'new') AS status, possible_duplicate FROM leads_h""",
)
def _(v):
    wide = convert.org_to_lead_view(convert.convert(v.tables)[0])
    return wide.select(
        "id", "company_name", "website", "domain", "company_email", "company_phone", "partner_tier", "rating", F.array_join("services", "|").alias("services"),
        F.array_join("locations", "|").alias("locations"), "fit_score", "status", "possible_duplicate",
    )


# --- command log -------------------------------------------------------------------------
@query(
    "current_command_state",
    "SELECT command_id, arg_max(status, epoch_us(ts) * 1000000 + event_id % 1000000) AS status FROM command_events GROUP BY command_id".replace(
        "epoch_us(ts) * 1000000 + event_id % 1000000", "CAST(epoch_us(ts) AS HUGEINT) * 1000000000 + event_id"),
)
def _(v):
    return audit.current_command_state(v.command_events).select("command_id", "status")


LEGAL = """(previous = 'received' AND status IN ('planned','rejected','failed')) OR (previous = 'planned' AND status IN ('awaiting_approval','executing','rejected','failed'))
OR (previous = 'awaiting_approval' AND status IN ('executing','rejected','failed')) OR (previous = 'executing' AND status IN ('succeeded','awaiting_approval','failed'))"""


@query(
    "illegal_transitions",
    f"""SELECT command_id, event_id, previous, status FROM (SELECT *, lag(status) OVER (PARTITION BY command_id ORDER BY ts, event_id) AS previous FROM command_events)
WHERE NOT coalesce((previous IS NULL AND status = 'received') OR {LEGAL}, false)""",
)
def _(v):
    return audit.illegal_transitions(v.command_events).select("command_id", "event_id", "previous", "status")


P = "json_extract(result_summary_json, '$.proposal')"


def field(name: str) -> str:
    return f"json_extract_string(result_summary_json, '$.proposal.{name}')"


ERROR = f"""CASE WHEN tool_name NOT IN ('propose_create_followup', 'propose_contact_update') THEN 'unsupported_tool'
WHEN result_summary_json IS NULL THEN 'no_stored_proposal' WHEN json_type({P}) <> 'OBJECT' THEN 'malformed_proposal'
WHEN {field('action')} IS NOT NULL AND {field('action')} <> CASE tool_name WHEN 'propose_create_followup' THEN 'create_followup' ELSE 'update_contact_field' END THEN 'invalid_action'
WHEN tool_name = 'propose_create_followup' AND (json_type({P}, '$.lead_id') NOT IN ('UBIGINT', 'BIGINT') OR trim(coalesce({field('title')}, '')) = '') THEN 'missing_lead_or_title'
WHEN tool_name = 'propose_contact_update' AND json_type({P}, '$.lead_id') NOT IN ('UBIGINT', 'BIGINT') THEN 'missing_lead'
WHEN tool_name = 'propose_contact_update' AND {field('field')} NOT IN ('company_email', 'company_phone', 'website') THEN 'invalid_field'
WHEN tool_name = 'propose_contact_update' AND trim(coalesce({field('value')}, '')) = '' THEN 'missing_value' END"""
CHECKED = f"SELECT *, {ERROR} AS proposal_error, try_cast({field('lead_id')} AS BIGINT) AS lead_id, {field('title')} AS title, {field('field')} AS field, trim({field('value')}) AS value FROM command_log"


@query("validate_proposals", f"SELECT id, proposal_error FROM ({CHECKED})")
def _(v):
    return audit.validate_proposals(v.command_log).select("id", "proposal_error")


@query(
    "pending_proposals",
    f"""SELECT id, tool_name, try_cast({field('lead_id')} AS BIGINT) AS lead_id, json_extract_string(result_summary_json, '$.proposal_preview.summary') AS summary
FROM command_log WHERE status = 'awaiting_approval' AND requires_approval AND tool_name <> 'other_tool' AND json_type({P}) = 'OBJECT'""",
)
def _(v):
    return audit.pending_proposals(v.command_log).select("id", "tool_name", "lead_id", "summary")


CHANGES = """
SELECT o_orderkey AS id, CASE WHEN o_orderkey % 10 = 0 THEN o_custkey + 10000000 ELSE o_custkey END AS lead_id,
  CASE o_orderkey % 5 WHEN 0 THEN 'company_email' WHEN 1 THEN 'company_phone' WHEN 2 THEN 'website' WHEN 3 THEN 'status' ELSE NULL END AS field,
  CASE WHEN o_orderkey % 7 = 0 THEN '  ' ELSE concat(' v', o_orderkey, ' ') END AS value FROM {orders}"""


@query(
    "preview_contact_update",
    f"""SELECT c.id, c.field, l.company_name, CASE c.field WHEN 'company_email' THEN l.company_email WHEN 'company_phone' THEN l.company_phone WHEN 'website' THEN l.website END AS previous_value,
trim(c.value) AS new_value, CASE WHEN NOT coalesce(c.field IN ('company_email', 'company_phone', 'website'), false) THEN 'invalid_field' WHEN trim(c.value) = '' THEN 'missing_value'
WHEN l.id IS NULL THEN 'lead_not_found' END AS error_code FROM ({CHANGES.replace('{orders}', 'orders')}) c LEFT JOIN leads l ON l.id = c.lead_id""",
)
def _(v):
    return audit.preview_contact_update(v.sql(CHANGES), v.leads).select(
        "id", "field", "company_name", "previous_value", "new_value", "error_code"
    )


READY = f"""SELECT * FROM ({CHECKED}) WHERE status = 'awaiting_approval' AND requires_approval AND approved_at IS NOT NULL AND proposal_error IS NULL"""


@query(
    "apply_contact_updates",
    f"""WITH r AS ({READY} AND tool_name = 'propose_contact_update'), o AS (SELECT *, row_number() OVER (ORDER BY approved_at, id) AS ord FROM r),
b AS (SELECT lead_id, arg_max(value, ord) FILTER (WHERE field = 'company_email') AS mail, arg_max(value, ord) FILTER (WHERE field = 'company_phone') AS phone,
  arg_max(value, ord) FILTER (WHERE field = 'website') AS site FROM o GROUP BY lead_id)
SELECT l.id, coalesce(b.mail, l.company_email) AS company_email, coalesce(b.phone, l.company_phone) AS company_phone, coalesce(b.site, l.website) AS website,
CASE WHEN b.site IS NOT NULL THEN regexp_replace(lower(b.site), '^www\\.', '') ELSE l.domain END AS domain FROM leads l LEFT JOIN b ON b.lead_id = l.id""",
)
def _(v):
    updated, _errors = audit.apply_contact_updates(v.leads, v.command_log)
    return updated.select("id", "company_email", "company_phone", "website", "domain")


@query(
    "apply_contact_updates_errors",
    f"SELECT id AS command_id, lead_id, 'lead_not_found' AS error_code FROM ({READY}) r WHERE tool_name = 'propose_contact_update' AND lead_id NOT IN (SELECT id FROM leads)",
)
def _(v):
    return audit.apply_contact_updates(v.leads, v.command_log)[1]


@query(
    "log_after_apply",
    f"""WITH r AS (SELECT DISTINCT id, lead_id IN (SELECT id FROM leads) AS found FROM ({READY}) x WHERE tool_name IN ('propose_contact_update', 'propose_create_followup'))
SELECT c.id, CASE WHEN r.found THEN 'succeeded' WHEN NOT r.found THEN 'failed' ELSE c.status END AS status,
CASE WHEN NOT r.found THEN 'lead_not_found' END AS error_code FROM command_log c LEFT JOIN r ON r.id = c.id""",
)
def _(v):
    log = upgrade_schema(v.command_log, SCHEMAS["command_log"])
    return audit.log_after_apply(v.leads, log).select("id", "status", "error_code")


@query(
    "apply_followups",
    f"SELECT id AS command_id, lead_id, title, '2024-02-01' AS due_date, 'high' AS priority, 'open' AS status FROM ({READY}) r WHERE tool_name = 'propose_create_followup' AND lead_id IN (SELECT id FROM leads)",
)
def _(v):
    return audit.apply_followups(v.leads, v.command_log).drop("created_at")


@query(
    "proposal_apply_join",
    "SELECT l.id, coalesce(c.mail, l.company_email) AS company_email, l.website FROM leads l LEFT JOIN (SELECT s_suppkey, concat('new', s_suppkey) AS mail FROM supplier) c ON c.s_suppkey = l.id",
)
def _(v):
    changes = v.base("supplier").select(
        F.col("s_suppkey").alias("lead_id"), F.concat(F.lit("new"), "s_suppkey").alias("company_email"),
        F.lit(None).cast("string").alias("company_phone"), F.lit(None).cast("string").alias("website"),
    )
    return audit.proposal_apply_join(v.leads, changes).select("id", "company_email", "website")


# --- files --------------------------------------------------------------------------------
def new_folder(v) -> str:
    return f"{shared_dir(v.spark)}/check-{uuid.uuid4().hex}"


CONTACT_LINES = """
SELECT CASE p_partkey % 4 WHEN 0 THEN concat(p_name, ', p', p_partkey, '@x.example,  Firm ', p_partkey % 50, ' , CEO') WHEN 1 THEN concat(p_name, ',x')
  WHEN 2 THEN concat(p_name, ',,Zeta') ELSE concat('plain ', p_partkey) END AS value FROM {part}"""
LINES_SQL = CONTACT_LINES.replace("{part}", "part")


@query(
    "read_contact_lines",
    f"""SELECT value, CASE WHEN len(f) > 2 THEN trim(f[3]) ELSE value END AS sort_key, trim(f[1]) AS name, trim(f[2]) AS email
FROM (SELECT value, str_split(value, ',') AS f FROM ({LINES_SQL}))""",
)
def _(v):
    path = new_folder(v)
    v.sql(CONTACT_LINES).write.text(path)
    return files.read_contact_lines(v.spark, path).select("value", "sort_key", "name", "email")


CARDS = """
SELECT s_suppkey, concat(CASE WHEN s_suppkey % 3 = 0 THEN '# ' ELSE '## ' END, s_name, ' ', chr(10), 'Website: x', chr(10),
  CASE WHEN s_suppkey % 4 = 0 THEN '' ELSE concat('Fit score:  ', s_suppkey % 101, '/100') END) AS value FROM {supplier}"""


@query(
    "read_company_cards",
    "SELECT replace(s_name, '#', '') AS title, CASE WHEN s_suppkey % 4 <> 0 THEN CAST(s_suppkey % 101 AS INTEGER) END AS fit_score FROM supplier",
)
def _(v):
    # One card per output file, as in a folder of company files.
    path = new_folder(v)
    files.write_company_cards(v.sql(CARDS).select("value", F.col("s_suppkey").alias("card")), path)
    return files.read_company_cards(v.spark, path).select("title", "fit_score")


INDEX = """
SELECT p_size, concat('{', concat('"k', p_partkey, '": {"name": "', p_name, '", "email": "p', p_partkey, '@x.example", "company": "C"}, "bad', p_partkey, '": 3'), '}') AS value FROM {part}"""


@query("read_contacts_index", "SELECT concat('k', p_partkey) AS key, p_name AS name, concat('p', p_partkey, '@x.example') AS email, 'C' AS company FROM part")
def _(v):
    path = new_folder(v)
    v.sql(INDEX).select("value").write.mode("overwrite").text(path)
    return files.read_contacts_index(v.spark, path, lines=True).select("key", "name", "email", "company")


@query("read_email_log", "SELECT concat('Order ', o_orderkey) AS subject, concat('C', o_custkey) AS company, 'in.txt' AS source_file, '2024-01-01T00:00:00Z' AS logged_at FROM orders")
def _(v):
    path = new_folder(v)
    mails = v.sql("SELECT concat('Order ', o_orderkey) AS subject, concat('C', o_custkey) AS company FROM {orders}")
    files.write_email_log(mails, path, "in.txt", "2024-01-01T00:00:00Z")
    return files.read_email_log(v.spark, path).select("subject", "company", "source_file", "logged_at")


OUTPUTS = """
SELECT CAST(s_suppkey AS STRING) AS source_file, concat('Here: {"companies": [{"name": "', s_name, '", "fit_score": ', s_suppkey % 100, '}, "text"], "contacts": ',
  CASE WHEN s_suppkey % 2 = 0 THEN '"none"' ELSE concat('[{"name": "A', s_suppkey, '", "email": "a@b.c"}, {"name": "B"}]') END,
  ', "emails": [], "conversation_notes": [{"company": "X", "open_questions": ["q"]}]}') AS value FROM {supplier}"""


@query(
    "explode_model_output",
    """SELECT CAST(s_suppkey AS VARCHAR) AS source_file, 'company' AS kind, s_name AS name FROM supplier
UNION ALL SELECT CAST(s_suppkey AS VARCHAR), 'contact', concat('A', s_suppkey) FROM supplier WHERE s_suppkey % 2 <> 0
UNION ALL SELECT CAST(s_suppkey AS VARCHAR), 'contact', 'B' FROM supplier WHERE s_suppkey % 2 <> 0
UNION ALL SELECT CAST(s_suppkey AS VARCHAR), 'note', 'X' FROM supplier""",
)
def _(v):
    made = files.explode_model_output(v.sql(OUTPUTS))

    def rows(section, kind, name):
        return made[section].select("source_file", F.lit(kind).alias("kind"), F.col(name).alias("name"))

    return rows("companies", "company", "name").unionByName(rows("contacts", "contact", "name")).unionByName(
        rows("emails", "email", "company")).unionByName(rows("conversation_notes", "note", "company"))


@query(
    "file_counts",
    """SELECT CAST(s_suppkey AS VARCHAR) AS source_file, CAST(2 AS BIGINT) AS companies, CAST(CASE WHEN s_suppkey % 2 = 0 THEN 0 ELSE 2 END AS BIGINT) AS contacts,
CAST(0 AS BIGINT) AS emails, CAST(1 AS BIGINT) AS conversation_notes FROM supplier""",
)
def _(v):
    return files.file_counts(v.sql(OUTPUTS))


@query(
    "csv_formula_guard",
    """SELECT CAST(p_partkey AS VARCHAR) AS id, CASE p_partkey % 5 WHEN 0 THEN '''=SUM(A1)' WHEN 1 THEN '''+1' WHEN 2 THEN '' WHEN 3 THEN 'a=b' ELSE '''@x' END AS cell,
CASE WHEN p_partkey > 0 THEN concat('''-', p_partkey) ELSE '0' END AS negative FROM part""",
)
def _(v):
    rows = v.sql("SELECT p_partkey AS id, CASE p_partkey % 5 WHEN 0 THEN '=SUM(A1)' WHEN 1 THEN '+1' WHEN 2 THEN NULL WHEN 3 THEN 'a=b' ELSE '@x' END AS cell, -p_partkey AS negative FROM {part}")
    return files.csv_formula_guard(rows)


@query(
    "export_leads_csv",
    """SELECT CAST(l.id AS VARCHAR) AS id, nullif(l.company_name, '') AS company_name, nullif(l.website, '') AS website, nullif(l.company_email, '') AS company_email,
nullif(l.partner_tier, '') AS partner_tier, nullif(array_to_string(l.services, ', '), '') AS services, CAST(l.fit_score AS VARCHAR) AS fit_score, l.status AS status,
CAST(o.people_count AS VARCHAR) AS people_count, CASE WHEN coalesce(o.has_decision_maker, false) THEN 'true' ELSE 'false' END AS has_decision_maker,
strftime(o.last_interaction, '%Y-%m-%d %H:%M:%S') AS last_interaction, o.next_deadline
FROM leads_h l JOIN open_children o ON o.lead_id = l.id""",
)
def _(v):
    path = new_folder(v)
    files.export_leads_csv(v.tables, path)
    return v.spark.read.option("header", True).csv(path).select(*files.CSV_COLUMNS)


# --- streams -------------------------------------------------------------------------------
def drain(v, frame, name: str):
    """Run a stream over all waiting input into a table in the shared folder and read it."""
    path = new_folder(v)
    frame.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").trigger(
        availableNow=True).start().awaitTermination()
    return v.spark.read.schema(frame.schema).parquet(f"{path}/out")


def event_stream(v):
    raw = commands.read_event_stream(v.spark, v.sf_dir, v.base("events").schema, "events.parquet")
    status = F.expr("CASE event_type WHEN 'signup' THEN 'received' WHEN 'view' THEN 'planned' WHEN 'click' THEN 'executing' WHEN 'purchase' THEN 'succeeded' ELSE 'failed' END")
    return raw.select("event_id", F.col("user_id").alias("command_id"), "ts", status.alias("status"))


@query(
    "stream_dedupe_apply",
    "SELECT user_id AS command_id FROM events GROUP BY user_id",
)
def _(v):
    seen = commands.stream_dedupe_apply(event_stream(v).select("command_id", "ts"), "365 days")
    return drain(v, seen.select("command_id"), "dedupe")


STREAM_SQL = """SELECT command_id, event_id, previous, status, coalesce((previous IS NULL AND status = 'received') OR """ + LEGAL + """, false) AS legal
FROM (SELECT *, lag(status) OVER (PARTITION BY command_id ORDER BY ts, event_id) AS previous FROM command_events)"""


@contextmanager
def state_in_rocksdb(spark):
    """The state store that ``transformWithState`` needs, for one query."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


@query("stream_command_state", STREAM_SQL)
def _(v):
    with state_in_rocksdb(v.spark):
        return drain(v, commands.stream_command_state(event_stream(v)), "state").drop("ts")


# The events come out of order: dealt over five files by a hash, one file per micro-batch, then a
# late event of no command that moves the watermark past all of them.
@query("stream_ordered_command_state", STREAM_SQL)
def _(v):
    inbox, schema = new_folder(v), "event_id long, command_id long, ts timestamp, status string"
    steps = v.command_events.select("event_id", "command_id", "ts", "status")
    far = v.sql("SELECT CAST(-1 AS BIGINT) AS event_id, CAST(-1 AS BIGINT) AS command_id, CAST(max(ts) AS TIMESTAMP) + INTERVAL 1500 DAYS AS ts, 'received' AS status FROM {events}")
    for n in range(5):
        steps.where(F.pmod(F.xxhash64("event_id"), F.lit(5)) == n).coalesce(1).write.mode("append").parquet(inbox)
    far.coalesce(1).write.mode("append").parquet(inbox)
    raw = v.spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(inbox)
    with state_in_rocksdb(v.spark):
        judged = drain(v, commands.stream_ordered_command_state(raw, "400 days", 400), "ordered")
    return judged.where("command_id >= 0").drop("ts")


@query("write_email_log", "SELECT 'in.txt' AS source_file, count(*) AS n FROM orders")
def _(v):
    path = new_folder(v)
    mails = v.sql("SELECT concat('Order ', o_orderkey) AS subject FROM {orders}")
    files.write_email_log(mails, path, "in.txt", "2024-01-01T00:00:00Z")
    return files.read_email_log(v.spark, path).groupBy("source_file").agg(F.count("*").alias("n"))


# Three batches: the first meets stored leads by name and adds others, the second meets those and adds more, the third
# meets leads of the second by their site and renames them. The second then comes again.
STORED_LEADS = "SELECT s_suppkey AS id, s_name AS company_name, replace(lower(s_name), '#', ' ') AS normalized_name, concat('old', s_suppkey, '.example.com') AS domain FROM {supplier} WHERE s_suppkey % 5 = 0"
INBOX = """
SELECT s_suppkey * 10 + %d AS id, 'linkedin_company' AS source_type, CAST(NULL AS STRING) AS source_url, concat(%s, chr(10), 'https://', %s, '.example.com') AS raw_text,
  CAST(NULL AS BIGINT) AS attach_lead_id, CAST(DATE '2024-01-01' + CAST(s_suppkey %% 50 AS INT) AS TIMESTAMP) AS created_at FROM {supplier} WHERE s_suppkey %% 5 IN (%s)"""
BATCHES = (
    INBOX % (1, "s_name", "concat('s', s_suppkey)", "0, 1"),
    INBOX % (2, "s_name", "concat('w', s_suppkey)", "1, 2"),
    INBOX % (3, "concat('Alias ', s_suppkey)", "concat('w', s_suppkey - 1)", "3"),
)


@query(
    "stream_intake",
    """WITH s AS (SELECT *, s_suppkey % 5 AS m FROM supplier), top AS (SELECT max(s_suppkey) AS id FROM s WHERE m = 0),
n AS (SELECT s_suppkey, (SELECT id FROM top) + row_number() OVER (ORDER BY m, s_suppkey % 50, s_suppkey) AS id FROM s WHERE m IN (1, 2))
SELECT CASE WHEN s.m = 0 THEN s.s_suppkey ELSE n.id END AS id, CASE WHEN s.m = 2 AND a.s_suppkey IS NOT NULL THEN concat('Alias ', a.s_suppkey) ELSE s.s_name END AS company_name,
concat(CASE WHEN s.m = 0 THEN 's' ELSE 'w' END, s.s_suppkey, '.example.com') AS domain, 'new' AS status,
CASE WHEN s.m = 1 OR a.s_suppkey IS NOT NULL THEN 2 ELSE 1 END::BIGINT AS n_sources
FROM s LEFT JOIN n USING (s_suppkey) LEFT JOIN supplier a ON s.m = 2 AND a.s_suppkey = s.s_suppkey + 1 WHERE s.m < 3""",
)
def _(v):
    root, inbox = new_folder(v), new_folder(v)
    start = {n: v.spark.createDataFrame([], struct_of(ddl)) for n, ddl in SCHEMAS.items()}
    start["leads"] = start["leads"].unionByName(v.sql(STORED_LEADS), allowMissingColumns=True)
    write_tables(Tables(**start), f"{root}/v0")
    for text in BATCHES:
        v.sql(text).write.mode("append").parquet(inbox)
        raw = v.spark.readStream.schema(v.sql(text).schema).parquet(inbox)
        stream_intake(raw, root).option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start().awaitTermination()
    store, now = open_store(v.spark, root)
    apply_batch(store, now, v.sql(BATCHES[1]), "another query 1")
    held = read_stored(v.spark, root)
    n_sources = held.raw_sources.groupBy(F.col("lead_id").alias("id")).agg(F.count("*").alias("n_sources"))
    return held.leads.join(n_sources, "id").select("id", "company_name", "domain", "status", "n_sources")
