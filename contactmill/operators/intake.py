"""Raw sources to leads: extract, link, merge, score - batch-wide."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contactmill.functions.scoring import fit_score
from contactmill.functions.text import extract_emails, is_directory_url
from contactmill.operators.extraction import FIELDS, extract_all, resolve_extraction
from contactmill.operators.linkage import (
    linkage_records,
    placeholder_name,
    resolve_leads,
)
from contactmill.operators.merge import (
    append_evidence,
    emit_interactions,
    emit_tasks,
    lead_changes,
    merge_leads,
    merge_people,
    write_fit_scores,
)
from contactmill.operators.numbering import number_rows
from contactmill.session import cut_lineage
from contactmill.sources.tables import Tables


def parse_records(raw: DataFrame) -> DataFrame:
    """Raw rows (``id, source_type, source_url, raw_text, attach_lead_id, created_at`` and
    optionally ``model_output``) to records with parsed fields as columns."""
    docs = raw if "model_output" in raw.columns else raw.withColumn("model_output", F.lit(None).cast("string"))
    parsed = resolve_extraction(extract_all(docs))
    is_mail = F.col("source_type") == "email"
    fields = [F.col(f"parsed.{n}").alias(n) for n in FIELDS if n != "confidence"]
    return parsed.select(
        F.col("id").alias("record_id"),
        F.col("created_at").alias("arrived"),
        "source_type",
        "source_url",
        "source_filter_tier",
        "raw_text",
        F.col("attach_lead_id").cast("long").alias("attach_lead_id"),
        F.when(is_mail, extract_emails(F.col("raw_text"))).alias("emails"),
        "extraction_status",
        "confidence",
        F.to_json("parsed").alias("parsed_json"),
        *fields,
    )


def resolved_records(records: DataFrame, leads: DataFrame, top: int | None = None) -> DataFrame:
    """Records with their lead, and the name and site that go onto it.

    A nameless record names its lead only where it creates the placeholder.
    """
    links = resolve_leads(linkage_records(records), leads, top).withColumnRenamed("record_id", "_rec")
    nameless = F.coalesce("company_name", F.lit("")) == ""
    borrowed = F.when(~is_directory_url(F.col("source_url")), F.col("source_url"))
    return records.join(links, F.col("record_id") == F.col("_rec")).drop("_rec").withColumns(
        {
            "company_name": F.when(nameless & F.col("creates"), placeholder_name(F.col("source_type"))).otherwise(
                F.col("company_name")
            ),
            "website": F.coalesce(F.nullif("website", F.lit("")), borrowed),
        }
    )


def _top(table: DataFrame, tops: dict[str, int] | None, name: str):
    """The largest id of a table."""
    if tops is not None:
        return F.lit(tops.get(name, 0))
    return table.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top")).scalar()


def run_intake(raw: DataFrame, t: Tables) -> Tables:
    """The tables after a batch of validated raw sources. Nothing is ever dropped:
    sources without a lead stay in the evidence table."""
    return intake_records(cut_lineage(parse_records(raw)), t)


def intake_records(records: DataFrame, t: Tables, tops: dict[str, int] | None = None) -> Tables:
    """The tables after the parsed ``records``.

    ``t`` may hold only the leads that share a key with the records, their people, and nothing else,
    if ``tops`` gives the largest id of each whole table; the result then holds those leads and people and the new rows.
    """
    # The wide texts stay in the written table; linkage and merging read the other columns.
    narrow = records.drop("raw_text", "parsed_json")
    resolved = cut_lineage(resolved_records(narrow, t.leads, None if tops is None else tops.get("leads", 0)))
    leads = cut_lineage(merge_leads(t.leads, lead_changes(resolved)))

    persons = resolved.filter(F.col("lead_id").isNotNull()).select(
        "record_id", "arrived", "lead_id", "confidence",
        F.col("record_id").alias("raw_source_id"), F.posexplode("people").alias("person_no", "p"),
    ).select(
        "record_id", "person_no", "arrived", "lead_id", "confidence", "raw_source_id", "p.*",
        F.lit(None).cast("string").alias("seniority"),
    ).filter((F.coalesce("name", F.lit("")) != "") | (F.coalesce("email", F.lit("")) != ""))
    people = cut_lineage(merge_people(t.people, persons, None if tops is None else tops.get("people", 0)))

    texts = records.select(F.col("record_id").alias("_text_of"), "raw_text")
    talking = resolved.filter(F.col("interaction").isNotNull())
    talks = emit_interactions(talking.join(texts, F.col("record_id") == F.col("_text_of")))
    talks = cut_lineage(number_rows(talks, ["created_at", "raw_source_id"], "_no").withColumn(
        "id", F.col("_no") + _top(t.interactions, tops, "interactions")).drop("_no"))
    todo = emit_tasks(talks.withColumn("_talk", F.col("id")))
    todo = todo.join(talks.select("raw_source_id", F.col("id").alias("source_interaction_id")), "raw_source_id")
    todo = number_rows(todo, ["created_at", "raw_source_id"], "_no").withColumn("id", F.col("_no") + _top(t.tasks, tops, "tasks"))

    touched = resolved.select(F.col("lead_id").alias("_lead")).filter(F.col("_lead").isNotNull()).distinct()
    changed = leads.join(touched, F.col("id") == F.col("_lead"), "left_semi")
    scored = write_fit_scores(leads, fit_score(changed, people), F.col("updated_at"))

    owners = resolved.select(F.col("record_id").alias("_rec"), "lead_id")
    evidence = records.join(owners, F.col("record_id") == F.col("_rec"), "left").select(
        F.col("record_id").alias("id"), "lead_id", "source_type", "source_url", "source_filter_tier",
        "raw_text", "parsed_json", "extraction_status", "confidence", F.col("arrived").alias("created_at"),
    )
    return t.with_(
        leads=scored,
        people=people,
        raw_sources=append_evidence(t.raw_sources, evidence),
        interactions=t.interactions.unionByName(talks, allowMissingColumns=True),
        tasks=t.tasks.unionByName(todo.drop("raw_source_id", "_no"), allowMissingColumns=True),
    )
