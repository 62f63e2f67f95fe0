"""Registered queries agree with DuckDB on the smallest tables.

One query per kind here, to keep the run short; ``python -m checks.compare``
compares all of them.
"""

import pytest

import __spark_entry__ as entry
from checks.compare import compare, duck

SF = "/root/testdata/sf0.001"
CHOSEN = (
    "hydrate_json_columns", "validate_intake", "model_quality_checks", "contact_summary", "pipeline_metric",
    "list_leads", "lead_detail", "canonical_source", "source_history", "list_contact_emails", "followups_due",
    "companies_missing_email", "company_summary_legacy", "lead_summary", "sort_nulls_last", "top_n_per_group",
    "search_contacts", "search_leads_many", "search_filters", "question_intents", "collect_lead_emails",
    "normalize_name", "normalize_website", "normalize_email", "parse_deadline", "extract_phone", "clean_lines",
    "extract_json", "validate_intent_json", "fit_score", "extract_directory", "extract_email_message",
    "match_leads_with_profiles", "match_leads_by_email", "slug_contains_join", "lead_components", "merge_people",
    "upsert_contacts_legacy", "merge_contacts_index", "to_contact_methods", "org_to_lead_view",
    "reconciliation_report", "illegal_transitions", "validate_proposals", "apply_contact_updates",
    "read_company_cards", "explode_model_output", "export_leads_csv", "stream_dedupe_apply",
)


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", CHOSEN)
def test_query(spark, con, name):
    line = compare(spark, con, name, entry.queries()[name], entry.oracle_sql()[name], SF)
    assert line.startswith("ok"), line


def test_entry(spark):
    row = entry.entry(spark).first()
    assert row["without_email"] == row["companies"] - row["with_any_email"]


def test_every_oracle_has_a_query():
    assert set(CHOSEN) <= set(entry.oracle_sql()) <= set(entry.queries())
