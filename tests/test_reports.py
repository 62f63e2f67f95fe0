"""Seeds with known answers, and what the plans must look like."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from contactmill.plans import reports, search
from contactmill.sources.tables import SCHEMAS, Tables, struct_of

NOW = datetime(2024, 1, 1)


def table(spark, name, rows):
    schema = struct_of(SCHEMAS[name])
    return spark.createDataFrame([tuple(r.get(f.name) for f in schema) for r in rows], schema)


@pytest.fixture(scope="module")
def seeded(spark):
    leads = [
        {"id": 1, "company_name": "High Fit Co", "fit_score": 90, "status": "qualified", "updated_at": NOW},
        {"id": 2, "company_name": "No Contacts Co", "fit_score": 50, "status": "new", "updated_at": NOW},
        {"id": 3, "company_name": "Closed Co", "fit_score": 0, "status": "closed", "updated_at": NOW},
        {"id": 4, "company_name": "Unset Co", "fit_score": None, "status": None, "company_email": "a@b.c", "updated_at": NOW},
    ]
    people = [{"id": 1, "lead_id": 1, "name": "Jane", "email": "j@x.com", "is_decision_maker": True, "created_at": NOW}]
    tasks = [
        {"id": 1, "lead_id": 1, "title": "Call", "due_date": "2020-01-01", "priority": "high", "status": "open", "created_at": NOW},
        {"id": 2, "lead_id": 2, "title": "Later", "due_date": "2999-01-01", "priority": "low", "status": "open", "created_at": NOW},
        {"id": 3, "lead_id": 2, "title": "Undated", "due_date": None, "priority": "low", "status": "open", "created_at": NOW},
    ]
    talks = [{"id": 1, "lead_id": 2, "type": "Email", "deadline": "2021-01-01", "status": "open", "created_at": NOW},
             {"id": 2, "lead_id": 1, "type": "call", "deadline": "2019-01-01", "status": "open", "created_at": NOW}]
    return Tables(table(spark, "leads", leads), table(spark, "people", people), table(spark, "raw_sources", []),
                  table(spark, "interactions", talks), table(spark, "tasks", tasks))


def test_counts(seeded):
    row = reports.contact_summary(seeded).first().asDict()
    assert row == {"companies": 2, "with_company_email": 0, "with_people": 1, "with_person_email": 1,
                   "with_any_email": 1, "without_email": 1, "email_interactions": 1}
    assert [r["id"] for r in reports.leads_without_contacts(seeded).collect()] == [2, 3, 4]
    assert reports.top_leads(seeded, 1).first()["company_name"] == "High Fit Co"


def test_next_deadline_counts_a_deadline_only_beside_undated_tasks(seeded):
    ahead = {r["id"]: r["next_deadline"] for r in reports.list_leads(seeded).collect()}
    assert ahead == {1: "2020-01-01", 2: "2021-01-01", 3: None, 4: None}


def test_metrics(seeded):
    values = {r["metric"]: r["value"] for r in reports.pipeline_metric(seeded, "2024-01-01").collect()}
    assert values == {"organization_count": 2.0, "contact_coverage_percent": 50.0,
                      "verified_email_coverage_percent": 0.0, "overdue_task_count": 3.0}
    with pytest.raises(ValueError):
        reports.pipeline_metric(seeded, "2024-01-01", "other")


def test_due_filter_uses_the_items_status(seeded):
    assert reports.due_followups_filtered(seeded, "2024-01-01", status="open").count() == 3
    assert reports.due_followups_filtered(seeded, "2024-01-01", status="done").count() == 0


def test_unknown_definition_is_refused(seeded):
    with pytest.raises(ValueError):
        reports.companies_missing_email(seeded, definition="maybe")


def plan_of(df):
    return df._jdf.queryExecution().explainString(
        df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def test_plans_push_down_and_avoid_nested_loops(spark):
    from checks.bind import Views

    v = Views(spark, "/root/testdata/sf0.001")
    for df in (reports.list_leads(v.tables), reports.contact_summary(v.tables), reports.leads_without_email(v.tables),
               reports.followups_due(v.tables, "1998-06-01")):
        plan = plan_of(df)
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    orders = v.base("orders").filter("o_orderstatus = 'O'").select("o_orderkey")
    assert "PushedFilters: [IsNotNull(o_orderstatus)" in plan_of(orders)


def test_search_terms_and_blank_query(spark, seeded):
    terms = spark.range(1).select(search.search_terms(F.lit("Find Shopify Plus agencies with CRO, please"))).first()[0]
    assert terms == ["shopify plus", "shopify", "plus", "cro", "please"]
    assert search.query_terms("Find Shopify Plus agencies with CRO, please") == terms
    assert search.search_leads_ranked(seeded, "", limit=2).count() == 2
    assert search.search_leads_ranked(seeded, "zzzz").count() == 0
