"""Deep pages and the counts of a conversion."""

import random

import pytest
from pyspark.sql import functions as F

from contactmill.operators import convert, numbering
from contactmill.sources.tables import SCHEMAS, struct_of


@pytest.mark.parametrize("small_page", [0, 10_000])
def test_pages_like_a_sorted_list(spark, monkeypatch, small_page):
    """Through the ranges and as a top-k: the same rows, in order, also across ranges, past the end and with ties."""
    monkeypatch.setattr(numbering, "SMALL_PAGE", small_page)
    rng = random.Random(4)
    rows = [(i, rng.choice([None, *range(12)]), f"t{i}") for i in range(700)]
    df = spark.createDataFrame(rows, "id long, score int, text string").repartition(5)
    want = [r[0] for r in sorted(rows, key=lambda r: (r[1] is None, r[1] or 0, r[0]))]
    for offset, limit in ((0, 5), (343, 100), (690, 50), (700, 5), (9000, 5), (0, 700)):
        page = numbering.page_of(df, [F.asc_nulls_last("score"), "id"], limit, offset)
        assert [r.id for r in page.collect()] == want[offset : offset + limit] and page.columns == df.columns
    assert numbering.page_of(df.limit(0), ["id"], 5, 3).collect() == []


def table(spark, name, rows):
    schema = struct_of(SCHEMAS[name])
    return spark.createDataFrame([tuple(r.get(f.name) for f in schema) for r in rows], schema)


def test_counts_of_a_conversion(spark, empty_tables):
    leads = [{"id": 1, "company_email": "a@b.c"}, {"id": 2, "company_phone": "12", "company_email": ""}, {"id": None, "company_email": "x@y.z"}, {"id": 3}]
    people = [{"id": 1, "lead_id": 1, "email": "p@q.r", "linkedin_url": "u"}, {"id": 2, "lead_id": None, "email": "p@q.r"}, {"id": 3, "lead_id": 9, "email": "z"}, {"id": 4, "lead_id": 2}]
    raw = [{"id": 1, "raw_text": "t"}, {"id": 2, "raw_text": "  "}, {"id": 3, "raw_text": None}, {"id": 4, "raw_text": "u"}]
    t = empty_tables.with_(
        leads=table(spark, "leads", leads), people=table(spark, "people", people), raw_sources=table(spark, "raw_sources", raw),
        interactions=table(spark, "interactions", [{"id": 1, "lead_id": 3}, {"id": 2, "lead_id": 8}]), tasks=table(spark, "tasks", [{"id": 1, "lead_id": 1}] * 3),
    )

    def counts(report):
        rows = [((r.entity, r.outcome, r.reason), r.n) for r in report.collect()]
        assert len(dict(rows)) == len(rows)
        return dict(rows)

    want = {
        ("organization", "migrated", ""): 3, ("organization", "skipped", "missing_id"): 1, ("contact_method", "migrated", ""): 4,
        ("source", "migrated", ""): 2, ("source", "skipped", "empty_text"): 2, ("person", "migrated", ""): 2, ("person", "skipped", "missing_org"): 2,
        ("interaction", "migrated", ""): 1, ("interaction", "skipped", "missing_org"): 1, ("task", "migrated", ""): 3, ("task", "skipped", "missing_org"): 0,
    }
    assert counts(convert.reconciliation_report(t)) == want
    made, _ = convert.convert(t.with_(leads=t.leads.where("id = 2"), raw_sources=t.raw_sources.where("id = 4")))
    again = want | {("organization", "migrated", ""): 2, ("organization", "conflict", "legacy_lead_id"): 1, ("contact_method", "migrated", ""): 3,
                    ("source", "migrated", ""): 1, ("source", "conflict", "legacy_source_id"): 1}
    assert counts(convert.reconciliation_report(t, made)) == again
    assert set(counts(convert.reconciliation_report(empty_tables)).values()) == {0}


def test_every_table_is_read_once(spark, tmp_path, empty_tables):
    from contactmill.sources.tables import read_tables, write_tables

    write_tables(empty_tables, str(tmp_path / "t"))
    plan = convert.reconciliation_report(read_tables(spark, str(tmp_path / "t")))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 5
