"""Lead details: every item of every lead, in order, however its rows lie between ranges."""

import datetime

import pytest

from contactmill.plans import reports
from contactmill.sources.tables import SCHEMAS, struct_of

DAY = datetime.datetime(2024, 1, 1)


def table(spark, name, rows):
    schema = struct_of(SCHEMAS[name])
    return spark.createDataFrame([tuple(r.get(f.name) for f in schema) for r in rows], schema)


@pytest.fixture
def details(spark, empty_tables):
    leads = [*({"id": i, "company_name": f"C{i}"} for i in range(1, 31)), {"id": 4, "company_name": None}, {"id": None, "company_name": "none"}]
    tasks = [{"id": i, "lead_id": owner, "title": f"T{i}", "due_date": f"2024-01-{1 + i % 28:02d}" if i % 5 else None, "created_at": DAY}
             for i, owner in enumerate([7] * 60 + [4] * 6 + [8, 8, 99, None, *range(1, 31)])]
    people = [{"id": i, "lead_id": i % 12 or None, "name": f"P{i % 3}", "is_decision_maker": i % 2 == 0} for i in range(40)]
    raw = [{"id": i, "lead_id": 7 if i < 4 else 98, "source_type": "note", "created_at": DAY + datetime.timedelta(i)} for i in range(6)]
    t = empty_tables.with_(leads=table(spark, "leads", leads), tasks=table(spark, "tasks", tasks), people=table(spark, "people", people), raw_sources=table(spark, "raw_sources", raw))
    items = [(x["id"], 0, "", x["id"], x["company_name"]) for x in leads]
    items += [(x["lead_id"], 1, ("0" if x["is_decision_maker"] else "1") + x["name"], x["id"], x["name"]) for x in people]
    items += [(x["lead_id"], 3, x["due_date"] or "~", x["id"], x["title"]) for x in tasks]
    items += [(x["lead_id"], 4, str(9 - x["id"]), x["id"], "note") for x in raw]
    want = [(*i, x["company_name"] or "") for i in items for x in leads if x["id"] is not None and x["id"] == i[0]]
    return t, sorted(want, key=lambda r: r[:4])


@pytest.mark.parametrize("hot", [2, 64])
def test_items_in_order(spark, monkeypatch, details, hot):
    """With and without leads that are cut between ranges; repeated and missing ids, items without a lead."""
    monkeypatch.setattr(reports, "LEAST_HOT", hot)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        t, want = details
        got = [(r.lead_id, r.section, r.item_id, r.label, r.company_name or "") for r in reports.lead_detail(t).collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    short = [(r[0], r[1], r[3], r[4], r[5]) for r in want]
    assert sorted(map(repr, got)) == sorted(map(repr, short))
    assert [r[:3] for r in got] == [r[:3] for r in short]


def test_wide_rows_are_shuffled_once(spark, details):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        lines = reports.lead_detail(details[0])._jdf.queryExecution().executedPlan().toString().splitlines()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert sum("Exchange rangepartitioning" in line for line in lines) == 1
    assert not any("Exchange hashpartitioning" in a and "Union" in b for a, b in zip(lines, lines[1:], strict=False))
