"""Searches by tables of questions and names equal the searches by one of them."""

import random

import pytest
from test_reports import table

from contactmill.plans import lookup, search
from contactmill.sources.tables import Tables

WORDS = ["shopify", "plus", "seo", "store", "asia", "zagreb", "product", "descriptions", "migration", "data", "shop", "ori"]


@pytest.fixture(scope="module")
def leads(spark):
    rng = random.Random(3)
    rows = [
        {"id": i, "company_name": rng.choice(["A", "b", None, "", "C_1", "100% Shop", "back\\slash", "A & B"]), "normalized_name": rng.choice(["a", "c_1", "100 shop", None, ""]),
         "fit_score": rng.choice([None, 0, 5, 5, 9]), "description": " ".join(rng.choices(WORDS, weights=range(12, 0, -1), k=rng.randrange(6)))}
        for i in range(300)
    ]
    return table(spark, "leads", rows)


@pytest.mark.parametrize("limit", [1, 3, 10, 400])
def test_questions(spark, leads, limit):
    rng = random.Random(limit)
    asked = [" ".join(rng.choices([*WORDS, "the", "nowhere", "st"], k=rng.randrange(8))) for _ in range(60)]
    asked += ["", "the and", "Shopify  PLUS plus plus", "zzzz", "product descriptions", "seo", "seo", "shopify store"]
    t = Tables(leads, *[table(spark, n, []) for n in ("people", "raw_sources", "interactions", "tasks")])
    questions = spark.createDataFrame(list(enumerate(asked)), "id long, text string")
    got = lookup.search_leads_by_questions(t, questions, limit)
    want = search.search_leads_many(t, asked, limit)
    assert got.columns == want.columns
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)


def test_empty_tables_and_null_questions(spark, leads):
    none = Tables(leads.limit(0), *[table(spark, n, []) for n in ("people", "raw_sources", "interactions", "tasks")])
    questions = spark.createDataFrame([(1, None), (2, "seo")], "id long, text string")
    assert lookup.search_leads_by_questions(none, questions).count() == 0
    some = Tables(leads, none.people, none.raw_sources, none.interactions, none.tasks)
    got = lookup.search_leads_by_questions(some, questions.where("id = 1"), 5)
    assert [r["score"] for r in got.collect()] == [0] * 5
    assert lookup.search_leads_by_questions(some, questions.limit(0)).count() == 0


def test_names(spark, leads):
    asked = ["a", "A", "c_1", "C%1", "%", "", "_", "100%", "0% s", "shop", "k\\s", "\\", "A & B", "&", "no such", "__", "ack\\slas", " b", None, "shop"]
    names = spark.createDataFrame([(i, n, 0) for i, n in enumerate(asked)], "needle long, name string, lead_id int").drop("lead_id")
    got = {(r["needle"], r["lead_id"]) for r in lookup.search_leads_by_names(leads, names).collect()}
    want = {(i, r["id"]) for i, n in enumerate(asked) if n is not None for r in search.search_lead_by_name(leads, n).select("id").collect()}
    assert got == want


def test_plans_have_no_products(spark, leads):
    names = spark.createDataFrame([(1, "a")], "id long, name string")
    plan = lookup.search_leads_by_names(leads, names)._jdf.queryExecution().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan
