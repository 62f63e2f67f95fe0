"""Needles meet few texts besides those that hold them."""

import random

from contactmill.plans import lookup


def test_numbers_meet_few_other_numbers(spark):
    rng = random.Random(7)
    texts = [f"customer {n:09d}" for n in rng.sample(range(10**6), 3000)]
    needles = [t[-7:] for t in texts[:300]] + ["r 0%" + t[-6:] for t in texts[300:400]]
    left = spark.createDataFrame([(n,) for n in set(needles)], "needle string")
    right = spark.createDataFrame(list(enumerate(texts)), "lead_id long, text string")
    pairs = lookup.anchored_pairs(left, right, []).select("needle", "lead_id").collect()
    found = {(r["needle"], texts[r["lead_id"]]) for r in pairs}
    assert len(found) == len(pairs)
    want = {(n, t) for n in set(needles) for t in texts if all(p in t for p in n.split("%"))}
    assert want <= found and len(found) <= 1.2 * len(want)


def test_questions_with_shared_terms_equal_the_search_by_one(spark, monkeypatch):
    from test_reports import table

    from contactmill.plans import search
    from contactmill.sources.tables import Tables

    rng = random.Random(11)
    words = ["shopify", "plus", "seo", "store", "asia", "zagreb", "product", "descriptions", "migration", "rare"]
    rows = [
        {"id": i, "company_name": f"Firm {i % 90}", "fit_score": rng.choice([None, 0, 5, 9]),
         "description": " ".join(rng.choices(words, weights=[9, 9, 9, 7, 7, 5, 5, 5, 2, 1], k=rng.randrange(6)))}
        for i in range(200)
    ]
    t = Tables(table(spark, "leads", rows), *[table(spark, n, []) for n in ("people", "raw_sources", "interactions", "tasks")])
    asked = [" ".join(rng.choices([*words, str(rng.randrange(90)), "nowhere"], k=rng.randrange(7))) for _ in range(50)]
    monkeypatch.setattr(lookup, "LONG_LIST", 8)
    monkeypatch.setattr(lookup, "OFTEN", 2)
    got = lookup.search_leads_by_questions(t, spark.createDataFrame(list(enumerate(asked)), "id long, text string"), 3)
    want = search.search_leads_many(t, asked, 3)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
