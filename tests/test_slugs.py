"""Slugs meet by parts of the lengths that occur."""

import random

from contactmill.operators import linkage


def test_slugs_meet_without_a_shared_beginning(spark):
    rng = random.Random(5)
    word = lambda most: "".join(rng.choices("ab-", k=rng.randrange(most)))
    asked = [*[word(9) for _ in range(80)], "", None, "customer-1", "zzz"]
    held = [*[word(7) for _ in range(40)], "", None, "customer-12", "customer-1", "xx-customer-1"]
    q = spark.createDataFrame(list(enumerate(asked)), "id long, slug string")
    c = spark.createDataFrame([(s,) for s in held], "slug string")
    found = linkage.slug_contains_join(q, c)
    got = {r["id"]: r["company_slug"] for r in found.collect()}
    some = [s for s in held if s]
    want = {i: s if s in some else min((x for x in some if s and (x in s or s in x)), default=None) for i, s in enumerate(asked)}
    assert got == want
    plan = found._jdf.queryExecution().executedPlan().toString()
    # Only the row of lengths is sent to all: a table of parts must not pass through the driver.
    assert plan.count("BroadcastExchange") == plan.count("IdentityBroadcastMode") and "contains" not in plan.lower()
