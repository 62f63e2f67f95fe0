"""Batch linkage against one-record-at-a-time brute force."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from contactmill.operators import linkage, merge
from contactmill.sources.tables import LEADS, PEOPLE, struct_of

PERSONAL = {"gmail.com"}


def one_by_one(records, leads):
    """Plain list scan: the meaning of linkage, without any index."""
    store = [dict(l) for l in leads]
    out, next_id, parked = {}, max([l["id"] for l in leads], default=0), {}

    def match(name, domain):
        return [l for l in store if (name and l["name"] == name) or (domain and l["domain"] == domain)]

    for r in sorted(records, key=lambda r: (r["arrived"], r["record_id"])):
        name = " ".join(r["company_name"].lower().split()) if r["company_name"] else None
        domain = r["website"]
        if not name and r["attach"] is None and r["source_type"] in linkage.NAMELESS_CREATES:
            kind = r["source_type"]
            owner = min(match(None, domain), key=lambda l: l["id"], default=None)
            if owner:
                owner["mail"] = r["company_email"] or owner["mail"]
                out[r["record_id"]] = owner["id"]
                continue
            seats = [l["id"] for l in store if l["name"] == f"unknown {kind}"]
            if kind not in parked:
                if not seats:
                    next_id += 1
                parked[kind] = min(seats) if seats else next_id
            out[r["record_id"]] = parked[kind]
            continue
        lead = next((l for l in store if l["id"] == r["attach"]), None)
        if lead is None and r["attach"] is not None:
            lead = {"id": r["attach"], "name": None, "domain": None, "mail": None, "raw": None}
            store.append(lead)
        if lead is None and name:
            lead = min(match(name, domain), key=lambda l: l["id"], default=None)
        is_mail = r["source_type"] == "email"
        if lead is None and is_mail:
            for mail in r["emails"]:
                host = mail.split("@")[1]
                if host in PERSONAL:
                    continue
                hits = [l for l in store if l["domain"] == host or l["mail"] == mail]
                if hits:
                    lead = min(hits, key=lambda l: l["id"])
                    break
        if lead is None and not name:
            out[r["record_id"]] = None
            continue
        keeps_name = lead is not None and is_mail
        if lead is None:
            lead = min(match(name, domain), key=lambda l: l["id"], default=None)
        if lead is None:
            next_id += 1
            lead = {"id": next_id, "name": None, "domain": None, "mail": None, "raw": None}
            store.append(lead)
        if name and not keeps_name:
            raw = r["company_name"]
            if not (lead["raw"] and lead["raw"][1:].lower() == raw.lower()):
                lead["raw"], lead["name"] = raw, name
        lead["domain"] = domain or lead["domain"]
        lead["mail"] = r["company_email"] or lead["mail"]
        out[r["record_id"]] = lead["id"]
    return out


def make_case(seed, n=60):
    """A small world of its own: names, sites and ids carry the seed."""
    rng = random.Random(seed)
    base = seed * 1000

    def own(word):
        return word and f"{word}{seed}"

    names = ["Acme", "cme", "Beta Inc", "Gamma", "Delta", None]
    sites = ["a.com", "b.com", "c.com", "d.com", None, None]
    leads = [
        {"id": base + i + 1, "raw": own(rng.choice(names[:5])), "domain": own(rng.choice(sites)), "mail": None}
        for i in range(rng.randint(0, 3))
    ]
    for l in leads:
        l["name"] = l["raw"].lower()
    start = datetime(2024, 1, 1)
    records = []
    for i in range(n):
        kind = rng.choice(["website", "email", "email", "linkedin_person", "note"])
        mails = [rng.choice([own("x@a.com"), "y@gmail.com", own("z@c.com"), own("q@zz.com")]) for _ in range(rng.randint(0, 2))]
        records.append({
            "record_id": base + i, "arrived": start + timedelta(minutes=rng.randint(0, 40)), "source_type": kind,
            "source_url": None, "attach": rng.choice([None] * 9 + [leads[0]["id"] if leads else None]),
            "company_name": own(rng.choice(names)), "website": None if kind == "email" else own(rng.choice(sites)),
            "company_email": own(rng.choice([None, None, "z@c.com", "p@p.com"])), "emails": mails if kind == "email" else [],
        })
    return records, leads


def frames(spark, records, leads):
    raw = spark.createDataFrame(
        [(r["record_id"], r["arrived"], r["source_type"], r["source_url"], r["attach"], r["company_name"],
          r["website"], r["company_email"], r["emails"]) for r in records],
        "record_id long, arrived timestamp, source_type string, source_url string, attach_lead_id long, "
        "company_name string, website string, company_email string, emails array<string>",
    )
    held = spark.createDataFrame(
        [(l["id"], l["raw"], l["name"], l["domain"], l["mail"]) for l in leads],
        "id long, company_name string, normalized_name string, domain string, company_email string",
    )
    return linkage.linkage_records(raw), held


def test_same_leads_as_one_by_one(spark):
    records, leads = [], []
    for seed in range(25):
        r, l = make_case(seed)
        records, leads = records + r, leads + l
    rec, held = frames(spark, records, leads)
    got = {r["record_id"]: r["lead_id"] for r in linkage.resolve_leads(rec, held).collect()}
    assert got == one_by_one(records, leads)


def test_nameless_note_goes_to_the_lead_of_its_site(spark):
    leads = [{"id": 7, "raw": "Acme", "name": "acme", "domain": "acme.com", "mail": None}]
    note = {
        "arrived": datetime(2024, 1, 1), "source_type": "note", "attach": None, "company_name": None,
        "website": None, "company_email": None, "emails": [],
    }
    urls = ["https://acme.com/x", "https://other.com/y", None, "https://other.com/z"]
    rec, held = frames(spark, [note | {"record_id": i, "source_url": u} for i, u in enumerate(urls)], leads)
    got = {r["record_id"]: r for r in linkage.resolve_leads(rec, held).collect()}
    assert [got[i]["lead_id"] for i in range(4)] == [7, 8, 8, 8]
    assert [got[i]["creates"] for i in range(4)] == [False, True, False, False]


def test_components_of_a_long_chain(spark):
    n = 300
    links = spark.createDataFrame([(i + 1, i) for i in range(n)], "node long, low long")
    rows = linkage.connected_components(links).collect()
    assert len(rows) == n + 1 and {r["component"] for r in rows} == {0}


def test_no_links(spark):
    links = spark.createDataFrame([], "node long, low long")
    assert linkage.connected_components(links).count() == 0


def test_match_counts(spark):
    records, leads = make_case(3, 200)
    leads = leads + [
        {"id": 10 + i, "raw": "Acme3", "name": f"{n}3", "domain": f"{d}.com3", "mail": None}
        for i, (n, d) in enumerate([("acme", "a"), ("acme", "b"), ("beta inc", "a"), ("delta", "c"), ("acme", "a")])
    ]
    raw = spark.createDataFrame(
        [(r["record_id"], r["company_name"], r["website"]) for r in records],
        "record_id long, company_name string, website string",
    )
    held = spark.createDataFrame([(l["id"], l["name"], l["domain"]) for l in leads],
                                 "id long, normalized_name string, domain string")
    got = {r["record_id"]: (r["lead_id"], r["match_count"]) for r in linkage.match_leads(raw, held).collect()}
    want = {}
    for r in records:
        name = r["company_name"].lower() if r["company_name"] else None
        hits = [l["id"] for l in leads if (name and l["name"] == name) or (r["website"] and l["domain"] == r["website"])]
        if hits:
            want[r["record_id"]] = (min(hits), len(hits))
    assert got == want


def lead_changes(spark, rows):
    df = spark.createDataFrame(rows, "record_id long, arrived timestamp, lead_id long, company_name string, website string")
    for f in struct_of(LEADS):
        if f.name not in df.columns and f.name not in ("id", "normalized_name", "domain", "created_at", "updated_at"):
            df = df.withColumn(f.name, F.lit(None).cast(f.dataType))
    return merge.lead_changes(df.withColumns({"source_type": F.lit("website"), "creates": F.lit(False)}))


def test_clipped_name_stays(spark):
    t0 = datetime(2024, 1, 1)
    names = {1: ["2IWD Agency", "IWD Agency"], 2: ["Acme", "cme", "me"], 3: ["Bcd", "cd", "Other", "ther"], 4: ["One", "Two"]}
    rows, i = [], 0
    for lead, given in names.items():
        for n in given:
            i += 1
            rows.append((i, t0 + timedelta(minutes=i), lead, n, None))
    held = spark.createDataFrame([], struct_of(LEADS))
    got = {r["id"]: r["company_name"] for r in merge.merge_leads(held, lead_changes(spark, rows)).collect()}
    # "me" is "cme" clipped, but the stored name is still "Acme", so it replaces it.
    assert got == {1: "2IWD Agency", 2: "me", 3: "Other", 4: "Two"}


def test_merge_twice_is_merge_once(spark):
    t0 = datetime(2024, 1, 1)
    changes = lead_changes(spark, [(1, t0, 5, "Acme", "https://a.com"), (2, t0, 5, None, None), (3, t0, 6, "Beta", None)])
    held = spark.createDataFrame([], struct_of(LEADS))
    once = merge.merge_leads(held, changes)
    twice = merge.merge_leads(once, changes)
    assert sorted(once.collect(), key=str) == sorted(twice.collect(), key=str)
    assert {(r["id"], r["domain"]) for r in once.collect()} == {(5, "a.com"), (6, None)}


def people_one_by_one(rows):
    store = []
    for r in sorted(rows, key=lambda r: (r["arrived"], r["record_id"])):
        hit = next((p for p in store if r["url"] and p["lead"] == r["lead"] and p["url"] == r["url"]), None)
        if hit is None and r["mail"]:
            hit = next((p for p in store if p["lead"] == r["lead"] and p["mail"] == r["mail"]), None)
        if hit is None:
            hit = {"id": len(store) + 1, "lead": r["lead"], "url": r["url"], "mail": None, "name": None}
            store.append(hit)
        hit["mail"] = r["mail"] or hit["mail"]
        hit["name"] = r["name"] or hit["name"]
    return {(p["id"], p["lead"], p["url"], p["mail"], p["name"]) for p in store}


def test_people_as_one_by_one(spark):
    rng = random.Random(7)
    t0 = datetime(2024, 1, 1)
    rows = [
        {"record_id": i, "arrived": t0 + timedelta(minutes=rng.randint(0, 30)), "lead": rng.randint(1, 12),
         "url": rng.choice([None, None, "linkedin.com/in/a", "linkedin.com/in/b"]),
         "mail": rng.choice([None, "a@x.com", "b@x.com", "c@x.com"]), "name": rng.choice([None, f"N{i}"])}
        for i in range(200)
    ]
    df = spark.createDataFrame(
        [(r["record_id"], 0, r["arrived"], r["lead"], r["name"], None, None, None, r["mail"], r["url"], 0.5, r["record_id"]) for r in rows],
        "record_id long, person_no int, arrived timestamp, lead_id long, name string, title string, department string, "
        "seniority string, email string, linkedin_url string, confidence double, raw_source_id long",
    )
    held = spark.createDataFrame([], struct_of(PEOPLE))
    got = {(p["id"], p["lead_id"], p["linkedin_url"], p["email"], p["name"]) for p in merge.merge_people(held, df).collect()}
    assert got == people_one_by_one(rows)


def test_hot_keys_are_not_brought_together(spark):
    """Same rows as a plain join; keys above the limit meet no shuffle; their number is bounded by the limit itself."""
    rows = spark.range(3000).select(F.when(F.col("id") < 1000, 7).otherwise(F.col("id") % 400 + 10).alias("key"), F.col("id").alias("node"))
    lookup = rows.groupBy("key").agg(F.min("node").alias("low"), F.count("*").alias("_size"))
    joined = linkage.join_hot_keys(rows, lookup, "key", 3000)
    assert sorted(map(tuple, joined.collect())) == sorted(map(tuple, rows.join(lookup.drop("_size"), "key").select("key", "node", "low").collect()))
    assert lookup.where(F.col("_size") > max(linkage.LEAST_HOT, 3000 // linkage.HOT_KEYS)).count() == 1 <= linkage.HOT_KEYS


def test_components_of_stars_chains_and_hubs(spark):
    """Two hubs with 500 nodes each that a chain connects, a lone pair, and a long chain."""
    links = [(i, 0) for i in range(1, 500)] + [(i, 1000) for i in range(1001, 1500)] + [(2000, 3), (2001, 2000), (2001, 1400)]
    links += [(5000, 4000)] + [(i + 1, i) for i in range(6000, 6100)]
    got = {r.node: r.component for r in linkage.connected_components(spark.createDataFrame(links, "node long, low long")).collect()}
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    assert got == {x: root(x) for x in list(parent)}
