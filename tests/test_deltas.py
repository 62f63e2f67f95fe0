"""Tables as a base and what batches changed: same rows as whole rewrites, and bytes that follow the batch."""

import os
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from contactmill.operators.intake import run_intake
from contactmill.operators.linkage import lead_keys
from contactmill.session import cut_lineage
from contactmill.sources.deltas import Store
from contactmill.sources.tables import SCHEMAS, Tables, struct_of, write_tables
from contactmill.streaming.intake import apply_batch, open_store, read_stored, stream_intake

T0 = datetime(2024, 1, 1)
RAW = "id long, source_type string, source_url string, raw_text string, attach_lead_id long, created_at timestamp"


def source(rng, i):
    """Firms that share names and sites now and then, and mails to them."""
    firm, kind = rng.randrange(9), rng.choice(["website", "linkedin_company", "note", "email"])
    text = {
        "website": f"Firm {firm}\nhttps://f{rng.randrange(9)}.com", "linkedin_company": f"Firm {firm}\nhttps://f{firm}.com", "note": f"https://f{firm}.com",
        "email": f"From: Jo{i % 4} <jo{i % 4}@f{firm}.com>\nSubject: Offer {i}\n\nCan you reply by 2024-05-01?",
    }[kind]
    return (i, kind, None, text, None, T0 + timedelta(minutes=i))


def rows_of(df, like):
    return sorted(map(str, df.select(*sorted(like.columns)).collect()))


def test_batches_like_whole_tables(spark, tmp_path, empty_tables):
    """Same leads, people, evidence, interactions and tasks as the intake that rewrites everything, compacted or not; a batch that comes again adds nothing."""
    rng = random.Random(3)
    batches = [[source(rng, i) for i in range(a, a + 18)] for a in (0, 18)]
    store, now = open_store(spark, str(tmp_path / "s"))
    whole = empty_tables
    for n, batch in enumerate(batches):
        given = spark.createDataFrame(batch, RAW)
        now = store.compact(apply_batch(store, now, given, f"q {n}"), most_commits=1, largest_share=0.9)
        done = run_intake(given, whole)
        whole = Tables(**{t: cut_lineage(getattr(done, t)) for t in SCHEMAS})
    again = apply_batch(store, now, spark.createDataFrame(batches[1], RAW), "q 9")
    assert {t: [p.rows for p in ps] for t, ps in again.parts.items()} == {t: [p.rows for p in ps] for t, ps in now.parts.items()}
    for version in (now, again):
        held = store.tables(version)
        for table in ("leads", "people", "raw_sources", "interactions", "tasks"):
            assert rows_of(getattr(held, table), getattr(whole, table)) == rows_of(getattr(whole, table), getattr(whole, table)), table


def leads(spark, ids, name):
    columns = {f.name: F.lit(None).cast(f.dataType) for f in struct_of(SCHEMAS["leads"])} | {
        "id": F.col("id"), "company_name": F.concat(F.lit(name), "id"), "normalized_name": F.concat(F.lit(name), "id")}
    return spark.createDataFrame([(i,) for i in ids], "id long").select(*[c.alias(n) for n, c in columns.items()])


def size(path):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, fs in os.walk(path) for f in fs if f.endswith(".parquet"))


def test_newest_row_compaction_and_bytes(spark, tmp_path, empty_tables):
    root = str(tmp_path / "s")
    first = leads(spark, range(3000), "a")
    store = Store(spark, root)
    now = store.create(empty_tables.with_(leads=first), lead_keys(first).select("key", "id"), 4)
    base = size(root)
    for n in range(1, 5):
        now = store.append(now, {"leads": leads(spark, sorted({1, n, 5000 + n}), f"b{n}-")}, f"q {n}")
    assert size(root) - base < 4 * base / 10 and len(now.parts["leads"]) == 5 and now.tops["leads"] == 5004
    want = {i: f"a{i}" for i in range(3000)} | {2: "b2-2", 3: "b3-3", 4: "b4-4", 1: "b4-1"} | {5000 + n: f"b{n}-{5000 + n}" for n in range(1, 5)}
    minor = store.compact(now, 3, 0.5)
    major = store.compact(now.__class__(minor.number, now.buckets, now.made_by, now.parts, now.tops), 3, 0.0)
    assert [len(v.parts["leads"]) for v in (now, minor, major)] == [5, 2, 1] and store.compact(minor, 3) is minor
    for version in (now, minor, major, store.last()):
        assert {r.id: r.company_name for r in store.read(version, "leads").collect()} == want
        parts = [store.read(version, "leads", [b]) for b in range(4)]
        assert sum(p.count() for p in parts) == len(want)
    plan = store.read(now, "leads", [2])._jdf.queryExecution().toString()
    assert "PartitionFilters" in plan and "bucket" in plan
    old = Store(spark, root).version(2)
    assert store.read(old, "leads").where("id = 1").first().company_name == "b2-1"


def test_unfinished_commits_and_second_writers(spark, tmp_path, empty_tables):
    """Files without a commit are not read; of two writers from one version the later one fails; nothing is lost."""
    store = Store(spark, str(tmp_path / "s"))
    now = store.create(empty_tables, lead_keys(empty_tables.leads).select("key", "id"), 2)
    store.write("leads", leads(spark, [7], "x"), now)
    assert store.tables().leads.count() == 0
    done = store.append(now, {"leads": leads(spark, [8], "x")}, "q 0")
    with pytest.raises(RuntimeError, match="there already"):
        store.append(now, {"leads": leads(spark, [9], "x")}, "r 0")
    assert [r.id for r in store.tables().leads.collect()] == [8] and store.last() == done


def test_stream_updates_stored_leads(spark, tmp_path, empty_tables):
    root, inbox = str(tmp_path / "tables"), str(tmp_path / "in")
    write_tables(empty_tables, f"{root}/v0")

    def step(rows, state="state"):
        spark.createDataFrame(rows, RAW).coalesce(1).write.mode("append").parquet(inbox)
        raw = spark.readStream.schema(RAW).parquet(inbox)
        stream_intake(raw, root).option("checkpointLocation", str(tmp_path / state)).trigger(availableNow=True).start().awaitTermination()

    step([(1, "website", None, "Acme\nhttps://acme.com", None, T0)])
    step([(2, "website", None, "Acme\nhttps://acme.org", None, T0 + timedelta(1))])
    last = read_stored(spark, root)
    assert [(r.id, r.domain) for r in last.leads.collect()] == [(1, "acme.org")]
    assert last.raw_sources.count() == 2
    with pytest.raises(Exception, match="was made by"):  # a lost checkpoint is no reason to pass input over
        step([(3, "website", None, "Late\nhttps://late.org", None, T0)], "other")
    assert read_stored(spark, root).raw_sources.filter(F.col("lead_id") == 1).count() == 2
