"""Proposals are applied once; illegal steps are found; streams agree with batch."""

import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from contactmill.operators import audit
from contactmill.sources.tables import LEADS, struct_of
from contactmill.streaming import commands

T0 = datetime(2024, 1, 1)


def log(spark, rows):
    return spark.createDataFrame(
        [(i, tool, "awaiting_approval", True, at, json.dumps({"proposal": p}) if p is not None else None, T0) for i, tool, at, p in rows],
        "id string, tool_name string, status string, requires_approval boolean, approved_at timestamp, result_summary_json string, created_at timestamp",
    )


@pytest.fixture
def leads(spark):
    schema = struct_of(LEADS)
    row = {"id": 1, "company_name": "A", "website": "https://old.com", "domain": "old.com", "company_email": "o@old.com", "company_phone": "1", "fit_score": 7}
    return spark.createDataFrame([tuple(row.get(f.name) for f in schema)], schema)


def test_updates_once_and_only_their_field(spark, leads):
    entries = log(spark, [
        ("a", "propose_contact_update", T0, {"lead_id": 1, "field": "company_email", "value": " n@new.com "}),
        ("b", "propose_contact_update", T0 + timedelta(1), {"lead_id": 1, "field": "website", "value": "https://www.new.com/x"}),
        ("c", "propose_contact_update", None, {"lead_id": 1, "field": "company_phone", "value": "2"}),
        ("d", "propose_contact_update", T0, {"lead_id": 9, "field": "company_phone", "value": "2"}),
        ("e", "propose_contact_update", T0, {"lead_id": 1, "field": "status", "value": "x"}),
    ])
    updated, errors = audit.apply_contact_updates(leads, entries)
    row = updated.first()
    assert (row.company_email, row.website, row.domain, row.company_phone, row.fit_score) == ("n@new.com", "https://www.new.com/x", "new.com", "1", 7)
    assert [(e.command_id, e.error_code) for e in errors.collect()] == [("d", "lead_not_found")]
    again, _ = audit.apply_contact_updates(updated, entries)
    assert again.first() == row
    done = spark.createDataFrame([("a",), ("b",)], "command_id string")
    kept, _ = audit.apply_contact_updates(leads, entries, done)
    assert kept.first().company_email == "o@old.com"


def test_followups_once(spark, leads):
    entries = log(spark, [("a", "propose_create_followup", T0, {"lead_id": 1, "title": "Call"})])
    entries = entries.unionByName(entries)
    assert audit.apply_followups(leads, entries).count() == 1
    assert audit.apply_followups(leads, entries, spark.createDataFrame([("a",)], "command_id string")).count() == 0


def test_proposal_errors(spark):
    rows = [("a", "other", T0, {}), ("b", "propose_create_followup", T0, None), ("c", "propose_create_followup", T0, "x"),
            ("d", "propose_create_followup", T0, {"action": "z"}), ("e", "propose_create_followup", T0, {"lead_id": "1", "title": "T"}),
            ("f", "propose_contact_update", T0, {"lead_id": 1, "field": "company_email", "value": " "})]
    got = {r.id: r.proposal_error for r in audit.validate_proposals(log(spark, rows)).collect()}
    assert got == {"a": "unsupported_tool", "b": "no_stored_proposal", "c": "malformed_proposal", "d": "invalid_action",
                   "e": "missing_lead_or_title", "f": "missing_value"}


def test_steps_over_day_borders(spark):
    path = ["received", "planned", "executing", "awaiting_approval", "executing", "succeeded", "planned"]
    rows = [(1, i, T0 + timedelta(hours=9 * i), s) for i, s in enumerate(path)] + [(2, 50, T0, "executing")]
    events = spark.createDataFrame(rows, "command_id long, event_id long, ts timestamp, status string")
    bad = {(r.command_id, r.previous, r.status) for r in audit.illegal_transitions(events).collect()}
    assert bad == {(1, "succeeded", "planned"), (2, None, "executing")}
    assert {r.command_id: r.status for r in audit.current_command_state(events).collect()} == {1: "planned", 2: "executing"}


def test_stream_keeps_state_between_batches(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass",
                   "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    schema = "command_id long, event_id long, ts timestamp, status string"
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))

    def step(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        events = commands.read_event_stream(spark, source, struct_of(schema))
        commands.stream_command_state(events).writeStream.format("parquet").option("path", out).option(
            "checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()

    step([(1, 1, T0, "received"), (1, 2, T0 + timedelta(seconds=1), "planned")])
    step([(1, 3, T0 + timedelta(seconds=2), "succeeded"), (1, 4, T0 + timedelta(seconds=3), "failed")])
    got = [(r.event_id, r.previous, r.legal) for r in spark.read.parquet(out).orderBy("event_id").collect()]
    assert got == [(1, None, True), (2, "received", True), (3, "planned", False), (4, "succeeded", False)]


def test_ordered_stream(spark, tmp_path):
    """Steps that come in any order over many micro-batches are judged as in batch; the state of finished commands goes, and late steps are counted."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass",
                   "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    schema = "command_id long, event_id long, ts timestamp, status string"
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    path = ["received", "planned", "executing", "awaiting_approval", "executing", "succeeded", "planned"]
    steps = [(c, c * 10 + i, T0 + timedelta(hours=i), s) for c in range(4) for i, s in enumerate(path[: 7 - c])] + [(9, 90, T0, "executing"), (9, 91, T0, "failed")]
    last = {}

    def step(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        events = commands.read_event_stream(spark, source, spark.createDataFrame([], schema).schema)
        run = commands.stream_ordered_command_state(events, "2 days", 3).writeStream.format("parquet").option("path", out).option(
            "checkpointLocation", state).trigger(availableNow=True).start()
        run.awaitTermination()
        last["late"] = sum(op["numRowsDroppedByWatermark"] for p in run.recentProgress for op in p["stateOperators"])

    def kept(name):
        return spark.read.format("statestore").option("path", state).option("stateVarName", name).load().count()

    shuffled = sorted(steps, key=lambda s: hash((s[1], 7)) % 101)
    for n in range(3):
        step(shuffled[n::3])
    step([(-1, -1, T0 + timedelta(days=3), "received")])
    got = {tuple(r) for r in spark.read.parquet(out).where("command_id >= 0").select("event_id", "previous", "legal").collect()}
    events = spark.createDataFrame(steps, schema)
    bad = {(r.event_id, r.previous) for r in audit.illegal_transitions(events).collect()}
    assert len(got) == len(steps) and {(i, p) for i, p, legal in got if not legal} == bad and bad
    assert kept("last") == 5
    step([(-1, -2, T0 + timedelta(days=9), "planned"), (0, 99, T0, "planned")])
    # Commands 1 and 9 have ended and are forgotten; 0, 2, 3 and -1 can still move. The step of nine days before is late.
    assert kept("last") == 4 and last["late"] == 1
    assert spark.read.parquet(out).where("event_id = 99").count() == 0
