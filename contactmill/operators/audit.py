"""The command log: states, proposals, and approved changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from contactmill import vocab
from contactmill.functions.text import extract_domain, strip


# --- states ------------------------------------------------------------------
def current_command_state(events: DataFrame) -> DataFrame:
    """Latest status per command from ``command_id, status, ts, event_id`` rows."""
    last = F.max(F.struct("ts", "event_id", "status")).alias("_last")
    return events.groupBy("command_id").agg(last).select(
        "command_id", F.col("_last.status").alias("status"), F.col("_last.ts").alias("ts")
    )


def is_legal_step(before: Column, after: Column) -> Column:
    """True when the status map allows the step; unknown states allow none."""
    test = F.lit(False)
    for state, allowed in vocab.ALLOWED_TRANSITIONS.items():
        if allowed:
            test = test | ((before == state) & after.isin(*allowed))
    return F.coalesce(test, F.lit(False))


def status_steps(events: DataFrame, bucket: str = "day") -> DataFrame:
    """Each event with the status before it.

    A command may own any number of events, so the previous status is looked
    up inside a (command, time bucket) window; only the first event of a
    bucket takes it from the last event of the bucket before, via one row per
    bucket.
    """
    rows = events.withColumn("_bucket", F.date_trunc(bucket, "ts"))
    inside = Window.partitionBy("command_id", "_bucket").orderBy("ts", "event_id")
    rows = rows.withColumn("_inside", F.lag("status").over(inside))
    ends = rows.groupBy(F.col("command_id").alias("_c"), F.col("_bucket").alias("_b")).agg(
        F.max(F.struct("ts", "event_id", "status"))["status"].alias("_end")
    )
    carry = ends.select(
        "_c", "_b", F.lag("_end").over(Window.partitionBy("_c").orderBy("_b")).alias("_carry")
    )
    joined = rows.join(
        carry, (F.col("command_id") == F.col("_c")) & (F.col("_bucket") == F.col("_b")), "left"
    )
    return joined.withColumn("previous", F.coalesce("_inside", "_carry")).drop(
        "_bucket", "_inside", "_c", "_b", "_carry"
    )


def illegal_transitions(events: DataFrame) -> DataFrame:
    """Steps outside the status map; a command must begin as ``received``."""
    steps = status_steps(events)
    first_ok = F.col("previous").isNull() & (F.col("status") == "received")
    return steps.filter(~(first_ok | is_legal_step(F.col("previous"), F.col("status"))))


# --- proposals -----------------------------------------------------------------


def with_proposal(log: DataFrame) -> DataFrame:
    """The stored proposal of each command, typed, with its JSON kinds checked."""
    doc = F.try_parse_json("result_summary_json")
    item = F.try_variant_get(doc, "$.proposal", "variant")
    return log.withColumns(
        {
            "_has_summary": F.coalesce(F.schema_of_variant(doc), F.lit("VOID")).startswith("OBJECT<")
            & (F.coalesce(F.trim("result_summary_json"), F.lit("")) != "{}"),
            "_is_object": F.coalesce(F.schema_of_variant(item), F.lit("VOID")).startswith("OBJECT"),
            "action": F.try_variant_get(item, "$.action", "string"),
            "_lead_kind": F.schema_of_variant(F.try_variant_get(item, "$.lead_id", "variant")),
            "lead_id": F.try_variant_get(item, "$.lead_id", "long"),
            "_title_kind": F.schema_of_variant(F.try_variant_get(item, "$.title", "variant")),
            "title": F.try_variant_get(item, "$.title", "string"),
            "due_date": F.try_variant_get(item, "$.due_date", "string"),
            "priority": F.try_variant_get(item, "$.priority", "string"),
            "field": F.try_variant_get(item, "$.field", "string"),
            "_value_kind": F.schema_of_variant(F.try_variant_get(item, "$.value", "variant")),
            "value": F.try_variant_get(item, "$.value", "string"),
            "summary": F.try_variant_get(doc, "$.proposal_preview.summary", "string"),
        }
    )


def _drop_checks(df: DataFrame) -> DataFrame:
    return df.drop("_has_summary", "_is_object", "_lead_kind", "_title_kind", "_value_kind")


def validate_proposals(log: DataFrame) -> DataFrame:
    """The log with typed proposal fields and the first broken rule in ``proposal_error``."""
    tool = F.coalesce("tool_name", F.lit(""))
    follow, update = vocab.PROPOSAL_ACTIONS
    expected = F.when(tool == follow, vocab.PROPOSAL_ACTIONS[follow]).when(
        tool == update, vocab.PROPOSAL_ACTIONS[update]
    )
    whole = F.coalesce(F.col("_lead_kind").isin("BIGINT", "BOOLEAN"), F.lit(False))

    def is_text(kind: str, c: str) -> Column:
        return F.coalesce((F.col(kind) == "STRING") & (strip(F.col(c)) != ""), F.lit(False))

    error = (
        F.when(expected.isNull(), "unsupported_tool")
        .when(~F.col("_has_summary"), "no_stored_proposal")
        .when(~F.col("_is_object"), "malformed_proposal")
        .when(F.col("action").isNotNull() & (F.col("action") != expected), "invalid_action")
        .when((tool == follow) & ~(whole & is_text("_title_kind", "title")), "missing_lead_or_title")
        .when((tool == update) & ~whole, "missing_lead")
        .when(
            (tool == update)
            & ~F.coalesce(F.col("field").isin(*vocab.CONTACT_UPDATE_FIELDS), F.lit(False)),
            "invalid_field",
        )
        .when((tool == update) & ~is_text("_value_kind", "value"), "missing_value")
    )
    return _drop_checks(with_proposal(log).withColumn("proposal_error", error))


def pending_proposals(log: DataFrame) -> DataFrame:
    """Commands waiting for approval with a proposal object, newest first."""
    waiting = log.filter(
        (F.col("status") == "awaiting_approval")
        & F.col("requires_approval")
        & F.col("tool_name").isin(*vocab.PROPOSAL_ACTIONS)
    )
    return _drop_checks(with_proposal(waiting).filter("_is_object")).orderBy(
        F.desc_nulls_last("created_at"), "id"
    )


def preview_contact_update(changes: DataFrame, leads: DataFrame) -> DataFrame:
    """Each asked-for change with the stored value, or an error; nothing is written."""
    held = leads.select(
        F.col("id").alias("_lead"), "company_name",
        *[F.col(f).alias(f"_{f}") for f in vocab.CONTACT_UPDATE_FIELDS],
    )
    previous = F.coalesce(
        *[F.when(F.col("field") == f, F.col(f"_{f}")) for f in vocab.CONTACT_UPDATE_FIELDS]
    )
    error = (
        F.when(~F.coalesce(F.col("field").isin(*vocab.CONTACT_UPDATE_FIELDS), F.lit(False)), "invalid_field")
        .when(strip(F.coalesce("value", F.lit(""))) == "", "missing_value")
        .when(F.col("_lead").isNull(), "lead_not_found")
    )
    joined = changes.join(held, F.col("lead_id") == F.col("_lead"), "left")
    return joined.select(
        *changes.columns[: len(changes.columns)],
        "company_name",
        previous.alias("previous_value"),
        strip(F.col("value")).alias("new_value"),
        error.alias("error_code"),
    )


def approved_once(checked: DataFrame, applied: DataFrame | None = None) -> DataFrame:
    """Valid, approved commands that wait to be applied, each command id once."""
    ready = checked.filter(
        (F.col("status") == "awaiting_approval")
        & F.col("requires_approval")
        & F.col("approved_at").isNotNull()
        & F.col("proposal_error").isNull()
    ).dropDuplicates(["id"])
    if applied is None:
        return ready
    done = applied.select(F.col("command_id").alias("_done"))
    return ready.join(done, F.col("id") == F.col("_done"), "left_anti")


def apply_contact_updates(
    leads: DataFrame, log: DataFrame, applied: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """Leads after the approved field changes, and the commands that failed.

    The last approved change per lead and field wins; a new site also resets
    the domain. Applying the same log again changes nothing.
    """
    ready = approved_once(validate_proposals(log), applied).filter(
        F.col("tool_name") == "propose_contact_update"
    )
    order = F.struct("approved_at", "id")
    changes = ready.groupBy(F.col("lead_id").alias("_lead")).agg(
        *[
            F.max_by(strip(F.col("value")), F.when(F.col("field") == f, order)).alias(f"_{f}")
            for f in vocab.CONTACT_UPDATE_FIELDS
        ],
        F.max("approved_at").alias("_at"),
    )
    joined = leads.join(changes, F.col("id") == F.col("_lead"), "left")
    fields = {f: F.coalesce(f"_{f}", f) for f in vocab.CONTACT_UPDATE_FIELDS}
    fields["domain"] = F.when(
        F.col("_website").isNotNull(), extract_domain(F.col("_website"))
    ).otherwise(F.col("domain"))
    fields["updated_at"] = F.coalesce("_at", "updated_at")
    updated = joined.select(*[fields.get(c, F.col(c)).alias(c) for c in leads.columns])
    keys = leads.select(F.col("id").alias("_known"))
    errors = ready.join(keys, F.col("lead_id") == F.col("_known"), "left_anti").select(
        F.col("id").alias("command_id"), "lead_id", F.lit("lead_not_found").alias("error_code")
    )
    return updated, errors


def log_after_apply(leads: DataFrame, log: DataFrame, applied: DataFrame | None = None) -> DataFrame:
    """The command log once its approved changes are applied: ``succeeded``, or ``failed`` with an error code.

    Commands that were not ready stay as they are. Kept as the log of the next run, it
    keeps an old change from being applied again over newer values.
    """
    ready = approved_once(validate_proposals(log), applied).filter(
        F.col("tool_name").isin("propose_contact_update", "propose_create_followup")
    )
    keys = leads.select(F.col("id").alias("_known"))
    outcome = ready.join(keys, F.col("lead_id") == F.col("_known"), "left").select(
        F.col("id").alias("_done"), F.col("_known").isNotNull().alias("_found"), F.col("approved_at").alias("_at")
    )
    changed = {
        "status": F.when(F.col("_found"), "succeeded").when(~F.col("_found"), "failed").otherwise(F.col("status")),
        "error_code": F.when(~F.col("_found"), "lead_not_found").otherwise(F.col("error_code")),
        "updated_at": F.coalesce("_at", "updated_at"),
    }
    joined = log.join(outcome, F.col("id") == F.col("_done"), "left")
    return joined.select(*[changed.get(c, F.col(c)).alias(c) for c in log.columns])


def proposal_apply_join(leads: DataFrame, changes: DataFrame) -> DataFrame:
    """Leads left-joined with at most one change row each; new values win."""
    renamed = changes.select(
        F.col("lead_id").alias("_lead"),
        *[F.col(f).alias(f"_{f}") for f in vocab.CONTACT_UPDATE_FIELDS],
    )
    joined = leads.join(renamed, F.col("id") == F.col("_lead"), "left")
    fields = {f: F.coalesce(f"_{f}", f) for f in vocab.CONTACT_UPDATE_FIELDS}
    return joined.select(*[fields.get(c, F.col(c)).alias(c) for c in leads.columns])


def apply_followups(
    leads: DataFrame, log: DataFrame, applied: DataFrame | None = None
) -> DataFrame:
    """Open tasks from approved follow-ups, once per command; the lead must exist."""
    ready = approved_once(validate_proposals(log), applied).filter(
        F.col("tool_name") == "propose_create_followup"
    )
    keys = leads.select(F.col("id").alias("_known"))
    return ready.join(keys, F.col("lead_id") == F.col("_known"), "left_semi").select(
        F.col("id").alias("command_id"),
        "lead_id",
        "title",
        "due_date",
        "priority",
        F.lit("open").alias("status"),
        F.col("approved_at").alias("created_at"),
    )
