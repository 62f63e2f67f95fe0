"""Intake validation and model quality rules."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contactmill import vocab
from contactmill.functions.text import strip
from contactmill.sources.tables import Tables


def validate_intake(
    raw: DataFrame, leads: DataFrame, max_chars: int = vocab.MAX_PASTE_CHARS
) -> DataFrame:
    """Each row with the first rule it breaks in ``error_code`` (NULL = valid).

    ``attach_to_lead_id`` is text as typed by a user.
    """
    attach = strip(F.coalesce("attach_to_lead_id", F.lit("")))
    text = strip(F.coalesce("raw_text", F.lit("")))
    url = strip(F.coalesce("source_url", F.lit("")))
    code = (
        F.when(~F.coalesce(strip(F.col("source_type")), F.lit("")).isin(*vocab.SOURCE_TYPES), "invalid_source_type")
        .when(text == "", "empty_raw_text")
        .when(F.length(text) > max_chars, "raw_text_too_long")
        .when((url != "") & ~url.rlike(r"^(?i:https?)://[^/?#]+"), "invalid_source_url")
        .when((attach != "") & ~attach.rlike(r"^\p{Nd}+$"), "invalid_attach_lead_id")
    )
    checked = raw.withColumn("error_code", code)
    # Only rows that name a lead and passed so far need the look-up; the others are not shuffled.
    asks = F.col("error_code").isNull() & (attach != "")
    keys = leads.select(F.col("id").alias("_lead"))
    asked = checked.filter(asks).join(keys, attach.try_cast("long") == F.col("_lead"), "left")
    found = asked.withColumn(
        "error_code", F.when(F.col("_lead").isNull(), "lead_not_found")
    ).drop("_lead")
    return checked.filter(~asks).unionByName(found)


def split_intake(checked: DataFrame) -> tuple[DataFrame, DataFrame]:
    bad = F.col("error_code").isNotNull()
    return checked.filter(~bad), checked.filter(bad)


def contact_field_whitelist(changes: DataFrame) -> DataFrame:
    return changes.filter(F.col("field").isin(*vocab.CONTACT_UPDATE_FIELDS))


def _broken(df: DataFrame, rule: str, key: Column, test: Column) -> DataFrame:
    return df.filter(test).select(F.lit(rule).alias("rule"), key.cast("string").alias("key"))


def contact_method_checks(methods: DataFrame) -> DataFrame:
    """``rule, key`` of contact methods that break the model's rules."""
    owner = F.coalesce("organization_id", "person_id")
    rows = [
        _broken(
            methods, "single_owner", F.col("id"),
            F.col("organization_id").isNull() == F.col("person_id").isNull(),
        ),
        _broken(
            methods, "confidence_range", F.col("id"),
            ~F.coalesce(F.col("confidence").between(0.0, 1.0), F.lit(False)),
        ),
        _broken(
            methods, "verified_at_without_verified", F.col("id"),
            F.col("verified_at").isNotNull() & (F.col("verification_status") != "verified"),
        ),
    ]
    primaries = methods.filter("is_primary").groupBy(owner.alias("owner"), "kind").agg(
        F.count("*").alias("n")
    )
    rows.append(
        _broken(primaries, "one_primary", F.concat_ws("|", "owner", "kind"), F.col("n") > 1)
    )
    return reduce(lambda a, b: a.unionByName(b), rows)


def unique_key_check(df: DataFrame, rule: str, key: str) -> DataFrame:
    counted = df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n"))
    return _broken(counted, rule, F.col(key), F.col("n") > 1)


def orphan_check(child: DataFrame, rule: str, key: str, parent: DataFrame) -> DataFrame:
    """Child rows whose reference names no parent; a NULL reference is allowed."""
    parents = parent.select(F.col("id").alias("_parent"))
    lost = child.filter(F.col(key).isNotNull()).join(
        parents, F.col(key) == F.col("_parent"), "left_anti"
    )
    return lost.select(F.lit(rule).alias("rule"), F.col("id").cast("string").alias("key"))


def model_quality_checks(t: Tables, methods: DataFrame | None = None) -> DataFrame:
    """All violations as ``rule, key`` rows."""
    rows = [
        orphan_check(t.people, "people.lead_id", "lead_id", t.leads),
        orphan_check(t.raw_sources, "raw_sources.lead_id", "lead_id", t.leads),
        orphan_check(t.interactions, "interactions.lead_id", "lead_id", t.leads),
        orphan_check(t.tasks, "tasks.lead_id", "lead_id", t.leads),
        unique_key_check(t.leads, "leads.id", "id"),
        unique_key_check(t.people, "people.id", "id"),
    ]
    if methods is not None:
        rows.append(contact_method_checks(methods))
    return reduce(lambda a, b: a.unionByName(b), rows)


def duplicate_intake(raw: DataFrame) -> DataFrame:
    """Equal text counts as the same intake: one row per hash seen more than once."""
    from contactmill.functions.text import content_hash

    return (
        raw.select("id", content_hash(F.col("raw_text")).alias("content_hash"))
        .groupBy("content_hash")
        .agg(F.count("*").alias("copies"), F.min("id").alias("first_id"))
        .filter(F.col("copies") > 1)
    )
