"""Wide leads to the normalised contact model and back, with a reconciliation report."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contactmill.functions.text import (
    blank_to_null,
    content_hash,
    normalize_email,
    normalize_linkedin_url,
    normalize_name,
    parse_deadline,
    strip,
)
from contactmill.operators.numbering import stable_uuid
from contactmill.sources.tables import Tables

METADATA = (
    "partner_tier", "plus_partner_signal", "rating", "review_count", "partner_since",
    "primary_location", "supported_locations", "languages", "featured_work", "services",
    "locations", "industries", "confidence", "extraction_status", "possible_duplicate",
)


@dataclass(frozen=True)
class Normalised:
    organizations: DataFrame
    people: DataFrame
    contact_methods: DataFrame
    sources: DataFrame
    extractions: DataFrame
    interactions: DataFrame
    tasks: DataFrame


def organization_id(lead: Column) -> Column:
    return F.when(lead.isNotNull(), stable_uuid("organization", lead))


def person_id(person: Column) -> Column:
    return F.when(person.isNotNull(), stable_uuid("person", person))


def _new_leads(leads: DataFrame, existing: DataFrame | None) -> DataFrame:
    fresh = leads.filter(F.col("id").isNotNull())
    if existing is None:
        return fresh
    known = existing.select(F.col("legacy_lead_id").alias("_known"))
    return fresh.join(known, F.col("id") == F.col("_known"), "left_anti")


def to_organizations(leads: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """Organizations of leads that the target does not hold yet."""
    return _new_leads(leads, existing).select(
        organization_id(F.col("id")).alias("id"),
        F.col("id").alias("legacy_lead_id"),
        F.col("company_name").alias("name"),
        "normalized_name",
        "website",
        F.col("domain").alias("normalized_domain"),
        "description",
        F.coalesce(blank_to_null(F.col("status")), F.lit("new")).alias("status"),
        F.coalesce("fit_score", F.lit(0)).alias("relevance_score"),
        F.struct(*METADATA).alias("metadata"),
        "created_at",
        "updated_at",
    )


def _with_org(df: DataFrame, leads: DataFrame) -> DataFrame:
    keys = leads.select(F.col("id").alias("_org_lead"))
    return df.join(keys, F.col("lead_id") == F.col("_org_lead")).drop("_org_lead")


def _without_org(df: DataFrame, leads: DataFrame) -> DataFrame:
    keys = leads.select(F.col("id").alias("_org_lead"))
    return df.join(keys, F.col("lead_id") == F.col("_org_lead"), "left_anti")


def to_people(people: DataFrame, leads: DataFrame) -> DataFrame:
    return _with_org(people, leads).select(
        person_id(F.col("id")).alias("id"),
        organization_id(F.col("lead_id")).alias("organization_id"),
        "name",
        normalize_name(F.col("name")).alias("normalized_name"),
        "title",
        F.coalesce("is_decision_maker", F.lit(False)).alias("is_decision_maker"),
        "relevance_reason",
        F.struct(
            F.col("id").alias("legacy_person_id"), "department", "seniority",
            "is_relevant_contact", "confidence", "raw_source_id",
        ).alias("metadata"),
        "created_at",
    )


def _methods(df: DataFrame, owner: str, values: list[tuple[str, str, Column]]) -> DataFrame:
    """One row per filled-in contact column."""
    items = F.array(*[
        F.struct(
            F.lit(kind).alias("kind"), F.col(c).alias("value"), normal.alias("normalized_value")
        )
        for kind, c, normal in values
    ])
    other = "person_id" if owner == "organization_id" else "organization_id"
    filled = F.filter(items, lambda m: F.coalesce(m["value"], F.lit("")) != "")
    return df.select(F.col("_owner"), F.inline(filled)).select(
        stable_uuid("method", F.col("_owner"), F.col("kind")).alias("id"),
        F.col("_owner").alias(owner),
        F.lit(None).cast("string").alias(other),
        "kind",
        "value",
        "normalized_value",
        F.lit(0.0).alias("confidence"),
        F.lit("unverified").alias("verification_status"),
        F.lit(False).alias("is_primary"),
        F.lit(None).cast("timestamp").alias("verified_at"),
    )


def to_contact_methods(
    leads: DataFrame, people: DataFrame, existing: DataFrame | None = None
) -> DataFrame:
    orgs = _new_leads(leads, existing).withColumn("_owner", organization_id(F.col("id")))
    persons = _with_org(people, leads).withColumn("_owner", person_id(F.col("id")))
    return _methods(
        orgs, "organization_id",
        [
            ("email", "company_email", normalize_email(F.col("company_email"))),
            ("phone", "company_phone", strip(F.col("company_phone"))),
        ],
    ).unionByName(
        _methods(
            persons, "person_id",
            [
                ("email", "email", normalize_email(F.col("email"))),
                ("linkedin", "linkedin_url", normalize_linkedin_url(F.col("linkedin_url"))),
            ],
        )
    )


def _filled_sources(raw: DataFrame) -> DataFrame:
    return raw.filter(strip(F.coalesce("raw_text", F.lit(""))) != "")


def _new_sources(raw: DataFrame, existing: DataFrame | None) -> DataFrame:
    if existing is None:
        return _filled_sources(raw)
    known = existing.select(F.col("legacy_source_id").alias("_known"))
    return _filled_sources(raw).join(known, F.col("id") == F.col("_known"), "left_anti")


def to_sources(raw: DataFrame, leads: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """Sources with their hash; a source may stay without an organization."""
    keys = leads.select(F.col("id").alias("_org_lead"))
    # Unlinked sources get distinct keys that match nothing instead of one NULL key.
    owner = F.coalesce("lead_id", -F.col("id") - 1)
    linked = _new_sources(raw, existing).join(keys, owner == F.col("_org_lead"), "left")
    return linked.select(
        stable_uuid("source", F.col("id")).alias("id"),
        organization_id(F.col("_org_lead")).alias("organization_id"),
        F.coalesce(blank_to_null(F.col("source_type")), F.lit("note")).alias("source_type"),
        "source_url",
        "raw_text",
        content_hash(F.col("raw_text")).alias("content_hash"),
        F.col("id").alias("legacy_source_id"),
        F.struct("lead_id", "source_filter_tier", "extraction_status", "confidence").alias("metadata"),
        F.col("created_at").alias("captured_at"),
    )


def to_extractions(raw: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    outcome = F.coalesce(blank_to_null(F.col("extraction_status")), F.lit("ok"))
    approved = outcome.isin("ok", "fallback")
    return _new_sources(raw, existing).select(
        stable_uuid("extraction", F.col("id")).alias("id"),
        stable_uuid("source", F.col("id")).alias("source_id"),
        F.col("id").alias("legacy_source_id"),
        F.when(approved, "approved").otherwise("proposed").alias("status"),
        F.coalesce("confidence", F.lit(0.0)).alias("confidence"),
        F.col("parsed_json").alias("structured_output"),
        F.when(approved, F.col("created_at")).alias("approved_at"),
    )


def to_interactions(interactions: DataFrame, leads: DataFrame) -> DataFrame:
    return _with_org(interactions, leads).select(
        stable_uuid("interaction", F.col("id")).alias("id"),
        organization_id(F.col("lead_id")).alias("organization_id"),
        F.col("type").alias("kind"),
        "summary",
        F.coalesce("reply_needed", F.lit(False)).alias("requires_followup"),
        F.col("id").alias("legacy_interaction_id"),
        F.struct(
            "subject", "body", "deadline", "priority", "next_action", "status", "raw_source_id",
            "person_id",
        ).alias("metadata"),
    )


def to_tasks(tasks: DataFrame, leads: DataFrame) -> DataFrame:
    """Tasks with a typed due time; text that is no date gives NULL and stays in the metadata."""
    return _with_org(tasks, leads).select(
        stable_uuid("task", F.col("id")).alias("id"),
        organization_id(F.col("lead_id")).alias("organization_id"),
        "title",
        "priority",
        F.coalesce(blank_to_null(F.col("status")), F.lit("open")).alias("status"),
        F.coalesce(
            F.try_to_timestamp("due_date"), parse_deadline(F.col("due_date")).cast("timestamp")
        ).alias("due_at"),
        F.col("id").alias("legacy_task_id"),
        F.struct("source_interaction_id", "person_id", F.col("due_date").alias("due_text")).alias("metadata"),
    )


def _filled(*columns: str) -> Column:
    """How many of the columns hold a contact method."""
    return reduce(lambda a, b: a + b, [(F.coalesce(c, F.lit("")) != "").cast("long") for c in columns])


def _marks(df: DataFrame, key: str, **marks: Column) -> DataFrame:
    """``key`` and the named numbers; those of ``COUNTED`` that are missing are 0."""
    zero = F.lit(0).cast("long")
    return df.select(F.col(key).alias("key"), *[marks.get(m, zero).cast("long").alias(m) for m in COUNTED])


COUNTED = ("lead", "known", "methods", "person", "person_methods", "interaction", "task", "empty")


def _report(totals: DataFrame, lines: list[tuple[str, str, str, Column]]) -> DataFrame:
    """One row per line from the single row of totals."""
    made = [F.struct(F.lit(e).alias("entity"), F.lit(o).alias("outcome"), F.lit(r).alias("reason"), F.coalesce(n, F.lit(0)).cast("long").alias("n")) for e, o, r, n in lines]
    return totals.select(F.inline(F.array(*made)))


def reconciliation_report(t: Tables, existing: Normalised | None = None) -> DataFrame:
    """``entity, outcome, reason, n``: what a conversion moves, skips or finds in conflict.

    Writes nothing, so it doubles as the dry run. Every table is read once: leads, the rows that hang on them and what the target
    holds are counted per lead and the counts added up, with partial sums before the shuffle, so a lead of very
    many rows (or none at all) is one row of it.
    """
    one = F.lit(1)
    by_lead = [
        _marks(t.leads, "id", lead=F.col("id").isNotNull(), empty=F.col("id").isNull(), methods=_filled("company_email", "company_phone")),
        _marks(t.people, "lead_id", person=one, person_methods=_filled("email", "linkedin_url")),
        _marks(t.interactions, "lead_id", interaction=one),
        _marks(t.tasks, "lead_id", task=one),
    ]
    is_empty = strip(F.coalesce("raw_text", F.lit(""))) == ""
    by_source = [_marks(t.raw_sources, "id", lead=~is_empty, empty=is_empty)]
    if existing:
        by_lead.append(_marks(existing.organizations, "legacy_lead_id", known=one))
        by_source.append(_marks(existing.sources, "legacy_source_id", known=one))

    def per_key(parts: list[DataFrame]) -> DataFrame:
        return reduce(lambda a, b: a.unionByName(b), parts).groupBy("key").agg(*[F.sum(m).alias(m) for m in COUNTED])

    found, fresh, clash = F.col("lead") > 0, (F.col("lead") > 0) & (F.col("known") == 0), (F.col("lead") > 0) & (F.col("known") > 0)

    def total(count: str, test: Column | None = None) -> Column:
        return F.sum(F.col(count) if test is None else F.when(test, F.col(count)))

    leads = per_key(by_lead).agg(
        total("lead", fresh).alias("new"), total("empty").alias("nameless"), total("lead", clash).alias("clash"),
        total("methods", fresh).alias("lead_methods"), total("person_methods", found).alias("person_methods"),
        *[total(c, found).alias(f"{c}_moved") for c in ("person", "interaction", "task")],
        *[total(c, ~found).alias(f"{c}_left") for c in ("person", "interaction", "task")],
    )
    sources = per_key(by_source).agg(total("lead", fresh).alias("new"), total("empty").alias("empty"), total("lead", clash).alias("clash"))
    c = F.col
    of_leads = [
        ("organization", "migrated", "", c("new")), ("organization", "skipped", "missing_id", c("nameless")),
        ("contact_method", "migrated", "", F.coalesce("lead_methods", F.lit(0)) + F.coalesce("person_methods", F.lit(0))),
    ]
    for entity in ("person", "interaction", "task"):
        of_leads += [(entity, "migrated", "", c(f"{entity}_moved")), (entity, "skipped", "missing_org", c(f"{entity}_left"))]
    of_sources = [("source", "migrated", "", c("new")), ("source", "skipped", "empty_text", c("empty"))]
    if existing:
        of_leads.append(("organization", "conflict", "legacy_lead_id", c("clash")))
        of_sources.append(("source", "conflict", "legacy_source_id", c("clash")))
    return _report(leads, of_leads).unionByName(_report(sources, of_sources))


def migration_skips(t: Tables) -> DataFrame:
    """``item``: every row the conversion leaves out, as ``entity:id:reason``."""
    def named(df: DataFrame, entity: str, reason: str) -> DataFrame:
        return df.select(F.concat_ws(":", F.lit(entity), F.col("id"), F.lit(reason)).alias("item"))

    parts = [
        named(_without_org(df, t.leads), entity, "missing_org")
        for entity, df in (("person", t.people), ("interaction", t.interactions), ("task", t.tasks))
    ]
    parts.append(
        named(
            t.raw_sources.filter(strip(F.coalesce("raw_text", F.lit(""))) == ""),
            "source", "empty_text",
        )
    )
    return reduce(lambda a, b: a.unionByName(b), parts)


def convert(t: Tables, existing: Normalised | None = None) -> tuple[Normalised, DataFrame]:
    orgs = existing.organizations if existing else None
    sources = existing.sources if existing else None
    made = Normalised(
        organizations=to_organizations(t.leads, orgs),
        people=to_people(t.people, t.leads),
        contact_methods=to_contact_methods(t.leads, t.people, orgs),
        sources=to_sources(t.raw_sources, t.leads, sources),
        extractions=to_extractions(t.raw_sources, sources),
        interactions=to_interactions(t.interactions, t.leads),
        tasks=to_tasks(t.tasks, t.leads),
    )
    return made, reconciliation_report(t, existing)


def first_methods(methods: DataFrame, owner: str, kinds: list[str]) -> DataFrame:
    """One row per owner with its first value of each listed kind."""
    return (
        methods.filter(F.col(owner).isNotNull() & F.col("kind").isin(*kinds))
        .groupBy(F.col(owner).alias("_owner"))
        .pivot("kind", kinds)
        .agg(F.min_by("value", "id"))
    )


def org_to_lead_view(n: Normalised) -> DataFrame:
    """The wide lead rows read back from the normalised model."""
    contact = first_methods(n.contact_methods, "organization_id", ["email", "phone"])
    meta = F.col("metadata")
    none = F.array().cast("array<string>")
    lists = {c: F.coalesce(meta[c], none) for c in ("supported_locations", "languages", "services", "industries")}
    return n.organizations.join(contact, F.col("id") == F.col("_owner"), "left").select(
        F.col("legacy_lead_id").alias("id"),
        F.col("name").alias("company_name"),
        "normalized_name",
        "website",
        F.col("normalized_domain").alias("domain"),
        F.col("email").alias("company_email"),
        F.col("phone").alias("company_phone"),
        *[meta[c].alias(c) for c in ("partner_tier", "rating", "review_count", "partner_since", "primary_location")],
        F.coalesce(meta["plus_partner_signal"], F.lit(False)).alias("plus_partner_signal"),
        *[v.alias(c) for c, v in lists.items()],
        F.when(F.size(meta["locations"]) > 0, meta["locations"])
        .otherwise(lists["supported_locations"]).alias("locations"),
        F.coalesce(meta["featured_work"], F.array().cast("array<struct<title:string,url:string>>")).alias("featured_work"),
        "description",
        F.col("relevance_score").alias("fit_score"),
        "status",
        F.coalesce(meta["confidence"], F.lit(0.0)).alias("confidence"),
        F.coalesce(meta["extraction_status"], F.lit("ok")).alias("extraction_status"),
        F.coalesce(meta["possible_duplicate"], F.lit(False)).alias("possible_duplicate"),
        "created_at",
        "updated_at",
    )


def list_unverified_contact_methods(
    methods: DataFrame, kind: str | None = None, status: str = "unverified",
    sources: DataFrame | None = None, source_type: str | None = None, captured_before: str | None = None,
) -> DataFrame:
    """Contact methods with a verification status, ``unverified`` by default.

    ``kind`` keeps one kind. With ``sources`` (normalised), ``source_type`` and
    ``captured_before`` (a timestamp) keep methods whose organization has a source of that type, captured before
    that time; methods of persons have no organization of their own and do not pass these two.
    """
    rows = methods.filter(F.col("verification_status") == status)
    if kind:
        rows = rows.filter(F.col("kind") == kind)
    if source_type or captured_before:
        if sources is None:
            raise ValueError("source_type and captured_before need sources")
        seen = sources
        if source_type:
            seen = seen.filter(F.col("source_type") == source_type)
        if captured_before:
            seen = seen.filter(F.col("captured_at") < F.lit(captured_before).cast("timestamp"))
        rows = rows.join(seen.select("organization_id"), "organization_id", "left_semi")
    return rows
