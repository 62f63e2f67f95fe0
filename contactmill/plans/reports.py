"""The fixed reports over leads, people, interactions, tasks and raw sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from contactmill.functions.limits import WHOLE, ExtractionLimits, shortened
from contactmill import vocab
from contactmill.functions.text import has_text
from contactmill.operators.linkage import HOT_KEYS, LEAST_HOT
from contactmill.sources.tables import Tables


def is_active() -> Column:
    """Open pipeline. A NULL status is dropped, as in SQL's three-valued logic."""
    return ~F.col("status").isin(*vocab.INACTIVE_STATUSES)


def is_active_or_unset() -> Column:
    return F.col("status").isNull() | is_active()


def leads_simple(leads: DataFrame) -> DataFrame:
    return leads.select("id", "company_name").orderBy(F.asc_nulls_first("company_name"), "id")


def active_leads(leads: DataFrame) -> DataFrame:
    return leads.filter(is_active())


def count_potential_clients(leads: DataFrame) -> DataFrame:
    return leads.filter(is_active()).agg(F.count("*").alias("potential_clients"))


# --- per-lead roll-up of the child tables ----------------------------------
def people_rollup(people: DataFrame) -> DataFrame:
    return people.groupBy("lead_id").agg(
        F.count("*").alias("people_count"),
        F.coalesce(F.bool_or("is_decision_maker"), F.lit(False)).alias("has_decision_maker"),
    )


def last_interaction(interactions: DataFrame) -> DataFrame:
    return interactions.groupBy("lead_id").agg(F.max("created_at").alias("last_interaction"))


def _deadline_parts(tasks: DataFrame, interactions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Narrow open rows of both tables in one shape, ready for a single group-by."""
    due = tasks.filter(F.col("status") == "open").select(
        "lead_id",
        F.lit(True).alias("is_task"),
        F.col("due_date").alias("due"),
    )
    waiting = interactions.filter(
        (F.col("status") == "open") & F.col("deadline").isNotNull()
    ).select("lead_id", F.lit(False).alias("is_task"), F.col("deadline").alias("due"))
    return due, waiting


def _next_deadline() -> Column:
    """MIN(COALESCE(due, deadline)) over open tasks x open interactions, in closed form.

    A deadline only counts next to a task without a due date, or when the
    lead has no open task at all, so the product of the two sides is not built.
    """
    first_due = F.min(F.when(F.col("is_task"), F.col("due")))
    first_wait = F.min(F.when(~F.col("is_task"), F.col("due")))
    n_tasks = F.count_if(F.col("is_task"))
    undated = F.count_if(F.col("is_task") & F.col("due").isNull())
    return F.least(first_due, F.when((n_tasks == 0) | (undated > 0), first_wait))


def next_deadline(tasks: DataFrame, interactions: DataFrame) -> DataFrame:
    due, waiting = _deadline_parts(tasks, interactions)
    return due.unionByName(waiting).groupBy("lead_id").agg(_next_deadline().alias("next_deadline"))


def child_rollup(t: Tables) -> DataFrame:
    """All per-lead figures in one group-by, so the children shuffle once.

    Each child is cut to a few narrow columns before the union, and the
    aggregates combine map-side, so a hot lead reaches its task pre-reduced.
    """
    people = t.people.select(
        "lead_id",
        F.lit(1).alias("is_person"),
        F.coalesce("is_decision_maker", F.lit(False)).alias("decides"),
    )
    talks = t.interactions.select(
        "lead_id",
        F.col("created_at").alias("talked_at"),
        F.when(
            (F.col("status") == "open") & F.col("deadline").isNotNull(), F.lit(False)
        ).alias("is_task"),
        F.when(F.col("status") == "open", F.col("deadline")).alias("due"),
    )
    tasks = t.tasks.select(
        "lead_id",
        F.lit(1).alias("any_task"),
        F.when(F.col("status") == "open", F.lit(True)).alias("is_task"),
        F.when(F.col("status") == "open", F.col("due_date")).alias("due"),
    )
    merged = people.unionByName(talks, allowMissingColumns=True).unionByName(
        tasks, allowMissingColumns=True
    )
    return merged.groupBy("lead_id").agg(
        F.count("is_person").alias("people_count"),
        F.coalesce(F.bool_or("decides"), F.lit(False)).alias("has_decision_maker"),
        F.max("talked_at").alias("last_interaction"),
        _next_deadline().alias("next_deadline"),
        F.count_if(F.col("is_task")).alias("open_tasks"),
        F.count("talked_at").alias("interaction_count"),
    )


def leads_with_rollup(t: Tables, extra: tuple[str, ...] = ()) -> DataFrame:
    roll = child_rollup(t).withColumnRenamed("lead_id", "_lead")
    zero = {"people_count": F.lit(0), "has_decision_maker": F.lit(False),
            "open_tasks": F.lit(0), "interaction_count": F.lit(0)}
    names = ("people_count", "has_decision_maker", "last_interaction", "next_deadline", *extra)
    joined = t.leads.join(roll, t.leads["id"] == F.col("_lead"), "left")
    figures = [
        (F.coalesce(roll[n], zero[n]) if n in zero else roll[n]).alias(n) for n in names
    ]
    return joined.select(*[t.leads[c] for c in t.leads.columns], *figures)


def by_rank() -> list[Column]:
    return [F.desc_nulls_last("fit_score"), F.desc_nulls_last("updated_at"), F.asc("id")]


def list_leads(t: Tables) -> DataFrame:
    """Every lead with its roll-up, best first; a distributed range sort."""
    return leads_with_rollup(t).orderBy(*by_rank())


def top_leads(t: Tables, limit: int = 10) -> DataFrame:
    """The first ``limit`` of ``list_leads``; closed leads are included.

    The ranking needs only lead columns, so the few winners are picked before
    the children are read and the child tables are cut to them.
    """
    best = t.leads.orderBy(*by_rank()).limit(limit)
    keys = F.broadcast(best.select(F.col("id").alias("lead_id")))

    def of_best(df: DataFrame) -> DataFrame:
        return df.join(keys, "lead_id", "left_semi")

    cut = t.with_(
        leads=best,
        people=of_best(t.people),
        interactions=of_best(t.interactions),
        tasks=of_best(t.tasks),
    )
    return leads_with_rollup(cut).orderBy(*by_rank())


# --- e-mail coverage --------------------------------------------------------
def people_mail_flags(people: DataFrame) -> DataFrame:
    return people.groupBy("lead_id").agg(
        F.bool_or(has_text(F.col("email"))).alias("has_person_email")
    )


def contact_summary(t: Tables) -> DataFrame:
    """Seven counts in one row. E-mail interactions are counted over all leads."""
    flags = people_mail_flags(t.people).withColumnRenamed("lead_id", "_lead")
    company_mail = has_text(F.col("company_email"))
    person_mail = F.coalesce("has_person_email", F.lit(False))
    zero = F.lit(0).cast("long")
    leads = (
        t.leads.filter(is_active())
        .select("id", "company_email")
        .join(flags, F.col("id") == F.col("_lead"), "left")
        .agg(
            F.count("*").alias("companies"),
            F.count_if(company_mail).alias("with_company_email"),
            F.count("_lead").alias("with_people"),
            F.count_if(person_mail).alias("with_person_email"),
            F.count_if(company_mail | person_mail).alias("with_any_email"),
            zero.alias("email_interactions"),
        )
    )
    talks = t.interactions.agg(
        *[zero.alias(n) for n in ("companies", "with_company_email", "with_people",
                                  "with_person_email", "with_any_email")],
        F.count_if(F.lower("type") == "email").alias("email_interactions"),
    )
    both = leads.unionByName(talks).agg(
        *[F.sum(n).alias(n) for n in leads.columns]
    )
    return both.withColumn("without_email", F.col("companies") - F.col("with_any_email"))


def people_with_lead(t: Tables) -> DataFrame:
    people = t.people.select(
        F.col("id").alias("person_id"), "lead_id", "name", "title", "email"
    )
    leads = t.leads.select(F.col("id").alias("lead_id"), "company_name", "status")
    return people.join(leads, "lead_id")


def leads_without_contacts(t: Tables) -> DataFrame:
    held = t.people.select(F.col("lead_id").alias("_lead"))
    return t.leads.join(held, F.col("id") == F.col("_lead"), "left_anti").orderBy(
        F.desc_nulls_last("fit_score"), "id"
    )


def _mailed_people(t: Tables) -> DataFrame:
    return t.people.filter(has_text(F.col("email"))).select(F.col("lead_id").alias("_lead"))


def leads_without_email(t: Tables) -> DataFrame:
    bare = t.leads.filter(is_active() & ~has_text(F.col("company_email")))
    return bare.join(_mailed_people(t), F.col("id") == F.col("_lead"), "left_anti").orderBy(
        F.desc_nulls_last("fit_score"), "id"
    )


def leads_with_any_email(t: Tables) -> DataFrame:
    flags = _mailed_people(t).distinct()
    joined = t.leads.filter(is_active()).join(flags, F.col("id") == F.col("_lead"), "left")
    return joined.filter(has_text(F.col("company_email")) | F.col("_lead").isNotNull()).drop("_lead")


def _missing_email(t: Tables, definition: str, status: str | None, min_fit: int | None) -> DataFrame:
    if definition not in vocab.MISSING_EMAIL_DEFINITIONS:
        raise ValueError(f"definition must be one of {vocab.MISSING_EMAIL_DEFINITIONS}")
    leads = t.leads.filter(~has_text(F.col("company_email")))
    if status:
        leads = leads.filter(F.col("status") == status)
    if min_fit is not None:
        leads = leads.filter(F.coalesce("fit_score", F.lit(0)) >= min_fit)
    if definition == "any":
        leads = leads.join(_mailed_people(t), F.col("id") == F.col("_lead"), "left_anti")
    return leads


def companies_missing_email(
    t: Tables,
    definition: str = "any",
    status: str | None = None,
    min_fit: int | None = None,
    limit: int = 50,
) -> DataFrame:
    """One page of leads without mail, plus the full count in ``record_count``."""
    missing = _missing_email(t, definition, status, min_fit)
    total = missing.agg(F.count("*").alias("n")).scalar()
    return missing.orderBy(*by_rank()).limit(limit).withColumn("record_count", total)


def list_contact_emails(t: Tables, limit: int = 50) -> DataFrame:
    """Company addresses by company, then person addresses by company and person."""
    fold = lambda c: F.lower(F.coalesce(c, F.lit("")))
    company = t.leads.filter(has_text(F.col("company_email"))).select(
        F.lit(0).alias("block"),
        F.col("id").alias("lead_id"),
        "company_name",
        F.col("company_email").alias("email"),
        F.lit(None).cast("string").alias("person_name"),
        F.lit("company").alias("source"),
        F.col("id").alias("_tie"),
    )
    leads = t.leads.select(F.col("id").alias("lead_id"), "company_name")
    person = (
        t.people.filter(has_text(F.col("email")))
        .select(F.col("id").alias("_tie"), "lead_id", "email", F.col("name").alias("person_name"))
        .join(leads, "lead_id")
        .withColumns({"block": F.lit(1), "source": F.lit("person")})
    )
    ordered = company.unionByName(person).orderBy(
        "block", fold(F.col("company_name")), fold(F.col("person_name")), "_tie"
    )
    return ordered.limit(limit).drop("block", "_tie")


# --- follow-ups -------------------------------------------------------------
def _followups(t: Tables, as_of: str) -> DataFrame:
    """Due open items of both kinds, narrow, before any join."""
    def due(df: DataFrame, title: str, date: str, kind: str) -> DataFrame:
        return df.filter(
            (F.col("status") == "open") & F.col(date).isNotNull() & (F.col(date) <= as_of)
        ).select(
            "id",
            "lead_id",
            F.col(title).alias("title"),
            F.col(date).alias("due_date"),
            "priority",
            "status",
            F.lit(kind).alias("item_type"),
        )

    return due(t.tasks, "title", "due_date", "task").unionByName(
        due(t.interactions, "subject", "deadline", "interaction")
    )


def followups_due(t: Tables, as_of: str) -> DataFrame:
    """Open tasks and interactions due on or before ``as_of``, earliest first."""
    leads = t.leads.select(F.col("id").alias("lead_id"), "company_name")
    return (
        _followups(t, as_of)
        .join(leads, "lead_id")
        .select("company_name", "lead_id", "title", "due_date", "priority", "item_type", "id")
        .orderBy("due_date", "item_type", "id")
    )


def due_followups_filtered(
    t: Tables,
    as_of: str,
    status: str | None = None,
    priority: str | None = None,
    limit: int = 50,
) -> DataFrame:
    """One page of due follow-ups with the full count. ``status`` filters the item's own status."""
    items = _followups(t, as_of)
    if status:
        items = items.filter(F.col("status") == status)
    if priority:
        items = items.filter(F.col("priority") == priority)
    leads = t.leads.select(F.col("id").alias("lead_id"), "company_name")
    items = items.join(leads, "lead_id")
    total = items.agg(F.count("*").alias("n")).scalar()
    page = items.orderBy("due_date", "item_type", "id").limit(limit)
    return page.withColumn("record_count", total)


def pipeline_metric(t: Tables, as_of: str, metric: str | None = None) -> DataFrame:
    """``metric, value`` rows. The percentage is rounded half-even on the binary value."""
    if metric is not None and metric not in vocab.PIPELINE_METRICS:
        raise ValueError(f"metric must be one of {vocab.PIPELINE_METRICS}")
    leads = t.leads.select(F.col("id").alias("lead_id"))
    due = _followups(t, as_of).join(leads, "lead_id").agg(F.count("*").alias("overdue"))
    summary = contact_summary(t)
    ratio = F.col("with_any_email") / F.nullif(F.col("companies"), F.lit(0)) * 100
    coverage = F.coalesce(F.round(ratio.cast("decimal(38,15)"), 2).cast("double"), F.lit(0.0))
    values = F.array(
        F.struct(F.lit("organization_count").alias("metric"), F.col("companies").cast("double").alias("value")),
        F.struct(F.lit("contact_coverage_percent").alias("metric"), coverage.alias("value")),
        F.struct(F.lit("verified_email_coverage_percent").alias("metric"), F.lit(0.0).alias("value")),
    )
    rows = summary.select(F.inline(values)).unionByName(
        due.select(F.lit("overdue_task_count").alias("metric"), F.col("overdue").cast("double").alias("value"))
    )
    return rows.filter(F.col("metric") == metric) if metric else rows


# --- evidence history -------------------------------------------------------
def _newest(raw: DataFrame) -> DataFrame:
    linked = raw.filter(F.col("lead_id").isNotNull())
    return linked.groupBy("lead_id").agg(
        F.max(F.struct("created_at", "id")).alias("_newest"),
        F.max_by(
            "source_filter_tier",
            F.when(
                F.coalesce("source_filter_tier", F.lit("")) != "", F.struct("created_at", "id")
            ),
        ).alias("lead_filter_tier"),
    )


def canonical_source(raw: DataFrame) -> DataFrame:
    """The newest raw source of each lead, with the newest non-empty filter tier.

    The pick is an aggregate over two narrow columns; the wide rows are then
    fetched by their own unique id, so a hot lead is never one task's sort.
    """
    newest = _newest(raw).select(F.col("_newest.id").alias("_pick"), "lead_filter_tier")
    return raw.join(newest, F.col("id") == F.col("_pick")).drop("_pick")


def source_history(raw: DataFrame) -> DataFrame:
    """All linked raw sources that are not the newest of their lead."""
    newest = _newest(raw).select(F.col("_newest.id").alias("_pick"))
    return raw.filter(F.col("lead_id").isNotNull()).join(
        newest, F.col("id") == F.col("_pick"), "left_anti"
    )


def lead_detail(t: Tables, lead_ids: DataFrame | None = None) -> DataFrame:
    """Everything known about leads, one row per item.

    A lead may own any number of items, so they stay rows instead of nested
    lists: ``section`` orders the lead itself (0), people (decision makers first, by name), then
    interactions and raw sources (newest first) and tasks (by due date, undated
    last). ``label`` and ``at`` name an item; its whole row is in the struct of its kind
    (``lead``, ``person``, ``interaction``, ``task``, ``raw_source``), the others are NULL. ``lead``
    also has ``people_count``, ``has_decision_maker``, ``canonical_source_id`` and
    ``lead_filter_tier``. The result is range-sorted; a hot lead spreads over partitions.
    """
    def items(df: DataFrame, section: int, kind: str, rank: Column, text: Column, owner: str = "lead_id") -> DataFrame:
        return df.select(
            F.col(owner).alias("lead_id"),
            F.lit(section).alias("section"),
            F.lit(kind).alias("item_type"),
            F.col("id").alias("item_id"),
            rank.alias("_rank"),
            text.alias("label"),
            F.col("created_at").alias("at"),
            F.struct(*df.columns).alias(kind),
        )

    def newest_first() -> Column:
        return F.lpad((F.lit(10**17) - F.unix_micros("created_at")).cast("string"), 18, "0")

    leads = t.leads
    if lead_ids is not None:
        leads = leads.join(lead_ids.select(F.col("lead_id").alias("_wanted")), F.col("id") == F.col("_wanted"), "left_semi")
    newest = _newest(t.raw_sources).select(
        F.col("lead_id").alias("_of"), F.col("_newest.id").alias("canonical_source_id"), "lead_filter_tier"
    )
    counts = people_rollup(t.people).withColumnRenamed("lead_id", "_lead")
    heads = (
        leads.join(counts, F.col("id") == F.col("_lead"), "left").join(newest, F.col("id") == F.col("_of"), "left")
        .drop("_lead", "_of").fillna({"people_count": 0, "has_decision_maker": False})
    )
    decides = F.when(F.coalesce("is_decision_maker", F.lit(False)), "0").otherwise("1")
    parts = [
        items(t.people, 1, "person", F.concat(decides, F.coalesce("name", F.lit(""))), F.col("name")),
        items(t.interactions, 2, "interaction", newest_first(), F.col("subject")),
        items(t.tasks, 3, "task", F.coalesce("due_date", F.lit("~")), F.col("title")),
        items(t.raw_sources, 4, "raw_source", newest_first(), F.col("source_type")),
    ]
    rows = items(heads, 0, "lead", F.lit(""), F.col("company_name"), "id")
    for part in parts:
        rows = rows.unionByName(part, allowMissingColumns=True)
    rows = rows.filter(F.col("lead_id").isNotNull())
    # One shuffle of the wide rows, by ranges: a lead stays whole and its head, sorted first, names the others. Only a
    # lead with more than its share of all rows is cut between ranges; its name, sent to all, is there already.
    owners = leads.select(F.col("id").alias("lead_id"))
    for df in (t.people, t.interactions, t.tasks, t.raw_sources):
        owners = owners.unionByName(df.select("lead_id"))
    sizes = owners.filter(F.col("lead_id").isNotNull()).groupBy("lead_id").agg(F.count("*").alias("_size"))
    share = sizes.agg(F.coalesce(F.sum("_size"), F.lit(0)).alias("n")).scalar() / HOT_KEYS
    hot = sizes.filter(F.col("_size") > F.greatest(share, F.lit(LEAST_HOT))).select(F.col("lead_id").alias("_hot"))
    hot = leads.join(F.broadcast(hot), F.col("id") == F.col("_hot")).select("_hot", F.struct("company_name").alias("_hot_name"))
    place = ("section", "_rank", "item_id")
    rows = rows.join(F.broadcast(hot), F.col("lead_id") == F.col("_hot"), "left").withColumn(
        "_spread", F.when(F.col("_hot").isNotNull(), F.struct(*place))
    )
    along = Window.partitionBy("lead_id", "_spread").orderBy(*place)
    heading = F.when(F.col("section") == 0, F.struct(F.col("label").alias("company_name")))
    named = rows.repartitionByRange("lead_id", "_spread").withColumn("_names", F.collect_list(heading).over(along))
    names = F.when(F.col("_hot").isNotNull(), F.array("_hot_name")).otherwise(F.col("_names"))
    return named.select("*", F.explode(names).alias("_name")).select(
        "lead_id", F.col("_name.company_name").alias("company_name"), "section", "item_type", "item_id", "label", "at",
        "lead", "person", "interaction", "task", "raw_source",
    )


def lead_summary(t: Tables, limits: ExtractionLimits = WHOLE) -> DataFrame:
    """One line per lead: score, status, services, counts and decision-maker names."""
    deciders = (
        t.people.filter(F.col("is_decision_maker"))
        .groupBy("lead_id")
        .agg(F.count("*").alias("decision_makers"))
        .withColumnRenamed("lead_id", "_lead")
    )
    base = leads_with_rollup(t, extra=("open_tasks", "interaction_count"))
    na = F.lit("n/a")
    return base.join(deciders, F.col("id") == F.col("_lead"), "left").select(
        F.col("id").alias("lead_id"),
        "company_name",
        F.coalesce("website", na).alias("website"),
        F.coalesce("company_email", na).alias("email"),
        F.coalesce("partner_tier", na).alias("partner_tier"),
        "fit_score",
        "status",
        F.coalesce(F.nullif(F.concat_ws(", ", "services"), F.lit("")), na).alias("services"),
        "people_count",
        F.coalesce("decision_makers", F.lit(0)).alias("decision_makers"),
        "interaction_count",
        "open_tasks",
        shortened(F.col("description"), limits.lead_summary_chars).alias("description"),
    )


def decision_maker_names(people: DataFrame) -> DataFrame:
    """``lead_id, name`` rows behind the summary's decision-maker count."""
    return people.filter(F.col("is_decision_maker")).select("lead_id", "name")


# --- described extras -------------------------------------------------------
def score_band() -> Column:
    score = F.coalesce("fit_score", F.lit(0))
    return F.when(score >= 70, "high").when(score >= 40, "medium").otherwise("low")


def coverage_by_relevance_tier(t: Tables) -> DataFrame:
    flags = people_mail_flags(t.people).withColumnRenamed("lead_id", "_lead")
    mailed = has_text(F.col("company_email")) | F.coalesce("has_person_email", F.lit(False))
    return (
        t.leads.filter(is_active())
        .select("id", "company_email", score_band().alias("band"))
        .join(flags, F.col("id") == F.col("_lead"), "left")
        .groupBy("band")
        .agg(
            F.count("*").alias("companies"),
            F.count("_lead").alias("with_people"),
            F.count_if(mailed).alias("with_any_email"),
        )
    )


def relevance_distribution(leads: DataFrame) -> DataFrame:
    band = F.least(F.lit(9), F.floor(F.coalesce("fit_score", F.lit(0)) / 10)).cast("int") * 10
    return leads.groupBy(band.alias("score_from")).agg(F.count("*").alias("companies"))


def high_relevance_no_open_followup(t: Tables, min_fit: int = 70) -> DataFrame:
    busy = t.tasks.filter(F.col("status") == "open").select(F.col("lead_id").alias("_lead"))
    strong = t.leads.filter(is_active() & (F.col("fit_score") >= min_fit))
    return strong.join(busy, F.col("id") == F.col("_lead"), "left_anti").orderBy(*by_rank())
