"""Writing resolved records onto leads, people, tasks and evidence.

Parquet has no MERGE, so every function returns the new table state to write
to a new folder: collapse the batch per key, join once, prefer the new value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contactmill.functions.scoring import classify_title
from contactmill.functions.text import (
    blank_to_null,
    computed_once,
    extract_domain,
    normalize_email,
    normalize_linkedin_url,
    normalize_name,
    sanitize_company_name,
    slugify,
)

LEAD_TEXTS = (
    "website", "domain", "company_email", "company_phone", "partner_tier", "rating",
    "review_count", "partner_since", "primary_location", "description",
)
LEAD_DEFAULTED = (
    "plus_partner_signal", "supported_locations", "languages", "featured_work", "services",
    "locations", "industries", "fit_score", "status", "confidence", "extraction_status",
    "possible_duplicate",
)
PERSON_TEXTS = (
    "name", "title", "department", "seniority", "email", "relevance_reason", "raw_source_id",
)
PERSON_FLAGS = ("is_decision_maker", "is_relevant_contact", "confidence")


def last_set(c: Column, order: Column) -> Column:
    """The last non-NULL value in the given order; combines map-side."""
    return F.max_by(c, F.when(c.isNotNull(), order))


def lead_changes(resolved: DataFrame) -> DataFrame:
    """Resolved records as lead writes, defaults filled so that they overwrite.

    ``resolved`` has ``record_id, arrived, lead_id, source_type, creates`` and
    the parsed lead fields. A mail linked to an existing lead leaves its name.
    """
    keeps_name = (F.col("source_type") == "email") & ~F.col("creates")
    name = blank_to_null(sanitize_company_name(F.col("company_name")))
    none = "array<string>"

    def listed(c: str, kind: str = none) -> Column:
        return F.coalesce(F.col(c), F.array().cast(kind))

    return resolved.filter(F.col("lead_id").isNotNull()).withColumns(
        {
            "company_name": F.when(~keeps_name, name),
            "domain": extract_domain(F.col("website")),
            "plus_partner_signal": F.coalesce("plus_partner_signal", F.lit(False)),
            "supported_locations": listed("supported_locations"),
            "languages": listed("languages"),
            "featured_work": listed("featured_work", "array<struct<title:string,url:string>>"),
            "services": listed("services"),
            "locations": F.when(F.size("locations") > 0, F.col("locations")).otherwise(
                listed("supported_locations")
            ),
            "industries": listed("industries"),
            "fit_score": F.lit(0),
            "status": F.lit("new"),
            "confidence": F.coalesce("confidence", F.lit(0.0)),
            "extraction_status": F.coalesce("extraction_status", F.lit("ok")),
            "possible_duplicate": F.coalesce("possible_duplicate", F.lit(False)),
        }
    )


def _keep_name_step(state: dict, row):
    stored = state.get("name")
    if not stored or stored[1:].lower() != row.company_name.lower():
        state["name"] = row.company_name
    return (row.lead_id, row.phase, row.at, row.record_id, state["name"])


def merged_names(leads: DataFrame, changes: DataFrame) -> DataFrame:
    """``lead_id, merged_name``: the name after all writes in order.

    Normally the last name wins. Only leads that saw both a name and the same
    name without its first character need the writes one after another; an
    equi-join on (lead, clipped name) finds them.
    """
    from contactmill.operators.linkage import fold_in_order

    order = F.struct("arrived", "record_id")
    writes = changes.filter(F.col("company_name").isNotNull()).select(
        "lead_id", "company_name", F.lit(1).alias("phase"), "arrived", "record_id"
    )
    touched = writes.select(F.col("lead_id").alias("_lead")).distinct()
    stored = leads.join(touched, F.col("id") == F.col("_lead"), "left_semi").select(
        F.col("id").alias("lead_id"),
        sanitize_company_name(F.col("company_name")).alias("company_name"),
        F.lit(0).alias("phase"),
        F.lit(None).cast(writes.schema["arrived"].dataType).alias("arrived"),
        F.lit(0).cast("long").alias("record_id"),
    ).filter(F.coalesce("company_name", F.lit("")) != "")
    every = stored.unionByName(writes)
    names = every.select("lead_id", F.lower("company_name").alias("low")).distinct()
    clipped = names.select(
        F.col("lead_id").alias("_lead"), F.substr("low", F.lit(2)).alias("_low")
    )
    risky = names.join(
        clipped, (F.col("lead_id") == F.col("_lead")) & (F.col("low") == F.col("_low")), "left_semi"
    ).select("lead_id").distinct()
    stepped = fold_in_order(
        every.join(risky, "lead_id", "left_semi").withColumn(
            "at", F.coalesce(F.unix_micros(F.col("arrived").cast("timestamp")), F.lit(0))
        ),
        "lead_id", ["phase", "arrived", "record_id"], dict, _keep_name_step,
        "lead_id long, phase int, at long, record_id long, name string",
    )
    folded = stepped.groupBy("lead_id").agg(
        F.max_by("name", F.struct("phase", "at", "record_id")).alias("_folded")
    )
    last = writes.groupBy("lead_id").agg(F.max_by("company_name", order).alias("_last"))
    return last.join(folded, "lead_id", "left").select(
        "lead_id", F.coalesce("_folded", "_last").alias("merged_name")
    )


def merge_leads(leads: DataFrame, changes: DataFrame) -> DataFrame:
    """The lead table after all writes of ``lead_changes`` in arrival order."""
    order = F.struct("arrived", "record_id")
    batch = changes.groupBy(F.col("lead_id").alias("_lead")).agg(
        *[last_set(F.col(c), order).alias(f"_{c}") for c in (*LEAD_TEXTS, *LEAD_DEFAULTED)],
        F.min("arrived").alias("_first"),
        F.max("arrived").alias("_last"),
    )
    names = merged_names(leads, changes).select(F.col("lead_id").alias("_named"), "merged_name")
    batch = batch.join(names, F.col("_lead") == F.col("_named"), "left").drop("_named")
    joined = leads.join(batch, F.col("id") == F.col("_lead"), "full_outer")
    name = F.coalesce("merged_name", "company_name")
    fields = {
        "id": F.coalesce("id", "_lead"),
        "company_name": name,
        "normalized_name": F.when(
            F.col("merged_name").isNotNull() | F.col("id").isNull(), normalize_name(name)
        ).otherwise(F.col("normalized_name")),
        "created_at": F.coalesce("created_at", "_first"),
        "updated_at": F.coalesce("_last", "updated_at"),
        **{c: F.coalesce(f"_{c}", c) for c in (*LEAD_TEXTS, *LEAD_DEFAULTED)},
    }
    return joined.select(*[fields[c].alias(c) for c in leads.columns])


def link_people(people: DataFrame, incoming: DataFrame) -> DataFrame:
    """Give each incoming person the entry it updates or creates.

    Within a lead a person is the same by profile page, else by address. Keys
    make components, so a lead with very many people splits into small groups;
    only groups with several keys are replayed in order.
    """
    from contactmill.operators.linkage import (
        connected_components,
        fold_in_order,
        join_hot_keys,
        star_edges,
        with_component,
    )
    from contactmill.operators.numbering import number_rows
    from contactmill.session import cut_lineage

    fresh = incoming.withColumns(
        {
            "linkedin_url": normalize_linkedin_url(F.col("linkedin_url")),
            "email": normalize_email(F.col("email")),
        }
    )
    fresh = cut_lineage(number_rows(fresh, ["arrived", "record_id", "person_no"], "place"))
    touched = fresh.select(F.col("lead_id").alias("_lead")).distinct()
    held = people.join(touched, F.col("lead_id") == F.col("_lead"), "left_semi").select(
        (F.col("id") * 2).alias("node"), "id", "lead_id", "linkedin_url",
        F.lower("email").alias("email"), F.lit(0).alias("kind"), F.lit(-1).cast("long").alias("place"),
    )
    rows = held.unionByName(
        fresh.select(
            (F.col("place") * 2 + 1).alias("node"), F.lit(-1).cast("long").alias("id"), "lead_id",
            "linkedin_url", "email", F.lit(1).alias("kind"), "place",
        )
    )
    keys = F.array_compact(
        F.array(
            F.when(F.col("linkedin_url").isNotNull(), F.concat_ws("|", F.col("lead_id"), F.lit("p"), "linkedin_url")),
            F.when(F.col("email").isNotNull(), F.concat_ws("|", F.col("lead_id"), F.lit("m"), "email")),
        )
    )
    parts = cut_lineage(connected_components(
        star_edges(rows.select("node", F.explode(keys).alias("key")))
    ))
    members = cut_lineage(with_component(rows, parts))
    stats = members.groupBy("component").agg(
        F.count("*").alias("n"),
        F.count("linkedin_url").alias("n_url"),
        F.min("linkedin_url").alias("url_lo"),
        F.max("linkedin_url").alias("url_hi"),
        F.count("email").alias("n_mail"),
        F.min("email").alias("mail_lo"),
        F.max("email").alias("mail_hi"),
        F.count_if(F.col("kind") == 0).alias("n_old"),
        F.min(F.when(F.col("kind") == 0, F.col("id"))).alias("first_id"),
        F.min(F.when(F.col("kind") == 1, F.col("place"))).alias("first_place"),
    )
    one_url = (F.col("n_url") == F.col("n")) & (F.col("url_lo") == F.col("url_hi"))
    one_mail = (F.col("n_mail") == F.col("n")) & (F.col("mail_lo") == F.col("mail_hi")) & (F.col("n_url") == 0)
    uniform = F.coalesce(one_url | one_mail, F.lit(False)) | (F.col("n") == 1)
    sized = stats.withColumns({"simple": uniform, "_size": F.col("n")}).select("component", "simple", "first_id", "first_place", "_size")
    routed = join_hot_keys(members, sized, "component", members.count())
    simple = routed.filter(F.col("simple") & (F.col("kind") == 1)).select(
        "place",
        F.col("first_id").alias("old_person"),
        F.when(F.col("first_id").isNull(), F.col("first_place")).alias("creator"),
    )
    replayed = fold_in_order(
        routed.filter(~F.col("simple")).select(
            "component", "kind", "id", "place", "linkedin_url", "email"
        ),
        "component", ["kind", "place", "id"], _PeopleReplay, _people_step,
        "place long, old_person long, creator long",
    ).withColumns({c: F.when(F.col(c) >= 0, F.col(c)) for c in ("old_person", "creator")})
    linked = simple.unionByName(replayed)
    return fresh.join(linked, "place")


class _PeopleReplay:
    def __init__(self):
        self.by_url, self.by_mail, self.mail_of = {}, {}, {}

    def set_mail(self, place, mail):
        old = self.mail_of.get(place)
        if old is not None:
            self.by_mail[old].discard(place)
        self.mail_of[place] = mail
        self.by_mail.setdefault(mail, set()).add(place)


def _people_step(state: _PeopleReplay, row):
    url = row.linkedin_url if isinstance(row.linkedin_url, str) else None
    mail = row.email if isinstance(row.email, str) else None
    hits = state.by_url.get(url) if url else None
    if not hits and mail:
        hits = state.by_mail.get(mail)
    if row.kind == 1 and hits:
        place = min(hits)
    else:
        place = (0, row.id) if row.kind == 0 else (1, row.place)
        if url:
            state.by_url.setdefault(url, set()).add(place)
    if mail:
        state.set_mail(place, mail)
    if row.kind == 0:
        return None
    return (row.place, place[1] if place[0] == 0 else -1, place[1] if place[0] == 1 else -1)


def merge_people(people: DataFrame, incoming: DataFrame, top: int | None = None) -> DataFrame:
    """The people table after all incoming persons in arrival order; ``top`` is the largest id if ``people`` are only some of all.

    ``incoming``: ``record_id, person_no, arrived, lead_id, name, title,
    department, seniority, email, linkedin_url, confidence, raw_source_id``.
    """
    from contactmill.operators.numbering import number_rows

    scored = incoming.withColumn("_class", classify_title(F.col("title"))).select("*", "_class.*")
    linked = link_people(people, scored.drop("_class"))
    order = F.col("place")
    batch = linked.groupBy("old_person", "creator").agg(
        *[last_set(F.col(c), order).alias(f"_{c}") for c in (*PERSON_TEXTS, *PERSON_FLAGS)],
        F.min_by("linkedin_url", "place").alias("_linkedin_url"),
        F.min("lead_id").alias("_lead_id"),
        F.min("arrived").alias("_created_at"),
    )
    top = people.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top")).scalar() if top is None else F.lit(top)
    born = number_rows(batch.filter(F.col("creator").isNotNull()), ["creator"], "_no").select(
        (F.col("_no") + top).alias("id"),
        F.col("_lead_id").alias("lead_id"),
        F.col("_linkedin_url").alias("linkedin_url"),
        F.col("_created_at").alias("created_at"),
        *[F.col(f"_{c}").alias(c) for c in (*PERSON_TEXTS, *PERSON_FLAGS)],
    )
    updates = batch.filter(F.col("old_person").isNotNull())
    kept = people.join(updates, F.col("id") == F.col("old_person"), "left").select(
        "id", "lead_id", "linkedin_url", "created_at",
        *[F.coalesce(f"_{c}", c).alias(c) for c in (*PERSON_TEXTS, *PERSON_FLAGS)],
    )
    return kept.unionByName(born).select(*people.columns)


def write_fit_scores(leads: DataFrame, scores: DataFrame, at: Column) -> DataFrame:
    """Put recomputed scores on their leads; others stay as they are."""
    renamed = scores.select(F.col("lead_id").alias("_lead"), F.col("fit_score").alias("_fit"))
    joined = leads.join(renamed, F.col("id") == F.col("_lead"), "left")
    changed = {
        "fit_score": F.coalesce("_fit", "fit_score"),
        "updated_at": F.when(F.col("_fit").isNotNull(), at).otherwise(F.col("updated_at")),
    }
    return joined.select(*[changed.get(c, F.col(c)).alias(c) for c in leads.columns])


def link_raw_sources(raw: DataFrame, links: DataFrame) -> DataFrame:
    """Set the lead of each linked raw source."""
    renamed = links.select(F.col("record_id").alias("_rec"), F.col("lead_id").alias("_lead"))
    joined = raw.join(renamed, F.col("id") == F.col("_rec"), "left")
    return joined.select(
        *[(F.coalesce("_lead", "lead_id") if c == "lead_id" else F.col(c)).alias(c) for c in raw.columns]
    )


def append_evidence(raw: DataFrame, parsed: DataFrame) -> DataFrame:
    """Raw sources plus new ones with their parsed output; unlinked ones are kept too."""
    return raw.unionByName(parsed.select(*raw.columns))


def emit_interactions(resolved: DataFrame) -> DataFrame:
    """Interaction rows of linked records that carry one."""
    talk = F.col("interaction")
    is_mail = F.col("source_type") == "email"
    needed = F.coalesce(talk["reply_needed"], F.lit(False))
    return resolved.filter(talk.isNotNull() & F.col("lead_id").isNotNull()).select(
        F.col("record_id").alias("raw_source_id"),
        "lead_id",
        F.when(is_mail, "email").otherwise("note").alias("type"),
        talk["subject"].alias("subject"),
        F.when(is_mail, F.col("raw_text")).alias("body"),
        talk["summary"].alias("summary"),
        needed.alias("reply_needed"),
        talk["deadline"].alias("deadline"),
        F.when(needed, "high").otherwise("normal").alias("priority"),
        talk["next_action"].alias("next_action"),
        F.lit("open").alias("status"),
        F.col("arrived").alias("created_at"),
    )


def emit_tasks(interactions: DataFrame) -> DataFrame:
    """One open task per interaction that needs a reply or names a date."""
    talks = computed_once(
        interactions, "raw_source_id", "lead_id", "reply_needed", "deadline", "next_action", "subject", "priority", "created_at"
    )
    return talks.filter(
        F.col("reply_needed") | (F.coalesce("deadline", F.lit("")) != "")
    ).select(
        "raw_source_id",
        "lead_id",
        F.coalesce(
            blank_to_null(F.col("next_action")), blank_to_null(F.col("subject")), F.lit("Follow up")
        ).alias("title"),
        F.col("deadline").alias("due_date"),
        "priority",
        F.lit("open").alias("status"),
        "created_at",
    )


def contact_key() -> Column:
    """Address, else a slug of name and company; NULL when neither identifies anyone."""
    name = F.trim(F.coalesce("name", F.lit("")))
    company = F.trim(F.coalesce("company", F.lit("")))
    mail = blank_to_null(F.lower(F.trim(F.coalesce("email", F.lit("")))))
    slug = F.nullif(slugify(F.concat_ws("-", name, company)), F.lit("unknown"))
    return F.coalesce(mail, slug)


def merge_contacts_index(index: DataFrame, new: DataFrame, order: str = "ord") -> DataFrame:
    """Contacts by key; non-empty new values win and the last one counts."""
    fields = [c for c in index.columns if c not in ("key",)]
    keyed = new.withColumn("_key", contact_key()).filter(F.col("_key").isNotNull())
    batch = keyed.groupBy("_key").agg(
        *[last_set(blank_to_null(F.col(c)), F.col(order)).alias(f"_{c}") for c in fields]
    )
    joined = index.join(batch, F.col("key") == F.col("_key"), "full_outer")
    return joined.select(
        F.coalesce("_key", "key").alias("key"),
        *[F.coalesce(f"_{c}", c).alias(c) for c in fields],
    )


def merge_duplicate_preview(
    pairs: DataFrame, people: DataFrame, raw: DataFrame, interactions: DataFrame, tasks: DataFrame
) -> DataFrame:
    """Rows that would move from each duplicate to its canonical lead, counted per kind."""
    kinds = {"person": people, "raw_source": raw, "interaction": interactions, "task": tasks}
    counts = None
    for kind, df in kinds.items():
        part = df.groupBy(F.col("lead_id").alias("_lead")).agg(F.count("*").alias("rows_moved"))
        part = part.withColumn("item_type", F.lit(kind))
        counts = part if counts is None else counts.unionByName(part)
    return pairs.join(counts, F.col("duplicate_id") == F.col("_lead")).select(
        "canonical_id", "duplicate_id", "item_type", "rows_moved"
    )
