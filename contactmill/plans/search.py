"""Search, ranking and question tagging."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from contactmill import vocab
from contactmill.functions.text import (
    any_contains,
    blank_to_null,
    email_tokens,
    is_host_mail,
    normalize_text,
)
from contactmill.operators.numbering import page_of
from contactmill.plans.reports import by_rank, people_rollup
from contactmill.sources.tables import Tables

BLOB_SCALARS = (
    "company_name", "website", "company_email", "partner_tier", "primary_location",
    "description", "status",
)
BLOB_LISTS = ("services", "locations", "industries", "supported_locations", "languages")


def search_blob() -> Column:
    """The normalised text a search looks into."""
    parts = [blank_to_null(F.col(c)) for c in BLOB_SCALARS] + [F.col(c) for c in BLOB_LISTS]
    return normalize_text(F.concat_ws(" ", *parts))


def search_terms(c: Column) -> Column:
    """Known phrases, then the first eight telling words."""
    text = normalize_text(c)
    phrases = F.array_compact(
        F.array(*[F.when(text.contains(p), F.lit(p)) for p in vocab.SEARCH_PHRASES])
    )
    words = F.regexp_extract_all(text, F.lit(vocab.SEARCH_WORD_PATTERN), F.lit(0))
    telling = F.filter(words, lambda w: (F.length(w) >= 3) & ~w.isin(*vocab.STOP_WORDS))
    return F.concat(phrases, F.slice(telling, 1, 8))


def search_contacts(
    t: Tables,
    text: str | None = None,
    status: str | None = None,
    min_fit: int | None = None,
    has_person: bool | None = None,
    limit: int = 25,
    offset: int = 0,
) -> DataFrame:
    """One page of leads that pass every filter, with the full count."""
    leads = t.leads
    if status:
        leads = leads.filter(F.col("status") == status)
    if min_fit is not None:
        leads = leads.filter(F.coalesce("fit_score", F.lit(0)) >= min_fit)
    if text:
        needle = text.lower()
        fields = ("company_name", "website", "company_email")
        leads = leads.filter(
            reduce(
                lambda a, b: a | b,
                [F.coalesce(F.lower(f).contains(needle), F.lit(False)) for f in fields],
            )
        )
    if has_person is not None:
        held = t.people.select(F.col("lead_id").alias("_lead"))
        how = "left_semi" if has_person else "left_anti"
        leads = leads.join(held, F.col("id") == F.col("_lead"), how)
    total = leads.agg(F.count("*").alias("n")).scalar()
    return page_of(leads, by_rank(), limit, offset).withColumn("record_count", total)


def _as_list(value) -> list[str]:
    if value is None:
        return []
    values = value if isinstance(value, (list, tuple)) else [value]
    return [str(v).strip() for v in values if str(v).strip()]


def _plain(value: str) -> str:
    return " ".join(value.lower().split())


def _whole(value) -> int | None:
    """A filter's number; one that is no number counts as not given."""
    try:
        return int(value)
    except (TypeError, ValueError):
        return None


def passes_filters(filters: dict) -> Column:
    """Row test on a lead with its roll-up columns."""
    tests = [F.lit(True)]
    least = _whole(filters.get("min_fit_score"))
    if least is not None:
        tests.append(F.coalesce("fit_score", F.lit(0)) >= least)
    for name, extra in (("services", ()), ("locations", ("primary_location",)), ("industries", ())):
        wanted = [_plain(v) for v in _as_list(filters.get(name) or filters.get(name[:-1]))]
        if filters.get("industry") and name == "industries" and not wanted:
            wanted = [_plain(v) for v in _as_list(filters["industry"])]
        if wanted:
            text = normalize_text(F.concat_ws(" ", F.col(name), *[F.col(e) for e in extra]))
            tests.append(any_contains(text, wanted))
    if filters.get("partner_tier"):
        wanted = _plain(str(filters["partner_tier"]))
        tier = normalize_text(F.coalesce("partner_tier", F.lit("")))
        both_plus = tier.contains("plus") if "plus" in wanted else F.lit(False)
        tests.append(tier.contains(wanted) | both_plus)
    if filters.get("status"):
        tests.append(
            normalize_text(F.coalesce("status", F.lit(""))).contains(_plain(str(filters["status"])))
        )
    if filters.get("has_contacts") is not None:
        tests.append((F.col("people_count") > 0) == bool(filters["has_contacts"]))
    if filters.get("has_decision_maker") is not None:
        tests.append(F.col("has_decision_maker") == bool(filters["has_decision_maker"]))
    return reduce(lambda a, b: a & b, tests)


def _filter_values(filters: dict) -> list[str]:
    keys = (
        "services", "service", "locations", "location", "industries", "industry",
        "partner_tier", "status",
    )
    return [_plain(v) for k in keys for v in _as_list(filters.get(k))]


def _ranked(scored: DataFrame) -> list[Column]:
    return [
        F.desc("score"),
        F.desc(F.coalesce("fit_score", F.lit(0))),
        F.asc(F.lower(F.coalesce("company_name", F.lit("")))),
        F.asc("id"),
    ]


def query_terms(text: str) -> list[str]:
    """``search_terms`` of one question, for questions that are arguments of the call."""
    plain = _plain(text)
    phrases = [p for p in vocab.SEARCH_PHRASES if p in plain]
    words = [
        w for w in re.findall(vocab.SEARCH_WORD_PATTERN, plain)
        if len(w) >= 3 and w not in vocab.STOP_WORDS
    ]
    return phrases + words[:8]


def _score(terms: list[str], values: list[str]) -> Column:
    """Three points per phrase, one per word, four per filter value found in the text."""
    blob, total = F.col("_blob"), F.lit(0)
    for term in terms:
        total = total + F.when(blob.contains(term), 3 if " " in term else 1).otherwise(0)
    for value in values:
        total = total + F.when(blob.contains(value), 4).otherwise(0)
    return total


def search_leads_ranked(
    t: Tables, query: str, filters: dict | None = None, limit: int = 10
) -> DataFrame:
    """Best matches for one question: one pass over leads, then a distributed top-k.

    Scores are generated as a one-item list and filtered inside it, so the
    lead's text is built once and not again for the filter.
    """
    filters = filters or {}
    needs_people = any(filters.get(k) is not None for k in ("has_contacts", "has_decision_maker"))
    leads = t.leads
    if needs_people:  # of the child tables only people
        rollup = people_rollup(t.people).withColumnRenamed("lead_id", "_lead")
        leads = leads.join(rollup, F.col("id") == F.col("_lead"), "left").drop("_lead").fillna(
            {"people_count": 0, "has_decision_maker": False}
        )
    terms = query_terms(query)
    kept = leads.filter(passes_filters(filters)).withColumn("_blob", search_blob())
    scored = F.array(F.struct(_score(terms, _filter_values(filters)).alias("score")))
    if terms and not filters:
        scored = F.filter(scored, lambda s: s["score"] > 0)
    rows = kept.select("*", F.inline(scored))
    return rows.orderBy(*_ranked(rows)).limit(limit).drop("_blob")


def search_leads_many(t: Tables, queries: list[str], limit: int = 10) -> DataFrame:
    """Best matches for a list of questions, still in one pass over leads.

    The questions are literals of the call. Each lead's text is built once, a
    lead is emitted only for questions it scores on, and the rank filter cuts
    to ``limit`` rows per question before the shuffle.
    """
    wanted = [query_terms(q) for q in queries]
    hits = F.array(*[
        F.struct(
            F.lit(i).alias("query_id"),
            F.lit(not terms).alias("open"),
            _score(terms, []).alias("score"),
        )
        for i, terms in enumerate(wanted)
    ])
    blobs = t.leads.select("id", "company_name", "fit_score", search_blob().alias("_blob"))
    rows = blobs.select(
        "id", "company_name", "fit_score",
        F.inline(F.filter(hits, lambda h: h["open"] | (h["score"] > 0))),
    )
    order = Window.partitionBy("query_id").orderBy(*_ranked(rows))
    return (
        rows.withColumn("place", F.row_number().over(order))
        .filter(F.col("place") <= limit)
        .select("query_id", "place", F.col("id").alias("lead_id"), "company_name", "score")
    )


def like_pattern(text: str) -> str:
    """SQL LIKE pattern where ``%`` and ``_`` in the text keep their wildcard meaning."""
    return "%" + text.replace("\\", "\\\\") + "%"


def search_lead_by_name(leads: DataFrame, name: str) -> DataFrame:
    lowered = "".join(ch if ch.isalnum() or ch in "_&.-" else " " for ch in name.lower())
    normal = " ".join(lowered.split())
    return leads.filter(
        F.col("normalized_name").ilike(like_pattern(normal))
        | F.col("company_name").ilike(like_pattern(name))
    )


# --- questions --------------------------------------------------------------
def _limit_in(text: Column, default: int, most: int) -> Column:
    number = blank_to_null(F.regexp_extract(text, r"(?U)\b(\d{1,2})\b", 1)).cast("int")
    return F.when(number.isNotNull(), F.greatest(F.lit(1), F.least(F.lit(most), number))).otherwise(
        F.lit(default)
    )


def question_intents(questions: DataFrame, col: str = "text") -> DataFrame:
    """Tag each question with an intent, a limit and search filters; first rule wins."""
    raw = F.col(col)
    q = F.col("_q")
    counts = any_contains(q, vocab.COUNT_WORDS)
    about = [q.startswith(p) for p in vocab.SUMMARY_PREFIXES]
    asks_summary = reduce(lambda a, b: a | b, about)
    intent = (
        F.when(counts & any_contains(q, vocab.COUNT_CONTACT_WORDS), "contact_summary")
        .when(counts, "count_leads")
        .when(any_contains(q, vocab.LIST_EMAIL_WORDS), "list_emails")
        .when(any_contains(q, vocab.CONTACT_SUMMARY_WORDS), "contact_summary")
        .when(any_contains(q, vocab.NO_EMAIL_WORDS), "leads_without_email")
        .when(any_contains(q, vocab.TOP_WORDS), "top_leads")
        .when(any_contains(q, vocab.NO_CONTACT_WORDS), "leads_without_contacts")
        .when(any_contains(q, vocab.FOLLOW_WORDS), "followups_due")
        .when(asks_summary, "summarize_company")
        .when(any_contains(q, vocab.SEARCH_WORDS), "search_leads")
        .otherwise("search_leads")
    )
    sure = any_contains(q, vocab.SEARCH_WORDS)
    label = F.col("intent")
    company = reduce(
        lambda acc, p: acc.when(q.startswith(p), F.trim(F.substr(raw, F.lit(len(p) + 1)))),
        vocab.SUMMARY_PREFIXES[1:],
        F.when(
            q.startswith(vocab.SUMMARY_PREFIXES[0]),
            F.trim(F.substr(raw, F.lit(len(vocab.SUMMARY_PREFIXES[0]) + 1))),
        ),
    )
    services = F.array_compact(
        F.array(*[
            F.when(any_contains(q, words), F.lit(name))
            for name, words in vocab.SERVICE_FILTER_WORDS.items()
        ])
    )
    floor = blank_to_null(
        F.regexp_extract(q, r"(?:score|fit|preko|iznad)\D{0,12}(\d{1,3})", 1)
    ).cast("int")
    searching = label == "search_leads"
    return (
        questions.withColumn("_q", normalize_text(raw))
        .withColumn("intent", intent)
        .withColumn(
            "limit",
            F.when(label == "list_emails", F.least(F.lit(100), _limit_in(q, 50, 25)))
            .when(label == "top_leads", _limit_in(q, 10, 25))
            .when(searching & sure, _limit_in(q, 10, 25))
            .when(searching, _limit_in(raw, 10, 25))
            .otherwise(F.lit(10)),
        )
        .withColumn("company", F.when(label == "summarize_company", company).otherwise(""))
        .withColumn("services", F.when(searching, services).otherwise(F.array().cast("array<string>")))
        .withColumn("min_fit_score", F.when(searching, floor))
        .withColumn(
            "confidence",
            F.when(searching & sure, 0.75).when(searching, 0.50).otherwise(1.0),
        )
        .drop("_q")
    )


# --- addresses known for a lead ---------------------------------------------
def _addresses(df: DataFrame, step: int, source: Column, text: str) -> DataFrame:
    tokens = F.regexp_extract_all(F.col(text), F.lit(vocab.EMAIL_PATTERN), F.lit(0))
    place = F.struct(
        F.lit(min(step, 1)).alias("later"), source.alias("source"), F.lit(step).alias("step")
    )
    return df.select("lead_id", place.alias("_at"), F.posexplode(F.array_distinct(tokens)))


def collect_lead_emails(t: Tables) -> DataFrame:
    """Distinct addresses of each lead, one row per address, in first-seen order.

    The company address comes first, then each raw source, newest first, its
    text before its parsed output. Addresses of the hosting platform are left
    out, and a lead without any address shows ``n/a``. Rows instead of a list
    keep a lead with very many addresses spread over partitions.
    """
    company = t.leads.select(F.col("id").alias("lead_id"), "company_email")
    raw = t.raw_sources.filter(F.col("lead_id").isNotNull())
    newest = F.struct(
        (-F.unix_micros("created_at")).alias("age"), (-F.col("id")).alias("back")
    )
    first = F.struct(F.lit(0).cast("long").alias("age"), F.lit(0).cast("long").alias("back"))
    every = (
        _addresses(company, 0, first, "company_email")
        .unionByName(_addresses(raw, 1, newest, "raw_text"))
        .unionByName(_addresses(raw, 2, newest, "parsed_json"))
    )
    seen = (
        every.withColumn("_low", F.lower("col"))
        .filter(~is_host_mail(F.col("_low")))
        .groupBy("lead_id", "_low")
        .agg(F.min(F.struct("_at", "pos", "col")).alias("_first"))
        .withColumnRenamed("lead_id", "_lead")
    )
    leads = t.leads.select(F.col("id").alias("lead_id"))
    return (
        leads.join(seen, F.col("lead_id") == F.col("_lead"), "left")
        .orderBy("lead_id", F.asc_nulls_last("_first"))
        .select("lead_id", F.coalesce("_first.col", F.lit("n/a")).alias("email"))
    )
