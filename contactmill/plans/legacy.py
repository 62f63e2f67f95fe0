"""Reports and upserts of the older companies/contacts model."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from contactmill.functions.text import normalize_name_legacy
from contactmill.operators.merge import last_set
from contactmill.plans.reports import is_active_or_unset
from contactmill.plans.search import like_pattern

COMPANY_FIELDS = ("name", "website", "industry", "country", "status", "fit_score", "extra")
CONTACT_FIELDS = ("company_id", "full_name", "role", "linkedin_url", "status", "extra")


def _any_ilike(fields, query: str) -> Column:
    pattern = like_pattern(query)
    return reduce(lambda a, b: a | b, [F.col(f).ilike(pattern) for f in fields])


def active_companies_legacy(companies: DataFrame) -> DataFrame:
    """Open companies; a NULL status is kept here."""
    return companies.filter(is_active_or_unset())


def count_companies_legacy(companies: DataFrame) -> DataFrame:
    return active_companies_legacy(companies).agg(F.count("*").alias("companies"))


def _best_first(updated: bool = True) -> list[Column]:
    order = [F.desc_nulls_last("fit_score")]
    if updated:
        order.append(F.desc_nulls_last("updated_at"))
    return [*order, F.asc("id")]


def top_companies_legacy(companies: DataFrame, limit: int = 10) -> DataFrame:
    return active_companies_legacy(companies).orderBy(*_best_first()).limit(limit)


def companies_without_contacts(
    companies: DataFrame, contacts: DataFrame, limit: int = 25
) -> DataFrame:
    held = contacts.select(F.col("company_id").alias("_company"))
    alone = active_companies_legacy(companies).join(
        held, F.col("id") == F.col("_company"), "left_anti"
    )
    return alone.orderBy(*_best_first()).limit(limit)


def search_companies_legacy(companies: DataFrame, query: str, limit: int = 20) -> DataFrame:
    found = companies.filter(_any_ilike(("name", "normalized_name", "website"), query))
    return found.orderBy(
        F.desc_nulls_last("fit_score"), F.desc_nulls_first("created_at"), "id"
    ).limit(limit)


def search_contacts_legacy(contacts: DataFrame, query: str, limit: int = 20) -> DataFrame:
    found = contacts.filter(_any_ilike(("full_name", "email", "role"), query))
    return found.orderBy(F.desc_nulls_first("created_at"), "id").limit(limit)


def top_n_per_group(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """The first ``n`` rows of every group.

    Spark pushes the rank limit below the shuffle, so each input partition
    sends at most ``n`` rows per group and a hot group never moves whole.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= n)


def company_summary_legacy(
    companies: DataFrame,
    contacts: DataFrame,
    interactions: DataFrame,
    name: str,
    n_contacts: int = 20,
    n_interactions: int = 10,
) -> DataFrame:
    """The best name match with its newest contacts and interactions, one row per item."""
    best = (
        companies.filter(_any_ilike(("name", "normalized_name"), name.strip()))
        .orderBy(*_best_first(updated=False))
        .limit(1)
        .select(F.col("id").alias("company_id"), F.col("name").alias("company_name"))
    )
    newest = [F.desc_nulls_first("created_at"), F.asc("id")]

    def items(df: DataFrame, kind: str, label: str, n: int) -> DataFrame:
        mine = df.join(F.broadcast(best), "company_id")
        return mine.orderBy(*newest).limit(n).select(
            "company_id", "company_name", F.lit(kind).alias("item_type"),
            F.col("id").alias("item_id"), F.col(label).alias("label"),
        )

    return items(contacts, "contact", "full_name", n_contacts).unionByName(
        items(interactions, "interaction", "kind", n_interactions)
    )


def _upsert(base: DataFrame, changes: DataFrame, key: str, fields, order: Column) -> DataFrame:
    """Collapse the batch per key, then one full outer join; new values win over stored ones."""
    batch = changes.groupBy(key).agg(
        *[last_set(F.col(f), order).alias(f) for f in fields]
    ).withColumnRenamed(key, "_key")
    batch = batch.select("_key", *[F.col(f).alias(f"_new_{f}") for f in fields])
    joined = base.join(batch, base[key] == F.col("_key"), "full_outer")
    carried = [c for c in base.columns if c not in (key, *fields)]
    return joined.select(
        *[base[c] for c in carried],
        F.coalesce(base[key], "_key").alias(key),
        *[F.coalesce(F.col(f"_new_{f}"), base[f]).alias(f) for f in fields],
        F.col("_key").isNotNull().alias("touched"),
    )


def upsert_companies_legacy(base: DataFrame, changes: DataFrame, order: str = "ord") -> DataFrame:
    """Upsert by normalised name; ``changes`` carries an arrival order column."""
    named = changes.withColumn(
        "normalized_name", F.coalesce(normalize_name_legacy(F.col("name")), F.lit(""))
    )
    return _upsert(base, named, "normalized_name", COMPANY_FIELDS, F.col(order))


def upsert_contacts_legacy(base: DataFrame, changes: DataFrame, order: str = "ord") -> DataFrame:
    """Upsert by address; rows without one are always inserted and skip the join."""
    keyed = F.coalesce("email", F.lit("")) != ""
    merged = _upsert(
        base.filter(F.col("email").isNotNull()), changes.filter(keyed), "email", CONTACT_FIELDS,
        F.col(order),
    )
    stored = base.filter(F.col("email").isNull()).withColumn("touched", F.lit(False))
    fresh = changes.filter(~keyed).select(
        *CONTACT_FIELDS, F.lit(None).cast("string").alias("email"), F.lit(True).alias("touched")
    )
    return merged.unionByName(stored).unionByName(fresh, allowMissingColumns=True)


def append_legacy_rows(base: DataFrame, rows: DataFrame) -> DataFrame:
    return base.unionByName(rows, allowMissingColumns=True)
