"""Job-title classes and the 0-100 fit score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contactmill import vocab
from contactmill.functions.text import any_contains, count_contains, strip


def classify_title(title: Column) -> Column:
    text = F.lower(strip(title))
    decides = any_contains(text, vocab.DECISION_MAKER_TITLES)
    relevant = decides | any_contains(text, vocab.RELEVANT_TITLE_WORDS)
    return F.struct(
        decides.alias("is_decision_maker"),
        relevant.alias("is_relevant_contact"),
        F.when(decides, F.lit(vocab.DECISION_MAKER_REASON))
        .when(relevant, F.lit(vocab.RELEVANT_REASON))
        .alias("relevance_reason"),
    )


def score_blob() -> Column:
    """Lower-case text the score reads; missing parts leave an empty slot."""
    scalars = [F.coalesce(F.col(c), F.lit("")) for c in ("company_name", "description", "partner_tier")]
    lists = [F.concat_ws(" ", F.col(c)) for c in ("services", "industries")]
    return F.lower(F.concat_ws(" ", *scalars, *lists))


def score_expression(decides: Column, relevant: Column, blob: Column) -> Column:
    """Score from a materialised text column and the per-lead people flags."""
    tier = F.lower(F.coalesce(F.col("partner_tier"), F.lit("")))
    sited = (F.coalesce(F.col("website"), F.lit("")) != "") | (
        F.coalesce(F.col("domain"), F.lit("")) != ""
    )

    def points(test: Column, n: int) -> Column:
        return F.when(test, n).otherwise(0)

    def capped(words, each: int, most: int) -> Column:
        return F.least(F.lit(most), count_contains(blob, words) * each)

    total = (
        F.when(any_contains(blob, vocab.PLUS_PHRASES), 20).when(blob.contains("plus"), 10).otherwise(0)
        + capped(vocab.SERVICE_PHRASES, 5, 25)
        + points(any_contains(blob, vocab.AGENCY_WORDS), 15)
        + points(sited, 10)
        + F.when(decides, 15).when(relevant, 8).otherwise(0)
        + capped(vocab.ECOMMERCE_WORDS, 5, 15)
        + capped(vocab.GOVERNANCE_WORDS, 3, 10)
        + points(tier.contains("plus"), 5)
        + points(tier.contains("premier") | tier.contains("platinum"), 5)
    )
    return F.greatest(F.lit(0), F.least(F.lit(100), total))


def people_flags(people: DataFrame) -> DataFrame:
    return people.groupBy("lead_id").agg(
        F.max(F.coalesce("is_decision_maker", F.lit(False))).alias("_decides"),
        F.max(F.coalesce("is_relevant_contact", F.lit(False))).alias("_relevant"),
    )


def fit_score(leads: DataFrame, people: DataFrame) -> DataFrame:
    """``lead_id, fit_score`` for every lead."""
    flags = people_flags(people).withColumnRenamed("lead_id", "_lead")
    texts = leads.select("id", "website", "domain", "partner_tier", score_blob().alias("_blob"))
    return (
        texts.join(flags, F.col("id") == F.col("_lead"), "left")
        .select(
            F.col("id").alias("lead_id"),
            score_expression(
                F.coalesce("_decides", F.lit(False)),
                F.coalesce("_relevant", F.lit(False)),
                F.col("_blob"),
            ).alias("fit_score"),
        )
    )
