"""Schemas of the core tables and how to load them."""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

LEADS = (
    "id long, company_name string, normalized_name string, website string, domain string, "
    "company_email string, company_phone string, partner_tier string, "
    "plus_partner_signal boolean, rating double, review_count long, partner_since string, "
    "primary_location string, supported_locations array<string>, languages array<string>, "
    "featured_work array<struct<title:string,url:string>>, services array<string>, "
    "locations array<string>, industries array<string>, description string, fit_score int, "
    "status string, confidence double, extraction_status string, possible_duplicate boolean, "
    "created_at timestamp, updated_at timestamp"
)
PEOPLE = (
    "id long, lead_id long, name string, title string, department string, seniority string, "
    "email string, linkedin_url string, is_decision_maker boolean, "
    "is_relevant_contact boolean, relevance_reason string, confidence double, "
    "raw_source_id long, created_at timestamp"
)
RAW_SOURCES = (
    "id long, lead_id long, source_type string, source_url string, "
    "source_filter_tier string, raw_text string, parsed_json string, "
    "extraction_status string, confidence double, created_at timestamp"
)
INTERACTIONS = (
    "id long, lead_id long, person_id long, type string, subject string, body string, "
    "summary string, reply_needed boolean, deadline string, priority string, "
    "next_action string, status string, raw_source_id long, created_at timestamp"
)
TASKS = (
    "id long, lead_id long, person_id long, title string, due_date string, priority string, "
    "status string, source_interaction_id long, created_at timestamp"
)
COMMAND_LOG = (
    "id string, command_text string, intent string, tool_name string, "
    "tool_arguments_json string, risk_class string, status string, requires_approval boolean, "
    "approved_at timestamp, result_summary_json string, error_code string, "
    "error_message string, correlation_id string, created_at timestamp, updated_at timestamp"
)
SCHEMAS = {
    "leads": LEADS,
    "people": PEOPLE,
    "raw_sources": RAW_SOURCES,
    "interactions": INTERACTIONS,
    "tasks": TASKS,
    "command_log": COMMAND_LOG,
}
LIST_COLUMNS = (
    "services", "locations", "industries", "supported_locations", "languages",
)
UPGRADE_DEFAULTS = {"plus_partner_signal": False}


@dataclass(frozen=True)
class Tables:
    """The six core tables."""

    leads: DataFrame
    people: DataFrame
    raw_sources: DataFrame
    interactions: DataFrame
    tasks: DataFrame
    command_log: DataFrame | None = None

    def with_(self, **changed: DataFrame) -> Tables:
        return replace(self, **changed)


def struct_of(ddl: str) -> T.StructType:
    return T.StructType.fromDDL(ddl)


def read_tables(spark: SparkSession, root: str) -> Tables:
    """Load the six tables, one folder each, with their fixed schemas."""
    return Tables(
        **{
            name: spark.read.schema(struct_of(ddl)).parquet(f"{root}/{name}")
            for name, ddl in SCHEMAS.items()
        }
    )


def write_tables(tables: Tables, root: str) -> None:
    """Write to a new folder; never onto the folder the tables were read from."""
    for name in SCHEMAS:
        df = getattr(tables, name)
        if df is not None:
            df.write.mode("errorifexists").parquet(f"{root}/{name}")


def upgrade_schema(df: DataFrame, schema: str, defaults: dict | None = None) -> DataFrame:
    """Add missing columns with type and default; other columns keep their place."""
    defaults = UPGRADE_DEFAULTS if defaults is None else defaults
    added = {
        f.name: F.lit(defaults.get(f.name)).cast(f.dataType)
        for f in struct_of(schema)
        if f.name not in df.columns
    }
    return df.withColumns(added) if added else df


def union_versions(*versions: DataFrame) -> DataFrame:
    """Rows of differently aged files of one table."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), versions)


def hydrate_json_columns(leads: DataFrame) -> DataFrame:
    """JSON text columns become arrays; bad, empty or missing JSON becomes ``[]``."""
    kinds = dict.fromkeys(LIST_COLUMNS, "array<string>")
    kinds["featured_work"] = "array<struct<title:string,url:string>>"
    parsed = {
        name: F.coalesce(F.from_json(f"{name}_json", kind), F.array().cast(kind))
        for name, kind in kinds.items()
    }
    flag = F.coalesce(F.col("plus_partner_signal").cast("boolean"), F.lit(False))
    return leads.withColumns({**parsed, "plus_partner_signal": flag}).drop(
        *[f"{name}_json" for name in kinds]
    )
