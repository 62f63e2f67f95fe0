"""File sources and sinks: text lines, cards, JSON maps and logs, model output, CSV."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from contactmill.functions.lines import split_lines
from contactmill.functions.text import blank_to_null, json_object_text, strip
from contactmill.plans.reports import by_rank, leads_with_rollup
from contactmill.sources.tables import Tables

# Field names of the JSON files and the header of the CSV file.
CONTACT = "name string, email string, role string, company string, linkedin string, notes string"
COMPANY = (
    "name string, website string, country string, industry string, fit_score int, "
    "fit_reason string, risks_or_objections array<string>, "
    "recommended_next_action string, priority string"
)
EMAIL = (
    "company string, contact_email string, direction string, status string, subject string, "
    "date string, summary string, next_action string"
)
NOTE = (
    "company string, summary string, open_questions array<string>, "
    "promises_made array<string>, next_action string"
)
OUTPUT_SECTIONS = {
    "companies": COMPANY, "contacts": CONTACT, "emails": EMAIL, "conversation_notes": NOTE,
}
LOG = f"{EMAIL}, logged_at string, source_file string"
CSV_COLUMNS = (
    "id", "company_name", "website", "company_email", "partner_tier", "services", "fit_score",
    "status", "people_count", "has_decision_maker", "last_interaction", "next_deadline",
)


# --- comma lines ---------------------------------------------------------------
def contact_line_key(line: Column) -> Column:
    """The third comma field, else the whole line."""
    fields = F.split(line, ",")
    return F.when(F.size(fields) > 2, strip(F.try_element_at(fields, F.lit(3)))).otherwise(line)


def sort_contact_lines(lines: DataFrame) -> DataFrame:
    """Lines with their fields, in key order (equal keys by line)."""
    fields = F.split("value", ",")
    names = ("name", "email", "company", "role")
    return lines.select(
        "value",
        contact_line_key(F.col("value")).alias("sort_key"),
        *[strip(F.try_element_at(fields, F.lit(i + 1))).alias(n) for i, n in enumerate(names)],
    ).orderBy("sort_key", "value")


def read_contact_lines(spark: SparkSession, path: str) -> DataFrame:
    return sort_contact_lines(spark.read.text(path))


# --- company cards -------------------------------------------------------------
def card_fields(text: Column) -> dict[str, Column]:
    """Title (first line without ``#``) and ``Fit score: N`` of one card."""
    title = strip(F.replace(F.try_element_at(split_lines(text), F.lit(1)), F.lit("#"), F.lit("")))
    score = blank_to_null(F.regexp_extract(text, r"Fit score:\s*(\d+)", 1)).try_cast("int")
    return {"title": title, "fit_score": score}


def write_company_cards(cards: DataFrame, path: str, key: str = "card", text: str = "value") -> None:
    """One text file per key, all in one flat folder; rows of the same key share a file, in the order they come.

    Many tasks write, and no key has a folder of its own: making and listing those takes longer than the cards.
    """
    tasks = cards.sparkSession.sparkContext.defaultParallelism
    dealt = cards.withColumn("_at", F.monotonically_increasing_id()).repartition(tasks, key)
    lines = F.array_sort(F.collect_list(F.struct("_at", F.coalesce(text, F.lit("")).alias("line"))))["line"]
    files = dealt.groupBy(key).agg(F.array_join(lines, "\n").alias("value"))
    files.select("value").write.option("maxRecordsPerFile", 1).text(path)


def read_company_cards(spark: SparkSession, path: str) -> DataFrame:
    """One row per card file: slug (file stem), title, score."""
    files = spark.read.text(path, wholetext=True).select("value", "_metadata.file_name")
    return files.select(
        F.regexp_replace("file_name", r"\.txt$", "").alias("slug"),
        *[c.alias(n) for n, c in card_fields(F.col("value")).items()],
    )


# --- JSON map of contacts --------------------------------------------------------
def explode_contacts_index(docs: DataFrame, text: str = "value") -> DataFrame:
    """``{key: contact}`` documents to rows in key order; values that are no objects are skipped."""
    pairs = docs.select(F.explode(F.from_json(text, "map<string,string>")).alias("key", "_item"))
    objects = pairs.filter(F.col("_item").startswith("{"))
    return objects.select("key", F.from_json("_item", CONTACT).alias("c")).select("key", "c.*").orderBy("key")


def read_contacts_index(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Contacts of index files. With ``lines`` every line is a document of its own, so a
    large index is read by many tasks; else each file is one document."""
    return explode_contacts_index(spark.read.text(path, wholetext=not lines))


# --- e-mail log -------------------------------------------------------------------
def write_email_log(emails: DataFrame, path: str, source_file: str, logged_at: str) -> None:
    """Append JSON lines with the time and source."""
    emails.withColumns(
        {"logged_at": F.lit(logged_at), "source_file": F.lit(source_file)}
    ).write.mode("append").json(path)


def read_email_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(LOG).json(path)


# --- model output ---------------------------------------------------------------
def explode_model_output(docs: DataFrame, text: str = "value", source: str = "source_file") -> dict[str, DataFrame]:
    """One JSON answer per row to four tables; non-lists are empty, non-objects dropped.

    Each row keeps its object in ``item_json``, with any further keys.
    """
    answers = docs.select(source, json_object_text(F.col(text)).alias("_doc"))
    out = {}
    for name, shape in OUTPUT_SECTIONS.items():
        items = F.from_json(F.get_json_object("_doc", f"$.{name}"), "array<string>")
        rows = answers.select(source, F.posexplode(items).alias("item_no", "_item"))
        out[name] = (
            rows.filter(strip(F.col("_item")).startswith("{"))
            .select(source, "item_no", "_item", F.from_json("_item", shape).alias("i"))
            .select(source, "item_no", F.col("_item").alias("item_json"), "i.*")
        )
    return out


def file_counts(docs: DataFrame, text: str = "value", source: str = "source_file") -> DataFrame:
    """How many companies, contacts, emails and notes each document names."""
    doc = F.col("_doc")
    sizes = [
        F.coalesce(
            F.sum(F.size(F.from_json(F.get_json_object(doc, f"$.{name}"), "array<string>"))), F.lit(0)
        ).alias(name)
        for name in OUTPUT_SECTIONS
    ]
    return docs.select(source, json_object_text(F.col(text)).alias("_doc")).groupBy(source).agg(*sizes)


# --- CSV ----------------------------------------------------------------------------
def csv_formula_guard(df: DataFrame) -> DataFrame:
    """Every cell as text; a cell that a spreadsheet would run gets a quote in front."""
    def guarded(name: str) -> Column:
        cell = F.col(name).cast("string")
        return F.coalesce(
            F.when(cell.rlike(r"^[=+\-@]"), F.concat(F.lit("'"), cell)).otherwise(cell), F.lit("")
        ).alias(name)

    return df.select(*[guarded(c) for c in df.columns])


def leads_csv_rows(t: Tables) -> DataFrame:
    rows = leads_with_rollup(t).withColumn("services", F.concat_ws(", ", "services"))
    return rows.select(*CSV_COLUMNS, "updated_at")


def export_leads_csv(t: Tables, path: str) -> None:
    """The lead list as CSV files with a header, in rank order across the files."""
    ordered = leads_csv_rows(t).orderBy(*by_rank()).select(*CSV_COLUMNS)
    csv_formula_guard(ordered).write.mode("errorifexists").csv(
        path, header=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False
    )


