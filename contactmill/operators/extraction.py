"""Pasted text to structured records, one pass over the documents.

Every extractor is a function ``(docs, text, out) -> docs``: it reads the
text column ``text`` (NULL for rows of another source type) and adds a struct
column ``out``. No row is shuffled; intermediate line arrays are columns, so
they are built once per document.
"""

from __future__ import annotations

from functools import partial

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contactmill.functions.limits import WHOLE, ExtractionLimits, first_lines, shortened
from contactmill import vocab
from contactmill.functions.lines import (
    clean_lines,
    drop,
    first_where,
    head,
    line_at,
)
from contactmill.functions.text import (
    any_contains,
    blank_to_null,
    email_domain,
    email_tokens,
    email_value,
    extract_date,
    extract_domain,
    extract_urls,
    first_url,
    is_business_email,
    json_object_text,
    keyword_hits,
    let,
    normalize_email,
    strip,
    url_param_tier,
)

PERSON = "struct<name:string,title:string,department:string,email:string,linkedin_url:string>"
TALK = (
    "struct<subject:string,summary:string,reply_needed:boolean,deadline:string,"
    "next_action:string>"
)
FIELDS = {
    "company_name": "string",
    "website": "string",
    "company_email": "string",
    "company_email_address": "string",
    "company_phone": "string",
    "partner_tier": "string",
    "plus_partner_signal": "boolean",
    "rating": "double",
    "review_count": "long",
    "partner_since": "string",
    "primary_location": "string",
    "supported_locations": "array<string>",
    "languages": "array<string>",
    "services": "array<string>",
    "locations": "array<string>",
    "industries": "array<string>",
    "description": "string",
    "featured_work": "array<struct<title:string,url:string>>",
    "people": f"array<{PERSON}>",
    "interaction": TALK,
    "confidence": "double",
}
Extractor = Callable[[DataFrame, str, str], DataFrame]


def record(present: Column, **fields: Column) -> Column:
    """The common output struct; fields not given are NULL or empty lists."""
    parts = []
    for name, kind in FIELDS.items():
        empty = F.array().cast(kind) if kind.startswith("array") else F.lit(None).cast(kind)
        value = fields[name].cast(kind) if name in fields else empty
        parts.append((F.coalesce(value, empty) if kind.startswith("array") else value).alias(name))
    return F.when(present, F.struct(*parts))


def person(**fields: Column) -> Column:
    names = ("name", "title", "department", "email", "linkedin_url")
    return F.struct(*[fields.get(n, F.lit(None).cast("string")).alias(n) for n in names])


# --- shared pieces -----------------------------------------------------------
def partner_tier(text: Column) -> Column:
    low = F.lower(text)
    found = F.coalesce(*[F.when(low.contains(p.lower()), F.lit(p)) for p in vocab.TIER_PHRASES])
    both = low.contains("plus") & low.contains("partner")
    return F.coalesce(found, F.when(both, "Plus Partner"))


def service_keywords(text: Column) -> Column:
    return keyword_hits(F.lower(text), vocab.SERVICE_KEYWORDS, str.title)


def guess_company_name(lines: Column) -> Column:
    """The first of eight lines that looks like a name, else the first line."""
    def looks_like_name(l: Column) -> Column:
        low = F.lower(l)
        return ~(
            (F.length(l) < 3)
            | low.isin(*vocab.NAME_GUESS_SKIP)
            | (low.contains("partner") & (F.length(l) < 20))
            | l.startswith("http://")
            | l.startswith("https://")
            | l.contains("@")
        )

    return F.coalesce(first_where(head(lines, 8), looks_like_name), line_at(lines, 1))


def _cleanup(docs: DataFrame, tag: str) -> DataFrame:
    return docs.drop(*[c for c in docs.columns if c.startswith(tag)])


# --- extractors --------------------------------------------------------------
def extract_note(docs: DataFrame, text: str, out: str, limits: ExtractionLimits = WHOLE) -> DataFrame:
    t = F.col(text)
    return docs.withColumn(
        out,
        record(
            t.isNotNull(),
            website=first_url(t),
            services=service_keywords(t),
            description=shortened(t, limits.note_chars),
            confidence=F.lit(0.3),
        ),
    )


def extract_website(docs: DataFrame, text: str, out: str, limits: ExtractionLimits = WHOLE) -> DataFrame:
    t, lines = F.col(text), F.col("_w_lines")
    docs = docs.withColumn("_w_lines", clean_lines(t)).withColumn("_w_url", first_url(t))
    name = F.coalesce(guess_company_name(lines), extract_domain(F.col("_w_url")))
    docs = docs.withColumn(
        out,
        record(
            t.isNotNull(),
            company_name=name,
            website=F.col("_w_url"),
            partner_tier=partner_tier(t),
            services=service_keywords(t),
            description=shortened(F.concat_ws(" ", first_lines(lines, limits.opening_lines)), limits.description_chars),
            confidence=F.lit(0.4),
        ),
    )
    return _cleanup(docs, "_w_")


def extract_linkedin_company(docs: DataFrame, text: str, out: str, limits: ExtractionLimits = WHOLE) -> DataFrame:
    t, lines = F.col(text), F.col("_c_lines")
    docs = docs.withColumn("_c_lines", clean_lines(t))
    site = first_where(extract_urls(t), lambda u: ~F.lower(u).contains("linkedin.com"))
    about = shortened(F.concat_ws(" ", first_lines(drop(lines, 1), limits.opening_lines)), limits.description_chars)
    docs = docs.withColumn(
        out,
        record(
            t.isNotNull(),
            company_name=guess_company_name(lines),
            website=F.rtrim(site, F.lit(".,)")),
            partner_tier=partner_tier(t),
            services=service_keywords(t),
            description=F.when(F.size(lines) > 1, about),
            confidence=F.lit(0.45),
        ),
    )
    return _cleanup(docs, "_c_")


def extract_linkedin_person(docs: DataFrame, text: str, out: str, limits: ExtractionLimits = WHOLE) -> DataFrame:
    t, lines = F.col(text), F.col("_p_lines")
    docs = docs.withColumn("_p_lines", clean_lines(t))
    urls = F.regexp_extract_all(t, F.lit(vocab.LINKEDIN_PATTERN), F.lit(0))
    profile = first_where(urls, lambda u: u.contains("/in/") | u.contains("/pub/"))
    employed = first_where(first_lines(drop(lines, 2), limits.employer_lines), lambda l: F.lower(l).contains(" at "))
    company = F.coalesce(
        blank_to_null(strip(F.substring_index(employed, " at ", -1))), line_at(lines, 3)
    )
    who = person(
        name=line_at(lines, 1), title=line_at(lines, 2),
        linkedin_url=F.rtrim(profile, F.lit(".,)")),
    )
    docs = docs.withColumn(
        out,
        record(
            t.isNotNull(),
            company_name=company,
            people=F.when(F.size(lines) > 0, F.array(who)),
            confidence=F.lit(0.5),
        ),
    )
    return _cleanup(docs, "_p_")


def header_people(text: Column, limits: ExtractionLimits = WHOLE) -> Column:
    """Name and address pairs of From/To/Cc/Reply-To lines, one per address."""
    starts = rf"(?i)^[{vocab.SPACE_CLASS}]*(?:" + "|".join(vocab.HEADER_PREFIXES) + "):"
    headers = F.filter(first_lines(F.split(text, vocab.LINE_BREAK), limits.header_lines), lambda l: l.rlike(starts))

    def bare(name: Column) -> Column:
        unquoted = F.trim(F.trim(strip(name), F.lit('"')), F.lit("'"))
        return let(unquoted, lambda n: F.when(n != "", n))

    def parse(rest: Column) -> Column:
        inner = blank_to_null(F.regexp_extract(rest, "<([^>]+@[^>]+)>", 1))
        plain = blank_to_null(F.regexp_extract(rest, vocab.EMAIL_PATTERN, 0))

        def pair(both: Column) -> Column:
            before = F.regexp_extract(rest, "(?s)^(.*?)<[^>]+@[^>]+>", 1)
            name = F.when(both["inner"].isNotNull(), bare(before)).otherwise(
                bare(F.replace(rest, both["plain"], F.lit("")))
            )
            mail = F.coalesce(email_value(both["inner"]), both["plain"])
            return F.struct(name.alias("name"), mail.alias("email"))

        return let(F.struct(inner.alias("inner"), plain.alias("plain")), pair)

    values = F.transform(headers, lambda l: strip(F.regexp_replace(l, "^[^:]*:", "")))
    found = F.filter(F.transform(values, parse), lambda p: p["email"].isNotNull())

    def one_per_address(people: Column) -> Column:
        def first_only(keys: Column) -> Column:
            kept = F.filter(
                people,
                lambda p, i: F.coalesce(
                    F.array_position(keys, F.get(keys, i)) == i + 1, F.lit(False)
                ),
            )
            return F.transform(kept, lambda p: person(name=p["name"], email=p["email"]))

        return let(F.transform(people, lambda p: normalize_email(p["email"])), first_only)

    return let(found, one_per_address)


def title_case(c: Column) -> Column:
    """Upper-case the first letter of each run of letters."""
    runs = F.regexp_extract_all(F.lower(c), F.lit(r"\p{L}+|[^\p{L}]+"), F.lit(0))
    return F.array_join(F.transform(runs, F.initcap), "")


def extract_email_message(docs: DataFrame, text: str, out: str, limits: ExtractionLimits = WHOLE) -> DataFrame:
    t, lines, at = F.col(text), F.col("_e_lines"), F.col("_e_at")
    top = first_lines(lines, limits.subject_lines)
    marks = F.transform(top, lambda l: F.lower(l).startswith("subject:"))
    docs = docs.withColumn("_e_lines", clean_lines(t))
    docs = docs.withColumn("_e_at", F.array_position(marks, F.lit(True)).cast("int"))
    titled = blank_to_null(strip(F.substr(F.try_element_at(lines, F.nullif(at, F.lit(0))), F.lit(9))))
    docs = docs.withColumns(
        {
            "_e_subject": F.coalesce(titled, line_at(lines, 1)),
            "_e_from": F.when(titled.isNotNull(), at).otherwise(F.least(F.lit(1), F.size(lines))),
            "_e_reply": any_contains(F.lower(t), vocab.REPLY_MARKERS),
            "_e_company": first_where(
                F.transform(email_tokens(t), email_value), is_business_email
            ),
        }
    )
    body = F.array_join(drop(lines, F.col("_e_from")), "\n")
    talk = F.struct(
        F.col("_e_subject").alias("subject"),
        blank_to_null(shortened(body, limits.summary_chars)).alias("summary"),
        F.col("_e_reply").alias("reply_needed"),
        extract_date(t).alias("deadline"),
        F.when(F.col("_e_reply"), "Reply to email").alias("next_action"),
    )
    label = F.substring_index(email_domain(F.col("_e_company")), ".", 1)
    docs = docs.withColumn(
        out,
        record(
            t.isNotNull(),
            company_name=title_case(label),
            company_email=F.col("_e_company"),
            company_email_address=normalize_email(F.col("_e_company")),
            people=header_people(t, limits),
            interaction=talk,
            confidence=F.lit(0.55),
        ),
    )
    return _cleanup(docs, "_e_")


def default_extractors(limits: ExtractionLimits = WHOLE) -> dict[str, Extractor]:
    """Extractor per source type; copy and extend the dict to add your own."""
    from contactmill.operators.directory import extract_directory

    own = {
        "shopify_directory": extract_directory,
        "linkedin_company": extract_linkedin_company,
        "linkedin_person": extract_linkedin_person,
        "website": extract_website,
        "email": extract_email_message,
        "note": extract_note,
    }
    return {kind: partial(extract, limits=limits) for kind, extract in own.items()}


def extract_all(raw: DataFrame, extractors: dict[str, Extractor] | None = None) -> DataFrame:
    """Add ``parsed`` by source type (unknown types are notes) and the filter tier.

    Each extractor sees the text only of its own rows, so the documents are
    read once and every row runs one extractor.
    """
    extractors = extractors or default_extractors()
    kind = F.when(F.col("source_type").isin(*extractors), F.col("source_type")).otherwise("note")
    docs = raw
    for name, extractor in extractors.items():
        docs = docs.withColumn("_text", F.when(kind == name, F.col("raw_text")))
        docs = extractor(docs, "_text", f"_parsed_{name}").drop("_text")
    outs = [f"_parsed_{name}" for name in extractors]
    return docs.withColumn("parsed", F.coalesce(*outs)).withColumn(
        "source_filter_tier", url_param_tier(F.col("source_url"))
    ).drop(*outs)


def merge_email_people(parsed: Column, message: Column) -> Column:
    """Model people completed by header people: addresses by equal name, then unseen ones."""
    def filled(p: Column) -> Column:
        same = first_where(
            message["people"],
            lambda h: F.coalesce(F.lower(h["name"]) == F.lower(p["name"]), F.lit(False))
            & (F.coalesce(p["name"], F.lit("")) != ""),
        )
        return F.when(
            F.coalesce(p["email"], F.lit("")) == "",
            person(**{n: p[n] for n in ("name", "title", "department", "linkedin_url")},
                   email=F.coalesce(same["email"], p["email"])),
        ).otherwise(p)

    def completed(people: Column) -> Column:
        def with_unseen(known: Column) -> Column:
            unseen = F.filter(
                message["people"],
                lambda h: ~F.coalesce(
                    F.array_contains(known, normalize_email(h["email"])), F.lit(False)
                ),
            )
            return F.concat(people, unseen)

        addresses = F.transform(people, lambda p: normalize_email(p["email"]))
        return let(F.array_compact(addresses), with_unseen)

    return let(F.transform(parsed["people"], filled), completed)


def resolve_extraction(docs: DataFrame, model_output: str = "model_output") -> DataFrame:
    """Prefer a model's answer over the rules, and say how the record came about.

    ``docs`` has ``parsed`` from ``extract_all`` and a text column with model
    output (NULL or blank when no model ran). A JSON object there is ``ok``;
    unusable text leaves the rules and asks for review; no text is ``fallback``.
    """
    shape = "struct<" + ",".join(f"{n}:{k}" for n, k in FIELDS.items()) + ">"
    docs = docs.withColumn("_object", json_object_text(F.col(model_output)))
    docs = docs.withColumn("_model", F.from_json("_object", shape))
    used = F.col("_object").isNotNull()
    answered = strip(F.coalesce(model_output, F.lit(""))) != ""
    rules, model = F.col("parsed"), F.col("_model")
    is_mail = F.col("source_type") == "email"
    people_kind = FIELDS["people"]
    model_people = F.coalesce(model["people"], F.array().cast(people_kind))
    merged = F.when(
        is_mail, merge_email_people(model.withField("people", model_people), rules)
    ).otherwise(model_people)
    from_model = (
        model.withField("people", merged)
        .withField(
            "company_email",
            F.when(
                is_mail, F.coalesce(blank_to_null(model["company_email"]), rules["company_email"])
            ).otherwise(model["company_email"]),
        )
        .withField(
            "interaction",
            F.when(is_mail, F.coalesce(model["interaction"], rules["interaction"])).otherwise(
                model["interaction"]
            ),
        )
        .withField("confidence", F.coalesce(F.nullif(model["confidence"], F.lit(0.0)), F.lit(0.7)))
    )
    return docs.withColumn("parsed", F.when(used, from_model).otherwise(rules)).withColumns(
        {
            "extraction_status": F.when(used, "ok").when(answered, "needs_review").otherwise("fallback"),
            "confidence": F.coalesce(F.nullif(F.col("parsed.confidence"), F.lit(0.0)), F.lit(0.4)),
        }
    ).drop("_object", "_model")


