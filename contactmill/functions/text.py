"""Column functions on names, sites, mail addresses, dates and JSON text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contactmill import vocab


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once per row.

    Catalyst does not share sub-expressions inside lambdas, so a function that
    needs an intermediate result twice binds it through a one-item array.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def computed_once(df: DataFrame, *columns: Column | str) -> DataFrame:
    """Only these columns, computed once per row whatever is filtered later.

    Catalyst copies an expression into every filter on its column, and moves the filter below shuffles; it does
    neither with what a generator returns.
    """
    return df.select(F.inline(F.array(F.struct(*columns))))


def strip(c: Column) -> Column:
    return F.trim(c, F.lit(vocab.WHITE_SPACE))


def blank_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def any_contains(c: Column, words) -> Column:
    """True when any of the literal words is a substring (NULL text is false)."""
    return F.coalesce(reduce(lambda a, b: a | b, [c.contains(w) for w in words]), F.lit(False))


def count_contains(c: Column, words) -> Column:
    return reduce(lambda a, b: a + b, [F.when(c.contains(w), 1).otherwise(0) for w in words])


def keyword_hits(c: Column, words, show=lambda w: w) -> Column:
    """The literal words found in the text, in list order."""
    return F.array_compact(
        F.array(*[F.when(c.contains(w), F.lit(show(w))) for w in words])
    )


def has_text(c: Column) -> Column:
    """Not NULL and not only spaces; never NULL itself."""
    return F.coalesce(F.trim(c) != "", F.lit(False))


# --- names -----------------------------------------------------------------
def normalize_name(c: Column) -> Column:
    kept = F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}_&.\-]+", " ")
    return F.coalesce(F.trim(kept), F.lit(""))


def normalize_name_legacy(c: Column) -> Column:
    collapsed = F.regexp_replace(F.lower(strip(c)), f"[{vocab.SPACE_CLASS}]+", " ")
    return F.when(c != "", collapsed)


def sanitize_company_name(c: Column) -> Column:
    return strip(F.ltrim(c, F.lit(vocab.ZERO_WIDTH)))


def merge_company_name(existing: Column, new: Column) -> Column:
    """The name to store, or NULL for no change.

    A new name that equals the stored one without its first character is a
    paste accident: the stored name stays.
    """
    old, fresh = sanitize_company_name(existing), sanitize_company_name(new)
    clipped = F.lower(fresh) == F.lower(F.substr(old, F.lit(2)))
    return (
        F.when(F.coalesce(fresh, F.lit("")) == "", F.lit(None).cast("string"))
        .when(F.coalesce(old, F.lit("")) == "", fresh)
        .when(clipped, old)
        .otherwise(fresh)
    )


def slugify(c: Column) -> Column:
    dashed = F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-")
    return F.coalesce(blank_to_null(F.trim(dashed, F.lit("-"))), F.lit("unknown"))


# --- sites -----------------------------------------------------------------
def _has_scheme(c: Column) -> Column:
    return c.startswith("http://") | c.startswith("https://")


def extract_domain(c: Column) -> Column:
    """Host part as written (port and user info stay), lower case, no ``www.``."""
    def checked(host: Column) -> Column:
        ipv6 = host.rlike(r"^([^\[\]]*@)?\[[0-9a-f:.]+\](:\d*)?$")
        bracketed = host.contains("[") | host.contains("]")
        return F.when((host != "") & (~bracketed | ipv6), host)

    def of_site(site: Column) -> Column:
        url = F.when(_has_scheme(site), site).otherwise(F.concat(F.lit("https://"), site))
        host = F.regexp_extract(url, "^https?://([^/?#]*)", 1)
        plain = F.regexp_replace(F.lower(host), r"^www\.", "")
        return F.when(site != "", let(plain, checked))

    return let(strip(c), of_site)


def is_company_site(c: Column) -> Column:
    return ~any_contains(F.lower(c), vocab.HOST_SITES)


def normalize_website(c: Column) -> Column:
    """The site's domain; NULL for blanks, platform and profile sites, addresses and phrases."""
    def of_site(site: Column) -> Column:
        linked = _has_scheme(site)
        phrase = site.contains("@") | site.contains(" ")
        return F.when(
            (site != "") & is_company_site(site) & (linked | ~phrase),
            F.coalesce(extract_domain(site), F.when(linked, site).otherwise(F.lower(site))),
        )

    return let(F.rtrim(strip(c), F.lit(".,)")), of_site)


def extract_urls(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(vocab.URL_PATTERN), F.lit(0))


def first_url(c: Column) -> Column:
    hit = blank_to_null(F.regexp_extract(c, vocab.URL_PATTERN, 0))
    return F.rtrim(hit, F.lit(".,)"))


def url_param_tier(url: Column) -> Column:
    """The partner-tier filter in the query string, in any of its three spellings."""
    query = F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)

    def param(name: str) -> Column:
        raw = blank_to_null(F.regexp_extract(query, rf"(?:^|&){name}=([^&]+)", 1))
        return F.coalesce(F.try_url_decode(raw), raw)

    # The parameter's spellings here and above.
    literal = F.when(url.contains("partnerTiers=tier_plus"), F.lit("tier_plus"))
    return F.coalesce(param("partnerTiers"), param("partnertiers"), param("partner_tiers"), literal)


def is_directory_url(url: Column) -> Column:
    # Fixed values.
    return any_contains(F.lower(url), ("partners.shopify.com", "partnertiers="))


# --- mail, phone, profiles --------------------------------------------------
def normalize_email(c: Column) -> Column:
    """Lower-case address out of ``Name <a@b>`` or a markdown link; NULL without ``@``."""
    def unwrapped(text: Column) -> Column:
        inner = F.regexp_extract(text, "<([^>]+@[^>]+)>", 1)
        chosen = let(inner, lambda i: F.when(i != "", i).otherwise(text))
        return strip(F.regexp_replace(chosen, r"\[([^\]]+)\]\([^)]+\)", "$1"))

    def of_text(text: Column) -> Column:
        wrapped = text.contains("<") | text.contains("[")
        mail = F.lower(F.when(wrapped, unwrapped(text)).otherwise(text))
        return let(mail, lambda m: F.when(m.contains("@"), m))

    return let(strip(c), of_text)


def email_domain(c: Column) -> Column:
    return F.substring_index(normalize_email(c), "@", -1)


def is_business_email(c: Column) -> Column:
    personal = ("", *vocab.PERSONAL_EMAIL_DOMAINS)
    return F.coalesce(~email_domain(c).isin(*personal), F.lit(False))


def email_value(token: Column) -> Column:
    """The address inside a markdown mail link, else the trimmed token."""
    linked = vocab.MAILTO_PATTERN.replace("(?i)", "(?i)^", 1)

    def of_text(text: Column) -> Column:
        inner = F.regexp_extract(text, linked, 1)
        return F.when(
            text.startswith("["), let(inner, lambda i: F.when(i != "", i).otherwise(text))
        ).otherwise(text)

    return let(strip(token), of_text)


def email_tokens(c: Column) -> Column:
    """Markdown mail links first, then plain addresses, in text order (with repeats)."""
    links = F.regexp_extract_all(c, F.lit(vocab.MAILTO_PATTERN), F.lit(0))
    plain = F.regexp_extract_all(c, F.lit(vocab.EMAIL_PATTERN), F.lit(0))
    return F.concat(links, plain)


def extract_emails(c: Column) -> Column:
    """Distinct lower-case addresses in first-seen order."""
    return F.array_distinct(F.transform(email_tokens(c), lambda t: F.lower(email_value(t))))


def is_host_mail(mail: Column) -> Column:
    return reduce(lambda a, b: a | b, [mail.endswith(s) for s in vocab.HOST_MAIL_SUFFIXES])


def extract_phone(c: Column) -> Column:
    runs = F.regexp_extract_all(c, F.lit(vocab.PHONE_PATTERN), F.lit(0))
    long_enough = F.filter(
        runs, lambda p: F.length(F.regexp_replace(p, r"[^\p{Nd}]", "")) >= 8
    )
    return strip(F.try_element_at(long_enough, F.lit(1)))


def normalize_linkedin_url(c: Column) -> Column:
    url = F.lower(F.rtrim(strip(c), F.lit("/")))
    return blank_to_null(F.substring_index(url, "?", 1))


# --- dates -----------------------------------------------------------------
def extract_date(c: Column) -> Column:
    return blank_to_null(F.regexp_extract(c, vocab.DATE_PATTERN, 1))


def parse_deadline(c: Column) -> Column:
    """Typed date. ``3/4/2024`` could be two dates and gives NULL; keep the raw text too."""
    text = strip(c)
    numeric = r"^(\d{1,2})[/.-](\d{1,2})[/.-](\d{4}|\d{2})$"
    first = F.regexp_extract(text, numeric, 1).try_cast("int")
    second = F.regexp_extract(text, numeric, 2).try_cast("int")
    year = F.regexp_extract(text, numeric, 3).try_cast("int")
    year = F.when(year < 100, year + 2000).otherwise(year)
    day_first = (first > 12) | (first == second)
    day = F.when(day_first, first).when(second > 12, second)
    month = F.when(day_first, second).when(second > 12, first)
    by_numbers = F.try_to_date(F.concat_ws("-", year, month, day), "y-M-d")
    named = r"(?i)^([a-z]{3})[a-z]*\s+(\d{1,2}),?\s+(\d{4})$"
    by_name = F.try_to_date(
        F.concat_ws(
            " ",
            F.initcap(F.regexp_extract(text, named, 1)),
            F.regexp_extract(text, named, 2),
            F.regexp_extract(text, named, 3),
        ),
        "MMM d yyyy",
    )
    return F.coalesce(
        F.try_to_date(F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}"), F.substring(text, 1, 10)), "yyyy-MM-dd"),
        F.when(day.isNotNull() & month.isNotNull(), by_numbers),
        F.when(text.rlike(named), by_name),
    )


# --- questions and JSON ----------------------------------------------------
def normalize_text(c: Column) -> Column:
    """Lower case with white space collapsed."""
    return strip(F.regexp_replace(F.lower(c), f"[{vocab.SPACE_CLASS}]+", " "))


def normalize_question(c: Column) -> Column:
    lowered = F.replace(F.lower(strip(c)), F.lit(vocab.ZERO_WIDTH[1]), F.lit(""))
    collapsed = F.regexp_replace(lowered, f"[{vocab.SPACE_CLASS}]+", " ")
    return F.rtrim(collapsed, F.lit(".?!,"))


def content_hash(c: Column) -> Column:
    return F.sha2(c, 256)


def _object_text(text: Column) -> Column:
    """The text when it parses as a JSON object, else NULL."""
    value = F.try_parse_json(text)
    return F.when(F.schema_of_variant(value).startswith("OBJECT"), text)


def json_object_text(c: Column) -> Column:
    """Text of the JSON object in a model answer: all of it, or first ``{`` to last ``}``."""
    text = strip(c)
    fenced = text.startswith("```")
    opened = strip(F.regexp_replace(text, "^```(?:json)?", ""))
    bare = F.when(fenced, strip(F.regexp_replace(opened, "```$", ""))).otherwise(text)
    braces = blank_to_null(F.regexp_extract(bare, r"(?s)\{.*\}", 0))
    return F.coalesce(_object_text(bare), _object_text(braces))


def extract_json(c: Column) -> Column:
    return F.try_parse_json(json_object_text(c))


def validate_intent_json(
    c: Column, threshold: float = 0.60, missing_confidence: float = 1.0
) -> Column:
    """Checked intent struct from a model answer; anything doubtful becomes ``unknown``."""
    payload = F.from_json(
        c,
        "intent string, confidence string, limit string, query string, company string, "
        "filters string",
    )
    is_object = _object_text(strip(c)).isNotNull()
    named = F.lower(strip(F.coalesce(payload["intent"], F.lit("unknown"))))
    given = F.when(is_object, payload["confidence"])
    confidence = F.when(given.isNull(), F.lit(missing_confidence)).otherwise(
        F.coalesce(given.try_cast("double"), F.lit(0.0))
    )
    asked = payload["limit"].try_cast("double").try_cast("int")
    limit = F.when(asked.isNull(), 10).otherwise(
        F.greatest(F.lit(1), F.least(F.lit(25), asked))
    )
    sure = is_object & named.isin(*vocab.INTENTS) & (confidence >= threshold)
    filters = F.when(payload["filters"].startswith("{"), payload["filters"])
    return F.struct(
        F.when(sure, named).otherwise("unknown").alias("intent"),
        F.when(is_object, confidence).otherwise(F.lit(0.0)).alias("confidence"),
        F.when(is_object, limit).otherwise(F.lit(10)).alias("limit"),
        F.when(is_object, strip(F.coalesce(payload["query"], F.lit("")))).otherwise("").alias("query"),
        F.when(is_object, strip(F.coalesce(payload["company"], F.lit("")))).otherwise("").alias("company"),
        F.when(is_object, F.coalesce(filters, F.lit("{}"))).otherwise("{}").alias("filters"),
    )
