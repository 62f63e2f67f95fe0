"""Partner-directory pages: find the profile in the page text, then read its sections."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contactmill.functions.limits import WHOLE, ExtractionLimits, first_lines, shortened
from contactmill import vocab
from contactmill.functions.lines import (
    clean_lines,
    drop,
    first_where,
    head,
    index_where,
    is_one_of,
    line_at,
    list_section,
    no_lines,
    section_after,
    section_text,
    split_comma_items,
    until,
)
from contactmill.functions.text import (
    blank_to_null,
    email_tokens,
    email_value,
    extract_domain,
    extract_phone,
    extract_urls,
    is_host_mail,
    let,
    normalize_website,
)
from contactmill.operators.extraction import _cleanup, partner_tier, record

# --- fixed values: section headers and where each section ends ---------------
CONTACT_STOPS = (
    "Primary location", "Supported locations", "Languages", "Business description",
    "Industries", "Featured work",
)
PRIMARY_STOPS = ("Supported locations", "Languages", "Business description")
SUPPORTED_STOPS = ("Languages", "Business description", "Industries")
LANGUAGE_STOPS = ("About", "Business description", "Industries", "Featured work")
INDUSTRY_STOPS = ("Featured work", "Business description")
SINCE_STOPS = ("Primary location", "Contact information", "Business description")
DESCRIPTION_STOPS = (
    "Plus Partner", "Other services", "More services", "Industries", "Featured work", "Rating",
    "Reviews", "What is Shopify?",
)
SERVICE_STOPS = (
    "More services", "Industries", "Featured work", "Rating", "Reviews",
    "Business description", "Contact information",
)
SERVICES_ON = ("plus partner", "other services", "more services")
SERVICES_OFF = (
    "industries", "featured work", "business description", "contact information", "rating",
    "reviews",
)
WORK_STOPS = (
    "Rating", "Reviews", "What is Shopify?", "Shopify Editions", "Careers", "Investors",
    "Newsroom", "Sustainability", "Developer Docs", "Theme Store", "App Store", "Partners",
    "Affiliates", "Resources", "Terms of Service", "Legal", "Privacy Policy", "Sitemap",
    "Your Privacy Choices",
)


# --- the profile inside the page ----------------------------------------------
def is_noise(line: Column) -> Column:
    """Navigation, footer and signed-in-user lines."""
    low = F.lower(line)
    prefixes = reduce(lambda a, b: a | b, [low.startswith(p) for p in vocab.NAVIGATION_PREFIXES])
    own_mail = low.endswith("gmail.com") & low.rlike(f"^{vocab.EMAIL_PATTERN}$")
    return (
        is_one_of(line, (*vocab.NAVIGATION_LINES, *vocab.FOOTER_LINES))
        | prefixes
        | low.contains(vocab.NAVIGATION_PHRASE)
        | own_mail
    )


def is_rating(line: Column) -> Column:
    """A bare number; the first character saves most lines the pattern."""
    return F.substring(line, 1, 1).between("0", "9") & line.rlike(vocab.RATING_LINE_PATTERN)


def is_review_count(line: Column) -> Column:
    return line.startswith("(") & line.rlike(vocab.REVIEW_LINE_PATTERN)


def is_company_line(line: Column) -> Column:
    low = F.lower(line)
    return ~(
        is_noise(line)
        | is_one_of(line, vocab.NOT_A_COMPANY_LINES)
        | is_one_of(line, vocab.TIER_NAMES)
        | low.startswith("partner since")
        | is_rating(line)
        | is_review_count(line)
        | line.contains("@")
        | low.startswith("http")
        | ~F.length(line).between(2, 80)
    )


def line_kind(line: Column) -> Column:
    """One letter per line: what it tells about a profile."""
    low = F.lower(line)
    return (
        F.when(is_one_of(line, vocab.TIER_NAMES), "T")
        .when(low.startswith("partner since"), "S")
        .when((low == "contact") | low.startswith("contact information"), "C")
        .when(low.startswith(vocab.NAVIGATION_PREFIXES[1]), "P")
        .when(is_rating(line), "R")
        .when(is_review_count(line), "V")
        .when(line == "|", "B")
        .otherwise("-")
    )


def profile_start(lines: Column, kinds: Column, names: Column) -> Column:
    """Position of the first likely company line with two signals in the next eight lines.

    ``kinds`` and ``names`` are strings with one character per line, so each
    look-ahead is a substring test. Without a hit the page starts at line 1.
    """
    def signals(ahead: Column) -> Column:
        tests = [ahead.contains(k) for k in "TSCP"] + [ahead.rlike("RB?V")]
        return reduce(lambda a, b: a + b, [F.when(t, 1).otherwise(0) for t in tests])

    hits = F.filter(
        F.sequence(F.lit(1), F.greatest(F.size(lines), F.lit(1))),
        lambda i: (F.substring(names, i, F.lit(1)) == "1")
        & (signals(F.substring(kinds, i + 1, F.lit(8))) >= 2),
    )
    return F.coalesce(F.try_element_at(hits, F.lit(1)), F.lit(1))


def profile_cut(tail: Column) -> Column:
    """Up to the first footer line, without noise; all of it when everything is noise."""
    def without_noise(page: Column) -> Column:
        kept = F.filter(page, lambda l: ~is_noise(l))
        return let(kept, lambda k: F.when(F.size(k) > 0, k).otherwise(page))

    return let(
        tail, lambda t: let(until(t, lambda l: is_one_of(l, vocab.FOOTER_LINES)), without_noise)
    )


# --- pieces of the profile ------------------------------------------------------
def tier_signals(text: Column, lines: Column, limits: ExtractionLimits = WHOLE) -> Column:
    """Tier, rating and review count: inline, else a tier line with what follows, else a phrase."""
    def values(tier, rating, count) -> Column:
        return F.struct(
            tier.alias("partner_tier"),
            rating.try_cast("double").alias("rating"),
            count.try_cast("long").alias("review_count"),
        )

    def group(n: int) -> Column:
        return F.regexp_extract(text, vocab.TIER_RATING_PATTERN, n)

    none = F.lit(None).cast("string")

    def by_line(at: Column) -> Column:
        def from_ahead(ahead: Column) -> Column:
            counts = F.filter(ahead, is_review_count)
            last = F.try_element_at(counts, F.lit(-1))
            return values(
                F.try_element_at(lines, F.nullif(at, F.lit(0))),
                first_where(ahead, is_rating),
                F.regexp_extract(last, vocab.REVIEW_LINE_PATTERN, 1),
            )

        return F.when(at > 0, let(F.slice(lines, at + 1, F.lit(7)), from_ahead)).otherwise(
            values(partner_tier(text), none, none)
        )

    tiered = index_where(first_lines(lines, limits.tier_lines), lambda l: is_one_of(l, vocab.TIER_NAMES))
    return F.when(text.rlike(vocab.TIER_RATING_PATTERN), values(group(1), group(2), group(3))).otherwise(
        let(tiered, by_line)
    )


def directory_website(text: Column, contact: Column) -> Column:
    """A site in the contact section, else a link, line or bare domain before featured work."""
    def first_site(items: Column) -> Column:
        return F.try_element_at(F.array_compact(F.transform(items, normalize_website)), F.lit(1))

    at = F.locate("featured work", F.lower(text))
    before = F.when(at > 0, F.substring(text, F.lit(1), at - 1)).otherwise(text)
    domains = F.regexp_extract_all(before, F.lit(vocab.DOMAIN_PATTERN), F.lit(1))
    return F.coalesce(
        first_site(contact),
        first_site(extract_urls(before)),
        first_site(clean_lines(before)),
        first_site(domains),
    )


def directory_email(text: Column, contact: Column, website: Column) -> Column:
    """The address on the site's own domain, else the first; markdown links keep their form."""
    def pick(usable: Column) -> Column:
        def on_domain(domain: Column) -> Column:
            return first_where(
                usable,
                lambda k: F.coalesce(
                    F.substring_index(F.lower(email_value(k)), "@", -1) == domain, F.lit(False)
                ),
            )

        return F.coalesce(let(extract_domain(website), on_domain), line_at(usable, 1))

    def usable(tokens: Column) -> Column:
        return F.filter(tokens, lambda k: ~is_host_mail(F.lower(email_value(k))))

    return let(
        email_tokens(F.array_join(contact, "\n")),
        lambda near: let(
            usable(F.when(F.size(near) > 0, near).otherwise(email_tokens(text))), pick
        ),
    )


def partner_since(text: Column, lines: Column, limits: ExtractionLimits = WHOLE) -> Column:
    inline = blank_to_null(F.regexp_extract(text, vocab.PARTNER_SINCE_PATTERN, 1))
    return F.coalesce(inline, section_text(lines, "Partner since", SINCE_STOPS, limits.section_chars))


def directory_description(lines: Column, limits: ExtractionLimits = WHOLE) -> Column:
    """The description section; a short tier line is none; else the lines after the header."""
    def ends(l: Column) -> Column:
        return is_one_of(l, DESCRIPTION_STOPS) | (
            F.lower(l).contains("partner") & l.rlike(r"\d+\.\d+")
        )

    def is_tier(section: Column) -> Column:
        words = F.size(F.regexp_extract_all(section, F.lit(r"\S+"), F.lit(0)))
        return section.rlike(vocab.TIER_RATING_PATTERN) & (words <= 6)

    starts = F.transform(
        lines,
        lambda l, i: (F.lower(l) == "business description")
        & ~F.coalesce(ends(F.try_element_at(lines, i + 2)), F.lit(True)),
    )

    def loose(at: Column) -> Column:
        parts = let(drop(lines, at), lambda rest: until(rest, ends))
        return F.when(at > 0, shortened(F.array_join(parts, " "), limits.section_chars))

    return let(
        section_text(lines, "Business description", DESCRIPTION_STOPS, limits.section_chars),
        lambda section: F.when(section.isNotNull(), F.when(~is_tier(section), section)).otherwise(
            let(F.array_position(starts, F.lit(True)).cast("int"), loose)
        ),
    )


def opening_lines(lines: Column, limits: ExtractionLimits = WHOLE) -> Column:
    """Lines 2 to 4 as a stand-in description, unless they talk about the tier."""
    text = shortened(F.array_join(head(drop(lines, 1), 3), " "), limits.description_chars)
    tiered = text.rlike(vocab.TIER_RATING_PATTERN) | F.lower(F.substring(text, 1, 30)).contains("partner")
    return F.when((F.size(lines) > 1) & ~tiered, text)


def directory_services(lines: Column) -> Column:
    """The other-services section; else everything between service headers and other headers."""
    marks = F.filter(
        F.transform(
            lines,
            lambda l, i: F.struct(
                (i + 1).alias("at"),
                F.when(is_one_of(l, SERVICES_ON), True)
                .when(is_one_of(l, SERVICES_OFF), False)
                .alias("on"),
            ),
        ),
        lambda m: m["on"].isNotNull(),
    )

    def spans(found: Column) -> Column:
        def span(m: Column, j: Column) -> Column:
            end = F.coalesce(F.try_element_at(found, j + 2)["at"], F.size(lines) + 1)
            return F.when(
                m["on"], F.slice(lines, m["at"] + 1, end - m["at"] - 1)
            ).otherwise(no_lines())

        return F.flatten(F.transform(found, span))

    offered = F.filter(
        let(marks, spans),
        lambda l: ~(
            l.startswith("http") | l.contains("@") | F.substring(l, 1, 3).contains("+")
            | (F.length(l) >= 120)
        ),
    )
    return let(
        section_after(lines, "Other services", SERVICE_STOPS),
        lambda section: F.when(F.size(section) > 0, split_comma_items(section)).otherwise(
            F.array_distinct(split_comma_items(offered))
        ),
    )


def featured_work(lines: Column) -> Column:
    """Title/link pairs; description lines close an entry."""
    section = section_after(lines, "Featured work", WORK_STOPS)
    kind = "struct<title:string,url:string,done:array<struct<title:string,url:string>>>"

    def describes(l: Column) -> Column:
        sentence = l.endswith(".") & (
            (F.length(l) > 50) | (F.size(F.regexp_extract_all(l, F.lit(r"\S+"), F.lit(0))) > 12)
        )
        return (F.lower(l) == "view featured work") | (~l.contains("|") & sentence)

    def state(title, url, done) -> Column:
        return F.struct(title.alias("title"), url.alias("url"), done.alias("done"))

    none = F.lit(None).cast("string")

    def step(acc: Column, l: Column) -> Column:
        titled = acc["title"].isNotNull()

        def closed(url: Column) -> Column:
            return F.concat(acc["done"], F.array(F.struct(acc["title"].alias("title"), url.alias("url"))))

        return (
            F.when(describes(l) & titled, state(none, none, closed(acc["url"])))
            .when(describes(l), acc)
            .when(l.startswith("http") & titled, state(none, none, closed(l)))
            .when(l.startswith("http"), state(none, l, acc["done"]))
            .when(titled, state(l, none, closed(acc["url"])))
            .otherwise(state(l, acc["url"], acc["done"]))
        )

    start = F.struct(
        none.alias("title"), none.alias("url"),
        F.array().cast("array<struct<title:string,url:string>>").alias("done"),
    ).cast(kind)

    def finish(acc: Column) -> Column:
        tail = F.array(F.struct(acc["title"].alias("title"), acc["url"].alias("url")))
        return F.when(acc["title"].isNotNull(), F.concat(acc["done"], tail)).otherwise(acc["done"])

    return F.aggregate(section, start, step, finish)


def extract_directory(docs: DataFrame, text: str, out: str, limits: ExtractionLimits = WHOLE) -> DataFrame:
    t = F.col(text)
    docs = docs.withColumn("_s_all", clean_lines(t))
    docs = docs.withColumns(
        {
            "_s_kinds": F.array_join(F.transform("_s_all", line_kind), ""),
            "_s_names": F.array_join(
                F.transform("_s_all", lambda l: F.when(is_company_line(l), "1").otherwise("0")), ""
            ),
        }
    )
    docs = docs.withColumn(
        "_s_start", profile_start(F.col("_s_all"), F.col("_s_kinds"), F.col("_s_names"))
    )
    docs = docs.withColumn("_s_lines", profile_cut(drop(F.col("_s_all"), F.col("_s_start") - 1)))
    lines, page = F.col("_s_lines"), F.col("_s_page")
    docs = docs.withColumns(
        {
            "_s_page": F.array_join(lines, "\n"),
            "_s_contact": section_after(lines, "Contact information", CONTACT_STOPS),
            "_s_places": split_comma_items(list_section(lines, "Supported locations", SUPPORTED_STOPS)),
            "_s_about": directory_description(lines, limits),
            "_s_tier": tier_signals(F.array_join(lines, "\n"), lines, limits),
        }
    )
    docs = docs.withColumn("_s_site", directory_website(page, F.col("_s_contact")))
    docs = docs.withColumn("_s_mail", directory_email(page, F.col("_s_contact"), F.col("_s_site")))
    first = line_at(lines, 1)
    docs = docs.withColumn(
        out,
        record(
            t.isNotNull(),
            company_name=F.when(is_company_line(first), first),
            website=F.col("_s_site"),
            company_email=F.col("_s_mail"),
            company_email_address=F.lower(email_value(F.col("_s_mail"))),
            company_phone=extract_phone(page),
            partner_tier=F.col("_s_tier.partner_tier"),
            rating=F.col("_s_tier.rating"),
            review_count=F.col("_s_tier.review_count"),
            plus_partner_signal=F.lower(page).contains("plus partner"),
            partner_since=partner_since(page, lines, limits),
            primary_location=section_text(lines, "Primary location", PRIMARY_STOPS, limits.section_chars),
            supported_locations=F.col("_s_places"),
            languages=split_comma_items(list_section(lines, "Languages", LANGUAGE_STOPS), ("About",)),
            services=directory_services(lines),
            locations=F.col("_s_places"),
            industries=split_comma_items(list_section(lines, "Industries", INDUSTRY_STOPS)),
            description=F.coalesce(F.col("_s_about"), opening_lines(lines, limits)),
            featured_work=featured_work(lines),
            confidence=F.lit(0.5),
        ),
    )
    return _cleanup(docs, "_s_")
