"""Extraction from whole texts and from pages rendered out of table rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.registry import query
from checks.texts import BREAK, EMAIL, MAILTO, st
from contactmill.functions import lines as L
from contactmill.operators import directory as D
from contactmill.operators import extraction as E

# A directory page per customer: navigation, profile, sections, footer.
PAGES = """
SELECT *, concat_ws(chr(10), 'Skip to Content', 'Shopify', 'Search by keyword...', '[me@gmail.com](mailto:me@gmail.com)', 'me@gmail.com', 'Log out',
  'Service partners', 'Store setup', 'SEO', 'United States', '', name,
  CASE WHEN id % 3 = 0 THEN concat(tier, ' ', rating_text, ' (', reviews, ')') ELSE concat_ws(chr(10), tier, rating_text, concat('(', reviews, ')')) END,
  '|', CASE WHEN id % 4 = 0 THEN concat_ws(chr(10), 'Partner since', since) ELSE concat('Partner since ', since) END, '',
  CASE WHEN id % 5 = 0 THEN concat_ws(chr(10), 'Contact information', concat('See https://www.', site, '/x).'), mail)
    ELSE concat_ws(chr(10), 'Contact information', site, phone, mail) END, '',
  'Primary location', primary_location, '', 'Supported locations', concat(places, ', +4 more'), '',
  'Languages', CASE WHEN id % 2 = 0 THEN 'English, French' ELSE concat_ws(chr(10), 'English', 'French') END, 'About',
  CASE WHEN id % 7 = 0 THEN 'Nothing' ELSE concat_ws(chr(10), 'Business description', description, 'Second line.') END, 'Plus Partner',
  CASE WHEN id % 6 = 0 THEN concat_ws(chr(10), 'CRO work', '+3 more', 'Migration, Theming') ELSE concat_ws(chr(10), 'Other services', 'SEO, Migration', 'Theming') END,
  'Industries', concat(segment, ', Toys'), 'Featured work', concat('Work ', id), 'https://work.example', 'Shop | A long title with a bar in it that ends with a full stop.',
  'A sentence that describes the work above at some length, so it closes the entry.', 'View featured work', 'Last one',
  'Rating', rating_text, concat('(', reviews, ')'), 'Reviews', 'Great partner.', '', 'What is Shopify?', 'Careers', 'Privacy Policy') AS page
FROM (SELECT c_custkey AS id, concat('Firm ', c_custkey) AS name, CASE c_custkey % 3 WHEN 0 THEN 'Service partner' WHEN 1 THEN 'Premier Partner' ELSE 'Shopify Plus Partner' END AS tier,
  concat(c_custkey % 5, '.5') AS rating_text, c_custkey % 90 AS reviews, concat('March ', 2000 + c_custkey % 20) AS since,
  concat('s', c_custkey, '.example.com') AS site, concat('+381 11 ', 100000 + c_custkey) AS phone,
  CASE c_custkey % 3 WHEN 0 THEN concat('x@other.example, Info@s', c_custkey, '.example.com') WHEN 1 THEN concat('[hi@s', c_custkey, '.example.com](mailto:hi@s.com)')
    ELSE concat('help@shopify.com team', c_custkey, '@agency.example') END AS mail,
  n_name AS primary_location, concat(n_name, ', ', r_name) AS places, concat('We build shops for ', c_mktsegment, ' since ', c_custkey, '.') AS description, c_mktsegment AS segment
  FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey) b"""
PAGES_SQL = PAGES.replace("{customer}", "customer").replace("{nation}", "nation").replace("{region}", "region")

EXPECT = {
    "company_name": "name",
    "website": "CASE WHEN id % 5 = 0 THEN site ELSE site END",
    "company_email": "CASE id % 3 WHEN 0 THEN concat('Info@s', id, '.example.com') WHEN 1 THEN mail ELSE concat('team', id, '@agency.example') END",
    "company_phone": "CASE WHEN id % 5 <> 0 THEN phone END",
    "partner_tier": "tier",
    "plus_partner_signal": "true",
    "rating": "CAST(rating_text AS DOUBLE)",
    "review_count": "CAST(reviews AS BIGINT)",
    "partner_since": "since",
    "primary_location": "primary_location",
    "supported_locations": "replace(concat(places, ', +4 more'), ', ', '|')",
    "languages": "'English|French'",
    "services": "CASE WHEN id % 6 = 0 THEN 'CRO work|Migration|Theming' ELSE 'SEO|Migration|Theming' END",
    "industries": "concat(segment, '|Toys')",
    "description": "CASE WHEN id % 7 <> 0 THEN concat(description, ' Second line.') END",
    "featured_work": "concat('Work ', id, '=https://work.example;Shop | A long title with a bar in it that ends with a full stop.=;Last one=')",
}


def expected(*names: str) -> str:
    return "SELECT id, " + ", ".join(f"{EXPECT[n]} AS {n}" for n in names) + f" FROM ({PAGES_SQL}) p"


def _shown(name: str, c):
    if name in ("supported_locations", "languages", "services", "industries"):
        return F.array_join(c, "|").alias(name)
    if name == "featured_work":
        return F.array_join(
            F.transform(c, lambda w: F.concat(w["title"], F.lit("="), F.coalesce(w["url"], F.lit("")))), ";"
        ).alias(name)
    return c.alias(name)


# The phone scan of a page without a phone line finds nothing; a page's id 0 mod 5 has none.
@query("extract_directory", expected(*EXPECT))
def _(v):
    docs = E.default_extractors()["shopify_directory"](v.texts(PAGES).select("id", "page"), "page", "parsed")
    return docs.select("id", *[_shown(n, F.col(f"parsed.{n}")) for n in EXPECT])


def profile(v):
    """Profile lines of each page, built step by step."""
    docs = v.texts(PAGES).select("id", L.clean_lines(F.col("page")).alias("all"))
    docs = docs.withColumns(
        {
            "kinds": F.array_join(F.transform("all", D.line_kind), ""),
            "names": F.array_join(F.transform("all", lambda l: F.when(D.is_company_line(l), "1").otherwise("0")), ""),
        }
    )
    docs = docs.withColumn("start", D.profile_start(F.col("all"), F.col("kinds"), F.col("names")))
    docs = docs.withColumn("lines", D.profile_cut(L.drop(F.col("all"), F.col("start") - 1)))
    return docs.withColumn("text", F.array_join("lines", "\n")).withColumn(
        "contact", L.section_after(F.col("lines"), "Contact information", D.CONTACT_STOPS)
    )


def piece(key: str, names: list[str], fn):
    @query(key, expected(*names))
    def _(v):
        made = fn(F.col("lines"), F.col("text"), F.col("contact"))
        return profile(v).select("id", *[_shown(n, made[n]) for n in names])


piece("guess_company_name", ["company_name"], lambda l, t, c: {
    "company_name": E.guess_company_name(l)})
piece("extract_tier_signals", ["partner_tier", "rating", "review_count"], lambda l, t, c: {
    n: D.tier_signals(t, l)[n] for n in ("partner_tier", "rating", "review_count")})
piece("extract_website_directory", ["website"], lambda l, t, c: {"website": D.directory_website(t, c)})
piece("extract_email_directory", ["company_email"], lambda l, t, c: {
    "company_email": D.directory_email(t, c, D.directory_website(t, c))})
piece("extract_partner_since", ["partner_since"], lambda l, t, c: {"partner_since": D.partner_since(t, l)})
piece("extract_description", ["description"], lambda l, t, c: {"description": D.directory_description(l)})
piece("extract_list_section", ["supported_locations", "industries"], lambda l, t, c: {
    "supported_locations": L.split_comma_items(L.list_section(l, "Supported locations", D.SUPPORTED_STOPS)),
    "industries": L.split_comma_items(L.list_section(l, "Industries", D.INDUSTRY_STOPS))})
piece("extract_services_directory", ["services"], lambda l, t, c: {"services": D.directory_services(l)})
piece("extract_featured_work", ["featured_work"], lambda l, t, c: {"featured_work": D.featured_work(l)})


@query("profile_start", f"SELECT id, name AS first_line, CAST(11 AS INTEGER) AS start FROM ({PAGES_SQL}) p")
def _(v):
    return profile(v).select("id", L.line_at(F.col("lines"), 1).alias("first_line"), "start")


@query("profile_cut", f"SELECT id, 'Great partner.' AS last_line FROM ({PAGES_SQL}) p")
def _(v):
    return profile(v).select("id", F.try_element_at("lines", F.lit(-1)).alias("last_line"))


NAV = (
    "'skip to content','shopify','log out','help center','browse','service partners','hire a professional','technology solutions',"
    "'what is shopify?','shopify editions','careers','investors','newsroom','sustainability','developer docs','theme store','app store',"
    "'partners','affiliates','resources','terms of service','legal','privacy policy','sitemap','your privacy choices'"
)


@query(
    "line_noise_filter",
    f"""SELECT id, len(k) AS kept, k[1] AS first_line FROM (SELECT id, list_filter(list_filter(list_transform(str_split(page, chr(10)), lambda l: trim(l)), lambda l: l <> ''),
lambda l: NOT (lower(l) IN ({NAV}) OR starts_with(lower(l), 'search by keyword') OR lower(l) LIKE '%shopify partner directory%'
OR (regexp_full_match(l, '{EMAIL}') AND ends_with(lower(l), 'gmail.com')))) AS k FROM ({PAGES_SQL}) p)""",
)
def _(v):
    kept = F.filter(L.clean_lines(F.col("page")), lambda l: ~D.is_noise(l))
    return v.texts(PAGES).select("id", kept.alias("k")).select(
        "id", F.size("k").cast("long").alias("kept"), L.line_at(F.col("k"), 1).alias("first_line")
    )


# --- whole raw texts -----------------------------------------------------------------------
LINES = f"list_filter(list_transform(regexp_split_to_array(raw_text, '{BREAK}'), lambda l: {st('l')}), lambda l: l <> '')"
URL = "(?i)https?://[^\\s\\v<>\"'']+"
FIRST = f"rtrim(nullif(regexp_extract(raw_text, '{URL}'), ''), '.,)')"
TIER = """CASE WHEN contains(lower(raw_text), 'shopify plus partner') THEN 'Shopify Plus Partner' WHEN contains(lower(raw_text), 'plus partner') THEN 'Plus Partner'
WHEN contains(lower(raw_text), 'premier partner') THEN 'Premier Partner' WHEN contains(lower(raw_text), 'select partner') THEN 'Select Partner'
WHEN contains(lower(raw_text), 'registered partner') THEN 'Registered Partner' WHEN contains(lower(raw_text), 'plus') AND contains(lower(raw_text), 'partner') THEN 'Plus Partner' END"""
SERVICES = """array_to_string(list_filter(['Store Setup','Migration','Cro','Shopify Plus','Theme','Custom Development','Seo','Paid Media','Email Marketing','Catalog',
'Product Management','Ongoing Support','Managed Services'], lambda k: contains(lower(raw_text), lower(k))), '|')"""
NAME = """coalesce(list_filter(list_slice(w, 1, 8), lambda l: NOT (length(l) < 3 OR lower(l) IN ('shopify','partners','directory','services','about','home','linkedin')
OR (contains(lower(l), 'partner') AND length(l) < 20) OR starts_with(l, 'http://') OR starts_with(l, 'https://') OR contains(l, '@')))[1], w[1])"""
RAW = f"(SELECT id, raw_text, {LINES} AS w FROM raw_sources)"


def run(v, name: str, *fields: str):
    docs = E.default_extractors()[name](v.raw_texts.select("id", "raw_text"), "raw_text", "parsed")
    return docs.select("id", *[
        (F.array_join(f"parsed.{f}", "|") if f == "services" else F.col(f"parsed.{f}")).alias(f) for f in fields
    ])


@query("extract_note", f"SELECT id, {FIRST} AS website, {SERVICES} AS services, raw_text AS description, 0.3::DOUBLE AS confidence FROM raw_sources")
def _(v):
    return run(v, "note", "website", "services", "description", "confidence")


@query(
    "extract_website",
    f"""SELECT id, coalesce({NAME}, NULL) AS company_name, {FIRST} AS website, {TIER} AS partner_tier, {SERVICES} AS services,
array_to_string(w, ' ') AS description FROM {RAW}""",
)
def _(v):
    return run(v, "website", "company_name", "website", "partner_tier", "services", "description")


@query(
    "extract_linkedin_company",
    f"""SELECT id, {NAME} AS company_name, rtrim(list_filter(regexp_extract_all(raw_text, '{URL}'), lambda u: NOT contains(lower(u), 'linkedin.com'))[1], '.,)') AS website,
CASE WHEN len(w) > 1 THEN array_to_string(list_slice(w, 2, len(w)), ' ') END AS description FROM {RAW}""",
)
def _(v):
    return run(v, "linkedin_company", "company_name", "website", "description")


PROFILES = """
SELECT p_partkey AS id, concat_ws(chr(10), '', p_name, CASE WHEN p_partkey % 2 = 0 THEN 'CEO' ELSE concat('CTO at Brand ', p_partkey) END,
  CASE p_partkey % 4 WHEN 0 THEN 'Lead at X at Firm Z' WHEN 1 THEN 'Firm Y' ELSE 'https://linkedin.com/company/x' END,
  concat('https://www.LinkedIn.com/in/p', p_partkey, ').'), CASE WHEN p_partkey % 4 = 2 THEN concat('Works at ', p_brand) ELSE 'Experience' END) AS raw_text, p_name, p_brand
FROM {part}"""


@query(
    "extract_linkedin_person",
    """SELECT p_partkey AS id, p_name AS name, CASE WHEN p_partkey % 2 = 0 THEN 'CEO' ELSE concat('CTO at Brand ', p_partkey) END AS title,
concat('https://www.LinkedIn.com/in/p', p_partkey) AS linkedin_url,
CASE p_partkey % 4 WHEN 0 THEN 'Firm Z' WHEN 1 THEN 'Firm Y' WHEN 2 THEN p_brand ELSE 'https://linkedin.com/company/x' END AS company_name FROM part""",
)
def _(v):
    docs = E.extract_linkedin_person(v.texts(PROFILES), "raw_text", "parsed")
    p = F.col("parsed.people")[0]
    return docs.select("id", p["name"].alias("name"), p["title"].alias("title"), p["linkedin_url"].alias("linkedin_url"),
                       F.col("parsed.company_name").alias("company_name"))


MAILS = """
SELECT o_orderkey AS id, concat_ws(chr(10), concat('From: "Jane ', o_custkey, '" <Jane', o_custkey, '@Big-shop', o_orderkey % 50, '.example.com>'),
  'To: me <me@gmail.com>, other@gmail.com', concat('Cc: jane', o_custkey, '@big-shop', o_orderkey % 50, '.example.com'), 'Reply-To: desk@x.org',
  CASE WHEN o_orderkey % 4 = 0 THEN 'Subject:' ELSE concat('SUBJECT:  Order ', o_orderkey, ': news ') END, '',
  CASE o_orderkey % 3 WHEN 0 THEN 'Please let me know.' WHEN 1 THEN 'All fine' ELSE 'See you' END,
  CASE WHEN o_orderkey % 5 = 0 THEN concat('by ', CAST(CAST(o_orderdate AS DATE) AS STRING), ', thanks') ELSE 'thanks' END) AS raw_text, o_custkey, o_orderdate
FROM {orders}"""
MAILS_SQL = MAILS.replace("{orders}", "orders")


@query(
    "extract_email_message",
    f"""SELECT id, CASE WHEN id % 4 = 0 THEN str_split(raw_text, chr(10))[1] ELSE concat('Order ', id, ': news') END AS subject,
id % 3 = 0 AS reply_needed, CASE WHEN id % 5 = 0 THEN CAST(CAST(o_orderdate AS DATE) AS VARCHAR) END AS deadline,
concat('Big-Shop', id % 50) AS company_name, concat('Jane', o_custkey, '@Big-shop', id % 50, '.example.com') AS company_email,
concat('Jane ', o_custkey, '<Jane', o_custkey, '@Big-shop', id % 50, '.example.com>;me<me@gmail.com>;<desk@x.org>') AS people FROM ({MAILS_SQL}) m""",
)
def _(v):
    docs = E.extract_email_message(v.texts(MAILS).select("id", "raw_text"), "raw_text", "parsed")
    people = F.array_join(
        F.transform("parsed.people", lambda p: F.concat(F.coalesce(p["name"], F.lit("")), F.lit("<"), p["email"], F.lit(">"))), ";"
    )
    return docs.select(
        "id", "parsed.interaction.subject", "parsed.interaction.reply_needed", "parsed.interaction.deadline",
        "parsed.company_name", "parsed.company_email", people.alias("people"),
    )


AT = "list_filter(list_slice(w, 3, 8), lambda l: contains(lower(l), ' at '))[1]"
PERSONAL = "'gmail.com','googlemail.com','yahoo.com','hotmail.com','outlook.com','live.com','icloud.com','protonmail.com','aol.com'"
HOSTS = f"""list_filter(list_transform(list_concat(regexp_extract_all(raw_text, '{MAILTO}', 1), regexp_extract_all(raw_text, '{EMAIL}')),
lambda m: lower(list_last(str_split(m, '@')))), lambda d: d NOT IN ({PERSONAL}))[1]"""
LABEL = f"str_split({HOSTS}, '.')[1]"


@query(
    "extract_all",
    f"""SELECT id, CASE source_type WHEN 'website' THEN {NAME} WHEN 'linkedin_company' THEN {NAME}
  WHEN 'linkedin_person' THEN coalesce(nullif({st("list_last(str_split(" + AT + ", ' at '))")}, ''), w[3])
  WHEN 'email' THEN concat(upper({LABEL}[1]), {LABEL}[2:]) END AS company_name,
CASE WHEN source_type IN ('note', 'website', 'fax') THEN {FIRST} WHEN source_type = 'linkedin_company' THEN
  rtrim(list_filter(regexp_extract_all(raw_text, '{URL}'), lambda u: NOT contains(lower(u), 'linkedin.com'))[1], '.,)') END AS website,
CASE source_type WHEN 'website' THEN 0.4::DOUBLE WHEN 'linkedin_company' THEN 0.45::DOUBLE WHEN 'linkedin_person' THEN 0.5::DOUBLE
  WHEN 'email' THEN 0.55::DOUBLE ELSE 0.3::DOUBLE END AS confidence
FROM (SELECT id, source_type, raw_text, {LINES} AS w FROM raw_sources)""".replace(
        "concat(upper(", f"CASE WHEN {HOSTS} IS NOT NULL THEN concat(upper(").replace("[2:]) END AS company_name", "[2:]) END END AS company_name"),
)
def _(v):
    docs = E.extract_all(v.raw_texts)
    return docs.select("id", "parsed.company_name", "parsed.website", "parsed.confidence")


MODEL = """
SELECT m.*, CASE id % 4 WHEN 0 THEN NULL WHEN 1 THEN 'sorry, no JSON' WHEN 2 THEN concat('{"company_name": "Model ', id, '", "people": [{"name": "JANE ', o_custkey, '"}]}')
  ELSE concat('```json', chr(10), '{"company_name": "Model ', id, '", "company_email": "m@m.example", "confidence": 0.9}', chr(10), '```') END AS model_output, 'email' AS source_type
FROM (""" + MAILS + ") m"


@query(
    "resolve_extraction",
    f"""SELECT id, CASE WHEN id % 4 = 0 THEN 'fallback' WHEN id % 4 = 1 THEN 'needs_review' ELSE 'ok' END AS extraction_status,
CASE WHEN id % 4 < 2 THEN 0.55::DOUBLE WHEN id % 4 = 2 THEN 0.7::DOUBLE ELSE 0.9::DOUBLE END AS confidence,
CASE WHEN id % 4 < 2 THEN concat('Big-Shop', id % 50) ELSE concat('Model ', id) END AS company_name,
CASE WHEN id % 4 = 3 THEN 'm@m.example' ELSE concat('Jane', o_custkey, '@Big-shop', id % 50, '.example.com') END AS company_email FROM ({MAILS_SQL}) m""",
)
def _(v):
    docs = E.extract_email_message(v.texts(MODEL), "raw_text", "parsed")
    return E.resolve_extraction(docs).select("id", "extraction_status", "confidence", "parsed.company_name", "parsed.company_email")


@query(
    "merge_email_people",
    f"""SELECT id, CASE WHEN id % 4 = 2 THEN concat('JANE ', o_custkey, '<Jane', o_custkey, '@Big-shop', id % 50, '.example.com>;me<me@gmail.com>;<desk@x.org>')
ELSE concat('Jane ', o_custkey, '<Jane', o_custkey, '@Big-shop', id % 50, '.example.com>;me<me@gmail.com>;<desk@x.org>') END AS people FROM ({MAILS_SQL}) m""",
)
def _(v):
    docs = E.resolve_extraction(E.extract_email_message(v.texts(MODEL), "raw_text", "parsed"))
    people = F.array_join(
        F.transform("parsed.people", lambda p: F.concat(F.coalesce(p["name"], F.lit("")), F.lit("<"), p["email"], F.lit(">"))), ";"
    )
    return docs.select("id", people.alias("people"))
