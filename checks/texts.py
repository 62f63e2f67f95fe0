"""Column functions, each on a real column of a whole table."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.registry import query
from contactmill.functions import lines as L
from contactmill.functions import scoring
from contactmill.functions import text as T
from contactmill.operators import quality

MESSY = """
SELECT c_custkey AS id,
  CASE c_custkey % 8 WHEN 0 THEN concat('  ', c_name, ' & Söhne, GmbH. ') WHEN 1 THEN concat('<zero-width>', c_name)
    WHEN 2 THEN concat(chr(9), c_mktsegment, '   Ünïcode-Name!', chr(160)) WHEN 3 THEN '' WHEN 4 THEN NULL
    WHEN 5 THEN concat('2', c_name, ' Agency') WHEN 6 THEN '***' ELSE upper(c_name) END AS name,
  CASE c_custkey % 8 WHEN 5 THEN concat(c_name, ' AGENCY') WHEN 0 THEN NULL WHEN 1 THEN ' ' ELSE concat('New ', c_name) END AS new_name,
  CASE c_custkey % 10 WHEN 0 THEN concat(' HTTPS://x', c_custkey, '.com/a') WHEN 1 THEN concat('https://www.Shop', c_custkey, '.com:80/p?q=1#f')
    WHEN 2 THEN concat('shop', c_custkey, '.co.uk/about,') WHEN 3 THEN 'https://linkedin.com/in/a' WHEN 4 THEN concat('user@h', c_custkey, '.com')
    WHEN 5 THEN '' WHEN 6 THEN NULL WHEN 7 THEN 'two words.com' WHEN 8 THEN concat('http://u:p@h', c_custkey, '.com?x')
    ELSE 'https:///path' END AS site,
  CASE c_custkey % 7 WHEN 0 THEN concat('Jane <J', c_custkey, '@Biz.example>') WHEN 1 THEN concat('[Info@b', c_custkey, '.com](mailto:info@b.com)')
    WHEN 2 THEN concat(' u', c_custkey, '@GMAIL.com ') WHEN 3 THEN 'no address' WHEN 4 THEN NULL WHEN 5 THEN concat('a@b@c', c_custkey, '.org') ELSE 'x@' END AS mail,
  CASE c_custkey % 5 WHEN 0 THEN concat(' https://LinkedIn.com/in/U', c_custkey, '/ ') WHEN 1 THEN concat('https://linkedin.com/in/u', c_custkey, '/?trk=x')
    WHEN 2 THEN NULL WHEN 3 THEN '/' ELSE concat('linkedin.com/company/c', c_custkey, '?a=b') END AS profile,
  CASE c_custkey % 9 WHEN 0 THEN CAST(DATE '2020-01-01' + CAST(c_custkey % 900 AS INT) AS STRING) WHEN 1 THEN concat(13 + c_custkey % 15, '/', 1 + c_custkey % 12, '/2021')
    WHEN 2 THEN concat(1 + c_custkey % 12, '.', 13 + c_custkey % 15, '.21') WHEN 3 THEN '3/4/2022' WHEN 4 THEN concat('January ', 1 + c_custkey % 28, ', 2023')
    WHEN 5 THEN 'soon' WHEN 6 THEN NULL WHEN 7 THEN '31/31/2020' ELSE '5-5-2024' END AS due,
  CASE c_custkey % 6 WHEN 0 THEN 'https://partners.shopify.com/d?x=1&partnerTiers=tier%20plus&y=2' WHEN 1 THEN 'https://a.b/?partner_tiers=gold#partnerTiers=no'
    WHEN 2 THEN concat('https://a.b/', c_custkey) WHEN 3 THEN 'partnerTiers=tier_plus' WHEN 4 THEN NULL ELSE 'https://a.b/?PARTNERTIERS=x' END AS url
FROM {customer}"""
MESSY = MESSY.replace("<zero-width>", chr(8203) + chr(65279))
TEXTS = """
SELECT doc_id AS id, concat(text, CASE doc_id % 8
  WHEN 0 THEN concat(chr(10), 'Call +1 (555) 010-', 1000 + doc_id, ' or 123-4567, see https://x', doc_id, '.example.com/a).', chr(10), chr(10), 'Due 2024-0', 1 + doc_id % 9, '-15')
  WHEN 1 THEN concat(chr(13), chr(10), '  [Me@Biz', doc_id, '.com](mailto:me@biz.com) me@biz', doc_id, '.com, other@x.org  ')
  WHEN 2 THEN concat(chr(10), 'Industries: Retail, Food', chr(10), 'Beauty, , Toys', chr(10), 'About', chr(10), 'x, y')
  WHEN 3 THEN concat(chr(10), 'Languages', chr(10), chr(10), 'English, French', chr(10), 'German', chr(10), chr(10), 'Later')
  WHEN 4 THEN concat(chr(10), 'We do SEO, Paid Media and migration by Feb 3, 2025 ')
  ELSE '' END) AS text
FROM {documents}"""
WS = "concat(chr(9),chr(10),chr(11),chr(12),chr(13),chr(28),chr(29),chr(30),chr(31),' ',chr(133),chr(160),chr(8195),chr(8232))"
Z = "concat(chr(65279),chr(8203),chr(8204),chr(8205))"
EMAIL = r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"
MAILTO = r"(?i)\[([a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,})\]\(mailto:[^)]+\)"
BREAK = r"\r\n|[\n\r\v\f]"


def st(expr: str) -> str:
    return f"trim({expr}, {WS})"


def messy(body: str) -> str:
    return "WITH m AS (" + MESSY.replace("{customer}", "customer") + ") " + body


def texts(body: str) -> str:
    return "WITH d AS (" + TEXTS.replace("{documents}", "documents") + ") " + body


def on_messy(name: str, column: str, expr: str, fn, cast: str | None = None):
    """One function of one messy column."""
    @query(name, messy(f"SELECT id, {expr} AS result FROM m"))
    def _(v):
        return v.sql(MESSY).select("id", fn(F.col(column)).alias("result"))


def on_text(name: str, expr: str, fn):
    @query(name, texts(f"SELECT id, {expr} AS result FROM d"))
    def _(v):
        return v.texts(TEXTS).select("id", fn(F.col("text")).alias("result"))


# --- names ---------------------------------------------------------------------------
NORM = r"trim(regexp_replace(lower(coalesce({0}, '')), '[^\p{{L}}\p{{N}}_&.\-]+', ' ', 'g'))"
SAN = st(f"ltrim({{0}}, {Z})")
on_messy("normalize_name", "name", NORM.format("name"), T.normalize_name)
on_messy(
    "normalize_name_legacy", "name",
    "CASE WHEN name <> '' THEN regexp_replace(lower(" + st("name") + r"), '[\s\v\p{Z}]+', ' ', 'g') END",
    T.normalize_name_legacy,
)
on_messy("sanitize_company_name", "name", SAN.format("name"), T.sanitize_company_name)
on_messy(
    "slugify", "name",
    "coalesce(nullif(trim(regexp_replace(lower(coalesce(name, '')), '[^a-z0-9]+', '-', 'g'), '-'), ''), 'unknown')",
    T.slugify,
)


@query(
    "merge_company_name",
    messy(f"""SELECT id, CASE WHEN coalesce(n, '') = '' THEN NULL WHEN coalesce(o, '') = '' THEN n
    WHEN lower(n) = lower(substr(o, 2)) THEN o ELSE n END AS result FROM (SELECT id, {SAN.format('name')} AS o, {SAN.format('new_name')} AS n FROM m)"""),
)
def _(v):
    return v.sql(MESSY).select("id", T.merge_company_name(F.col("name"), F.col("new_name")).alias("result"))


# --- sites ---------------------------------------------------------------------------
def domain_sql(c: str) -> str:
    s = st(c)
    return (
        f"CASE WHEN {s} <> '' THEN nullif(regexp_replace(lower(regexp_extract(CASE WHEN starts_with({s}, 'http://') OR starts_with({s}, 'https://') "
        f"THEN {s} ELSE concat('https://', {s}) END, '^https?://([^/?#]*)', 1)), '^www\\.', ''), '') END"
    )


on_messy("extract_domain", "site", domain_sql("site"), T.extract_domain)
CUT = f"rtrim({st('site')}, '.,)')"
HTTP = f"(starts_with({CUT}, 'http://') OR starts_with({CUT}, 'https://'))"
on_messy(
    "normalize_website", "site",
    f"""CASE WHEN coalesce({CUT}, '') = '' OR contains(lower({CUT}), 'shopify.com') OR contains(lower({CUT}), 'linkedin.com') THEN NULL
    WHEN {HTTP} THEN coalesce({domain_sql(CUT)}, {CUT})
    WHEN contains({CUT}, '@') OR contains({CUT}, ' ') THEN NULL ELSE coalesce({domain_sql(CUT)}, lower({CUT})) END""",
    T.normalize_website,
)
on_messy(
    "url_param_tier", "url",
    """CASE id % 6 WHEN 0 THEN 'tier plus' WHEN 1 THEN 'gold' WHEN 3 THEN 'tier_plus' END""",
    T.url_param_tier,
)
on_messy(
    "is_directory_url", "url",
    "coalesce(contains(lower(url), 'partners.shopify.com') OR contains(lower(url), 'partnertiers='), false)",
    T.is_directory_url,
)


# --- mail ----------------------------------------------------------------------------
INNER = f"coalesce(nullif(regexp_extract({st('mail')}, '<([^>]+@[^>]+)>', 1), ''), {st('mail')})"
MAIL = f"lower({st('regexp_replace(' + INNER + chr(44) + ' ' + chr(39) + chr(92) + '[([^' + chr(92) + ']]+)' + chr(92) + ']' + chr(92) + '([^)]+' + chr(92) + ')' + chr(39) + ', ' + chr(39) + chr(92) + '1' + chr(39) + ', ' + chr(39) + 'g' + chr(39) + ')')})"
NMAIL = f"CASE WHEN contains({MAIL}, '@') THEN {MAIL} END"
EDOM = f"list_last(str_split({NMAIL}, '@'))"
on_messy("normalize_email", "mail", NMAIL, T.normalize_email)
on_messy("email_domain", "mail", EDOM, T.email_domain)
on_messy(
    "is_business_email", "mail",
    f"coalesce({EDOM} <> '' AND {EDOM} NOT IN ('gmail.com','googlemail.com','yahoo.com','hotmail.com','outlook.com','live.com','icloud.com','protonmail.com','aol.com'), false)",
    T.is_business_email,
)
on_messy(
    "normalize_linkedin_url", "profile",
    f"nullif(regexp_replace(lower(rtrim({st('profile')}, '/')), '\\?.*$', ''), '')",
    T.normalize_linkedin_url,
)
on_messy(
    "parse_deadline", "due",
    """CASE id % 9 WHEN 0 THEN DATE '2020-01-01' + CAST(id % 900 AS INT)
    WHEN 1 THEN make_date(2021, CAST(1 + id % 12 AS INT), CAST(13 + id % 15 AS INT)) WHEN 2 THEN make_date(2021, CAST(1 + id % 12 AS INT), CAST(13 + id % 15 AS INT))
    WHEN 4 THEN make_date(2023, 1, CAST(1 + id % 28 AS INT)) WHEN 8 THEN DATE '2024-05-05' END""",
    T.parse_deadline,
)


# --- whole texts -----------------------------------------------------------------------
URL = r"(?i)https?://[^\s\v<>\"'']+".replace(r"\"", '"')
on_text("extract_urls", f"array_to_string(regexp_extract_all(text, '{URL}'), ' ')", lambda c: F.array_join(T.extract_urls(c), " "))
on_text("first_url", f"rtrim(nullif(regexp_extract(text, '{URL}'), ''), '.,)')", T.first_url)
TOKENS = f"list_concat(list_transform(regexp_extract_all(text, '{MAILTO}', 1), lambda x: lower(x)), list_transform(regexp_extract_all(text, '{EMAIL}'), lambda x: lower(x)))"
on_text(
    "extract_emails",
    f"array_to_string(list_filter({TOKENS}, lambda x, i: list_position({TOKENS}, x) = i), ' ')",
    lambda c: F.array_join(T.extract_emails(c), " "),
)
PHONE = r"\+?\p{Nd}[\p{Nd}\s\v\p{Z}().-]{7,}\p{Nd}"
on_text(
    "extract_phone",
    f"list_filter(regexp_extract_all(text, '{PHONE}'), lambda p: length(regexp_replace(p, '[^\\p{{Nd}}]', '', 'g')) >= 8)[1]",
    T.extract_phone,
)
DATE = r"(?i)(?:^|[^\p{L}\p{N}_])(\d{4}-\d{2}-\d{2}|\d{1,2}[/.-]\d{1,2}[/.-]\d{2,4}|(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*\s+\d{1,2},?\s+\d{4})(?:$|[^\p{L}\p{N}_])"
on_text("extract_date", f"nullif(regexp_extract(text, '{DATE}', 1), '')", T.extract_date)
on_text("content_hash", "sha256(text)", T.content_hash)
LINES = f"list_filter(list_transform(regexp_split_to_array(text, '{BREAK}'), lambda l: {st('l')}), lambda l: l <> '')"
on_text("clean_lines", f"array_to_string({LINES}, '|')", lambda c: F.array_join(L.clean_lines(c), "|"))
on_text(
    "keyword_hits",
    "array_to_string(list_filter(['store setup','migration','cro','shopify plus','theme','custom development','seo','paid media','email marketing',"
    "'catalog','product management','ongoing support','managed services'], lambda k: contains(lower(text), k)), '|')",
    lambda c: F.array_join(T.keyword_hits(F.lower(c), (
        "store setup", "migration", "cro", "shopify plus", "theme", "custom development", "seo", "paid media",
        "email marketing", "catalog", "product management", "ongoing support", "managed services")), "|"),
)
on_text("truncate", "substr(text, 1, 300)", lambda c: F.substring(c, 1, 300))
PARTS = f"list_filter(flatten(list_transform({LINES}, lambda l: list_transform(str_split(l, ','), lambda p: {st('p')}))), lambda p: p <> '')"
on_text(
    "split_comma_items",
    f"array_to_string(list_slice({PARTS}, 1, coalesce(nullif(list_position(list_transform({PARTS}, lambda p: lower(p)), 'about'), 0) - 1, len({PARTS}))), '|')",
    lambda c: F.array_join(L.split_comma_items(L.clean_lines(c), ("About",)), "|"),
)
on_text(
    "section_after",
    "CASE id % 8 WHEN 3 THEN 'English, French|German' WHEN 2 THEN '' ELSE '' END",
    lambda c: F.array_join(L.section_after(L.split_lines(c), "Languages", ("About",)), "|"),
)
on_text(
    "section_after_inline",
    "CASE id % 8 WHEN 2 THEN 'Retail, Food|Beauty, , Toys' ELSE '' END",
    lambda c: F.array_join(L.section_after(L.split_lines(c), "Industries", ("About",)), "|"),
)


@query(
    "duplicate_intake",
    "SELECT sha256(raw_text) AS content_hash, count(*) AS copies, min(id) AS first_id FROM raw_sources GROUP BY 1 HAVING count(*) > 1",
)
def _(v):
    return quality.duplicate_intake(v.raw_sources)


@query(
    "normalize_question",
    r"""SELECT conv_id, turn, rtrim(regexp_replace(replace(lower(trim(text, concat(chr(9),chr(10),chr(13),' ',chr(160)))), chr(8203), ''), '[\s\v\p{Z}]+', ' ', 'g'), '.?!,') AS q FROM conversations""",
)
def _(v):
    return v.base("conversations").select("conv_id", "turn", T.normalize_question(F.col("text")).alias("q"))


# --- JSON ------------------------------------------------------------------------------
ANSWERS = """
SELECT event_id, CASE event_id % 8 WHEN 0 THEN props WHEN 1 THEN concat('```json', chr(10), props, chr(10), '```')
  WHEN 2 THEN concat('Sure: ', props, ' done') WHEN 3 THEN 'none' WHEN 4 THEN '[1, 2]' WHEN 5 THEN NULL WHEN 6 THEN concat('{', props)
  ELSE concat('  ', props, '  ') END AS answer, props FROM {events}"""


@query(
    "extract_json",
    "WITH a AS (" + ANSWERS.replace("{events}", "events") + ") SELECT event_id, CASE WHEN event_id % 8 IN (0, 1, 2, 7) "
    "THEN CAST(json_extract_string(props, '$.k') AS BIGINT) END AS k FROM a",
)
def _(v):
    found = T.extract_json(F.col("answer"))
    return v.sql(ANSWERS).select("event_id", F.try_variant_get(found, "$.k", "long").alias("k"))


INTENT_ANSWERS = """
SELECT event_id, CASE event_id % 7 WHEN 0 THEN 'not json' WHEN 1 THEN '[]' ELSE concat('{"intent": "', CASE event_id % 3 WHEN 0 THEN ' Top_Leads ' WHEN 1 THEN 'search_leads' ELSE 'drop_table' END,
  '", "confidence": ', CASE event_id % 5 WHEN 0 THEN 'null' WHEN 1 THEN '0.5' WHEN 2 THEN '"0.75"' WHEN 3 THEN '"high"' ELSE '0.6' END,
  ', "limit": ', CASE event_id % 4 WHEN 0 THEN '0' WHEN 1 THEN '30' WHEN 2 THEN '"x"' ELSE '7' END,
  ', "filters": ', CASE event_id % 2 WHEN 0 THEN '{"a": 1}' ELSE '[1]' END, '}') END AS answer FROM {events}"""


@query(
    "validate_intent_json",
    """SELECT event_id, CASE WHEN obj AND conf >= 0.6 AND named <> 'drop_table' THEN named ELSE 'unknown' END AS intent,
CASE WHEN obj THEN conf ELSE 0.0::DOUBLE END AS confidence,
CASE WHEN obj THEN CASE event_id % 4 WHEN 0 THEN 1 WHEN 1 THEN 25 WHEN 2 THEN 10 ELSE 7 END ELSE 10 END AS "limit",
CASE WHEN obj AND event_id % 2 = 0 THEN true ELSE false END AS has_filters
FROM (SELECT event_id, event_id % 7 > 1 AS obj, CASE event_id % 3 WHEN 0 THEN 'top_leads' WHEN 1 THEN 'search_leads' ELSE 'drop_table' END AS named,
CASE event_id % 5 WHEN 0 THEN 1.0::DOUBLE WHEN 1 THEN 0.5::DOUBLE WHEN 2 THEN 0.75::DOUBLE WHEN 3 THEN 0.0::DOUBLE ELSE 0.6::DOUBLE END AS conf FROM events)""",
)
def _(v):
    checked = v.sql(INTENT_ANSWERS).select("event_id", T.validate_intent_json(F.col("answer")).alias("c"))
    return checked.select("event_id", "c.intent", "c.confidence", "c.limit", (F.col("c.filters") != "{}").alias("has_filters"))


# --- scores ----------------------------------------------------------------------------
DM = "['founder','co-founder','cofounder','ceo','managing partner','partner','head of ecommerce','vp ecommerce','director of ecommerce','head of shopify','solutions architect','technical director','growth lead','partnerships','client success','operations']"
REL = "['ecommerce','e-commerce','shopify','cto','coo','president','owner']"


def hits(words: str, text: str) -> str:
    return f"len(list_filter({words}, lambda w: contains({text}, w)))"


TITLE = "lower(trim(coalesce(title, '')))"


@query(
    "classify_title",
    f"""SELECT id, {hits(DM, TITLE)} > 0 AS is_decision_maker, {hits(DM, TITLE)} > 0 OR {hits(REL, TITLE)} > 0 AS is_relevant_contact,
CASE WHEN {hits(DM, TITLE)} > 0 THEN 'title matches decision-maker pattern' WHEN {hits(REL, TITLE)} > 0 THEN 'title matches relevant contact pattern' END AS relevance_reason
FROM people""",
)
def _(v):
    return v.people.select("id", scoring.classify_title(F.col("title")).alias("c")).select("id", "c.*")


PLUS = "['shopify plus','plus partner','plus certified','plus agency']"
SERV = "['website management','store setup','store build','migration','cro','conversion','catalog','product ops','ongoing support','managed services','shopify development','ecommerce development','e-commerce']"
AGENCY = "['agency','partner','studio','consulting','solutions','services']"
ECOM = "['shopify','ecommerce','e-commerce','dtc','direct to consumer']"
GOV = "['catalog','pim','governance','compliance','manual review','product data','merchandising','ops']"
TIER = "lower(coalesce(partner_tier, ''))"
FIT = f"""SELECT id AS lead_id, CAST(greatest(0, least(100,
  CASE WHEN {hits(PLUS, 'b')} > 0 THEN 20 WHEN contains(b, 'plus') THEN 10 ELSE 0 END + least(25, 5 * {hits(SERV, 'b')})
  + CASE WHEN {hits(AGENCY, 'b')} > 0 THEN 15 ELSE 0 END + CASE WHEN coalesce(website, '') <> '' OR coalesce(domain, '') <> '' THEN 10 ELSE 0 END
  + CASE WHEN dm THEN 15 WHEN rel THEN 8 ELSE 0 END + least(15, 5 * {hits(ECOM, 'b')}) + least(10, 3 * {hits(GOV, 'b')})
  + CASE WHEN contains({TIER}, 'plus') THEN 5 ELSE 0 END + CASE WHEN contains({TIER}, 'premier') OR contains({TIER}, 'platinum') THEN 5 ELSE 0 END)) AS INTEGER) AS fit_score
FROM (SELECT *, lower(concat(coalesce(company_name, ''), ' ', coalesce(description, ''), ' ', coalesce(partner_tier, ''), ' ',
  array_to_string(services, ' '), ' ', array_to_string(industries, ' '))) AS b,
  EXISTS (SELECT 1 FROM people p WHERE p.lead_id = l.id AND p.is_decision_maker) AS dm,
  EXISTS (SELECT 1 FROM people p WHERE p.lead_id = l.id AND p.is_relevant_contact) AS rel FROM leads_h l)"""


@query("fit_score", FIT)
def _(v):
    return scoring.fit_score(v.leads, v.people)


@query("write_fit_scores", f"SELECT l.id, f.fit_score, l.status FROM leads l JOIN ({FIT}) f ON f.lead_id = l.id")
def _(v):
    from contactmill.operators.merge import write_fit_scores

    scored = write_fit_scores(v.leads, scoring.fit_score(v.leads, v.people), F.lit("2024-01-01").cast("timestamp"))
    return scored.select("id", "fit_score", "status")


