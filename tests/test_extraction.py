"""Golden values of directory pages and short samples."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from contactmill.functions import lines as L
from contactmill.functions import text as T
from contactmill.operators.extraction import extract_all
from contactmill.operators.intake import run_intake
from contactmill.operators.quality import validate_intake
from contactmill.plans import reports

NAV = ["Skip to Content", "Shopify", "Search by keyword...", "Log out", "Help Center", "Browse", "Service partners",
       "Hire a professional", "Technology solutions", "Store setup", "Store migration", "SEO", "United States"]
FOOT = ["What is Shopify?", "Shopify Editions", "Careers", "Privacy Policy", "Sitemap"]


def page(name, tier, rating, reviews, since, contact, place, places, languages, about, services, industries, work, tail=()):
    body = [name, tier, rating, f"({reviews})", "|", f"Partner since {since}", "", "Contact information", *contact, "",
            "Primary location", place, "", "Supported locations", *places, "", "Languages", *languages, "",
            "Business description", about, "", "Plus Partner", "Other services", *services, "", "Industries", *industries,
            "", "Featured work", *work, "", "Rating", rating, f"({reviews})", "Reviews", "Great.", *tail]
    return "\n".join([*NAV, "", *body, "", *FOOT])


LIST_PAGE = page(
    "x-mozo", "Service partner", "5.0", 4, "February 2020",
    ["x-mozo.com", "+972-524788739", "[Hello@x-mozo.com](mailto:Hello@x-mozo.com)"], "yehud, Israel",
    ["Israel", "United States"], ["English", "Hebrew"], "A boutique company for stores of every size.",
    ["Store migration", "Theme customization", "Systems integration"], ["Clothing and fashion", "Health and beauty"],
    ["NOOSH | Soft, Seamless Tights", "Ronen Chen", "B Unique"],
)
COMMA_PAGE = page(
    "Shopvert", "Service partner", "5.0", 58, "March 2019",
    ["shopvert.com", "+971 52 700 94 95", "[info@shopvert.com](mailto:info@shopvert.com)"], "Dubai, United Arab Emirates",
    ["United Arab Emirates, Saudi Arabia, United Kingdom, +45 more"], ["English, French, Arabic", "", "About"],
    "Enterprise-level expertise.", ["Custom apps and integrations, Checkout upgrade, Headless commerce"],
    ["Business to business (B2B), Services"],
    ["Feel22 Website & Mobile Application", "A leading beauty retailer in the region with a strong online presence.",
     "View featured work", "Lacoste", "A brand store redesign for the whole of the Middle East market."],
)


@pytest.fixture(scope="module")
def parsed(spark):
    rows = [
        (1, "shopify_directory", LIST_PAGE), (2, "shopify_directory", COMMA_PAGE),
        (3, "shopify_directory", "\nShero Commerce\nShopify Plus Partner\nhttps://sherocommerce.com\nServices: Store setup\nNew York, USA\n"),
        (4, "linkedin_person", "Jane Doe\nCEO\nHead at Acme\nhttps://www.linkedin.com/in/janedoe\n"),
        (5, "email", "From: \"Jane Doe\" <jane@blinc.design>\nTo: me@gmail.com\nSubject: Hi\n\nplease reply by Jan 5, 2024"),
        (6, "fax", "call https://foo.com.), we do SEO"), (7, "website", ""), (8, "shopify_directory", "  \n \n"),
    ]
    df = spark.createDataFrame(rows, "id long, source_type string, raw_text string").withColumn("source_url", F.lit(None).cast("string"))
    return {r["id"]: r["parsed"] for r in extract_all(df).collect()}


def test_list_page(parsed):
    p = parsed[1]
    assert (p.company_name, p.website, p.company_phone) == ("x-mozo", "x-mozo.com", "+972-524788739")
    assert p.company_email == "[Hello@x-mozo.com](mailto:Hello@x-mozo.com)"
    assert p.company_email_address == "hello@x-mozo.com"
    assert (p.partner_tier, p.plus_partner_signal, p.rating, p.review_count) == ("Service partner", True, 5.0, 4)
    assert (p.partner_since, p.primary_location) == ("February 2020", "yehud, Israel")
    assert p.supported_locations == ["Israel", "United States"] and p.languages == ["English", "Hebrew"]
    assert p.services == ["Store migration", "Theme customization", "Systems integration"]
    assert [w.title for w in p.featured_work] == ["NOOSH | Soft, Seamless Tights", "Ronen Chen", "B Unique"]


def test_comma_page(parsed):
    p = parsed[2]
    assert (p.company_name, p.website, p.company_phone) == ("Shopvert", "shopvert.com", "+971 52 700 94 95")
    assert p.languages == ["English", "French", "Arabic"]
    assert p.supported_locations[-1] == "+45 more"
    assert p.services == ["Custom apps and integrations", "Checkout upgrade", "Headless commerce"]
    assert p.industries == ["Business to business (B2B)", "Services"]
    assert [w.title for w in p.featured_work] == ["Feel22 Website & Mobile Application", "Lacoste"]


def test_short_samples(parsed):
    assert parsed[3].company_name == "Shero Commerce" and parsed[3].website == "sherocommerce.com"
    assert "Plus" in parsed[3].partner_tier and parsed[3].description is None
    assert parsed[4].people[0].name == "Jane Doe" and parsed[4].company_name == "Acme"
    talk = parsed[5].interaction
    assert (talk.subject, talk.reply_needed, talk.deadline, talk.next_action) == ("Hi", True, "Jan 5, 2024", "Reply to email")
    assert [(p.name, p.email) for p in parsed[5].people] == [("Jane Doe", "jane@blinc.design"), (None, "me@gmail.com")]
    assert parsed[5].company_name == "Blinc"
    assert parsed[6].website == "https://foo.com" and parsed[6].services == ["Seo"] and parsed[6].confidence == 0.3
    assert parsed[7].company_name is None and parsed[7].description == ""
    assert parsed[8].company_name is None and parsed[8].services == []


def lines_of(spark, text, fn):
    return spark.createDataFrame([(text,)], "t string").select(fn(F.col("t"))).first()[0]


def test_lines_and_sections(spark):
    assert lines_of(spark, " a \r\n ​b\x0b\xa0 c\x85", L.clean_lines) == ["a", "b", "c"]
    assert lines_of(spark, "﻿\n ​ x", L.clean_lines) == ["﻿", "x"]
    section = lambda t: L.section_after(L.split_lines(t), "Languages", ("About",))
    assert lines_of(spark, "Languages: English\nFrench\n\nGerman", section) == ["English", "French"]
    assert lines_of(spark, "x\nLanguages\n\n\nEnglish\nAbout\ny", section) == ["English"]
    assert lines_of(spark, "Languages\nAbout\ny", section) == []
    assert lines_of(spark, "none", section) == []
    assert lines_of(spark, " " * 5000 + "a" + " " * 5000 + "b\n c", L.clean_lines)[1] == "c"


def test_text_edges(spark):
    cases = [
        (T.normalize_linkedin_url, "https://x/?a", "https://x/"), (T.extract_domain, "https://www.foocorp.com", "foocorp.com"),
        (T.extract_domain, "https://a.com:80/x", "a.com:80"), (T.extract_domain, "https://[bad", None),
        (T.normalize_name, "ACME  Agency (NL)", "acme agency nl"), (T.normalize_name, "Čačak & Söhne", "čačak & söhne"),
        (T.normalize_email, "Jane <J@X.com>", "j@x.com"), (T.extract_phone, "call 123-4567 or +1 (555) 010-9999", "+1 (555) 010-9999"),
        (T.json_object_text, '```json\n{"a": 1}\n```', '{"a": 1}'), (T.json_object_text, "[1]", None),
    ]
    for fn, value, want in cases:
        assert lines_of(spark, value, fn) == want, (fn.__name__, value)


def test_intake_errors(spark):
    rows = [(1, "email", " ", None, ""), (2, "fax", "x", None, ""), (3, "note", "x" * 1001, None, ""),
            (4, "note", "x", "ftp://a.b", ""), (5, "note", "x", None, "999"), (6, "note", "x", None, "a1"), (7, "note", "x", "https://a.b", "1")]
    raw = spark.createDataFrame(rows, "id long, source_type string, raw_text string, source_url string, attach_to_lead_id string")
    leads = spark.createDataFrame([(1,)], "id long")
    got = {r["id"]: r["error_code"] for r in validate_intake(raw, leads, 1000).collect()}
    assert got == {1: "empty_raw_text", 2: "invalid_source_type", 3: "raw_text_too_long", 4: "invalid_source_url",
                   5: "lead_not_found", 6: "invalid_attach_lead_id", 7: None}


def test_intake_end_to_end(spark, empty_tables):
    t0 = datetime(2024, 1, 1)
    rows = [
        (1, "shopify_directory", "https://partners.shopify.com/x?partnerTiers=tier_plus", LIST_PAGE, t0),
        (2, "shopify_directory", None, LIST_PAGE, t0.replace(day=2)),
        (3, "email", None, "From: Ann <ann@x-mozo.com>\nTo: me@gmail.com\nSubject: Deal\n\nCan we talk?", t0.replace(day=3)),
        (4, "email", None, "no addresses here", t0.replace(day=4)),
        (5, "note", None, "just a note", t0.replace(day=5)),
    ]
    raw = spark.createDataFrame(rows, "id long, source_type string, source_url string, raw_text string, created_at timestamp")
    after = run_intake(raw.withColumn("attach_lead_id", F.lit(None).cast("long")), empty_tables)
    leads = {r["id"]: r for r in after.leads.collect()}
    assert [(i, leads[i]["company_name"], leads[i]["domain"]) for i in sorted(leads)] == [
        (1, "x-mozo", "x-mozo.com"), (2, "Unknown (note)", None)]
    assert leads[1]["fit_score"] > 0 and leads[1]["status"] == "new" and leads[1]["services"] == []
    evidence = {r["id"]: (r["lead_id"], r["extraction_status"]) for r in after.raw_sources.collect()}
    assert evidence == {1: (1, "fallback"), 2: (1, "fallback"), 3: (1, "fallback"), 4: (None, "fallback"), 5: (2, "fallback")}
    people = [(p["lead_id"], p["name"], p["email"]) for p in after.people.orderBy("id").collect()]
    assert people == [(1, "Ann", "ann@x-mozo.com"), (1, None, "me@gmail.com")]
    talk = after.interactions.collect()
    assert [(i["lead_id"], i["subject"], i["priority"]) for i in talk] == [(1, "Deal", "high")]
    assert [(k["title"], k["source_interaction_id"]) for k in after.tasks.collect()] == [("Reply to email", talk[0]["id"])]
    assert reports.canonical_source(after.raw_sources).filter("lead_id = 1").first()["id"] == 3
    again = run_intake(
        spark.createDataFrame([(6, "linkedin_company", None, "x-mozo\nhttps://x-mozo.com", t0.replace(day=6))],
                              "id long, source_type string, source_url string, raw_text string, created_at timestamp")
        .withColumn("attach_lead_id", F.lit(None).cast("long")), after)
    assert again.leads.count() == 2 and again.raw_sources.count() == 6


def test_nothing_of_a_text_is_cut_unless_asked(spark):
    from contactmill.functions.limits import SHORT
    from contactmill.operators import extraction

    mail = "\n".join([f"line {i}" for i in range(59)] + ["From: Ann Late <ann@late.example>", "Subject: late", "x" * 5000])
    page = "\n".join(["Late Works"] + [f"about {i}" for i in range(24)] + ["Premier Partner", "4.5", "(7 reviews)", "Business description", "y " * 2500])
    rows = spark.createDataFrame([(1, mail, page, "z" * 1_500_000)], "id long, mail string, page string, note string")

    def fields(kind, text, limits=None):
        made = extraction.default_extractors(*([limits] if limits else []))[kind](rows, text, "p")
        return made.select("p.*").first()

    whole, short = fields("email", "mail"), fields("email", "mail", SHORT)
    assert [p["email"] for p in whole["people"]] == ["ann@late.example"] and not short["people"]
    assert whole["interaction"]["subject"] == "late" and len(whole["interaction"]["summary"]) == 5000
    assert len(short["interaction"]["summary"]) == 300
    whole, short = fields("shopify_directory", "page"), fields("shopify_directory", "page", SHORT)
    assert whole["partner_tier"] == "Premier Partner" and len(whole["description"]) == 4999
    assert len(short["description"]) == 2000
    assert len(fields("note", "note")["description"]) == 1_500_000 and len(fields("note", "note", SHORT)["description"]) == 1000
