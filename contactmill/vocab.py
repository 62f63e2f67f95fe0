"""Word lists, enumerations and patterns that define results."""

from __future__ import annotations

# --- fixed values: enumerations -------------------------------------------
SOURCE_TYPES = (
    "shopify_directory", "linkedin_company", "linkedin_person", "website", "email", "note",
)
LEAD_STATUSES = (
    "new", "researching", "qualified", "contacted", "active", "closed", "archived",
)
INACTIVE_STATUSES = ("closed", "archived")
EXTRACTION_STATUSES = ("ok", "needs_review", "fallback")
CONTACT_UPDATE_FIELDS = ("company_email", "company_phone", "website")
MISSING_EMAIL_DEFINITIONS = ("any", "non_rejected", "verified")
PIPELINE_METRICS = (
    "organization_count",
    "contact_coverage_percent",
    "verified_email_coverage_percent",
    "overdue_task_count",
)
MAX_PASTE_CHARS = 200_000

# --- fixed values: command log --------------------------------------------
TERMINAL_STATUSES = ("succeeded", "rejected", "failed")
ALLOWED_TRANSITIONS = {
    "received": ("planned", "rejected", "failed"),
    "planned": ("awaiting_approval", "executing", "rejected", "failed"),
    "awaiting_approval": ("executing", "rejected", "failed"),
    "executing": ("succeeded", "awaiting_approval", "failed"),
    "succeeded": (),
    "rejected": (),
    "failed": (),
}
PROPOSAL_ACTIONS = {
    "propose_create_followup": "create_followup",
    "propose_contact_update": "update_contact_field",
}

# --- fixed values: mail ----------------------------------------------------
PERSONAL_EMAIL_DOMAINS = (
    "gmail.com", "googlemail.com", "yahoo.com", "hotmail.com", "outlook.com",
    "live.com", "icloud.com", "protonmail.com", "aol.com",
)
HOST_MAIL_SUFFIXES = ("shopify.com", "myshopify.com")
HOST_SITES = ("shopify.com", "linkedin.com")
REPLY_MARKERS = (
    "?", "please reply", "let me know", "follow up", "waiting for", "deadline", "asap",
)
HEADER_PREFIXES = ("from", "to", "cc", "reply-to")

# --- fixed values: title classification -----------------------------------
DECISION_MAKER_TITLES = (
    "founder", "co-founder", "cofounder", "ceo", "managing partner", "partner",
    "head of ecommerce", "vp ecommerce", "director of ecommerce", "head of shopify",
    "solutions architect", "technical director", "growth lead", "partnerships",
    "client success", "operations",
)
RELEVANT_TITLE_WORDS = (
    "ecommerce", "e-commerce", "shopify", "cto", "coo", "president", "owner",
)
DECISION_MAKER_REASON = "title matches decision-maker pattern"
RELEVANT_REASON = "title matches relevant contact pattern"

# --- fixed values: fit score ----------------------------------------------
PLUS_PHRASES = ("shopify plus", "plus partner", "plus certified", "plus agency")
SERVICE_PHRASES = (
    "website management", "store setup", "store build", "migration", "cro", "conversion",
    "catalog", "product ops", "ongoing support", "managed services", "shopify development",
    "ecommerce development", "e-commerce",
)
AGENCY_WORDS = ("agency", "partner", "studio", "consulting", "solutions", "services")
ECOMMERCE_WORDS = ("shopify", "ecommerce", "e-commerce", "dtc", "direct to consumer")
GOVERNANCE_WORDS = (
    "catalog", "pim", "governance", "compliance", "manual review", "product data",
    "merchandising", "ops",
)

# --- fixed values: text extraction ----------------------------------------
SERVICE_KEYWORDS = (
    "store setup", "migration", "cro", "shopify plus", "theme", "custom development", "seo",
    "paid media", "email marketing", "catalog", "product management", "ongoing support",
    "managed services",
)
TIER_PHRASES = (
    "Shopify Plus Partner", "Plus Partner", "Premier Partner", "Select Partner",
    "Registered Partner",
)
NAME_GUESS_SKIP = (
    "shopify", "partners", "directory", "services", "about", "home", "linkedin",
)
FOOTER_LINES = (
    "what is shopify?", "shopify editions", "careers", "investors", "newsroom",
    "sustainability", "developer docs", "theme store", "app store", "partners", "affiliates",
    "resources", "terms of service", "legal", "privacy policy", "sitemap",
    "your privacy choices",
)
NAVIGATION_LINES = (
    "skip to content", "shopify", "log out", "help center", "browse", "service partners",
    "hire a professional", "technology solutions",
)
NAVIGATION_PREFIXES = ("search by keyword", "price range for selected services")
NAVIGATION_PHRASE = "shopify partner directory"
NOT_A_COMPANY_LINES = (
    "store setup", "store migration", "store build or redesign", "systems integration",
    "store settings configuration", "product and collection setup", "seo", "cro",
    "paid media", "email marketing", "custom development", "theme customization",
    "united states", "canada", "india", "united kingdom", "australia", "germany", "france",
    "italy", "israel", "view all partner locations", "service partners",
    "hire a professional", "technology solutions", "browse", "contact",
    "contact information", "primary location", "supported locations", "languages",
    "business description", "industries", "featured work", "rating", "reviews", "about",
    "plus partner", "other services", "more services",
)

# --- fixed values: question routing ---------------------------------------
STOP_WORDS = (
    "and", "are", "for", "from", "that", "the", "with", "who", "which", "what", "find",
    "show", "list", "give", "lead", "leads", "agency", "agencies", "company", "companies",
    "koje", "koja", "koji", "rade", "radi", "agencije", "agencija", "kompanije", "klijenti",
    "daj", "nadji", "prikazi", "imamo", "ima", "bazi", "preko", "iznad", "mail", "email",
    "kontakt", "contact",
)
SEARCH_PHRASES = ("product descriptions", "product description", "shopify plus")
INTENTS = (
    "count_leads", "top_leads", "leads_without_contacts", "leads_without_email",
    "followups_due", "summarize_company", "contact_summary", "list_emails", "search_leads",
    "unknown",
)
COUNT_WORDS = ("how many", "koliko", "count", "broj")
COUNT_CONTACT_WORDS = ("email", "contact", "kontakt")
LIST_EMAIL_WORDS = (
    "all email", "list email", "print email", "show email", "email addresses",
    "emails from", "svi email", "prikazi email", "ispisi email",
)
CONTACT_SUMMARY_WORDS = (
    "contact summary", "contact info", "contact information", "available contact",
    "kontakt", "email coverage", "contact overview",
)
NO_EMAIL_WORDS = ("without email", "no email", "missing email", "bez email", "bez maila")
TOP_WORDS = ("top leads", "best leads", "najbolj", "top klijenti", "top leadove")
NO_CONTACT_WORDS = ("without contact", "bez kontakt")
FOLLOW_WORDS = ("follow", "deadline", "rok")
SUMMARY_PREFIXES = (
    "summarize company ", "summary company ", "rezimiraj kompaniju ", "sumiraj kompaniju ",
)
SEARCH_WORDS = (
    "product description", "opis proizvoda", "opisi proizvoda", "seo", "copywriting",
    "content", "email", "mail", "contact", "kontakt",
)
SERVICE_FILTER_WORDS = {
    "product descriptions": ("product description", "opis proizvoda", "opisi proizvoda"),
    "seo": ("seo",),
    "copywriting": ("copywriting", "copy"),
    "content": ("content", "sadrzaj", "sadržaj"),
}

# --- fixed values: characters and patterns --------------------------------
# What Python's str.strip() removes, and what str.splitlines() breaks on.
WHITE_SPACE = "".join(
    chr(c)
    for c in (
        *range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B),
        0x2028, 0x2029, 0x202F, 0x205F, 0x3000,
    )
)
ZERO_WIDTH = "".join(chr(c) for c in (0xFEFF, 0x200B, 0x200C, 0x200D))
SPACE_CLASS = r"\s\x0B\x1C-\x1F\x{85}\p{Z}"
LINE_BREAK = r"\r\n|[\n\r\x0B\f\x1C-\x1E\x{85}\x{2028}\x{2029}]"
# Line breaks with the white space around them; starts only where a run of it starts.
BREAK_WITH_MARGIN = (
    rf"(?<![{SPACE_CLASS}])[{SPACE_CLASS}]*"
    rf"[\n\r\x0B\f\x1C-\x1E\x{{85}}\x{{2028}}\x{{2029}}][{SPACE_CLASS}]*"
)
ZERO_WIDTH_CLASS = r"[\x{FEFF}\x{200B}-\x{200D}]"
URL_PATTERN = rf"(?i)https?://[^{SPACE_CLASS}<>\"']+"
EMAIL_PATTERN = r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"
MAILTO_PATTERN = r"(?i)\[([a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,})\]\(mailto:[^)]+\)"
DOMAIN_PATTERN = (
    rf"(?i)(?:^|[{SPACE_CLASS}])"
    r"((?:[a-zA-Z0-9](?:[a-zA-Z0-9-]{0,61}[a-zA-Z0-9])?\.)+[a-zA-Z]{2,})"
    rf"(?:[{SPACE_CLASS}]|$|[.,)])"
)
PHONE_PATTERN = rf"\+?\p{{Nd}}[\p{{Nd}}{SPACE_CLASS}().-]{{7,}}\p{{Nd}}"
LINKEDIN_PATTERN = rf"(?i)https?://(?:www\.)?linkedin\.com/[^{SPACE_CLASS}<>\"']+"
DATE_PATTERN = (
    r"(?iU)\b(\d{4}-\d{2}-\d{2}|\d{1,2}[/.-]\d{1,2}[/.-]\d{2,4}|"
    r"(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*\s+\d{1,2},?\s+\d{4})\b"
)
TIER_NAMES = (
    "Service partner", "Shopify Plus Partner", "Plus Partner", "Premier Partner",
    "Select Partner", "Registered Partner",
)
TIER_RATING_PATTERN = rf"(?i)({'|'.join(TIER_NAMES)})\s+([\d.]+)\s*\((\d+)\)"
RATING_LINE_PATTERN = r"^\d+(?:\.\d+)?$"
REVIEW_LINE_PATTERN = r"^\((\d+)\)$"
PARTNER_SINCE_PATTERN = r"(?iU)\bPartner since\s+([A-Za-z]+\s+\d{4})\b"
SEARCH_WORD_PATTERN = "[a-z0-9ćčžšđ]+"
