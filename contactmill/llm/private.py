"""Personal data in stored texts: fixed formats, and identifiers found from their surroundings.

E-mail addresses, IP addresses, card and phone numbers have fixed formats. They are also
the seeds of a search for identifiers without a known format: what stands
before a seed becomes a pattern, patterns and the strings they stand before form a
graph, and scores go back and forth over it a few times. A string that trusted
patterns stand before is taken as an identifier, and then vouches for its other patterns, such
as a key like ``password=`` or the letters it begins with.

Everything is columns and joins; no row leaves the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from contactmill.session import cut_lineage

# The formats. They find what [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+,
# [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+), [0-9]([\x20-]?[0-9])+ and \+[0-9][\x20().0-9-]+[0-9] find.
# A run of characters is entered at its start only and never given back, so long runs cost no more than short ones.
KINDS = ("email", "ip", "card", "phone")
FORMATS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
FOUND = "id"
CODE = r"(?<![A-Za-z0-9_/+-])[A-Za-z_/+-]*+[0-9][A-Za-z0-9_/+-]*+"
# Groups of capitals and digits with one blank or dot between them, and words without a digit behind a key.
GROUPS = r"(?<![A-Za-z0-9_/+.-])[A-Z]{0,4}[0-9][A-Z0-9]{0,5}(?:[\x20.][A-Z0-9]{1,6})*[\x20.](?=[A-Z]*[0-9])[A-Z0-9]{1,6}(?![A-Za-z0-9_/+-])"
WORD = r"(?<![A-Za-z0-9_/+.-])(?<=[\p{L}_]\s{0,3}[=:]\s{0,3}[\"']?)[A-Za-z](?:[A-Za-z_+-]|\.(?=[A-Za-z]))*+(?![A-Za-z0-9_/+-])"
CANDIDATES = {FOUND: (CODE, "[0-9]"), "groups": (GROUPS, r"[0-9][\x20.][A-Z0-9]|[0-9][A-Z]+[\x20.]"), "word": (WORD, r"[\p{L}_]\s*[=:]")}
YEAR = "^(?:1[5-9]|20)[0-9]{2}$"
BYTE = "0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])?"

TAIL = 48
# A string with a digit and of this length is no ordinary word, however often it is used; a shorter one, or
# one without a digit, is ordinary if so many different words stand before it.
MIN_LENGTH = 8
ORDINARY = 3
# A long string of letters and digits in turn, behind a key, looks made by chance: it counts this much for its key before anything is known of it.
CHANCE, CHANCE_LENGTH = 0.75, 16
# A sign and a country code alone.
DIAL = "^[+-][0-9]{1,3}$"


def valid(kind: str, match: Column) -> Column:
    digits = F.regexp_replace(match, "[^0-9]", "")
    if kind == "ip":
        return match.rlike(rf"^(?:{BYTE}\.){{3}}{BYTE}$")
    if kind == "card":
        return F.length(digits).between(12, 19) & F.call_function("luhn_check", digits)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return ~match.rlike(DIAL)


def by_chance(match: Column) -> Column:
    """Whether a string looks drawn at random: long, letters followed by digits more than once, and many different characters."""
    return (
        (F.length(match) >= CHANCE_LENGTH) & (F.regexp_count(match, F.lit("[A-Za-z][0-9]")) >= 2)
        & (F.size(F.array_distinct(F.split(match, ""))) >= CHANCE_LENGTH // 2)
    )


def places(texts: DataFrame, kind: str, pattern: str, prefilter: str) -> DataFrame:
    """``key, kind, at, match, tail, gap``: all matches of a pattern with what stands before each.

    ``gap`` is the number of characters since the match before, ``tail`` the last of them.
    """
    matches = F.regexp_extract_all("raw_text", F.lit(pattern), F.lit(0))
    gaps = F.transform(F.split("raw_text", pattern, -1), lambda g: F.struct(F.length(g).alias("gap"), F.right(g, F.lit(TAIL)).alias("tail")))
    return (
        texts.where(F.col("raw_text").rlike(prefilter))
        .select("key", F.posexplode(F.arrays_zip(matches.alias("match"), gaps.alias("before"))).alias("at", "m"))
        .where(F.col("m.match").isNotNull())
        .select("key", F.lit(kind).alias("kind"), "at", F.col("m.match").alias("match"), F.col("m.before.tail").alias("tail"), F.col("m.before.gap").alias("gap"))
    )


def spans_of(texts: DataFrame) -> DataFrame:
    """``key, kind, match, tail, start, end`` of the valid fixed formats and of all candidates: tokens with a digit, groups of them, words behind a key."""
    parts = [
        places(texts, "email", FORMATS["email"], "@"), places(texts, "ip", FORMATS["ip"], r"[0-9]\.[0-9]"),
        places(texts, "card", FORMATS["card"], "[0-9][ -]?[0-9]"), places(texts, "phone", FORMATS["phone"], r"\+[0-9]"),
        *[places(texts, kind, pattern, prefilter) for kind, (pattern, prefilter) in CANDIDATES.items()],
    ]
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    every = every.distinct()  # repeated rows share a key
    along = Window.partitionBy("key", "kind").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    n = F.length("match")
    end = F.sum(F.col("gap").cast("long") + n).over(along)
    keep = F.lit(False)
    for kind in (*KINDS, *CANDIDATES):
        keep = keep | ((F.col("kind") == kind) & valid(kind, F.col("match")))
    every = every.withColumn("end", end).withColumn("start", F.col("end") - n).where(keep).drop("at", "gap")
    return every.withColumn("kind", F.when(F.col("kind").isin(*CANDIDATES), FOUND).otherwise(F.col("kind")))


def clear_of_formats(spans: DataFrame) -> DataFrame:
    """Codes that touch no span of a fixed format; one pass in order of position, so a text of many codes costs no more for each."""
    fixed = F.col("kind") != FOUND
    order = Window.partitionBy("key").orderBy("start", F.col("kind") == FOUND, "end")
    before = F.max(F.when(fixed, F.col("end"))).over(order.rowsBetween(Window.unboundedPreceding, -1))
    after = F.min(F.when(fixed, F.col("start"))).over(order.rowsBetween(1, Window.unboundedFollowing))
    return spans.withColumns({"_before": before, "_after": after}).where(
        ~fixed & (F.coalesce(F.col("_before"), F.lit(-1)) <= F.col("start")) & (F.coalesce(F.col("_after"), F.lit(1 << 60)) >= F.col("end"))
    ).drop("_before", "_after")


def patterns_of(spans: DataFrame) -> DataFrame:
    """``pattern, match`` for what stands before each string (the word before it and before its key, the key), and the letters it begins with."""
    word = F.lower(F.regexp_extract("tail", r"([\p{L}']+)[^\p{L}']*(?:\s[\p{L}_]+\s*[=:]\s*[\"']?)?$", 1))
    key = F.lower(F.regexp_extract("tail", r"([\p{L}_]+)\s*[=:]\s*[\"']?$", 1))
    begin = F.regexp_extract("match", "^([A-Za-z]{4})", 1)
    named = F.array(
        F.when((word != "") & F.col("tail").rlike(r"(\s|[=:]\s*[\"']?)$"), F.concat(F.lit("word "), word)),
        F.when(key != "", F.concat(F.lit("key "), key)),
        F.when(begin != "", F.concat(F.lit("letters "), begin)),
    )
    return spans.select(F.explode(F.array_compact(named)).alias("pattern"), "match", "kind")


def discovered(spans: DataFrame, codes: DataFrame, rounds: int, trusted: float, min_support: int) -> DataFrame:
    """``match`` of the codes that trusted patterns name.

    Strings of a fixed format count 1; years, and ordinary strings (short or without a digit,
    with ``ORDINARY`` different words before them in the whole table) 0; the rest is unknown and
    counts for a pattern only once found. A string that looks drawn at random counts ``CHANCE`` for the key before it from the
    start, so a kind of identifier needs no other kind to be known by; it is found itself only if a pattern is trusted.
    """
    edges = patterns_of(spans.where(F.col("kind") != FOUND)).unionByName(patterns_of(codes)).select(
        "pattern", "match",
        F.when(F.col("kind") != FOUND, 1.0).when(F.col("match").rlike(YEAR), 0.0).alias("seed"),
    )
    edges = edges.groupBy("pattern", "match").agg(F.max("seed").alias("seed"))
    chance = F.when(F.col("seed").isNull() & F.col("pattern").startswith("key ") & by_chance(F.col("match")), CHANCE)
    edges = cut_lineage(edges.withColumn("prior", F.coalesce(chance, F.lit(0.0))))
    plain = (F.length("match") < MIN_LENGTH) | ~F.col("match").rlike("[0-9]")
    ordinary = edges.where(F.col("seed").isNull() & plain & F.col("pattern").startswith("word ")).groupBy("match").agg(
        F.count("*").alias("words")
    ).where(F.col("words") >= ORDINARY).select("match", F.lit(0.0).alias("ordinary"))
    edges = cut_lineage(edges.join(ordinary, "match", "left").select("pattern", "match", F.coalesce("seed", "ordinary").alias("seed"), "prior"))
    scores = None
    for _ in range(rounds):
        known = edges.withColumn("found", F.lit(0.0)) if scores is None else edges.join(scores, "match", "left")
        known = known.withColumn("score", F.coalesce("seed", F.greatest("found", "prior")))
        good = F.col("score") >= trusted
        strength = known.groupBy("pattern").agg(
            F.sum(F.when(good, F.col("score"))).alias("for"), F.count_if(good).alias("support"), F.count_if(F.col("seed") == 0).alias("against")
        ).where(F.col("support") >= min_support).select(
            "pattern", (F.col("for") / (F.col("for") + F.col("against") + 0.5)).alias("trust")
        ).where(F.col("trust") >= trusted)
        doubt = F.sum(F.log(1.001 - F.col("trust"))) + F.log(1 - F.max("prior"))
        scores = cut_lineage(
            edges.where("seed IS NULL").join(strength, "pattern").groupBy("match").agg((1 - F.exp(doubt)).alias("found"))
        )
    return scores.where(F.col("found") >= trusted).select("match")


def outermost(spans: DataFrame) -> DataFrame:
    """Found spans that lie in no other: a token of a group goes with its group."""
    order = Window.partitionBy("key").orderBy("start", F.desc("end")).rowsBetween(Window.unboundedPreceding, -1)
    return spans.withColumn("_reach", F.max("end").over(order)).where(
        F.col("_reach").isNull() | (F.col("_reach") < F.col("end"))
    ).drop("_reach")


def spans_by_text(texts: DataFrame, rounds: int = 3, trusted: float = 0.6, min_support: int = 3) -> DataFrame:
    """``key, spans`` of the texts (``key, raw_text``) that have any."""
    spans = cut_lineage(spans_of(texts.where(F.col("raw_text").rlike("[0-9@=:]"))).distinct())
    codes = cut_lineage(clear_of_formats(spans))
    named = outermost(codes.join(discovered(spans, codes, rounds, trusted, min_support), "match", "left_semi").select("key", "kind", "start", "end").distinct())
    every = spans.where(F.col("kind") != FOUND).select("key", "kind", "start", "end").unionByName(named.select("key", "kind", "start", "end"))
    rank = F.array_position(F.array(*map(F.lit, (*KINDS, FOUND))), F.col("kind")).cast("int")
    return every.groupBy("key").agg(
        F.array_sort(F.collect_set(F.struct("start", rank.alias("rank"), "kind", "end"))).alias("spans")
    )


def find_private_data(raw_sources: DataFrame, rounds: int = 3, trusted: float = 0.6, min_support: int = 3) -> DataFrame:
    """Personal data of every raw source: ``id, spans``, one row per row of ``id, raw_text``.

    ``spans`` is an array of ``(start, rank, kind, end)`` in order of start, then of kind
    (email, ip, card, phone, id); positions are code points, the end is exclusive. Within a fixed format
    spans are leftmost and do not overlap; matches that fail its test (parts over 255, Luhn,
    number of digits) are dropped. Kind ``id`` marks other identifiers outside all fixed formats, of any
    length: tokens with a digit, groups of capitals and digits with one blank or dot between
    them, and words without a digit behind a key and ``=`` or ``:``, that patterns with a trust of
    ``trusted`` and ``min_support`` known strings name after at most ``rounds`` rounds over the whole table. Strings that look
    drawn at random count for the key before them as if they were known in part. A sign with up to three digits is none.
    Years and short or digit-free strings that follow many different words are none. A null or empty text
    has no spans; repeated rows give repeated rows; other columns are ignored.
    """
    texts = raw_sources.select("id", "raw_text").withColumn("key", F.xxhash64("id", "raw_text"))
    per_text = spans_by_text(texts, rounds, trusted, min_support)
    none = F.array().cast("array<struct<start: bigint, rank: int, kind: string, end: bigint>>")
    return texts.select("id", "key").join(per_text, "key", "left").select("id", F.coalesce("spans", none).alias("spans"))


def mask_private_data(rows: DataFrame, text: str = "raw_text", **options) -> DataFrame:
    """The rows with every span in ``text`` replaced by its kind in angle brackets; a null text stays null.

    All other columns stay. Spans that overlap are replaced together, under the kind of the first.
    ``options`` go to ``find_private_data``.
    """
    keyed = rows.withColumn("_private_key", F.xxhash64(F.col(text)))
    per_text = spans_by_text(keyed.select(F.col("_private_key").alias("key"), F.col(text).alias("raw_text")), **options)
    per_text = per_text.select(F.col("key").alias("_private_key"), F.col("spans").alias("_private_spans"))
    joined = keyed.join(per_text, "_private_key", "left")
    return joined.withColumn(text, masked(F.col(text), F.col("_private_spans"))).select(*[F.col(f"`{c}`") for c in rows.columns])


def masked(text: Column, spans: Column) -> Column:
    """``text`` with its spans (in order) replaced; one pass that keeps the end of what has been written."""
    start = F.struct(F.lit("").alias("done"), F.lit(0).cast("bigint").alias("at"))

    def step(state: Column, span: Column) -> Column:
        between = F.substr(text, (state["at"] + 1).cast("int"), (span["start"] - state["at"]).cast("int"))
        return F.when(span["start"] >= state["at"], F.struct(
            F.concat(state["done"], between, F.lit("<"), span["kind"], F.lit(">")).alias("done"), span["end"].alias("at")
        )).otherwise(F.struct(state["done"].alias("done"), F.greatest(state["at"], span["end"]).alias("at")))

    filled = F.aggregate(spans, start, step)
    rest = F.concat(filled["done"], F.substr(text, (filled["at"] + 1).cast("int")))
    return F.when(spans.isNull() | (F.size(spans) == 0), text).otherwise(rest)
