"""Searches for a whole table of questions or names at once.

Both find text by parts of it: of the parts of a few lengths that a text must have to match, the rarest one is a needle's
anchor, so a needle meets only texts that hold its anchor, by an equi-join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from contactmill import vocab
from contactmill.functions.text import normalize_name
from contactmill.operators.numbering import number_rows
from contactmill.plans.search import search_blob, search_terms
from contactmill.session import cut_lineage
from contactmill.sources.tables import Tables

# Lengths of the parts: a needle is found by parts of the longest of these lengths that it has.
GRAMS = (1, 2, 3, 6)
# Tasks per core that cut texts into parts: a small table makes many rows.
DEALT = 4


def _grams(c: Column, n: int) -> Column:
    """All parts of ``n`` characters."""
    cuts = F.transform(F.sequence(F.lit(1), F.length(c) - n + 1), lambda i: F.substr(c, i, F.lit(n)))
    return F.when(F.length(c) >= n, cuts).otherwise(F.array().cast("array<string>"))


def _parts(c: Column, lengths: list[int]) -> Column:
    """Every different part of a text that is as long as one of ``lengths``; one of length 0 is in every text."""
    empty = [F.array(F.lit(""))] if 0 in lengths else []
    return F.array_distinct(F.concat(F.array().cast("array<string>"), *empty, *[_grams(c, n) for n in lengths if n]))


def _needed_parts(c: Column) -> Column:
    """Parts that every text has which a needle matches; ``%`` and ``_`` in the needle are wildcards."""
    pieces = F.filter(F.split(c, "[%_]"), lambda p: p != "")
    steps = [(n, [m for m in GRAMS if m > n]) for n in GRAMS]

    def of(p: Column) -> Column:
        cuts = _grams(p, GRAMS[-1])
        for n, longer in reversed(steps[:-1]):
            cuts = F.when(F.length(p) < longer[0], _grams(p, n)).otherwise(cuts)
        return cuts

    needed = F.array_distinct(F.flatten(F.transform(pieces, of)))
    most = F.array_max(F.transform(needed, F.length))
    return F.when(F.size(needed) > 0, F.filter(needed, lambda p: F.length(p) == most)).otherwise(F.array(F.lit("")))


def anchored_pairs(needles: DataFrame, texts: DataFrame, within: list[str]) -> DataFrame:
    """Rows of ``needles`` (``needle``) and ``texts`` (``text``) that may match, equal in the columns ``within``.

    Every needle that occurs in a text meets it once; so do some that do not, which the caller tests. Needles are
    compared as they are, so both sides should be in lower case; equal needles should be given once. A needle of
    wildcards only meets every text.

    The texts are cut into parts of those lengths only that some needle needs. A part is known by its hash, and is counted
    before it is shuffled; two parts of the same hash only make pairs that the caller's test drops.
    """
    tasks = texts.sparkSession.sparkContext.defaultParallelism
    key = [*within, "_part"]
    known = lambda p: F.xxhash64(p)
    wanted = cut_lineage(needles.withColumn("_part", F.explode(_needed_parts(F.col("needle")))))
    lengths = sorted(r["n"] for r in wanted.select(F.length("_part").alias("n")).distinct().collect())
    wanted = wanted.withColumn("_part", known(F.col("_part")))
    dealt = texts.repartition(tasks * DEALT)
    parts = dealt.withColumn("_part", F.explode(F.transform(_parts(F.col("text"), lengths), known)))
    held = parts.groupBy(*key).agg(F.count("*").alias("_n"))
    rarest = (
        wanted.join(held.hint("merge"), key)
        .groupBy(*within, "needle")
        .agg(F.min_by("_part", F.struct("_n", "_part")).alias("_part"), F.count("*").alias("_held"))
        # A needle of which no text holds some part is in none.
        .join(wanted.groupBy(*within, "needle").agg(F.count("*").alias("_all")).hint("merge"), [*within, "needle"])
        .where(F.col("_held") == F.col("_all")).drop("_held", "_all")
    )
    return parts.join(rarest.hint("merge"), key).drop("_part")


def search_leads_by_names(leads: DataFrame, names: DataFrame, name: str = "name") -> DataFrame:
    """``search_lead_by_name`` for each row of ``names``: its columns with ``lead_id`` and ``company_name``.

    A name matches a lead if the normalised one is part of the lead's ``normalized_name`` or the name as it is of its
    ``company_name``, in any case; ``%`` and ``_`` keep their meaning in LIKE. An empty name matches every lead whose
    compared column is not null; a null name matches none. Equal names are searched once, and repeated rows give
    repeated rows.
    """
    asked = names.select(F.col(name).alias("_name")).where("_name IS NOT NULL").distinct()
    forms = asked.select(
        "_name",
        F.inline(F.array(
            F.struct(F.lit("normalized_name").alias("field"), F.trim(F.regexp_replace(normalize_name(F.col("_name")), r"\s+", " ")).alias("needle")),
            F.struct(F.lit("company_name").alias("field"), F.lower("_name").alias("needle")),
        )),
    )
    fields = ("normalized_name", "company_name")
    texts = leads.select(
        F.col("id").alias("lead_id"),
        F.inline(F.array(*[F.struct(F.lit(f).alias("field"), F.lower(f).alias("text")) for f in fields])),
    ).where("text IS NOT NULL")
    pairs = anchored_pairs(forms.select("field", "needle").distinct(), texts, ["field"])
    like = F.concat(F.lit("%"), F.replace("needle", F.lit("\\"), F.lit("\\\\")), F.lit("%"))
    found = F.when(F.col("needle").rlike("[%_]"), F.like("text", like)).otherwise(F.contains("text", "needle"))
    hits = pairs.where(found).select("field", "needle", "lead_id").join(forms, ["field", "needle"])
    hits = hits.select("_name", "lead_id").distinct()
    named = hits.join(leads.select(F.col("id").alias("lead_id"), F.col("company_name").alias("_company")), "lead_id")
    out = names.join(named, F.col(name) == F.col("_name"))
    return out.select(*[names[c] for c in names.columns], "lead_id", F.col("_company").alias("company_name"))


def _postings(leads: DataFrame, terms: DataFrame) -> DataFrame:
    """Which lead holds which of ``terms`` (``term``) in its search text: ``term, id``, each pair once."""
    blobs = leads.select("id", search_blob().alias("_blob"))
    words = F.array_distinct(F.regexp_extract_all("_blob", F.lit(vocab.SEARCH_WORD_PATTERN), F.lit(0)))
    held = blobs.select("id", F.explode(words).alias("text"))
    # A term is part of the text if it is part of one of its words; different words are far fewer than leads.
    single = terms.where(~F.contains("term", F.lit(" "))).withColumnRenamed("term", "needle")
    meets = anchored_pairs(single, held.select("text").distinct(), []).where(F.contains("text", "needle"))
    by_word = held.join(meets, "text").select(F.col("needle").alias("term"), "id")
    phrases = F.array_compact(F.array(*[F.when(F.contains("_blob", F.lit(p)), F.lit(p)) for p in vocab.SEARCH_PHRASES]))
    by_phrase = blobs.select(F.explode(phrases).alias("term"), "id").join(terms, "term", "left_semi")
    return by_word.unionByName(by_phrase).distinct()


def _level(rank: Column) -> Column:
    """Ranks 1, 2 to 3, 4 to 7 and so on: a list cut at any rank is a few whole levels and part of one."""
    return F.length(F.bin(rank))


def _scored(pairs: DataFrame, asks: DataFrame, postings: DataFrame) -> DataFrame:
    """``ask, rank, score`` of each different pair of ``pairs``."""
    by_lead = postings.groupBy("rank").agg(F.collect_list("term").alias("_held"))
    points = F.aggregate(
        "terms", F.lit(0), lambda s, x: s + F.when(F.array_contains("_held", x["term"]), x["weight"]).otherwise(0)
    )
    return pairs.distinct().join(by_lead, "rank").join(asks, "ask").select("ask", "rank", points.alias("score"))


def _best_leads(asks: DataFrame, postings: DataFrame, limit: int) -> DataFrame:
    """``ask, rank`` with the ``limit`` best leads of each row of ``asks`` (``ask, terms``), and some others.

    The first ``limit`` of each term's list, scored in full, give an ask a least place: a score, and a number for ties. Its most
    frequent terms that together cannot reach that score are not looked up; the next one, if it just reaches it, only
    before that number, in lists cut into levels; only the lists of the rarer ones are read whole.
    """
    wants = asks.select("ask", F.inline("terms"))
    of_term = Window.partitionBy("term").orderBy("rank")
    heads = postings.withColumn("_at", F.row_number().over(of_term)).where(F.col("_at") <= limit).drop("_at")
    first = wants.join(heads, "term").select("ask", "rank")
    best = Window.partitionBy("ask").orderBy(F.desc("score"), "rank")
    last = (
        _scored(first, asks, postings).withColumn("_at", F.row_number().over(best)).where(F.col("_at") == limit)
        .select("ask", F.col("score").alias("_least"), F.col("rank").alias("_before"))
    )
    # An ask without such a place has all its lists in the heads already.
    sizes = postings.groupBy("term").agg(F.count("*").alias("_n"))
    frequent = Window.partitionBy("ask").orderBy(F.desc("_n"), "term").rowsBetween(Window.unboundedPreceding, 0)
    needs = wants.join(sizes, "term").withColumn("_reach", F.sum("weight").over(frequent)).join(last, "ask")
    whole = needs.where(F.col("_reach") > F.col("_least")).select("ask", "term").join(postings, "term").select("ask", "rank")
    cut = needs.where(F.col("_reach") == F.col("_least"))
    cut = cut.select("ask", "term", "_before", F.explode(F.sequence(F.lit(1), _level(F.col("_before")))).alias("_level"))
    ahead = cut.join(postings.withColumn("_level", _level(F.col("rank"))), ["term", "_level"])
    ahead = ahead.where(F.col("rank") < F.col("_before")).select("ask", "rank")
    rows = _scored(first.unionByName(whole).unionByName(ahead), asks, postings)
    return rows.withColumn("_at", F.row_number().over(best)).where(F.col("_at") <= limit).select("ask", "rank")


# A term is shared if more than so many leads hold it and more than so many questions ask for it.
LONG_LIST, OFTEN = 1024, 16


def search_leads_by_questions(
    t: Tables, questions: DataFrame, limit: int = 10, key: str = "id", text: str = "text"
) -> DataFrame:
    """The ``limit`` best leads for each row of ``questions``: ``query_id, place, lead_id, company_name, score``.

    Same scores, order and rows as ``search_leads_many``; a question without telling words (null or empty, too) gets
    the first leads of the order, one whose words no lead holds gets none. Questions with the same words are answered once.

    Leads are numbered in the order that breaks ties, and every asked term gets the list of leads that hold it. Lists of terms
    that few leads hold or few questions ask for are read whole for each question. The others are shared: questions with the
    same shared terms and weights form one group, and of leads with the same shared terms only the first ``limit`` can be
    among the best of a group. A lead that holds none of a question's other terms is among its best only if it is
    among the ``limit`` best of the group, so these and the lists read whole, scored in full, hold the answer.
    """
    found = search_terms(F.coalesce(text, F.lit("")))
    asked = cut_lineage(
        questions.select(F.col(key).alias("query_id"), F.array_sort(found).alias("_found"))
        .select("query_id", "_found", F.array_join("_found", "\n").alias("ask"))
    )
    weights = F.transform(
        F.array_distinct("_found"),
        lambda w: F.struct(
            w.alias("term"),
            (F.size(F.filter("_found", lambda x: x == w)) * F.when(F.contains(w, F.lit(" ")), 3).otherwise(1)).alias("weight"),
        ),
    )
    asks = asked.groupBy("ask").agg(F.first("_found").alias("_found")).select("ask", weights.alias("terms"))
    wants = asks.select("ask", F.inline("terms"))

    order = [F.desc(F.coalesce("fit_score", F.lit(0))), F.asc(F.lower(F.coalesce("company_name", F.lit("")))), F.asc("id")]
    ranked = cut_lineage(number_rows(t.leads.select("id", "company_name", "fit_score"), order, "rank"))
    postings = cut_lineage(
        _postings(t.leads, wants.select("term").distinct()).join(ranked.select("id", "rank"), "id").select("term", "rank")
    )
    held_by = postings.groupBy("term").agg(F.count("*").alias("_leads"))
    asked_by = wants.groupBy("term").agg(F.count("*").alias("_asks"))
    kinds = cut_lineage(
        asked_by.join(held_by, "term").select("term", ((F.col("_leads") > LONG_LIST) & (F.col("_asks") > OFTEN)).alias("_shared"))
    )
    placed = cut_lineage(wants.join(kinds, "term"))
    own = placed.where(~F.col("_shared")).select("ask", "term").join(postings, "term").select("ask", "rank")

    in_group = placed.where("_shared").groupBy("ask").agg(F.array_sort(F.collect_list(F.struct("term", "weight"))).alias("terms"))
    grouped = cut_lineage(in_group.withColumn("group", F.to_json("terms")))
    groups = grouped.select(F.col("group").alias("ask"), "terms").dropDuplicates(["ask"])
    common = postings.join(kinds.where("_shared").select("term"), "term", "left_semi")
    held = common.groupBy("rank").agg(F.array_join(F.array_sort(F.collect_list("term")), "\n").alias("_held"))
    alike = Window.partitionBy("_held").orderBy("rank")
    firsts = held.withColumn("_at", F.row_number().over(alike)).where(F.col("_at") <= limit).select("rank")
    top = _best_leads(groups, cut_lineage(common.join(firsts, "rank", "left_semi")), limit)
    shared = grouped.select("ask", "group").join(top.withColumnRenamed("ask", "group"), "group").select("ask", "rank")

    open_ones = ranked.where(F.col("rank") <= limit).select(F.lit("").alias("ask"), "rank", F.lit(0).alias("score"))
    rows = _scored(own.unionByName(shared), asks, postings).unionByName(open_ones)
    best = Window.partitionBy("ask").orderBy(F.desc("score"), "rank")
    placed = rows.withColumn("place", F.row_number().over(best)).where(F.col("place") <= limit)
    named = placed.join(ranked.select(F.col("id").alias("lead_id"), "company_name", "rank"), "rank")
    return asked.select("query_id", "ask").join(named, "ask").select("query_id", "place", "lead_id", "company_name", "score")
