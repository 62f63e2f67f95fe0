"""Which lead does a record belong to?

Matching is by normalised name, web domain or mail address. Look-ups never
pair records with leads: leads are first reduced to one row per key (lowest id
and count), so a hot key costs one row on the build side. Batch linkage builds
star edges per key, finds connected components with large-star/small-star
rounds, settles uniform components by aggregation and replays only the mixed
ones in arrival order.
"""

from __future__ import annotations

from collections import defaultdict
from functools import reduce
from itertools import combinations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contactmill import vocab
from contactmill.functions.text import (
    blank_to_null,
    email_domain,
    extract_domain,
    is_business_email,
    is_directory_url,
    normalize_email,
    normalize_linkedin_url,
    normalize_name,
    sanitize_company_name,
)
from contactmill.operators.numbering import number_rows
from contactmill.session import cut_lineage

NAMELESS_CREATES = ("shopify_directory", "linkedin_company", "website", "note")


# --- look-ups ----------------------------------------------------------------
def never_null(key: Column, row_id: Column) -> Column:
    """A text join key where missing values become distinct keys that match nothing.

    In an outer join all NULL keys would meet in one task.
    """
    return F.coalesce(key, F.concat(F.lit("\u0000"), row_id))


def _count_matches(records: DataFrame, held: DataFrame, keys: list[str]) -> DataFrame:
    """Lowest lead and number of distinct leads that share any of the keys.

    The size of the union comes from the counts per key combination
    (inclusion-exclusion; ``held`` has one row per lead and key set), so no
    record-lead pair is ever built.
    """
    total, lows = F.lit(0), []
    out = records
    for size in range(1, len(keys) + 1):
        for combo in combinations(keys, size):
            tag = "_".join(combo)
            full = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in combo])
            lookup = (
                held.filter(full)
                .groupBy(*[F.col(k).alias(f"_k_{k}") for k in combo])
                .agg(F.count("*").alias(f"_n_{tag}"), F.min("lead").alias(f"_m_{tag}"))
            )
            test = reduce(
                lambda a, b: a & b,
                [never_null(F.col(k), F.col("record_id")) == F.col(f"_k_{k}") for k in combo],
            )
            out = out.join(lookup, test, "left").drop(*[f"_k_{k}" for k in combo])
            sign = 1 if size % 2 else -1
            total = total + F.coalesce(f"_n_{tag}", F.lit(0)) * sign
            if size == 1:
                lows.append(F.col(f"_m_{tag}"))
    low = F.least(*lows) if len(lows) > 1 else lows[0]
    return out.withColumns({"match_count": total.cast("long"), "first_lead": low})


def _held_keys(leads: DataFrame) -> DataFrame:
    return leads.select(
        F.col("id").alias("lead"),
        blank_to_null(F.col("normalized_name")).alias("name_key"),
        blank_to_null(F.col("domain")).alias("domain_key"),
    )


def match_leads(records: DataFrame, leads: DataFrame, people: DataFrame | None = None) -> DataFrame:
    """``record_id, lead_id, match_count`` for records with a name or a site.

    ``lead_id`` is the lowest matching lead. With ``people``, leads of persons
    on the same profile page count too, behind the name and domain matches.
    """
    keyed = records.select(
        "record_id",
        blank_to_null(normalize_name(F.col("company_name"))).alias("name_key"),
        extract_domain(F.col("website")).alias("domain_key"),
        *([normalize_linkedin_url(F.col("linkedin_url")).alias("profile_key")] if people is not None else []),
    ).filter(F.col("name_key").isNotNull() | F.col("domain_key").isNotNull())
    held = _held_keys(leads)
    found = _count_matches(keyed, held, ["name_key", "domain_key"])
    if people is not None:
        profiles = people.filter(F.col("linkedin_url").isNotNull()).select(
            F.col("lead_id").alias("lead"), F.col("linkedin_url").alias("profile_key")
        )
        on_page = held.join(profiles.distinct(), "lead")
        for combo in (("profile_key",), ("profile_key", "name_key"), ("profile_key", "domain_key"),
                      ("profile_key", "name_key", "domain_key")):
            tag = "p" + "".join(k[0] for k in combo)
            full = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in combo])
            lookup = on_page.filter(full).groupBy(
                *[F.col(k).alias(f"_k_{k}") for k in combo]
            ).agg(F.count("*").alias(tag), F.min("lead").alias(f"m_{tag}"))
            test = reduce(
                lambda a, b: a & b,
                [never_null(F.col(k), F.col("record_id")) == F.col(f"_k_{k}") for k in combo],
            )
            found = found.join(lookup, test, "left").drop(*[f"_k_{k}" for k in combo])
        none = F.lit(0)
        extra = (
            F.coalesce("pp", none) - F.coalesce("ppn", none) - F.coalesce("ppd", none)
            + F.coalesce("ppnd", none)
        )
        found = found.withColumns(
            {
                "match_count": F.col("match_count") + extra,
                "first_lead": F.coalesce("first_lead", "m_pp"),
            }
        )
    return found.filter(F.col("match_count") > 0).select(
        "record_id", F.col("first_lead").alias("lead_id"), "match_count"
    )


def match_leads_by_email(addresses: DataFrame, leads: DataFrame) -> DataFrame:
    """``record_id, lead_id, match_count`` by mail domain or exact address.

    Addresses at personal mail hosts never match.
    """
    keyed = addresses.filter(is_business_email(F.col("email"))).select(
        "record_id",
        email_domain(F.col("email")).alias("domain_key"),
        normalize_email(F.col("email")).alias("mail_key"),
    )
    held = leads.select(
        F.col("id").alias("lead"),
        F.lower("domain").alias("domain_key"),
        F.lower("company_email").alias("mail_key"),
    )
    found = _count_matches(keyed, held, ["domain_key", "mail_key"])
    return found.filter(F.col("match_count") > 0).select(
        "record_id", F.col("first_lead").alias("lead_id"), "match_count"
    )


def people_by_linkedin_semi(
    leads: DataFrame, people: DataFrame, urls: DataFrame, matched: DataFrame
) -> DataFrame:
    """Leads of people on the given profile pages that are not matched already."""
    wanted = urls.select(normalize_linkedin_url(F.col("linkedin_url")).alias("linkedin_url"))
    owners = people.join(wanted, "linkedin_url", "left_semi").select(F.col("lead_id").alias("_lead"))
    return leads.join(owners, F.col("id") == F.col("_lead"), "left_semi").join(
        matched.select(F.col("lead_id").alias("_lead")), F.col("id") == F.col("_lead"), "left_anti"
    )


def _inner_slugs(slugs: DataFrame, lengths: DataFrame) -> DataFrame:
    """``slug, part``: every different part of a slug that is as long as one of ``lengths`` (``_n``).

    A slug of L letters makes at most L rows per length that occurs; the lengths are one small row.
    """
    wanted = lengths.agg(F.array_sort(F.collect_set("_n")).alias("_lengths"))
    cuts = F.transform(
        F.filter("_lengths", lambda n: n <= F.length("slug")),
        lambda n: F.transform(F.sequence(F.lit(1), F.length("slug") - n + 1), lambda at: F.substr("slug", at, n)),
    )
    return slugs.crossJoin(F.broadcast(wanted)).select("slug", F.explode(F.array_distinct(F.flatten(cuts))).alias("part"))


def slug_contains_join(queries: DataFrame, companies: DataFrame) -> DataFrame:
    """For each query slug the company slug that contains it or lies inside it.

    An exact match wins, else the first in sorted order.

    The longer slugs are cut into parts of the lengths that the shorter ones have, which meet by an equi-join: no pair is built
    that does not match, and a part that many companies hold keeps only the first of them. The parts are far more
    rows than their tables, so their size is no reason for a broadcast.
    """
    tasks = queries.sparkSession.sparkContext.defaultParallelism
    q, c = (df.select("slug").where("slug <> ''").repartition(tasks, "slug").distinct() for df in (queries, companies))
    inside = _inner_slugs(q, c.select(F.length("slug").alias("_n"))).join(
        c.select(F.col("slug").alias("part")).hint("merge"), "part"
    ).groupBy("slug").agg(F.min("part").alias("company_slug"))
    holders = _inner_slugs(c, q.select(F.length("slug").alias("_n"))).groupBy("part").agg(F.min("slug").alias("company_slug"))
    around = q.withColumnRenamed("slug", "part").join(holders.hint("merge"), "part").withColumnRenamed("part", "slug")
    found = inside.unionByName(around)
    exact = q.join(c.hint("merge"), "slug").select("slug", F.col("slug").alias("company_slug"))
    found = found.withColumn("_exact", F.lit(1)).unionByName(exact.withColumn("_exact", F.lit(0)))
    best = found.groupBy("slug").agg(F.min(F.struct("_exact", "company_slug"))["company_slug"].alias("company_slug"))
    return queries.join(best.hint("merge"), "slug", "left")


# --- components --------------------------------------------------------------
# At most so many keys are treated as hot, and none with fewer rows than this.
HOT_KEYS, LEAST_HOT = 16_384, 64
# Parts that the rows of one hot key are dealt to.
SPREAD = 4096


def join_hot_keys(rows: DataFrame, lookup: DataFrame, key: str, total: int) -> DataFrame:
    """Inner join of ``rows`` with ``lookup``, one row per key with ``_size``, its number of rows.

    Of ``total`` rows at most ``HOT_KEYS`` keys can have more than ``total / HOT_KEYS`` each: these are broadcast to their
    rows. All other keys are small and meet by a shuffle.
    """
    limit = max(LEAST_HOT, total // HOT_KEYS)
    values = [c for c in lookup.columns if c not in (key, "_size")]
    is_hot = F.col("_size") > limit
    hot = lookup.where(is_hot).select(F.col(key).alias("_hot"), F.struct(*values).alias("_in_hot"))
    cold = lookup.where(~is_hot).select(F.col(key).alias("_cold"), F.lit(0).alias("_part"), F.struct(*values).alias("_in_cold"))
    marked = rows.join(F.broadcast(hot), F.col(key) == F.col("_hot"), "left")
    # Rows of hot keys have found theirs; in the shuffle they match nothing and are spread by a part of their own.
    spread = F.when(F.col("_hot").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64(*rows.columns), F.lit(SPREAD)).cast("int") + 1)
    met = marked.withColumn("_at", spread).join(cold, (F.col(key) == F.col("_cold")) & (F.col("_at") == F.col("_part")), "left")
    found = F.coalesce("_in_hot", "_in_cold")
    return met.where(found.isNotNull()).select(*rows.columns, *[found[c].alias(c) for c in values])


def star_edges(keyed: DataFrame) -> DataFrame:
    """``node, key`` rows to edges from every node to the smallest node of its key."""
    centres = cut_lineage(
        keyed.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("_high"), F.count("*").alias("_size"))
        .filter(F.col("low") < F.col("_high")).drop("_high")
    )
    total = centres.agg(F.sum("_size").alias("n")).first()["n"] or 0
    return join_hot_keys(keyed, centres, "key", total).filter(
        F.col("node") != F.col("low")
    ).select("node", "low").distinct()


def _least(links: DataFrame) -> DataFrame:
    """``node, m, _size``: the smallest neighbour of each node, and how many it has."""
    return links.groupBy("node").agg(F.min("low").alias("m"), F.count("*").alias("_size"))


def _large_star(links: DataFrame, total: int) -> DataFrame:
    both = links.unionByName(links.select(F.col("low").alias("node"), F.col("node").alias("low")))
    least = _least(both).withColumn("m", F.least("node", "m"))
    return (
        join_hot_keys(both.filter(F.col("low") > F.col("node")), least, "node", 2 * total)
        .select(F.col("low").alias("node"), F.col("m").alias("low"))
        .distinct()
    )


def _small_star(links: DataFrame, total: int) -> DataFrame:
    least = _least(links)
    moved = join_hot_keys(links, least, "node", total).filter(F.col("low") != F.col("m"))
    return (
        moved.select(F.col("low").alias("node"), F.col("m").alias("low"))
        .unionByName(least.select("node", F.col("m").alias("low")))
        .distinct()
    )


def _fingerprint(links: DataFrame) -> tuple:
    row = links.agg(
        F.count("*").alias("n"),
        F.sum(F.xxhash64("node", "low").cast("decimal(38,0)")).alias("s"),
    ).first()
    return row["n"], row["s"]


def connected_components(links: DataFrame) -> DataFrame:
    """``node, component`` for every node that has an edge; the component is its lowest node.

    Alternating large-star and small-star rounds (Kiveris et al., 2014). Each
    round is a few aggregations and joins, written to the shared folder, so a
    lost executor costs one round. Only two numbers per round reach the driver. The links of a
    node with very many of them are not brought together: see ``join_hot_keys``.
    """
    now = cut_lineage(
        links.filter(F.col("node") != F.col("low"))
        .select(F.greatest("node", "low").alias("node"), F.least("node", "low").alias("low"))
        .distinct()
    )
    mark = _fingerprint(now)
    while mark[0]:
        now = cut_lineage(_small_star(_large_star(now, mark[0]), 2 * mark[0]))
        before, mark = mark, _fingerprint(now)
        if mark == before:
            break
    roots = now.select(F.col("low").alias("node"), F.col("low").alias("component")).distinct()
    return now.select("node", F.col("low").alias("component")).unionByName(roots)


def with_component(rows: DataFrame, components: DataFrame, node: str = "node") -> DataFrame:
    """Attach the component; a node without edges is its own."""
    renamed = components.select(F.col("node").alias("_node"), "component")
    return rows.join(renamed, F.col(node) == F.col("_node"), "left").withColumn(
        "component", F.coalesce("component", node)
    ).drop("_node")


def fold_in_order(df: DataFrame, group: str, order: list, start, step, schema: str) -> DataFrame:
    """Feed the rows of each group, in order, to a small state.

    Rows stream through the task in Arrow batches, sorted by Spark; only the
    state of the current group is held.
    """
    names = [part.split()[0] for part in schema.split(", ")]

    def run(batches):
        current, state = None, None
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                key = getattr(row, group)
                if state is None or key != current:
                    current, state = key, start()
                result = step(state, row)
                if result is not None:
                    out.append(result)
            yield pd.DataFrame(out, columns=names)

    arranged = df.repartition(F.col(group)).sortWithinPartitions(group, *order)
    return arranged.mapInPandas(run, schema)


# --- batch linkage -----------------------------------------------------------
def linkage_records(parsed: DataFrame) -> DataFrame:
    """Key columns of parsed records, as ``resolve_leads`` reads them.

    Input: ``record_id, arrived, source_type, source_url, attach_lead_id,
    company_name, website, company_email, emails`` (addresses in text order).
    """
    name = blank_to_null(sanitize_company_name(F.col("company_name")))
    own = extract_domain(F.col("website"))
    borrowed = F.when(~is_directory_url(F.col("source_url")), F.col("source_url"))
    site = F.coalesce(blank_to_null(F.col("website")), blank_to_null(borrowed))
    is_mail = F.col("source_type") == "email"
    mails = F.filter(
        F.transform(F.coalesce("emails", F.array().cast("array<string>")), normalize_email),
        is_business_email,
    )
    return parsed.select(
        "record_id",
        "arrived",
        "source_type",
        F.col("attach_lead_id").cast("long").alias("attach"),
        name.alias("name"),
        blank_to_null(normalize_name(name)).alias("name_key"),
        own.alias("match_domain"),
        extract_domain(site).alias("domain_key"),
        F.lower("company_email").alias("mail_key"),
        F.when(is_mail, mails).otherwise(F.array().cast("array<string>")).alias("mails"),
        is_mail.alias("is_mail"),
    )


def _record_node(c: Column) -> Column:
    return c * 2 + 1


def _lead_node(c: Column) -> Column:
    return c * 2


def _tagged(tag: str, c: Column) -> Column:
    return F.when(c.isNotNull(), F.concat(F.lit(tag), c))


def record_keys(records: DataFrame) -> DataFrame:
    """``node, key``: everything by which a record can meet a lead or another record."""
    mails = F.flatten(
        F.transform(
            "mails",
            lambda m: F.array(F.concat(F.lit("m:"), m), F.concat(F.lit("d:"), email_domain(m))),
        )
    )
    own = F.array_compact(
        F.array(
            _tagged("n:", F.col("name_key")), _tagged("d:", F.col("domain_key")),
            _tagged("m:", F.col("mail_key")),
            F.when(F.col("attach").isNotNull(), F.concat(F.lit("l:"), F.col("attach"))),
        )
    )
    return records.select(
        _record_node(F.col("record_id")).alias("node"),
        F.explode(F.array_distinct(F.concat(own, mails))).alias("key"),
    )


def lead_keys(leads: DataFrame) -> DataFrame:
    """``id, key``: the name, site, address and number of each lead, as ``record_keys`` writes them."""
    held = F.array_compact(
        F.array(
            _tagged("n:", blank_to_null(F.col("normalized_name"))),
            _tagged("d:", blank_to_null(F.lower("domain"))),
            _tagged("m:", blank_to_null(F.lower("company_email"))),
            F.concat(F.lit("l:"), F.col("id")),
        )
    )
    return leads.select("id", F.explode(held).alias("key"))


def _keyed_nodes(records: DataFrame, leads: DataFrame) -> DataFrame:
    from_leads = lead_keys(leads).select(_lead_node(F.col("id")).alias("node"), "key")
    return record_keys(records).unionByName(from_leads)


def lead_components(records: DataFrame, leads: DataFrame) -> DataFrame:
    """``record_id, component``: records that could ever meet in one lead."""
    parts = connected_components(star_edges(_keyed_nodes(records, leads)))
    return with_component(
        records.select("record_id", _record_node(F.col("record_id")).alias("node")), parts
    ).select("record_id", "component")


class _Replay:
    """Leads of one component while its records arrive one by one."""

    def __init__(self):
        self.leads = {}
        self.index = {k: defaultdict(set) for k in ("name", "domain", "mail")}

    def find(self, **keys):
        found = set()
        for kind, value in keys.items():
            if value:
                found |= self.index[kind].get(value, set())
        return found

    def put(self, place, **values):
        lead = self.leads.setdefault(place, {"raw": None, "name": None, "domain": None, "mail": None})
        for kind, value in values.items():
            if value is None:
                continue
            if kind != "raw":
                if lead[kind]:
                    self.index[kind][lead[kind]].discard(place)
                self.index[kind][value].add(place)
            lead[kind] = value


def _clipped(old, new) -> bool:
    return bool(old) and bool(new) and old[1:].lower() == new.lower()


def _text(value):
    return value if isinstance(value, str) and value else None


def _replay_step(state: _Replay, row):
    """One record against the current leads; the reference order of the rules.

    A place is ``(0, lead id)`` for a stored lead and ``(1, creator's number)``
    for a new one, so the smallest place is the oldest lead.
    """
    name, raw = _text(row.name_key), _text(row.name)
    domain, mail = _text(row.domain_key), _text(row.mail_key)
    if row.kind == 0:
        state.put((0, row.record_id), raw=raw, name=name, domain=domain, mail=mail)
        return None
    place = (0, row.attach) if row.attach >= 0 else None
    if place is None and name:
        place = min(state.find(name=name, domain=_text(row.match_domain)), default=None)
    if place is None and row.is_mail:
        for address in row.mails:
            hits = state.find(domain=address.split("@")[-1], mail=address)
            if hits:
                place = min(hits)
                break
    if place is None and row.seeks:
        place = min(state.find(domain=domain), default=None)
    known = place is not None
    if not known and not name:
        return (row.record_id, -1, -1, False, False)
    writes_name = not (known and row.is_mail) and name is not None
    matches = state.find(name=name if writes_name else None, domain=domain)
    if known:
        repeated = len(matches) > 1 or (len(matches) == 1 and place not in matches)
    else:
        repeated = len(matches) > 1
        place = min(matches, default=(1, row.place))
    new_name, new_raw = None, None
    if writes_name:
        stored = state.leads.get(place, {}).get("raw")
        if not _clipped(stored, raw):
            new_name, new_raw = name, raw
    state.put(place, raw=new_raw, name=new_name, domain=domain, mail=mail)
    if place[0] == 0:
        return (row.record_id, place[1], -1, repeated, False)
    return (row.record_id, -1, place[1], repeated, place[1] == row.place)


def resolve_leads(records: DataFrame, leads: DataFrame, top: int | None = None) -> DataFrame:
    """``record_id, lead_id, is_new, creates, possible_duplicate`` for every record.

    ``records`` comes from ``linkage_records``. New leads get the ids a
    one-by-one run would give: after the largest stored id, by arrival of the
    record that ``creates`` them. ``lead_id`` is NULL where nothing matches and the
    record may not create a lead.

    A nameless record of a creating type goes to the oldest lead with its site, whose
    stored name stays. Those whose site no lead has, and those without one, share one
    placeholder lead per type, which does not link other records.

    ``leads`` may be cut down to those that share a key with the records (``record_keys``,
    ``lead_keys``, ``placeholder_key``); ``top`` is then the largest id of all.
    """
    nameless = F.col("name_key").isNull() & F.col("attach").isNull()
    seeks = nameless & F.col("source_type").isin(*NAMELESS_CREATES)
    placeholder = seeks & F.col("domain_key").isNull()
    records = number_rows(records, ["arrived", "record_id"], "place").withColumn("seeks", seeks)
    held = leads.select("id", "company_name", "normalized_name", "domain", "company_email")
    open_rows = records.filter(~placeholder)

    keyed = _keyed_nodes(open_rows, held)
    carried = keyed.filter(F.col("node") % 2 == 1).select("key").distinct()
    parts = connected_components(star_edges(keyed.join(carried, "key", "left_semi")))
    rec = with_component(
        open_rows.withColumn("node", _record_node(F.col("record_id"))), parts
    ).withColumn("kind", F.lit(1))
    old = with_component(
        held.select(
            F.col("id").alias("record_id"),
            F.col("company_name").alias("name"),
            blank_to_null(F.col("normalized_name")).alias("name_key"),
            blank_to_null(F.lower("domain")).alias("domain_key"),
            blank_to_null(F.lower("company_email")).alias("mail_key"),
            _lead_node(F.col("id")).alias("node"),
            F.lit(0).alias("kind"),
        ),
        parts,
    )
    members = cut_lineage(rec.unionByName(old, allowMissingColumns=True))

    is_record = F.col("kind") == 1
    stats = members.groupBy("component").agg(
        F.count("*").alias("n"),
        F.count("name_key").alias("n_name"),
        F.min("name_key").alias("name_lo"),
        F.max("name_key").alias("name_hi"),
        F.count("domain_key").alias("n_domain"),
        F.min("domain_key").alias("domain_lo"),
        F.max("domain_key").alias("domain_hi"),
        F.count_if(is_record).alias("n_records"),
        F.count_if(~is_record).alias("n_leads"),
        F.min(F.when(~is_record, F.col("record_id"))).alias("first_lead"),
        F.min(F.when(is_record, F.col("place"))).alias("first_place"),
        F.count_if(is_record & (F.col("attach").isNotNull() | F.col("name_key").isNull())).alias("n_odd"),
        F.count_if(
            is_record & F.coalesce(F.col("match_domain") != F.col("domain_key"), F.lit(True))
        ).alias("n_borrowed"),
        F.count_if(is_record & F.col("is_mail")).alias("n_mail"),
    ).filter(F.col("n_records") > 0)
    one_lead = F.col("n_leads") <= 1
    one_name = (F.col("n_name") == F.col("n")) & (F.col("name_lo") == F.col("name_hi"))
    one_domain = (F.col("n_domain") == F.col("n")) & (F.col("domain_lo") == F.col("domain_hi"))
    uniform = (F.col("n_odd") == 0) & (
        (one_name & (one_lead | (F.col("n_mail") == 0)))
        | (one_domain & (one_lead | ((F.col("n_borrowed") == 0) & (F.col("n_mail") == 0))))
    )
    lone = (F.col("n") == 1) & (F.col("n_odd") == 1)
    stats = (
        stats.withColumn("route", F.when(F.coalesce(uniform, F.lit(False)), "uniform")
                         .when(lone, "lone").otherwise("mixed"))
        .select("component", "route", "n_leads", "first_lead", "first_place", "n")
    )

    routed = cut_lineage(join_hot_keys(members, stats.withColumn("_size", F.col("n")).drop("n"), "component", members.count()))
    settled = routed.filter(is_record & (F.col("route") == "uniform")).select(
        "record_id",
        F.col("first_lead").alias("old_lead"),
        F.when(F.col("first_lead").isNull(), F.col("first_place")).alias("creator"),
        (F.col("n_leads") > 1).alias("possible_duplicate"),
        (F.col("first_lead").isNull() & (F.col("place") == F.col("first_place"))).alias("creates"),
    )
    alone = routed.filter(is_record & (F.col("route") == "lone")).select(
        "record_id",
        F.col("attach").alias("old_lead"),
        F.lit(None).cast("long").alias("creator"),
        F.lit(False).alias("possible_duplicate"),
        F.lit(False).alias("creates"),
    )
    mixed = routed.filter(F.col("route") == "mixed").select(
        "component", "kind", "record_id", "name", "name_key", "match_domain", "domain_key",
        "mail_key",
        F.coalesce("attach", F.lit(-1)).alias("attach"),
        F.coalesce("place", F.lit(-1)).alias("place"),
        F.coalesce("is_mail", F.lit(False)).alias("is_mail"),
        F.coalesce("seeks", F.lit(False)).alias("seeks"),
        F.coalesce("mails", F.array().cast("array<string>")).alias("mails"),
    )
    replayed = fold_in_order(
        mixed, "component", ["kind", "place", "record_id"], _Replay, _replay_step,
        "record_id long, old_lead long, creator long, possible_duplicate boolean, creates boolean",
    ).withColumns({c: F.when(F.col(c) >= 0, F.col(c)) for c in ("old_lead", "creator")})

    opened = cut_lineage(settled.unionByName(alone).unionByName(replayed))
    unmatched = opened.filter("old_lead IS NULL AND creator IS NULL").select("record_id")
    late = records.filter(F.col("seeks") & F.col("domain_key").isNotNull()).join(unmatched, "record_id", "left_semi")
    unnamed = records.filter(placeholder).unionByName(late).withColumn("name_key", placeholder_key(F.col("source_type")))
    seats = held.filter(F.col("normalized_name").isNotNull()).groupBy("normalized_name").agg(
        F.min("id").alias("old_lead")
    )
    firsts = unnamed.groupBy("name_key").agg(F.min("place").alias("first_place"))
    firsts = firsts.join(seats, F.col("name_key") == F.col("normalized_name"), "left").drop(
        "normalized_name"
    )
    parked = unnamed.join(F.broadcast(firsts), "name_key").select(
        "record_id",
        "old_lead",
        F.when(F.col("old_lead").isNull(), F.col("first_place")).alias("creator"),
        F.lit(False).alias("possible_duplicate"),
        (F.col("old_lead").isNull() & (F.col("place") == F.col("first_place"))).alias("creates"),
    )

    linked = cut_lineage(
        opened.join(late.select("record_id"), "record_id", "left_anti").unionByName(parked)
    )
    creators = linked.filter(F.col("creator").isNotNull()).select("creator").distinct()
    top = held.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top")).scalar() if top is None else F.lit(top)
    fresh = number_rows(creators, ["creator"], "_no").select(
        F.col("creator").alias("_creator"), (F.col("_no") + top).alias("_new")
    )
    # Records of stored leads get distinct keys that match nothing, so they spread out.
    seat = F.coalesce("creator", -F.col("record_id") - 1)
    return linked.join(fresh, seat == F.col("_creator"), "left").select(
        "record_id",
        F.coalesce("old_lead", "_new").alias("lead_id"),
        F.col("_new").isNotNull().alias("is_new"),
        "creates",
        "possible_duplicate",
    )


def placeholder_name(source_type: Column) -> Column:
    return F.concat(F.lit("Unknown ("), source_type, F.lit(")"))


def placeholder_key(source_type: Column) -> Column:
    return normalize_name(placeholder_name(source_type))
