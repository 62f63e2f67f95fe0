"""Similarity join of stored texts on word shingles, exact, without any pair of copies written out.

Texts with equal sets are one class. For the rest:

* Counting. The shingles of all texts are counted in ranges of their hashes, except those
  that a sample finds in very many texts, which come last in the order of rarity. A text
  whose shingles occur elsewhere too rarely for any partner to reach the
  threshold leaves here, which is most of them.
* Light sets, of few shingles, put out every subset of the size that two linked
  sets must share; sets with an equal subset are linked, no test needed.
* Heavy sets enter inverted lists of their rarest shingles. Positions in the lists bound the
  overlap. Short lists give the pairs that pass; long lists give one link from each
  entry to the first. Both only group sets into families; families are cut
  into tiles, and tiles that a list or pair connects are counted against each other
  in one product, which gives exact overlaps and puts out components, never pairs.

The boundary between light and heavy is where subsets cost more than lists.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contactmill.llm.rows import map_rows, stream_rows
from contactmill.operators.linkage import connected_components
from contactmill.operators.numbering import number_rows
from contactmill.session import cut_lineage

WORDS = 5
BLOCK_ROWS, BLOCK_SHINGLES = 512, 400_000
RANGE_SHINGLES = 1_000_000
MAX_LIGHT = 16
SHORT_LIST = 200
TILE_ROWS = 256
COLUMNS_AT_ONCE = 4096
STRETCH = 1 << 16
SAMPLE_TEXTS, COMMON_TEXTS, COMMON_SHARE, MAX_COMMON = 2048, 32, 64, 1 << 16

LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
PRIME = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def mixed(x: np.ndarray, key: int = 0xBF58476D1CE4E5B9) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(key)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(base: int, n: int) -> np.ndarray:
    return np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(n, base, np.uint64), dtype=np.uint64)])


UP, DOWN = powers(int(PRIME), STRETCH), powers(int(INVERSE), STRETCH)


def word_hashes(octets: np.ndarray) -> np.ndarray:
    """64-bit hashes of the words; they depend on a word's characters alone, not on where it stands."""
    word = ~SPACE[octets]
    edge = np.flatnonzero(np.diff(np.concatenate([[False], word, [False]]).astype(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    up, down = (UP, DOWN) if len(octets) <= STRETCH else (powers(int(PRIME), len(octets)), powers(int(INVERSE), len(octets)))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((octets.astype(np.uint64) + np.uint64(1)) * up[: len(octets)], dtype=np.uint64)])
    return mixed((sums[ends] - sums[starts]) * down[starts])


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of five words (of all words, if there are fewer).

    A long text is read in stretches that end at white space, so only its hashes are held whole.
    """
    octets = np.frombuffer((text or "").encode("utf-8", "surrogatepass").translate(LOWER), np.uint8)
    found, at = [np.zeros(0, np.uint64)], 0
    while at < len(octets):
        end, reach = min(len(octets), at + STRETCH), STRETCH
        while end < len(octets):  # back to the last blank, or on to one if a single word fills the stretch
            blanks = np.flatnonzero(SPACE[octets[at:end]])
            if len(blanks):
                end = at + int(blanks[-1]) + 1
                break
            reach *= 2
            end = min(len(octets), at + reach)
        found.append(word_hashes(octets[at:end]))
        at = end
    words = np.concatenate(found)
    if not len(words):
        return words
    size = min(WORDS, len(words))
    out = np.full(len(words) - size + 1, size, np.uint64)
    for at in range(size):
        out = out * PRIME + words[at : at + len(out)]
    return np.unique(mixed(out))


def needed(n: int, m: int) -> int:
    """Least overlap of linked sets of these sizes: 100 * overlap >= 80 * (n + m - overlap)."""
    return -(-4 * (n + m) // 9)


# --- counting ----------------------------------------------------------------
BLOCKS = "block long, range long, head binary, ids array<long>, texts binary, counts binary, prints binary, small binary"
SETS = "id long, key long, n long, h1 long, h2 long, first int, prefix array<long>, small array<long>"
COMMON_RANK = 255


def cut_blocks(rows: Iterator[tuple], n_ranges: int, common: np.ndarray) -> Iterator[tuple]:
    """Rows of each block of texts: one per range of hashes that any of its shingles is in, and one with the heads of its texts.

    A range's row holds the 32-bit prints of its shingles, in order of text, and how many each text has there; a text without any
    takes no room. The row of heads has a range of its own below 0, and the tokens of common shingles, which are not counted.
    """
    bits = n_ranges.bit_length() - 1
    block = TaskContext.get().partitionId() << 24
    ids, keys, sets, size = [], [], [], 0
    for i, key, text in rows:
        ids.append(i)
        keys.append(key)
        sets.append(shingles(text))
        size += len(sets[-1])
        if len(ids) == BLOCK_ROWS or size >= BLOCK_SHINGLES:
            yield from block_rows(block, ids, keys, sets, bits, common)
            block += 1
            ids, keys, sets, size = [], [], [], 0
    if ids:
        yield from block_rows(block, ids, keys, sets, bits, common)


def runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of equal values begin, and how long they are."""
    begin = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])) if len(values) else np.zeros(0, np.int64)
    return begin, np.diff(np.append(begin, len(values)))


def block_rows(block: int, ids: list, keys: list, sets: list, bits: int, common: np.ndarray) -> Iterator[tuple]:
    head = np.zeros((len(sets), 4), "<i8")
    for i, s in enumerate(sets):
        head[i] = keys[i], len(s), int(mixed(s).sum(dtype=np.uint64).view(np.int64)), int(mixed(s, 0xD6E8FEB86659FD93).sum(dtype=np.uint64).view(np.int64))
    small = b"".join(s.astype("<u8").tobytes() for s in sets if len(s) <= MAX_LIGHT)
    every = np.concatenate(sets)
    text = np.repeat(np.arange(len(sets), dtype=np.int32), [len(s) for s in sets])
    in_range = (every >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(every), np.int64)
    often = np.isin(every, common) if len(common) else np.zeros(len(every), bool)
    begin, counts = runs(text[often])
    tokens = (every[often] & np.uint64(0xFFFFFFFF)).astype("<i8") | (in_range[often] << 32)
    yield block, -1 - block, head.tobytes(), ids, text[often][begin].astype("<u4").tobytes(), counts.astype("<u4").tobytes(), tokens.tobytes(), small
    order = np.flatnonzero(~often)
    order = order[np.argsort(in_range[order], kind="stable")]
    every, text, in_range = every[order].astype("<u4"), text[order], in_range[order]
    for at, n in zip(*runs(in_range)):
        own = text[at : at + n]
        begin, counts = runs(own)
        yield (
            block, int(in_range[at]), None, None, own[begin].astype("<u4").tobytes(), counts.astype("<u4").tobytes(),
            every[at : at + n].tobytes(), None,
        )


def count_range(held: list[tuple]) -> Iterator[tuple]:
    """Keep the prints that more than one text has, each with the rank of its count (eighths of a power of two)."""
    if held[0][1] < 0:
        yield from ((*row, None) for row in held)
        return
    prints = np.concatenate([np.frombuffer(row[6], "<u4") for row in held])
    _, place, counts = np.unique(prints, return_inverse=True, return_counts=True)
    rank = np.minimum(COMMON_RANK, np.floor(8 * np.log2(counts))).astype(np.uint8)[place]
    at = 0
    for block, r, _, _, texts, counts, own, _ in held:
        texts, counts = np.frombuffer(texts, "<u4"), np.frombuffer(counts, "<u4")
        own = np.frombuffer(own, "<u4")
        own_rank = rank[at : at + len(own)]
        at += len(own)
        shared = own_rank > 0
        if shared.any():
            left = np.repeat(texts, counts)[shared]
            begin, n = runs(left)
            yield (
                block, r, None, None, left[begin].tobytes(), n.astype("<u4").tobytes(), own[shared].tobytes(), None,
                own_rank[shared].tobytes(),
            )


def finish_block(held: list[tuple]) -> Iterator[tuple]:
    """One row per text; ``prefix`` holds its rarest shared shingles, as many as a linked set must meet, if it can have a link."""
    heads, ids, small = next((h[2], h[3], h[7]) for h in held if h[1] < 0)
    heads = np.frombuffer(heads, "<i8").reshape(-1, 4)
    small, taken = np.frombuffer(small, "<i8"), 0
    text = np.concatenate([np.repeat(np.frombuffer(h[4], "<u4"), np.frombuffer(h[5], "<u4")) for h in held])
    token = np.concatenate([
        np.frombuffer(h[6], "<i8") if h[1] < 0 else np.frombuffer(h[6], "<u4").astype(np.int64) | (h[1] << 32) for h in held
    ])
    rank = np.concatenate([np.full(len(h[6]) // 8, COMMON_RANK, np.uint8) if h[1] < 0 else np.frombuffer(h[8], np.uint8) for h in held])
    order = np.lexsort((token, rank, text))
    token, bounds = token[order], np.searchsorted(text[order], np.arange(len(heads) + 1))
    for i, (key, n, h1, h2) in enumerate(heads.tolist()):
        alone = n - int(bounds[i + 1] - bounds[i])
        allowed = n // 5
        prefix = token[bounds[i] : bounds[i] + allowed + 1 - alone].tolist() if n and alone <= allowed else None
        own = None
        if n <= MAX_LIGHT:
            own, taken = small[taken : taken + n].tolist(), taken + n
        yield ids[i], key, n, h1, h2, alone, prefix, own


def by_group(rows: Iterator[tuple], at: int, fn) -> Iterator[tuple]:
    held: list[tuple] = []
    for row in rows:
        if held and held[-1][at] != row[at]:
            yield from fn(held)
            held = []
        held.append(row)
    if held:
        yield from fn(held)


def common_shingles(texts: DataFrame, rows: int) -> np.ndarray:
    """Sorted hashes of shingles that many texts have, at most ``MAX_COMMON``, found in about ``SAMPLE_TEXTS`` texts chosen by a hash.

    They are in at least ``COMMON_TEXTS`` texts of the sample and in one of ``COMMON_SHARE``. The order of rarity puts them last
    uncounted, so no task ever holds all occurrences of one. Results do not depend on which they are: a frequent shingle that the sample
    missed is counted like any other.
    """
    every = max(1, rows // SAMPLE_TEXTS)
    sample = texts.where(F.pmod(F.xxhash64("key"), F.lit(every)) == 0).select("raw_text")

    def counted(rows):
        found, counts, pending, size, held = np.zeros(0, np.uint64), np.zeros(0, np.int64), [], 0, 0

        def fold():
            every, place = np.unique(np.concatenate([found, *pending]), return_inverse=True)
            weight = np.concatenate([counts, np.ones(len(place) - len(counts), np.int64)])
            return every, np.bincount(place, weight, len(every)).astype(np.int64)

        for (text,) in rows:
            held += 1
            pending.append(shingles(text))
            size += len(pending[-1])
            if size > RANGE_SHINGLES // 2:
                (found, counts), pending, size = fold(), [], 0
        found, counts = fold()
        for at in range(0, len(found), COLUMNS_AT_ONCE):
            cut = slice(at, at + COLUMNS_AT_ONCE)
            yield found[cut].view(np.int64).tolist(), counts[cut].tolist(), 0
        yield [], [], held

    counts = cut_lineage(stream_rows(sample, counted, "shingles array<long>, counts array<long>, held long"))
    held = counts.agg(F.sum("held").alias("held")).first()["held"] or 0
    least = max(COMMON_TEXTS, -(-held // COMMON_SHARE))
    pairs = counts.select(F.inline(F.arrays_zip(F.col("shingles").alias("shingle"), F.col("counts").alias("n"))))
    often = pairs.groupBy("shingle").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    often = often.orderBy(F.desc("n"), "shingle").limit(MAX_COMMON).select("shingle").collect()
    return np.sort(np.array([r["shingle"] for r in often], np.int64).view(np.uint64))


def sketch(raw_sources: DataFrame, n_ranges: int | None = None) -> DataFrame:
    """``SETS`` for every raw source, written to the shared folder."""
    texts = raw_sources.select("id", "raw_text").withColumn("key", F.xxhash64("id", "raw_text"))
    size = texts.agg(F.sum(F.octet_length("raw_text").cast("long")).alias("octets"), F.count("*").alias("rows")).first()
    if n_ranges is None:
        n_ranges = 64
        while n_ranges * RANGE_SHINGLES < (size["octets"] or 0) // 6:
            n_ranges *= 2
    common = common_shingles(texts, size["rows"])
    cut = stream_rows(texts.select("id", "key", "raw_text"), lambda rows: cut_blocks(rows, n_ranges, common), BLOCKS)
    ranged = cut.repartition("range").sortWithinPartitions("range")
    counted = stream_rows(ranged, lambda rows: by_group(rows, 1, count_range), BLOCKS + ", ranks binary")
    whole = counted.repartition("block").sortWithinPartitions("block")
    return cut_lineage(stream_rows(whole, lambda rows: by_group(rows, 0, finish_block), SETS))


# --- light sets --------------------------------------------------------------
def subset_keys(tokens: list[int], boundary: int) -> Iterator[tuple[int, int]]:
    """(key, partner's size) for each subset that a linked set of at most ``boundary`` shingles must share; keys tell the sizes apart."""
    n = len(tokens)
    spread = mixed(np.array(tokens, np.int64).view(np.uint64)).tolist()
    for m in range(-(-4 * n // 5), min(boundary, 5 * n // 4) + 1):
        if m == 0:
            continue
        low, high = min(n, m), max(n, m)
        for chosen in combinations(spread, needed(n, m)):
            key = (sum(chosen) * 0x9E3779B97F4A7C15 + low * 1021 + high * 131071) & 0xFFFFFFFFFFFFFFFF
            yield key - (1 << 64 if key >> 63 else 0), m


def subset_cost(n: int, boundary: int) -> int:
    return sum(comb(n, needed(n, m)) for m in range(-(-4 * n // 5), min(boundary, 5 * n // 4) + 1) if m)


def light_links(classes: DataFrame, boundary: int) -> DataFrame:
    """``node, low`` links among sets of at most ``boundary`` shingles.

    All sets of one size under a key are linked with all of the other size, so
    a link from each to the first of the other size joins all that are linked.
    """
    def keys():
        return lambda key, n, small: (key, n, *zip(*subset_keys(small, boundary)))

    small = classes.where((F.col("n") >= 2) & (F.col("n") <= boundary)).select("key", "n", "small")
    rows = map_rows(small, keys, "node long, size long, subsets array<long>, partners array<long>")
    rows = rows.select("node", "size", F.explode(F.arrays_zip("subsets", "partners")).alias("s")).select(
        "node", "size", F.col("s.subsets").alias("subset"), F.col("s.partners").alias("partner")
    )
    first = rows.groupBy("subset", F.col("size").alias("partner")).agg(F.min("node").alias("low"))
    return rows.join(first, ["subset", "partner"]).select("node", "low").where("node <> low").distinct()


# --- heavy sets --------------------------------------------------------------
class Tile:
    """Sets of one tile: their nodes, sizes, and all shingles one set after the other."""

    def __init__(self, nodes: bytes, sizes: bytes, tokens: bytes):
        self.nodes, self.sizes, self.tokens = np.frombuffer(nodes, "<i8"), np.frombuffer(sizes, "<i8"), np.frombuffer(tokens, "<u8")


def overlaps(a: Tile, b: Tile) -> np.ndarray:
    """How many shingles each set of ``a`` shares with each of ``b``: a product of 0/1 columns, a few thousand shingles at a time."""
    common = np.intersect1d(a.tokens, b.tokens)
    out = np.zeros((len(a.nodes), len(b.nodes)), np.float64)
    if not len(common):
        return out
    places = []
    for tile in (a, b):
        at = np.minimum(np.searchsorted(common, tile.tokens), len(common) - 1)
        hit = common[at] == tile.tokens
        column, row = at[hit], np.repeat(np.arange(len(tile.nodes)), tile.sizes)[hit]
        order = np.argsort(column, kind="stable")
        places.append((row[order], column[order]))
    for first in range(0, len(common), COLUMNS_AT_ONCE):
        parts = []
        for tile, (row, column) in zip((a, b), places):
            lo, hi = np.searchsorted(column, [first, first + COLUMNS_AT_ONCE])
            dense = np.zeros((len(tile.nodes), min(COLUMNS_AT_ONCE, len(common) - first)), np.float32)
            dense[row[lo:hi], column[lo:hi] - first] = 1
            parts.append(dense)
        out += parts[0] @ parts[1].T
    return out


def compare(a: Tile, b: Tile) -> Iterator[tuple[int, int]]:
    """(node, lowest node of its local component) for the nodes with a link across the tiles."""
    shared = overlaps(a, b)
    rows, columns = np.nonzero(100 * shared >= 80 * (a.sizes[:, None] + b.sizes[None, :] - shared))
    left, right = a.nodes[rows], b.nodes[columns]
    keep = left != right
    left, right = left[keep], right[keep]
    nodes, ends = np.unique(np.concatenate([left, right]), return_inverse=True)
    if not len(nodes):
        return
    x, y = ends[: len(left)], ends[len(left) :]
    low = np.arange(len(nodes))
    while True:
        before = low.copy()
        np.minimum.at(low, x, low[y])
        np.minimum.at(low, y, low[x])
        if (before == low).all():
            break
    yield from ((int(n), int(nodes[k])) for n, k in zip(nodes, low) if nodes[k] != n)


def heavy_links(classes: DataFrame, raw_sources: DataFrame, least: int) -> DataFrame:
    """``node, low`` links among sets of at least ``least`` shingles, as local components of the tiles that meet."""
    entries = classes.where((F.col("n") >= least) & F.col("prefix").isNotNull()).select(
        F.col("key").alias("node"), "n", "first", F.posexplode("prefix").alias("at", "token")
    ).select("node", "n", "token", (F.col("first") + F.col("at")).alias("place"))
    lengths = entries.groupBy("token").agg(F.count("*").alias("entries"), F.min("node").alias("pivot")).where("entries > 1")
    listed = cut_lineage(entries.join(lengths, "token"))
    short = listed.where(F.col("entries") <= SHORT_LIST).select("token", "node", "n", "place")
    other = short.select("token", F.col("node").alias("node2"), F.col("n").alias("n2"), F.col("place").alias("place2"))
    overlap = F.ceil(4 * (F.col("n") + F.col("n2")) / 9)
    pairs = cut_lineage(
        short.join(other, "token").where(
            (F.col("node") < F.col("node2")) & (4 * F.col("n") <= 5 * F.col("n2")) & (4 * F.col("n2") <= 5 * F.col("n"))
            & (F.col("place") <= F.col("n") - overlap) & (F.col("place2") <= F.col("n2") - overlap)
        ).select("node", "node2").distinct()
    )
    long = listed.where(F.col("entries") > SHORT_LIST).select("token", "node", "pivot")
    linked = pairs.select(F.col("node2").alias("node"), F.col("node").alias("low")).unionByName(
        long.select("node", F.col("pivot").alias("low")).where("node <> low").distinct()
    )
    families = connected_components(linked)
    placed = number_rows(families, ["component", "node"], "no").select(
        "node", F.floor((F.col("no") - 1) / TILE_ROWS).alias("tile")
    )
    placed = cut_lineage(placed)

    texts = raw_sources.select(F.xxhash64("id", "raw_text").alias("node"), "raw_text")
    chosen = texts.join(placed, "node").dropDuplicates(["node"])

    def sets():
        return lambda node, tile, text: (node, tile, shingles(text).astype("<u8").tobytes())

    found = map_rows(chosen.select("node", "tile", "raw_text"), sets, "node long, tile long, tokens binary")

    def gather(held):
        yield (
            held[0][1], np.array([h[0] for h in held], "<i8").tobytes(),
            np.array([len(h[2]) // 8 for h in held], "<i8").tobytes(), b"".join(h[2] for h in held),
        )

    body = "tile long, nodes binary, sizes binary, tokens binary"
    tiles = cut_lineage(
        stream_rows(found.repartition("tile").sortWithinPartitions("tile", "node"), lambda rows: by_group(rows, 1, gather), body)
    )

    where = placed.select("node", "tile")
    first = pairs.join(where, "node").select(F.col("tile").alias("a"), "node2")
    meets = first.join(where.select(F.col("node").alias("node2"), F.col("tile").alias("b")), "node2").select("a", "b")
    spans = long.join(where, "node").select("token", "tile").distinct()
    crossed = spans.select("token", F.col("tile").alias("a")).join(spans.select("token", F.col("tile").alias("b")), "token")
    meetings = meets.unionByName(crossed.where("a < b").select("a", "b")).select(
        F.least("a", "b").alias("tile"), F.greatest("a", "b").alias("other")
    ).where("tile <> other").distinct()
    # A tile's own row comes first among its rows, then the tiles it meets.
    others = tiles.withColumnRenamed("tile", "other")
    rows = meetings.join(others, "other").select("tile", "other", "nodes", "sizes", "tokens").unionByName(
        tiles.select("tile", F.col("tile").alias("other"), "nodes", "sizes", "tokens")
    )

    def meet(rows):
        held = None
        for tile, other, nodes, sizes, tokens in rows:
            now = Tile(nodes, sizes, tokens)
            if tile == other:
                held = now
            yield from compare(held, now)

    return stream_rows(rows.repartition("tile").sortWithinPartitions("tile", "other"), meet, "node long, low long")


def light_boundary(classes: DataFrame) -> int:
    """The largest size up to which subsets cost no more than list entries, each taken with the mean length of its list."""
    sizes = {r["n"]: r["c"] for r in classes.where(F.col("n") <= MAX_LIGHT).groupBy("n").agg(F.count("*").alias("c")).collect()}
    lists = classes.where("prefix IS NOT NULL").select(F.explode("prefix").alias("token")).groupBy("token").agg(F.count("*").alias("k"))
    row = lists.agg(F.sum(F.col("k") * F.col("k")).alias("work"), F.sum("k").alias("entries")).first()
    mean = (row["work"] or 0) / max(1, row["entries"] or 0) + 1
    boundary = 4
    for n in range(5, MAX_LIGHT + 1):
        subsets = sum(sizes.get(k, 0) * subset_cost(k, n) for k in range(2, n + 1))
        entries = sum(sizes.get(k, 0) * (k // 5 + 1) * mean for k in range(2, n + 1))
        if subsets > 4 * entries:
            break
        boundary = n
    return boundary


def grouped(raw_sources: DataFrame) -> DataFrame:
    """``id, key, n, first``: each row with its number of shingles and the first row (``absent, id, key``) of its group; null for an empty set."""
    sets = sketch(raw_sources)
    row = F.struct(F.isnull("id").alias("absent"), "id", "key")
    classes = cut_lineage(
        sets.where("n > 0").groupBy("n", "h1", "h2").agg(
            F.min_by(F.struct("key", "first", "prefix", "small"), "key").alias("rep"), F.min(row).alias("least")
        ).select("n", "h1", "h2", "rep.*", "least")
    )
    boundary = light_boundary(classes)
    links = light_links(classes, boundary).unionByName(
        heavy_links(classes, raw_sources, -(-4 * (boundary + 1) // 5))
    )
    components = connected_components(links)
    settled = classes.select("n", "h1", "h2", "key", "least").join(
        components.withColumnRenamed("node", "key"), "key", "left"
    ).withColumn("component", F.coalesce("component", "key"))
    names = settled.groupBy("component").agg(F.min("least").alias("first"))
    named = settled.join(names, "component").select("n", "h1", "h2", "first")
    return sets.select("id", "key", "n", "h1", "h2").join(named, ["n", "h1", "h2"], "left").drop("h1", "h2")


def similar_sources(raw_sources: DataFrame) -> DataFrame:
    """Texts that share shingles: ``id, n_shingles, component_id``, one row per row of ``id, raw_text``.

    Words are runs without ASCII white space, A-Z in lower case; a text's set holds its
    distinct runs of five words, the whole sequence if there are fewer. Two
    texts link if 100 * overlap >= 80 * union. ``component_id`` is the
    smallest id reachable by links, its own included. An empty or
    null text has an empty set and no link. Rows with equal texts are linked,
    also with equal or null ids; a null id never names a component that has another. Other columns
    are ignored; an empty table gives no rows. Shingles are compared by 64-bit hashes.
    """
    return grouped(raw_sources).select(
        "id", F.col("n").alias("n_shingles"), F.coalesce("first.id", "id").alias("component_id")
    )


def keep_first_of_similar(rows: DataFrame, id_column: str = "id", text: str = "raw_text") -> DataFrame:
    """One row of each group of similar texts, with all its columns: the one with the smallest id (of repeated rows, one).

    Rows without words are in no group and all stay.
    """
    sources = rows.select(F.col(id_column).cast("long").alias("id"), F.col(text).alias("raw_text"))
    kept = grouped(sources).where(F.col("first").isNull() | (F.col("key") == F.col("first.key")))
    kept = kept.groupBy("key").agg(F.max(F.col("n") > 0).alias("_once")).withColumnRenamed("key", "_row")
    keyed = rows.withColumn("_row", F.xxhash64(F.col(id_column).cast("long"), F.col(text)))
    joined = keyed.join(kept, "_row")
    return joined.where("_once").dropDuplicates(["_row"]).unionByName(joined.where("NOT _once")).drop("_row", "_once")
