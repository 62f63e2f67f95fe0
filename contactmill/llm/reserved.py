"""Raw sources that hold passages of texts kept back for evaluation, by winnowed fingerprints.

Of every ``WINDOW`` consecutive words a text keeps the smallest hash of the word runs inside.
Two texts that share such a window keep the same smallest hash there, so a join
on these few fingerprints finds every shared window; what it finds is then
compared word by word. Only DataFrame functions are used.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from contactmill.session import cut_lineage

# What a word is, and how many words make a window.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WINDOW = 10
# Rows of the reserved side that are broadcast at most; more are joined by a shuffle, split into SALTS parts per key.
BROADCAST_ROWS = 500_000
SALTS = 32


def words_of(text: Column) -> Column:
    """The words of a text with A-Z in lower case; other letters stay as they are."""
    text = F.coalesce(text, F.lit(""))
    ascii_only = F.length(text) == F.octet_length(text)
    folded = F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    return F.array_remove(F.split(folded, SEPARATORS, -1), "")


def along(rows: DataFrame, column: str, n: int, combine: Callable) -> DataFrame:
    """Replace an array by ``combine`` over every ``n`` neighbours, doubling the reach in each step."""
    def step(rows: DataFrame, by: int) -> DataFrame:
        a = F.col(column)
        left = F.greatest(F.size(a) - by, F.lit(0))
        return rows.withColumn(column, F.zip_with(F.slice(a, F.lit(1), left), F.slice(a, F.lit(1 + by), left), combine))

    reach = 1
    while 2 * reach <= n:
        rows, reach = step(rows, reach), 2 * reach
    return step(rows, n - reach) if reach < n else rows


def shape(size: int) -> tuple[int, int]:
    """Words per hashed run, and runs per window of ``size`` words: a shared window has a shared smallest run."""
    run = (size + 1) // 2
    return run, size + 1 - run


def with_fingerprints(texts: DataFrame, sizes: list[int], wanted: Callable[[int], Column] | None = None) -> DataFrame:
    """Add ``picks array<struct<size, at, print, context>>`` to rows with ``words``.

    ``at`` is the place of a run that is smallest in a window of ``size`` words, ``context`` holds the words
    of all windows around it. ``wanted(size)`` limits a size to some rows.
    """
    lowest = F.lit(-(1 << 63))
    texts = texts.withColumn("_hashes", F.transform("words", lambda w: F.xxhash64(w)))
    picks = []
    for size in sizes:
        run, reach = shape(size)
        g, low = f"_runs{size}", f"_low{size}"
        texts = along(texts.withColumn(g, F.col("_hashes")), g, run, lambda a, b: F.xxhash64(a, b))
        texts = along(texts.withColumn(low, F.col(g)), low, reach, lambda a, b: F.least(a, b))
        # A run is picked if it is the smallest of any window around it: the largest of those minima is itself.
        pad = F.array_repeat(lowest, reach - 1)
        texts = along(texts.withColumn(low, F.when(F.size(low) > 0, F.concat(pad, F.col(low), pad)).otherwise(F.col(low))), low, reach, lambda a, b: F.greatest(a, b))
        places = F.when(F.size(low) > 0, F.sequence(F.lit(0), F.size(low) - 1)).otherwise(F.array().cast("array<int>"))
        if wanted is not None:
            places = F.when(wanted(size), places).otherwise(F.array().cast("array<int>"))
        picked = F.filter(places, lambda i: F.get(F.col(g), i) == F.get(F.col(low), i))

        def pick(i):
            start = F.greatest(i - (size - run), F.lit(0))
            context = F.array_join(F.slice(F.col("words"), start + 1, i + size - start), " ")
            return F.struct(F.lit(size).alias("size"), i.alias("at"), F.get(F.col(g), i).alias("print"), context.alias("context"))

        picks.append(F.transform(picked, pick))
    return texts.withColumn("picks", F.concat(*picks))


def windows_around(picks: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, start, size, text``: every window of the picked places, once."""
    run = F.floor((F.col("size") + 1) / 2).cast("int")
    near = F.split("context", " ")
    first = F.greatest(F.col("at") - (F.col("size") - run), F.lit(0))
    return picks.select(*keys, "size", first.alias("_first"), near.alias("_near")).select(
        *keys, "size", "_first", "_near", F.explode(F.sequence(F.lit(0), F.size("_near") - F.col("size"))).alias("_j")
    ).select(
        *keys, (F.col("_first") + F.col("_j")).alias("start"), "size",
        F.array_join(F.slice("_near", F.col("_j") + 1, F.col("size")), " ").alias("text"),
    ).distinct()


def look_up(rows: DataFrame, held: DataFrame, on: list[str], broadcast_rows: int, how: str = "inner") -> DataFrame:
    """Join ``rows`` with the reserved side ``held``.

    ``held`` is broadcast if it has been counted and is small; else each of its rows
    goes to ``SALTS`` places and the other side is dealt over them, so that a key that most rows share is split.
    """
    if held.limit(broadcast_rows + 1).count() <= broadcast_rows:
        return rows.join(F.broadcast(held), on, how)
    salts = F.array(*[F.lit(s) for s in range(SALTS)])
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(*[c for c in rows.columns]), F.lit(SALTS)).cast("int"))
    return salted.join(held.withColumn("_salt", F.explode(salts)), [*on, "_salt"], how).drop("_salt")


def merged_spans(found: DataFrame) -> DataFrame:
    """``key, spans``: the union of the windows of each text, as spans of words."""
    order = Window.partitionBy("key").orderBy("start", "end")
    spans = found.select("key", F.col("start").cast("long"), (F.col("start") + F.col("size")).cast("long").alias("end")).distinct()
    reached = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    opened = spans.withColumn("_new", F.coalesce((F.col("start") > reached).cast("long"), F.lit(1)))
    runs = opened.withColumn("_run", F.sum("_new").over(order)).groupBy("key", "_run").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    return runs.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("spans"))


def find_reserved_passages(raw_sources: DataFrame, reserved: DataFrame, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """``id, n_words, spans, reserved_ids``: where each raw source repeats a reserved one.

    Both tables have ``id, raw_text``; the reserved sources are those an evaluation will ask about. Words are runs of
    letters, digits and all characters beyond ASCII, with A-Z in lower case. A window is ``WINDOW``
    consecutive words of a reserved source, or the whole of one that has fewer words, but not none. ``spans``
    (``start, end``, in words, end exclusive, in order, apart from each other) covers every word of the source inside a window
    that occurs anywhere in the reserved sources; ``reserved_ids`` names, sorted as strings, the reserved sources with such a window.

    A null or empty text has no words and matches nothing. Repeated rows each give a row. A null id stays null; a
    reserved source without an id is named by an empty string. Empty tables give no rows, or rows without spans. Other columns are
    ignored. Lengths of short reserved sources (at most nine numbers) are all that reaches the driver.
    """
    source_id = next(f.dataType for f in raw_sources.schema if f.name == "id")
    items = reserved.select(F.coalesce(F.col("id").cast("string"), F.lit("")).alias("item"), words_of(F.col("raw_text")).alias("words")).where(F.size("words") > 0)
    items = items.withColumn("fits", F.least(F.size("words"), F.lit(WINDOW)))
    sizes = sorted(r["fits"] for r in items.select("fits").distinct().collect())
    text = F.coalesce("raw_text", F.lit(""))
    texts = raw_sources.select(
        F.col("id"), F.md5(F.concat(F.coalesce(F.col("id").cast("string"), F.lit("-")), F.lit(":"), text)).alias("key"), words_of(text).alias("words"),
    ).withColumn("n_words", F.size("words").cast("long"))
    if not sizes:
        return texts.select("id", "n_words", F.array().cast("array<struct<start: bigint, end: bigint>>").alias("spans"), F.array().cast("array<string>").alias("reserved_ids"))

    # explode_outer: a plain explode would push "not empty" down through all the array steps and write them out many times over.
    own = with_fingerprints(items, sizes, lambda size: F.col("fits") == size)
    own = cut_lineage(own.select("item", F.explode_outer("picks").alias("p")).select("item", "p.*").where("size IS NOT NULL"))
    held = cut_lineage(windows_around(own, ["item"]).select("text", "item").distinct())
    prints = own.select("size", "print").distinct().withColumn("known", F.lit(True))

    # One pass over the texts: a row per text (size 0) and one per fingerprint, of which the unknown ones go at once.
    mark = F.struct(F.lit(0).alias("size"), F.lit(-1).alias("at"), F.xxhash64("key").alias("print"), F.lit(None).cast("string").alias("context"))
    picked = with_fingerprints(texts, sizes).select("id", "key", "n_words", F.explode_outer(F.concat(F.array(mark), F.col("picks"))).alias("p"))
    marks = look_up(picked.select("id", "key", "n_words", "p.*"), prints, ["size", "print"], broadcast_rows, "left")
    marks = cut_lineage(marks.where("known OR size = 0").drop("known", "print"))

    # Windows that occur in the same reserved sources count as one of them when they are listed.
    same = held.groupBy("text").agg(
        F.count("*").alias("n"), F.bit_xor(F.xxhash64("item")).alias("x"), F.sum(F.xxhash64(F.lit(1), "item").cast("decimal(38,0)")).alias("s")
    ).withColumn("like", F.min("text").over(Window.partitionBy("n", "x", "s"))).select("text", "like")
    around = windows_around(marks.where("size > 0").select("key", "size", "at", "context"), ["key"])
    found = cut_lineage(look_up(around, same, ["text"], broadcast_rows).select("key", "start", "size", "like"))
    listed = look_up(found.select("key", F.col("like").alias("text")).distinct(), held, ["text"], broadcast_rows)
    named = listed.select("key", "item").distinct().groupBy("key").agg(F.array_sort(F.collect_list("item")).alias("reserved_ids"))
    results = merged_spans(found).join(named, "key")
    return marks.where("size = 0").select(F.col("id").cast(source_id), "key", "n_words").join(results, "key", "left").select(
        "id", "n_words", F.coalesce("spans", F.array().cast("array<struct<start: bigint, end: bigint>>")).alias("spans"),
        F.coalesce("reserved_ids", F.array().cast("array<string>")).alias("reserved_ids"),
    )
