"""Language of stored texts by a bit-sliced Bloom filter over letter n-grams.

One filter serves all languages: every slot holds a bit for each language, in as many words as that takes. A
look-up takes the conjunction of an n-gram's slots and so gives, at once, all
languages that contain it. The bits are counted per language over a text,
corrected for what a filter answers by chance, and the language with the largest
corrected share is the answer.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from contactmill.llm.rows import map_rows
from contactmill.session import cut_lineage

SIZES = (2, 3)
PROBES = 3
WORD = 64
UNKNOWN = "und"


@functools.lru_cache(maxsize=1)
def letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit numbers over all bits."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def grams(text: str | None) -> np.ndarray:
    """Hashes of the letter n-grams of a text in lower case; whatever lies between words is one blank."""
    code = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    kind = letters()[code]
    if not kind.any():
        return np.zeros(0, np.uint64)
    code = np.where(kind, code, 32)
    keep = np.ones(len(code), bool)
    keep[1:] = kind[1:] | kind[:-1]
    code = np.concatenate([[32], code[keep], [32]]).astype(np.uint64)
    out = []
    for size in SIZES:
        key = np.full(max(0, len(code) - size + 1), size, np.uint64)
        for at in range(size):
            key = (key << np.uint64(21)) + code[at : at + len(key)]
        out.append(key)
    return mixed(np.concatenate(out))


def holding(found: np.ndarray, language: int) -> np.ndarray:
    """Non-zero where a bit set, of one word or a row of words, has the language's bit."""
    word = found if found.ndim == 1 else found[:, language // WORD]
    return word & np.uint64(1 << language % WORD)


@dataclass
class LanguageFilter:
    """The fitted filter: languages in order, slots (a row of words each, if one word has too few bits), and the share of n-grams each language answers by chance."""

    languages: list[str]
    slots: np.ndarray
    by_chance: np.ndarray

    @classmethod
    def of(cls, languages: list[str], keys: np.ndarray, masks: np.ndarray, n_slots: int) -> LanguageFilter:
        slots = np.zeros((n_slots, *masks.shape[1:]), np.uint64)
        words, given = slots.reshape(n_slots, -1), masks.reshape(len(keys), -1)
        for place in cls.places(keys, n_slots):
            for w in range(words.shape[1]):
                np.bitwise_or.at(words[:, w], place, given[:, w])
        filled = np.array([np.count_nonzero(holding(slots, i)) for i in range(len(languages))])
        return cls(languages, slots, (filled / n_slots) ** PROBES)

    @staticmethod
    def places(keys: np.ndarray, n_slots: int) -> Iterator[np.ndarray]:
        for probe in range(PROBES):
            yield ((keys >> np.uint64(21 * probe)) & np.uint64(n_slots - 1)).astype(np.int64)

    def containing(self, keys: np.ndarray) -> np.ndarray:
        """For each n-gram the bit set of the languages that contain it."""
        found = None
        for place in self.places(keys, len(self.slots)):
            found = self.slots[place] if found is None else found & self.slots[place]
        return found

    def predict(self, text: str | None) -> tuple[str, float]:
        keys = grams(text)
        if not len(keys) or not self.languages:
            return UNKNOWN, 0.0
        masks = self.containing(keys)
        counts = np.array([np.count_nonzero(holding(masks, i)) for i in range(len(self.languages))])
        shares = (counts / len(keys) - self.by_chance) / (1 - np.minimum(self.by_chance, 0.99))
        best = int(np.argmax(shares))
        return self.languages[best], float(min(1.0, max(0.0, shares[best])))


def fit_language_filter(
    examples: DataFrame, max_examples: int = 20_000, max_grams: int = 60_000, n_slots: int = 1 << 20,
    min_texts: int = 3, min_rate: float = 0.1,
) -> LanguageFilter:
    """Learn which n-grams belong to which language from ``raw_text, language`` rows.

    Of every language about ``max_examples`` different texts are used, chosen by a hash of
    the text (all, if there are no more), so what is learned of a language depends neither on the
    size of the table nor on copies. A language contains an n-gram if at least ``min_texts`` of its
    examples do (or as many as share any n-gram, if those are fewer, so that every language
    with a letter is learned) and its rate there is at least ``min_rate`` of the highest rate in any
    language that has it in ``min_texts``, so that a few foreign lines do no harm. Only the
    ``max_grams`` most frequent of each language are kept, which bounds what reaches the
    driver. Any number of languages: a slot takes 8 octets for every 64. Rows without text or
    language teach nothing; without any rows the filter knows no language.
    """
    known = examples.select("raw_text", "language").where("raw_text IS NOT NULL AND language IS NOT NULL")
    drawn = known.withColumn("drawn", F.xxhash64("raw_text"))
    different = drawn.select("language", "drawn").distinct().groupBy("language").agg(F.count("*").alias("different"))
    share = F.lit(float(max_examples)) / F.col("different")
    known = drawn.join(F.broadcast(different), "language").where(
        (F.col("different") <= max_examples) | (F.pmod("drawn", F.lit(1 << 40)) < share * (1 << 40))
    ).select("raw_text", "language").distinct()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}
        size = 0

        def given():
            for language, parts in held.items():
                keys, texts = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
                total = np.bincount(texts, np.concatenate([p[1] for p in parts])).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([language] * len(keys)), pa.array(keys.view(np.int64)), pa.array(total), pa.array(np.bincount(texts))],
                    names=["language", "gram", "n", "texts"],
                )
            held.clear()

        for batch in batches:
            for i in range(batch.num_rows):
                keys, n = np.unique(grams(batch.column(0)[i].as_py()), return_counts=True)
                held.setdefault(batch.column(1)[i].as_py(), []).append((keys, n))
                size += len(keys)
                if size > 2_000_000:
                    yield from given()
                    size = 0
        yield from given()

    counts = cut_lineage(
        known.mapInArrow(count, "language string, gram long, n long, texts long")
        .groupBy("language", "gram").agg(F.sum("n").alias("n"), F.sum("texts").alias("texts"))
    )
    shared = counts.groupBy("language").agg(F.least(F.max("texts"), F.lit(min_texts)).alias("least"))
    counts = counts.join(F.broadcast(shared), "language").where(F.col("texts") >= F.col("least")).drop("least")
    totals = sorted(counts.groupBy("language").agg(F.sum("n"), F.count("*")).collect())
    if not totals:
        return LanguageFilter([], np.zeros(n_slots, np.uint64), np.zeros(0))
    names = [name for name, _, _ in totals]
    large = [name for name, _, different in totals if different > max_grams]
    if large:
        rank = F.row_number().over(Window.partitionBy("language").orderBy(F.desc("n"), "gram"))
        cut = counts.where(F.col("language").isin(large)).withColumn("rank", rank).where(F.col("rank") <= max_grams).drop("rank")
        counts = counts.where(~F.col("language").isin(large)).unionByName(cut)
    sizes = examples.sparkSession.createDataFrame([(name, at, n) for at, (name, n, _) in enumerate(totals)], "language string, at int, total long")
    rates = counts.join(F.broadcast(sizes), "language").withColumn("rate", F.col("n") / F.col("total"))
    wide = rates.groupBy("gram").agg(
        F.coalesce(F.max(F.when(F.col("texts") >= min_texts, F.col("rate"))), F.lit(0.0)).alias("top"),
        F.collect_list(F.struct("at", "rate")).alias("rates"),
    )
    own = wide.select("gram", F.explode(F.filter("rates", lambda r: r["rate"] >= min_rate * F.col("top"))).alias("r"))
    kept = own.select("gram", "r.at").toArrow()
    keys, row = np.unique(kept["gram"].to_numpy().view(np.uint64), return_inverse=True)
    at = kept["at"].to_numpy()
    masks = np.zeros((len(keys), -(-len(names) // WORD)), np.uint64)
    np.bitwise_or.at(masks, (row, at // WORD), np.uint64(1) << (at % WORD).astype(np.uint64))
    return LanguageFilter.of(names, keys, masks if masks.shape[1] > 1 else masks[:, 0], n_slots)


def identify_language(raw_sources: DataFrame, examples: DataFrame, **fit) -> DataFrame:
    """Language of every raw source: ``id, language, score``, one row per row of ``id, raw_text``.

    ``examples`` (``raw_text, language``) and ``fit`` go to ``fit_language_filter``.
    Whole texts are read. ``score`` (0 to 1) is the share of the text's n-grams that
    the language contains, less what it would by chance; ties go to the first language
    in order of name. A null text, or one without a letter, is ``und`` with
    score 0, as is everything if nothing was learned. Other columns are ignored.
    """
    shared = raw_sources.sparkSession.sparkContext.broadcast(fit_language_filter(examples, **fit))

    def predict():
        model = shared.value
        return lambda i, text: (i, *model.predict(text))

    return map_rows(raw_sources.select("id", "raw_text"), predict, "id long, language string, score double")
