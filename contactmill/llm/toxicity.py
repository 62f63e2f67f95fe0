"""Toxicity of stored texts by a weighted finite-state grammar over clauses.

A text is cut into clauses. A lexicon turns the words of a clause into classes
(insult, threat, target, speaker, negation, report, other) with weights. A first transducer reads a clause from its end
and marks insults that a target follows and threats whose object, a target, follows closely. Then three small ones
read from its start: one weakens insults and threats under negation, one weakens what is
reported of others, one strengthens insults with a target on either side and threats of the speaker, and gives a
threat without an object no weight. Their composition is built once as one machine; the weight of a clause is the sum
along its path, and the clauses of a text add up to its log-odds.

Insults and their weights are learned from labelled texts, as whole words or as the longest beginning that several
forms of a word share; the other classes are fixed words.
"""

from __future__ import annotations

import functools
import math
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contactmill.llm.rows import filter_rows, map_rows
from contactmill.session import cut_lineage

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT, SPEAKER, AIMED_INSULT, AIMED_THREAT = CLASSES = range(9)
HURTFUL = (INSULT, THREAT, AIMED_INSULT, AIMED_THREAT)

# Words of the closed classes in English, German, French and Spanish.
FIXED = {
    TARGET: "you your you're yourself he she they them him her du dich dir euch ihr sie tu te toi vous tú te ti vosotros ustedes él ella",
    SPEAKER: "i i'll i'm we we'll ich wir je nous yo nosotros",
    NEGATION: "not no never isn't aren't wasn't don't won't can't couldn't wouldn't didn't doesn't nicht kein keine nie ne pas jamais no nunca jamás",
    REPORT: "said says told called reported quoted wrote sagte sagt nannte berichtet dit disait appelé dijo dice llamó",
    THREAT: "kill hurt destroy beat stab shoot töten umbringen schlagen tuer frapper détruire matar golpear destruir",
}
DEADLY = set("kill stab shoot töten umbringen tuer matar".split())
#: weight of a deadly and of any other threat, share left of a negated and of a reported insult, factors of a targeted insult
#: and of a threat that the speaker makes
DEADLY_WEIGHT, THREAT_WEIGHT, NEGATED, REPORTED, TARGETED, SPOKEN = 3.0, 1.5, 0.4, 0.5, 1.5, 1.8
NEGATION_REACH = 3
OBJECT_REACH = 3
#: shortest learned beginning, and letters a word may have beyond one
SHORTEST_STEM, LONGEST_ENDING = 5, 4

WORD = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?")
CLAUSE_END = re.compile(r"[.!?;:,\n]")


@dataclass
class Transducer:
    """States from 0, and for (state, class) the next state, the class given on, and a factor on its weight."""

    n_states: int
    step: dict = field(default_factory=dict)

    def compose(self, after: Transducer) -> Transducer:
        """The machine that feeds this one's classes to ``after``; factors multiply."""
        out = Transducer(self.n_states * after.n_states)
        for a in range(self.n_states):
            for b in range(after.n_states):
                for c in CLASSES:
                    a2, mid, f = self.step[a, c]
                    b2, last, g = after.step[b, mid]
                    out.step[a * after.n_states + b, c] = (a2 * after.n_states + b2, last, f * g)
        return out


@functools.lru_cache(maxsize=1)
def looking_ahead() -> Transducer:
    """Reads a clause from its end: state 0 before any target, else 1 and how many words it reaches back to a threat."""
    out = Transducer(OBJECT_REACH + 2)
    for s in range(OBJECT_REACH + 2):
        for c in CLASSES:
            following = OBJECT_REACH + 1 if c == TARGET else max(min(s, 1), s - 1)
            given = AIMED_INSULT if s and c == INSULT else AIMED_THREAT if s > 1 and c == THREAT else c
            out.step[s, c] = (following, given, 1.0)
    return out


@functools.lru_cache(maxsize=1)
def grammar() -> Transducer:
    """Reads the classes that ``looking_ahead`` gives, from the start of the clause."""
    negation = Transducer(NEGATION_REACH + 1)
    for s in range(NEGATION_REACH + 1):
        for c in CLASSES:
            following = NEGATION_REACH if c == NEGATION else max(0, s - 1)
            negation.step[s, c] = (following, c, NEGATED if s and c in HURTFUL else 1.0)
    reported = Transducer(2)
    for s in range(2):
        for c in CLASSES:
            reported.step[s, c] = (1 if c == REPORT else s, c, REPORTED if s and c in HURTFUL else 1.0)
    # States: 0, 1 after a target, 2 after the speaker, 3 after both; who reports is neither.
    aimed = Transducer(4)
    for s in range(4):
        for c in CLASSES:
            factor = {
                INSULT: TARGETED if s & 1 else 1.0, AIMED_INSULT: TARGETED, THREAT: 0.0, AIMED_THREAT: SPOKEN if s & 2 else 1.0,
            }.get(c, 1.0)
            aimed.step[s, c] = (0 if c == REPORT else s | {TARGET: 1, SPEAKER: 2}.get(c, 0), c, factor)
    return negation.compose(reported).compose(aimed)


@dataclass
class ToxicityModel:
    """Learned insults: stems (a word may add an ending of a few letters) and whole words with weights; log-odds before any evidence."""

    stems: dict[str, float]
    words: dict[str, float]
    prior: float

    def __post_init__(self):
        self.fixed = {w: c for c, text in FIXED.items() for w in text.split()}
        self.ahead, self.machine = looking_ahead().step, grammar().step
        self.finder = ahocorasick.Automaton()
        for w in {*self.stems, *self.words, *FIXED[THREAT].split()}:
            self.finder.add_word(w, len(w))
        self.finder.make_automaton()
        self.lengths = sorted({len(s) for s in self.stems})

    def classify(self, word: str) -> tuple[int, float]:
        weight = self.words.get(word, 0.0)
        for n in self.lengths:
            if n <= len(word) <= n + LONGEST_ENDING:
                weight = max(weight, self.stems.get(word[:n], 0.0))
        if weight:
            return INSULT, weight
        kind = self.fixed.get(word, OTHER)
        return kind, 0.0 if kind != THREAT else DEADLY_WEIGHT if word in DEADLY else THREAT_WEIGHT

    def clause_weight(self, clause: str) -> float:
        found = [self.classify(word) for word in WORD.findall(clause)]
        state, kinds = 0, []
        for kind, _ in reversed(found):
            state, given, _ = self.ahead[state, kind]
            kinds.append(given)
        state, total = 0, 0.0
        for kind, (_, weight) in zip(reversed(kinds), found):
            state, _, factor = self.machine[state, kind]
            total += weight * factor
        return total

    def score(self, text: str | None) -> float:
        """Chance that the text is toxic. Only clauses with a word of the lexicon can have weight, so only they are read."""
        lower = (text or "").lower()
        total, done = self.prior, 0
        if len(self.finder):
            for end, length in self.finder.iter(lower):
                start = end - length + 1
                if start < done or (start and (lower[start - 1].isalnum())):
                    continue
                begin = 1 + max((lower.rfind(mark, done, start) for mark in ".!?;:,\n"), default=-1)
                stop = CLAUSE_END.search(lower, end)
                stop = stop.start() if stop else len(lower)
                total += self.clause_weight(lower[max(begin, done):stop])
                done = stop
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, total))))


def stems_of(text: str | None) -> Iterator[tuple[str, str, str]]:
    """Each word with its neighbours, as itself (``=word``) and by all its beginnings from five letters on: candidate, neighbours, word."""
    words = WORD.findall((text or "").lower())
    for i, w in enumerate(words):
        near = f"{words[i - 1] if i else ''} {words[i + 1] if i + 1 < len(words) else ''}"
        if len(w) >= 3:
            yield "=" + w, near, w
        for n in range(max(SHORTEST_STEM, len(w) - LONGEST_ENDING), len(w) + 1):
            yield w[:n], near, w


def fit_toxicity(
    raw_sources: DataFrame, labels: DataFrame, max_toxic: int = 4_000, max_clean: int = 16_000,
    max_candidates: int = 20_000, min_contexts: int = 5, min_ratio: float = 30.0,
) -> ToxicityModel:
    """Learn insults from the raw sources that ``labels`` (``id, toxic``: 1 or 0; others teach nothing) names.

    At most ``max_toxic`` toxic and ``max_clean`` clean labels are used, chosen by a hash
    of the id among those that have a source, so only that many ids are sent to the texts. A candidate is a word, or a beginning that at least two
    forms of a word share, that occurs in at least ``min_contexts`` different neighbourhoods in toxic texts, and in about as many
    neighbourhoods as texts (a word that only copies of one text share has few).
    It is an insult if toxic texts have it ``min_ratio`` times as
    often as clean ones; its weight is the logarithm of that. The ``max_candidates``
    most frequent candidates are tried, which bounds what reaches the driver.
    Without toxic examples nothing is learned.
    """
    known = labels.select("id", F.col("toxic").cast("int").alias("toxic")).where("id IS NOT NULL AND toxic IN (0, 1)")
    texts = raw_sources.select("id", "raw_text")
    known = cut_lineage(known.join(texts.select("id"), "id", "left_semi"))
    sizes = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    prior = math.log((sizes.get(1, 0) + 1) / (sizes.get(0, 0) + 2))
    prior = min(prior, -1.0)

    def part(label: int, most: int) -> DataFrame:
        chosen = known.where(F.col("toxic") == label).orderBy(F.xxhash64("id"), "id").limit(most).select("id").distinct()
        return texts.join(F.broadcast(chosen), "id").select("raw_text")

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, near = defaultdict(int), defaultdict(set)
        for batch in batches:
            for value in batch.column(0):
                once = {}
                for stem, context, word in stems_of(value.as_py()):
                    once.setdefault(stem, (context, word))
                for stem, seen in once.items():
                    texts[stem] += 1
                    near[stem].add(seen)
        rows = [(stem, *seen, 0) for stem, all_of in near.items() for seen in all_of] + [(s, None, None, n) for s, n in texts.items()]
        for at in range(0, len(rows), 10_000):
            cut = rows[at : at + 10_000]
            kinds = (pa.string(), pa.string(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*cut), kinds)], names=["stem", "near", "form", "texts"])

    found = (
        part(1, max_toxic).mapInArrow(contexts, "stem string, near string, form string, texts long")
        .groupBy("stem").agg(
            F.count_distinct("near").alias("contexts"), F.count_distinct("form").alias("forms"), F.sum("texts").alias("texts")
        )
        .where((F.col("contexts") >= min_contexts) & (2 * F.col("contexts") >= F.col("texts")))
        .where(F.startswith("stem", F.lit("=")) | (F.col("forms") >= 2))
        .orderBy(F.desc("texts"), "stem").limit(max_candidates).collect()
    )
    candidates = {r["stem"]: r["texts"] for r in found}

    def occurring(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, seen = defaultdict(int), 0
        for batch in batches:
            for value in batch.column(0):
                seen += 1
                for stem in {s for s, _, _ in stems_of(value.as_py()) if s in candidates}:
                    texts[stem] += 1
        texts[""] = seen
        yield pa.RecordBatch.from_arrays([pa.array(list(texts)), pa.array(list(texts.values()))], names=["stem", "n"])

    clean = part(0, max_clean).mapInArrow(occurring, "stem string, n long").groupBy("stem").agg(F.sum("n").alias("n"))
    clean = {r["stem"]: r["n"] for r in clean.collect()} if candidates else {}
    n_toxic, n_clean = part(1, max_toxic).count() if candidates else 0, clean.get("", 0)
    ratios = {
        s: (n + 0.5) / (n_toxic + 1) * (n_clean + 1) / (clean.get(s, 0) + 0.5) for s, n in candidates.items()
    }
    # The longest beginning stands for its forms: a longer one, or a whole word, with most texts of a stem takes its place.
    telling = {s for s, ratio in ratios.items() if ratio >= min_ratio}
    outdone = set()
    for form in telling:
        plain = form.removeprefix("=")
        for n in range(SHORTEST_STEM, len(plain) + (form != plain)):
            if plain[:n] != form and candidates[form] >= 0.8 * candidates.get(plain[:n], math.inf):
                outdone.add(plain[:n])
    stems = {s: math.log(ratios[s]) for s in sorted(telling - outdone) if not s.startswith("=")}
    words = {s[1:]: math.log(ratios[s]) for s in sorted(telling) if s.startswith("=")}
    return ToxicityModel(stems, words, prior)


def drop_toxic(rows: DataFrame, model: ToxicityModel, text: str = "raw_text") -> DataFrame:
    """The rows whose text scores below 0.5, with all their columns; nothing is shuffled."""
    shared = rows.sparkSession.sparkContext.broadcast(model)
    return filter_rows(rows, text, lambda: lambda texts: [shared.value.score(t) < 0.5 for t in texts])


def score_toxicity(raw_sources: DataFrame, labels: DataFrame, **fit) -> DataFrame:
    """Toxicity of every raw source: ``id, score, toxic``, one row per row of ``id, raw_text``.

    ``labels`` (``id, toxic``) and ``fit`` go to ``fit_toxicity``, which learns from these sources. Whole texts
    are read. ``score`` (0 to 1) is the chance that a label would be 1;
    ``toxic`` is 1 if it is at least 0.5. A null or empty text has the score of a
    text without evidence; repeated rows give repeated rows; other columns are ignored.
    """
    shared = raw_sources.sparkSession.sparkContext.broadcast(fit_toxicity(raw_sources, labels, **fit))

    def scored():
        model = shared.value
        return lambda i, text: (i, model.score(text))

    out = map_rows(raw_sources.select("id", "raw_text"), scored, "id long, score double")
    return out.withColumn("toxic", (F.col("score") >= 0.5).cast("int"))
