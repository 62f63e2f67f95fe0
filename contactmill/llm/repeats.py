"""Quality rules of stored texts, with repetition measured on a suffix array of words.

The suffix array of a text's words is built by doubling: suffixes are ordered
by their first word, then two, four, and so on, and only those still tied go
on. Neighbours in the array with a common prefix of k words are a repeat of k
words; for each word the longer prefix shared with its two neighbours is the
longest repeated run of words that starts there. The union of all such runs is
what the text repeats.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from contactmill.llm.rows import filter_rows

WORD = re.compile("[^\x20\x09-\x0d]+")
SYMBOLS = "#*$%&|<>"
WORDS_AT_ONCE = 100_000

SCHEMA = (
    "id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "covered_words long, longest_repeat long, base_failed boolean, kept boolean"
)


def longest_repeats(words: np.ndarray, text_of: np.ndarray) -> np.ndarray:
    """For each word the length of the longest run of words from there that occurs again in the same text.

    ``words`` are word numbers of several texts one after the other, ``text_of``
    the number of each word's text, ascending. Runs of fewer than two words count as 0.
    """
    n = len(words)
    if not n:
        return np.zeros(0, np.int64)
    # Words of different texts differ, so no run goes over the end of a text.
    key = text_of.astype(np.int64) * (int(words.max()) + 1) + words
    order = np.argsort(key, kind="stable")
    new = np.concatenate([[True], key[order][1:] != key[order][:-1]])
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    levels, step = [], 1
    while True:
        tied = np.flatnonzero(np.bincount(rank, minlength=n)[rank] > 1)
        if not len(tied):
            break
        levels.append((step, rank.copy()))
        after = np.where(tied + step < n, rank[np.minimum(tied + step, n - 1)], -1)
        order = np.lexsort((after, rank[tied]))
        at, head, tail = tied[order], rank[tied][order], after[order]
        place = np.arange(len(at))
        first_of_group = np.maximum.accumulate(np.where(np.concatenate([[True], head[1:] != head[:-1]]), place, 0))
        fresh = np.concatenate([[True], (head[1:] != head[:-1]) | (tail[1:] != tail[:-1])])
        rank[at] = head + np.maximum.accumulate(np.where(fresh, place, 0)) - first_of_group
        step *= 2
    suffixes = np.empty(n, np.int64)
    suffixes[rank] = np.arange(n)
    left, right = suffixes[:-1], suffixes[1:]
    if len(levels) < 2:
        return np.zeros(n, np.int64)
    alike = np.flatnonzero(levels[1][1][left] == levels[1][1][right])
    left, right = left[alike], right[alike]
    common = np.zeros(len(alike), np.int64)
    for step, ranks in reversed(levels):
        a, b = left + common, right + common
        inside = (a < n) & (b < n)
        common += step * (inside & (ranks[np.minimum(a, n - 1)] == ranks[np.minimum(b, n - 1)]))
    longest = np.zeros(n, np.int64)
    np.maximum.at(longest, left, common)
    np.maximum.at(longest, right, common)
    return longest


def covered(starts: np.ndarray, lengths: np.ndarray, n: int) -> np.ndarray:
    """Which of ``n`` places lie in one of the spans."""
    edges = np.bincount(starts, minlength=n + 1)[: n + 1] - np.bincount(starts + lengths, minlength=n + 1)[: n + 1]
    return np.cumsum(edges)[:n] > 0


def text_rows(ids: list, texts: list, min_words: int, max_covered: float, max_repeat: int) -> list[tuple]:
    """Quality columns of a few texts."""
    numbers, counts, plain = {}, [], []
    words = []
    for text in texts:
        text = text or ""
        own = WORD.findall(text)
        counts.append(len(own))
        words += [numbers.setdefault(w, len(numbers)) for w in own]
        seen, duplicates = set(), 0
        for line in text.split("\n"):
            if line in seen:
                duplicates += 1
            elif WORD.search(line):
                seen.add(line)
        plain.append((sum(map(len, own)), sum(map(text.count, SYMBOLS)), duplicates))
    total = len(words)
    text_of = np.repeat(np.arange(len(texts)), counts)
    longest = longest_repeats(np.array(words, np.int64), text_of)
    by_text = lambda hit: np.bincount(text_of[hit], minlength=len(texts)).tolist()
    threes = np.flatnonzero(longest >= 3)
    repeated = by_text(covered(threes, np.full(len(threes), 3), total))
    runs = np.flatnonzero(longest >= min_words)
    spans = by_text(covered(runs, longest[runs], total))
    most = np.zeros(len(texts), np.int64)
    np.maximum.at(most, text_of, longest)
    out = []
    for i, n, (chars, symbols, duplicates), again, span, run in zip(ids, counts, plain, repeated, spans, most.tolist()):
        failed = n < 50 or 100 * again > 50 * n
        kept = not failed and span <= max_covered * n and run <= max_repeat
        out.append((i, n, chars, symbols, duplicates, again, span, run, failed, kept))
    return out


#: least words of a run that counts, largest share of words in such runs, most words in one run. The share is below that of
#: the base rule, whose windows of three words lie in every such run, so that it can reject a text on its own.
LIMITS = (8, 0.3, 300)


def keep_good_texts(rows: DataFrame, text: str = "raw_text", limits: tuple[int, float, int] = LIMITS) -> DataFrame:
    """The rows whose text ``quality_rules`` keeps, with all their columns; nothing is shuffled."""
    return filter_rows(rows, text, lambda: lambda texts: [r[-1] for r in text_rows(texts, texts, *limits)])


def quality_rules(
    raw_sources: DataFrame, min_words: int = LIMITS[0], max_covered: float = LIMITS[1], max_repeat: int = LIMITS[2]
) -> DataFrame:
    """Measure every raw source and decide whether it is kept: one row per row of ``id, raw_text``.

    ``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words`` describe the
    text; ``base_failed`` is true for fewer than 50 words or more than half of
    them in repeated 3-word windows. ``covered_words`` is the union of all
    repeated runs of at least ``min_words`` words, ``longest_repeat`` the words
    in the longest run (0 if no two words recur). A text is ``kept`` if it
    passes the base rules, repeats at most ``max_covered`` of its words in such
    runs, and has no run over ``max_repeat`` words. Words are split at ASCII
    white space and compared exactly. A null text counts as empty (all zero,
    not kept); repeated rows give repeated rows; other columns are ignored.
    """
    target = to_arrow_schema(StructType.fromDDL(SCHEMA))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts, chars = [], [], 0
            for i in range(batch.num_rows):
                text = batch.column(1)[i].as_py()
                ids.append(batch.column(0)[i].as_py())
                texts.append(text)
                chars += len(text or "")
                if chars >= 6 * WORDS_AT_ONCE or i + 1 == batch.num_rows:
                    rows = text_rows(ids, texts, min_words, max_covered, max_repeat)
                    yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), target)], schema=target)
                    ids, texts, chars = [], [], 0

    return raw_sources.select("id", "raw_text").mapInArrow(run, SCHEMA)
