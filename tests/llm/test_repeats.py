import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from contactmill.llm import repeats


def brute(words):
    n, out = len(words), []
    for i in range(n):
        best = 0
        for j in range(n):
            k = 0
            while i != j and i + k < n and j + k < n and words[i + k] == words[j + k]:
                k += 1
            best = max(best, k)
        out.append(best if best >= 2 else 0)
    return out


@given(st.lists(st.lists(st.integers(0, 2), max_size=14), min_size=1, max_size=4))
@settings(max_examples=300, deadline=None)
def test_longest_repeats(texts):
    words = np.array([w for t in texts for w in t], np.int64)
    text_of = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    assert repeats.longest_repeats(words, text_of).tolist() == [x for t in texts for x in brute(t)]


def base(text):
    words = re.findall("[^\x20\x09-\x0d]+", text or "")
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    inside = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)}
    lines = [line for line in (text or "").split("\n") if re.search("[^\x20\x09-\x0d]", line)]
    return (
        len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(inside),
        len(words) < 50 or 100 * len(inside) > 50 * len(words),
    )


def test_rules(spark):
    plain = " ".join(f"w{i}" for i in range(80))
    long_repeat = " ".join([" ".join(f"v{i}" for i in range(40))] * 2 + [f"u{i}" for i in range(30)])
    texts = [plain, plain, None, "", "a b\na b\n\n#*", long_repeat, "x " * 5000, plain + "\n" + " ".join(f"w{i}" for i in range(9))]
    rows = spark.createDataFrame([(i, t, "e") for i, t in enumerate(texts)], "id long, raw_text string, kept string")
    out = {r["id"]: r for r in repeats.quality_rules(rows).collect()}
    for i, text in enumerate(texts):
        r = out[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == base(text)
    assert [i for i in out if out[i]["kept"]] == [0, 1, 7]
    assert (out[7]["covered_words"], out[7]["longest_repeat"]) == (18, 9)
    kept = repeats.keep_good_texts(rows.withColumnRenamed("raw_text", "text"), "text")
    assert sorted(r["id"] for r in kept.collect()) == [0, 1, 7] and kept.columns == ["id", "text", "kept"]
    strict = repeats.quality_rules(rows, max_covered=0.1).where("kept").collect()
    assert sorted(r["id"] for r in strict) == [0, 1]
    assert repeats.quality_rules(rows.limit(0)).count() == 0


def test_covered_share_rejects_what_the_base_keeps(spark):
    """Runs over 0.3 but not over half of the words; several very long texts in one slice of ``keep_good_texts``."""
    twice = " ".join(f"w{i}" for i in range(20))
    texts = [" ".join([twice, *[f"u{i}" for i in range(60)], twice]), " ".join([twice, *[f"u{i}" for i in range(160)], twice])]
    long_texts = [" ".join(f"{k}x{i}" for i in range(120_000)) for k in range(3)]
    rows = spark.createDataFrame(list(enumerate([*texts, *long_texts])), "id long, raw_text string").coalesce(1)
    out = {r["id"]: r for r in repeats.quality_rules(rows).collect()}
    assert not out[0]["base_failed"] and not out[0]["kept"] and out[1]["kept"]
    assert sorted(r["id"] for r in repeats.keep_good_texts(rows).select("id").collect()) == [1, 2, 3, 4]
