import random
import re

import pytest

from contactmill.llm import reserved

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items):
    """Words inside windows, and the items with such windows, by looking at every window."""
    windows = {}
    for i, text in items:
        w = words(text)
        n = min(10, len(w))
        for a in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[a : a + n]), set()).add("" if i is None else str(i))
    out = []
    for i, text in docs:
        w, hit, named = words(text), set(), set()
        for n in {len(k) for k in windows}:
            for a in range(len(w) - n + 1):
                if (found := windows.get(tuple(w[a : a + n]))) is not None:
                    hit |= set(range(a, a + n))
                    named |= found
        out.append((i, len(w), sorted(hit), sorted(named)))
    return sorted(out, key=repr)


def run(spark, docs, items, schema="id long, raw_text string", **given):
    found = reserved.find_reserved_passages(spark.createDataFrame(docs, schema), spark.createDataFrame(items, schema), **given).collect()
    for r in found:
        assert all(a.end < b.start for a, b in zip(r.spans, r.spans[1:]))
    return sorted(((r.id, r.n_words, [w for s in r.spans for w in range(s.start, s.end)], r.reserved_ids) for r in found), key=repr)


def repetitive():
    """Three words only: many equal runs, ties among the smallest, windows of every length."""
    rng = random.Random(1)
    text = lambda n: " ".join(rng.choice("abc") for _ in range(n))
    docs = [(k, text(rng.randrange(0, 60))) for k in range(200)] + [(None, None), (None, "a b É c"), (5, "A a-b c"), (5, "A a-b c"), (6, "")]
    return docs, [(k, text(rng.choice([1, 3, 5, 8, 12, 14]))) for k in range(20)] + [(None, "b É"), (77, None), (78, ""), (79, "no such words here")]


@pytest.mark.parametrize("broadcast_rows", [500_000, 0])
def test_like_brute_force(spark, broadcast_rows):
    """By broadcast and by salted shuffle alike."""
    docs, items = repetitive()
    assert run(spark, docs, items, broadcast_rows=broadcast_rows) == brute(docs, items)


def test_any_shared_window_is_found(spark):
    """A window of ten words is found wherever it stands, at both ends of a text too, and nine words are not."""
    rng = random.Random(2)
    vocabulary = [f"w{n}" for n in range(50)]
    text = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [(k, text(60)) for k in range(30)]
    docs = []
    for k in range(150):
        source, n = items[k % 30][1], 10 if k % 3 else 9
        a = rng.randrange(0, 60 - n)
        docs.append((k, text(rng.choice([0, 30])) + source[a : a + n] + text(rng.choice([0, 30]))))
    joined = lambda rows: [(k, ", ".join(w)) for k, w in rows]
    got = run(spark, joined(docs), joined(items))
    assert got == brute(joined(docs), joined(items)) and sum(bool(r[2]) for r in got) >= 100


def test_empty_tables_long_text_and_other_columns(spark):
    docs, items = repetitive()
    assert run(spark, [], items) == [] and run(spark, docs, []) == brute(docs, [])
    passage = " ".join(f"p{n}" for n in range(12))
    long_text = f"{'x y ' * 60_000}{passage} {'y ' * 100_000}{passage}"
    rows = [(1, long_text, "a", 1), (2, passage, "b", 2)]
    assert run(spark, rows, rows[1:], "id long, raw_text string, key string, words int") == brute([r[:2] for r in rows], [rows[1][:2]])


def test_only_dataframe_functions(spark):
    docs, items = repetitive()
    found = reserved.find_reserved_passages(spark.createDataFrame(docs, "id long, raw_text string"), spark.createDataFrame(items, "id long, raw_text string"))
    plan = found._jdf.queryExecution().toString()
    assert "Python" not in plan and "InArrow" not in plan and "InPandas" not in plan
