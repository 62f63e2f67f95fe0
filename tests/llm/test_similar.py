import random
import re
from itertools import combinations

import numpy as np
import pytest

from contactmill.llm import similar


def words_of(text):
    return re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def shingle_set(text):
    w = words_of(text)
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(rows):
    """(id, set size, smallest reachable id) of rows (id, text); ids are unique."""
    sets = {i: shingle_set(t) for i, t in rows}
    root = {i: i for i in sets}
    for a, b in combinations(sorted(sets), 2):
        common = len(sets[a] & sets[b])
        if common and 100 * common >= 80 * len(sets[a] | sets[b]):
            old, new = max(root[a], root[b]), min(root[a], root[b])
            root = {i: new if r == old else r for i, r in root.items()}
    return sorted((i, len(s), root[i]) for i, s in sets.items())


def corpus(seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    passage = [rng.choice(words) for _ in range(30)]
    texts = ["", None, " \n\t", "One two", "one  TWO", "one two three four five", "É é Straße", "é é straße"]
    for size in (6, 9, 12, 14, 17, 24, 60, 200):
        base = [rng.choice(words) for _ in range(size)]
        for edits in (0, 0, 1, 1, 1, 2, 3, 5):
            copy = list(base)
            for _ in range(edits):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            texts.append(" ".join(copy))
        texts += [" ".join(base[1:]), " ".join(base + [rng.choice(words)]), " ".join(base[: size * 9 // 10]), " ".join(base + passage), " ".join(passage + base[::-1])]
    rng.shuffle(texts)
    return list(enumerate(texts, 1))


@pytest.mark.parametrize("seed,short,light,tile,common", [(1, 200, 16, 256, 32), (2, 3, 6, 4, 3), (3, 2, 0, 2, 2)])
def test_like_brute_force(spark, monkeypatch, seed, short, light, tile, common):
    monkeypatch.setattr(similar, "SHORT_LIST", short)
    monkeypatch.setattr(similar, "COMMON_TEXTS", common)
    monkeypatch.setattr(similar, "TILE_ROWS", tile)
    if light < 16:
        monkeypatch.setattr(similar, "light_boundary", lambda classes: light)
    rows = corpus(seed)
    table = spark.createDataFrame([(i, t, "x") for i, t in rows], "id long, raw_text string, key string")
    out = sorted(tuple(r) for r in similar.similar_sources(table.repartition(3)).collect())
    assert out == brute(rows)


def test_subsets_link_exactly():
    rng = random.Random(4)
    for _ in range(300):
        n, m = rng.randrange(2, 13), rng.randrange(2, 13)
        a = [rng.getrandbits(62) for _ in range(n)]
        b = rng.sample(a, min(n, m) - rng.randrange(0, 2)) + [rng.getrandbits(62) for _ in range(12)]
        b = b[:m]
        meet = {k for k, p in similar.subset_keys(a, 12) if p == m} & {k for k, p in similar.subset_keys(b, 12) if p == n}
        common = len(set(a) & set(b))
        assert bool(meet) == (100 * common >= 80 * (n + m - common))


def test_shingles_of_long_text(monkeypatch):
    text = " ".join(f"w{i % 5000}" for i in range(40_000))
    assert len(similar.shingles(text)) == 5000 == len(np.unique(similar.shingles(text)))
    texts = [text, "x" * 500_000 + " a b c d e f " + "y" * 70_000, "  lone  ", "é" * 100 + "\t\n" + text[:3000]]
    whole = [similar.shingles(t).tolist() for t in texts]
    monkeypatch.setattr(similar, "STRETCH", 16)
    assert [similar.shingles(t).tolist() for t in texts] == whole


def test_rows_to_ranges_do_not_grow_with_their_number(monkeypatch):
    monkeypatch.setattr(similar.TaskContext, "get", lambda: type("Task", (), {"partitionId": lambda self: 0})())
    rng = random.Random(5)
    often = [f"w{i}" for i in range(40)]
    rows = [(i, i, " ".join([f"t{rng.randrange(10**6)}" for _ in range(60)] + often)) for i in range(300)]
    common = np.unique(similar.shingles(" ".join(often)))
    sizes = {}
    for n_ranges in (64, 128, 1024, 8192):
        cut = list(similar.cut_blocks(iter(rows), n_ranges, common))
        counted = [r for r in cut if r[1] >= 0]
        sizes[n_ranges] = sum(len(r[6]) for r in counted)
        assert sum(len(r[4]) + len(r[5]) for r in counted) <= 2 * sizes[n_ranges]
        # No occurrence of a common shingle goes to a range; all of them stay with their block.
        assert sum(len(r[6]) for r in cut if r[1] < 0) == 8 * len(common) * len(rows)
    assert len(set(sizes.values())) == 1 and sizes[64] == 4 * 300 * (60 + 40 - 4 - len(common))
    assert len(cut) <= sizes[64] // 4 + 1


@pytest.mark.parametrize("n_ranges", [1, 64, 1024])
def test_sets_do_not_depend_on_ranges(spark, monkeypatch, n_ranges):
    monkeypatch.setattr(similar, "COMMON_TEXTS", 5)
    monkeypatch.setattr(similar, "BLOCK_ROWS", 16)
    rows = corpus(6)
    table = spark.createDataFrame(rows, "id long, raw_text string").repartition(2)
    sets = {i: shingle_set(t) for i, t in rows}
    often = {}
    for own in sets.values():
        for s in own:
            often[s] = often.get(s, 0) + 1
    for r in similar.sketch(table, n_ranges).collect():
        own = sets[r["id"]]
        alone = sum(often[s] == 1 for s in own)
        assert (r["n"], r["first"]) == (len(own), alone)
        assert (len(r["prefix"]) if r["prefix"] is not None else None) == (len(own) // 5 + 1 - alone if own and alone <= len(own) // 5 else None)


def test_odd_tables(spark):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (None, "x y"), (5, None), (5, None), (6, "q r")]
    table = spark.createDataFrame([(i, t, "u") for i, t in rows], "id long, raw_text string, component_id string")
    out = sorted(((r["id"] or 0), r["n_shingles"], r["component_id"]) for r in similar.similar_sources(table).collect())
    assert out == [(0, 1, None), (0, 2, 1), (1, 2, 1), (1, 2, 1), (5, 0, 5), (5, 0, 5), (6, 1, 6)]
    kept = similar.keep_first_of_similar(table)
    assert kept.columns == table.columns
    assert sorted((r["id"] or 0, r["raw_text"] or "") for r in kept.collect()) == [(0, "x y"), (1, "a b c d e f"), (5, ""), (5, ""), (6, "q r")]
    assert similar.similar_sources(table.limit(0)).count() == 0
