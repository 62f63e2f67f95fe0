import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from contactmill.llm import packing
from contactmill.llm.queries import vocabulary

PATH = vocabulary("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)


@pytest.mark.parametrize("text", ["", "It's 12 o'clock, (really)!", "ΟΔΟΣ ΣΑΣ İ é e\u0301", "<|endoftext|>a <|startoftext|>", "a\tb\u00a0c\x1cd \n\n e", "WORD, Word. word;", "字" * 300, "x1, 2. A&B"])
def test_same_ids_as_the_library(text):
    model = packing.encoder(PATH)
    assert np.frombuffer(model.encode(text), model.dtype).tolist() == LIBRARY.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("mark", ["H\u0331", "J\u030c", "T\u0308", "T\u0344", "W\u030a", "Y\u030a", "H\u0321\u0331"])
def test_capitals_that_compose_only_in_lower_case(mark):
    test_same_ids_as_the_library(f"{mark}oly A{mark} {mark}. (THE{mark}, É{mark}) {mark.lower()}oly Word. E\u0301 I\u2019m")
    model = packing.encoder(PATH)
    texts = ["Plain TEXT.", None, f"{mark}oly", "<|endoftext|> " + mark]
    for text, ids in zip(texts, model.encode_batch(pa.array(texts, pa.string()))):
        assert np.frombuffer(ids, model.dtype).tolist() == LIBRARY.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("counts", [{}, {5: 3}, {60: 4, 40: 4, 20: 1}, {n: 1 + n % 4 for n in range(1, 100)}, {50: 1001, 99: 2, 1: 5}])
def test_plan_places_every_tail_once(counts):
    plan = packing.plan_tails(counts, 100)
    filled, rank = {}, 0
    for n in sorted(counts):
        for _ in range(counts[n]):
            pieces = plan.pieces(rank)
            rank += 1
            assert sum(p[1] for p in pieces) == n and [p[0] for p in pieces] == [0, pieces[0][1]][: len(pieces)]
            for _, length, sequence, offset in pieces:
                filled.setdefault(sequence, []).append((offset, length))
    assert sorted(filled) == list(range(plan.n_sequences))
    for sequence, parts in filled.items():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at == 100 or sequence == plan.n_sequences - 1 and at < 100


def test_least_squares_finds_the_mixture():
    patterns = [(40, 60), (20, 20, 60), (50, 50)]
    assert packing.non_negative_least_squares(patterns, {40: 7, 60: 10, 20: 6, 50: 8}) == pytest.approx([7, 3, 4], abs=0.05)


def test_table(spark):
    texts = ["a b c", "a b c", None, "", "word " * 700, "other " * 33] + [f"n{i} " * (i % 50) for i in range(60)]
    rows = spark.createDataFrame([(i if i else None, t, "x") for i, t in enumerate(texts)], "id long, raw_text string, start string")
    out = packing.pack_sources(rows, PATH, window=64).collect()
    by_source, by_sequence = {}, {}
    for r in out:
        by_source.setdefault(r["id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    for i, text in enumerate(texts):
        expected = LIBRARY.encode(text or "", add_special_tokens=False).ids + [2]
        pieces = sorted(by_source[i or None], key=lambda r: r["start"])
        assert [x for p in pieces for x in np.frombuffer(p["token_ids"], "<u4")] == expected
        assert all(p["doc_tokens"] == len(expected) for p in pieces)
    fills = []
    for parts in by_sequence.values():
        at = 0
        for p in sorted(parts, key=lambda r: r["offset"]):
            assert p["offset"] == at
            at += p["length"]
        fills.append(at)
    assert sum(f < 64 for f in fills) <= 1 and max(fills) <= 64
    assert packing.pack_sources(rows.limit(0), PATH).count() == 0
