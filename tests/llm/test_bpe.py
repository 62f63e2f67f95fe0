import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from contactmill.llm import bpe
from contactmill.llm.queries import vocabulary

PATH = vocabulary("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)
MODEL = bpe.encoder(PATH)


def ids(text):
    return np.frombuffer(MODEL.encode(text), "<u4").tolist()


@given(st.text(st.sampled_from("abcdeth in'sl\n.,0189 é字\t\u2003\x1c😀<|>"), max_size=60))
@settings(max_examples=300, deadline=None)
def test_same_ids_as_the_library(text):
    expected = LIBRARY.encode(text, add_special_tokens=False).ids
    assert ids(text) == expected
    assert MODEL.decode(MODEL.encode(text)) == LIBRARY.decode(expected, skip_special_tokens=False)


@pytest.mark.parametrize("text", ["", "a" * 5000, "<|endoftext|> a<|endoftext|>", " \n\n  x ", "it's we'll I'd", "\x00\ufffd"])
def test_odd_texts(text):
    assert ids(text) == LIBRARY.encode(text, add_special_tokens=False).ids


def test_table(spark):
    rows = [(1, "a b", "x"), (1, "a b", "x"), (None, "c", "y"), (3, None, None), (4, "", "z")]
    given_rows = spark.createDataFrame(rows, "id long, raw_text string, token_ids string")
    back = bpe.decode_sources(bpe.encode_sources(given_rows, PATH), PATH).collect()
    assert sorted((r["id"] or 0, r["raw_text"], r["n_tokens"]) for r in back) == [(0, "c", 1), (1, "a b", 2), (1, "a b", 2), (3, "", 0), (4, "", 0)]
    assert bpe.encode_sources(given_rows.limit(0), PATH).count() == 0
    assert MODEL.decode(None) == "" and MODEL.decode(np.array([10**6], "<u4").tobytes()) == ""
