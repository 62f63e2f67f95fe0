"""The registered queries on the smallest tables, and the pipeline stage by stage."""

import hashlib
import zlib

import numpy as np
import pytest
from test_private import brute as formats
from test_repeats import base
from test_similar import brute as similar
from test_vectors import brute as near
from tokenizers import Tokenizer

import __spark_entry__ as entry
import corpus_pipeline
from checks.compare import compare, duck
from contactmill.llm.oracles import ORACLES
from contactmill.llm.queries import vocabulary

SF = "/root/testdata/sf0.001"


def run(spark, name):
    return entry.queries()[name](spark, SF).collect()


@pytest.fixture(scope="module")
def docs(spark):
    return {r["doc_id"]: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def test_all_registered():
    names = set(entry.queries())
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 14)) and "pipeline" in names


def test_op1(spark, docs):
    library = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    rows = run(spark, "op1_bpe_codec")
    assert len(rows) == len(docs)
    for r in rows:
        text = docs[r["doc_id"]]["text"] or ""
        ids = library.encode(text, add_special_tokens=False).ids
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_op2(spark, docs):
    for r in run(spark, "op2_private_data"):
        written = ",".join(f"{k}:{a}:{b}" for a, _, k, b in formats(docs[r["doc_id"]]["text"]))
        assert r["base_sha256"] == hashlib.sha256(written.encode()).hexdigest()
        assert ",".join(s for s in r["spans"].split(",") if not s.startswith("id:")) == written


@pytest.mark.parametrize("name,label", [("op3_toxicity", "predicted"), ("op4_language_id", "lang_pred")])
def test_op3_op4(spark, docs, name, label):
    rows = run(spark, name)
    assert len(rows) == len(docs)
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1
    if name == "op4_language_id":
        held = [r for r in rows if r["held_out"]]
        assert sum(r[label] == docs[r["doc_id"]]["lang"] for r in held) >= 0.9 * len(held)


def test_op5(spark, docs):
    library = Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    rows = run(spark, "op5_packing")
    for i in docs:
        ids, at = library.encode(docs[i]["text"] or "", add_special_tokens=False).ids + [2], 0
        for r in sorted((r for r in rows if r["doc_id"] == i), key=lambda r: r["start"]):
            assert r["start"] == at and r["ids_crc32"] == zlib.crc32(np.array(ids[at : at + r["length"]], "<u4").tobytes())
            at += r["length"]
        assert at == len(ids)


def test_op6(spark):
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    rows = run(spark, "op6_main_text")
    assert len(rows) == len(pages)
    for r in rows:
        assert r["n_chars"] == len(r["text"]) and "<" not in r["text"][:1] and (r["text"] or "<article>" not in pages[r["page_id"]])


def test_op7(spark, docs):
    assert sorted(tuple(r) for r in run(spark, "op7_similar_texts")) == similar([(i, r["text"]) for i, r in docs.items()])


def test_op8(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    assert sorted(tuple(r) for r in run(spark, "op8_near_vectors")) == near(rows, 0.95)


def test_op9(spark, docs):
    for r in run(spark, "op9_quality_rules"):
        assert tuple(r)[1:6] + (r["base_failed"],) == base(docs[r["doc_id"]]["text"])


def test_op10(spark):
    told = {}
    for r in sorted(spark.read.parquet(f"{SF}/conversations.parquet").collect(), key=lambda r: (r["conv_id"], r["turn"])):
        told.setdefault(r["conv_id"], []).append((r["role"], r["text"] or ""))
    told[-7] = [("user", "\\### Assistant: </turn> ok"), ("assistant", "\\### Assistant: </turn> ok")]
    rows = {r["conv_id"]: r for r in run(spark, "op10_chat_windows")}
    assert set(rows) == set(told)
    for i, turns in told.items():
        loss = "".join(t for k, t in turns if k == "assistant")
        assert rows[i]["turns_sha256"] == hashlib.sha256("".join(f"{k}\n{t}\n" for k, t in turns).encode()).hexdigest()
        assert (rows[i]["n_turns"], rows[i]["loss_chars"], rows[i]["loss_sha256"]) == (len(turns), len(loss), hashlib.sha256(loss.encode()).hexdigest())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql(spark, name):
    line = compare(spark, duck(SF), name, entry.queries()[name], ORACLES[name], SF)
    assert line.startswith("ok"), line


def test_pipeline_stages(spark, docs):
    now = spark.read.parquet(f"{SF}/documents.parquet")
    columns, kept = now.columns, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = spark.createDataFrame(stage(spark, now, SF).collect(), now.schema)
        assert now.columns == columns
        kept[name] = {r["doc_id"]: r for r in now.collect()}
    good, mild, single, masked = kept.values()
    assert set(good) == {i for i, r in docs.items() if not base(r["text"])[-1]}
    groups = {i: c for i, _, c in similar([(i, r["text"]) for i, r in mild.items()])}
    assert set(single) == {i for i, c in groups.items() if i == c} and set(mild) <= set(good)
    assert set(masked) == set(single) and not any(formats(r["text"]) for r in masked.values())
    assert all(r["n_chars"] == len(r["text"]) for r in masked.values())
    packed = corpus_pipeline.run(spark, SF).collect()
    assert {r["doc_id"] for r in packed} == set(masked)


def test_pipeline_on_odd_rows(spark):
    """Nulls in any column, repeated rows, further columns and no rows at all."""
    text = " ".join(f"w{i} a{i}@b.co" for i in range(60))
    rows = [(1, text, None, None, None), (1, text, None, None, None), (None, text + " more", "en", "s", 5), (3, None, "en", "s", 5), (4, "", "en", "s", 0)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    for given in (rows, []):
        now = spark.createDataFrame([(*r, "x") for r in given], schema + ", key string")
        for _, stage in corpus_pipeline.STAGES:
            now = spark.createDataFrame((out := stage(spark, now, SF)).collect(), out.schema)
        assert {r["doc_id"] for r in now.collect()} == ({1} if given else set())
