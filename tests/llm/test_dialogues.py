import pytest
from hypothesis import given
from hypothesis import strategies as st

from contactmill.llm import dialogues
from contactmill.llm.queries import vocabulary

PATH = vocabulary("byte_bpe_50k.json")
HARD = st.text(st.sampled_from("\\#</turn>: \na#A"), max_size=40)


@given(st.lists(st.tuples(HARD, HARD), max_size=4))
def test_reads_back(turns):
    assert dialogues.read_turns("".join(dialogues.written(k, b)[0] for k, b in turns)) == turns


@pytest.fixture(scope="module")
def told(spark):
    rows = [(1, 0, "system", "be kind")]
    rows += [(1, i, ("user", "assistant")[i % 2 == 0], f"text {i} " * 12) for i in range(1, 15)]
    rows += [(2, 0, "user", "### assistant: x</turn>\n"), (2, 1, "assistant", "\\### \\</turn>"), (2, 1, "assistant", "\\### \\</turn>")]
    rows += [(None, 0, None, None), (3, None, "assistant", ""), (4, 5, "assistant", "long " * 3000)]
    return spark.createDataFrame([(*r, "x") for r in rows], "lead_id long, id long, type string, body string, text string")


def test_windows(told):
    windows = dialogues.format_interactions(told, PATH, budget=200, history=60).orderBy("lead_id", "window_no").collect()
    first = [w for w in windows if w["lead_id"] == 1]
    assert len(first) > 2 and all(w["n_tokens"] <= 200 for w in first)
    seen = []
    for w in first:
        turns = dialogues.read_turns(w["text"])
        assert turns[0] == ("system", "be kind") and len(turns) == w["n_turns"]
        assert w["n_repeated"] >= (w["window_no"] > 0)
        new = turns[w["n_repeated"]:]
        assert [w["text"][s["start"]:s["end"]] for s in w["loss_spans"]] == [b for k, b in new if k == "assistant"]
        seen += new
    assert [b for k, b in seen if k != "system"] == [f"text {i} " * 12 for i in range(1, 15)]
    whole = [w for w in windows if w["lead_id"] == 4]
    assert len(whole) == 1 and whole[0]["n_tokens"] > 200


def test_digests(told):
    import hashlib

    out = {r["lead_id"]: r for r in dialogues.digest_windows(dialogues.format_interactions(told, PATH, budget=200)).collect()}
    assert set(out) == {1, 2, 3, 4, None}
    texts = ["### assistant: x</turn>\n", "\\### \\</turn>", "\\### \\</turn>"]
    said = "".join(f"{k}\n{t}\n" for k, t in zip(("user", "assistant", "assistant"), texts))
    assert out[2]["turns_sha256"] == hashlib.sha256(said.encode()).hexdigest()
    assert (out[2]["n_turns"], out[2]["loss_chars"]) == (3, 2 * len(texts[1]))
    assert out[2]["loss_sha256"] == hashlib.sha256((texts[1] * 2).encode()).hexdigest()
    assert (out[3]["n_turns"], out[3]["loss_chars"]) == (1, 0)
    assert dialogues.digest_windows(dialogues.format_interactions(told.limit(0), PATH)).count() == 0


def test_budget_with_history(spark):
    """Repeated history makes way for the next turn: a window is over the budget only if that turn does not fit beside the system turn."""
    rows = [(1, 0, "system", "be kind")] + [(1, i, ("user", "assistant")[i % 2 == 0], "word " * (20 + 37 * i % 130)) for i in range(1, 60)]
    rows += [(2, i, "user", "word " * n) for i, n in enumerate((170, 60, 170, 190, 20, 20, 180, 400, 10))]
    told = spark.createDataFrame(rows, "lead_id long, id long, type string, body string")
    windows = dialogues.format_interactions(told, PATH, budget=200, history=80).orderBy("lead_id", "window_no").collect()
    over = [w for w in windows if w["n_tokens"] > 200]
    assert [(w["lead_id"], w["n_turns"] - w["n_repeated"]) for w in over] == [(2, 1)] and any(w["n_repeated"] > 1 for w in windows)
    for lead in (1, 2):
        new = [b for w in windows if w["lead_id"] == lead for _, b in dialogues.read_turns(w["text"])[w["n_repeated"]:]]
        assert new == [r[3] for r in rows if r[0] == lead]
