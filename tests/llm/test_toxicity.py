import random

import pytest

from contactmill.llm import toxicity

COMMON = [f"{a}{b}" for a in "bdfgklmnprst" for b in ("alo", "emi", "iru", "ona", "uvi")]


def sentence(rng, extra=()):
    words = [rng.choice(COMMON) for _ in range(60)]
    for w in extra:
        words.insert(rng.randrange(60), w)
    return " ".join(words)


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(5)
    rows = [(i, sentence(rng, ["zorbling"] if i % 4 == 0 else []), int(i % 4 == 0)) for i in range(400)]
    rows += [(1000 + i, rows[0][1], 1) for i in range(5)] + [(2000, None, 1), (None, "x", 1), (2001, "zorbling", None)]
    return spark.createDataFrame(rows, "id long, raw_text string, toxic int")


def test_learns_insults_only(labelled):
    model = toxicity.fit_toxicity(labelled.drop("toxic"), labelled.select("id", "toxic"))
    assert not model.stems and set(model.words) == {"zorbling"}
    assert model.score("alo zorbling, emi") > 0.5 > model.score("alo emi") and model.score(None) == model.score("")
    rest = toxicity.fit_toxicity(labelled.drop("toxic"), labelled.select("id", "toxic").limit(0))
    assert not rest.stems and rest.score("zorbling") < 0.5


def test_forms_share_their_longest_beginning(spark):
    rng = random.Random(6)
    forms = ["zorbling", "zorblings", "zorblinger"]
    rows = [(i, sentence(rng, [forms[i % 3]] if i % 4 == 0 else ["zorb", "snorl"] if i % 4 == 1 else []), int(i % 4 == 0)) for i in range(400)]
    data = spark.createDataFrame(rows, "id long, raw_text string, toxic int")
    model = toxicity.fit_toxicity(data.drop("toxic"), data.select("id", "toxic"))
    assert set(model.stems) == {"zorbling"}
    assert model.classify("zorblinges")[0] == toxicity.INSULT and model.classify("zorb")[0] == toxicity.OTHER
    assert model.classify("zorblingsomething")[0] == toxicity.OTHER


def test_grammar():
    model = toxicity.ToxicityModel({"zorbl": 4.0}, {}, -2.0)
    weight = model.clause_weight
    plain = weight("a zorbl")
    assert weight("not a zorbl") < plain < weight("you are a zorbl") == weight("zorbl you are")
    assert weight("she said a zorbl") < weight("she saw a zorbl")
    assert weight("never was one of the many a zorbl") == plain
    assert weight("you kill time") == weight("they kill the old slow lights of her") == 0
    assert 0 < weight("you will not kill you") < weight("kill you") < weight("i will kill you")
    assert weight("hurt you") < weight("kill you") and weight("he said i will kill you") < weight("i will kill you")
    assert model.score("not ok. a zorbl") > model.score("not a zorbl")
    assert model.score("x" * 300_000 + " zorbl") > 0.5 and model.score("abzorbl") < 0.5


LEARNED = dict.fromkeys("clown disgusting idiot loser moron pathetic scum stupid trash worthless".split(), 5.0)
ORDINARY = """The path to Morocco is worth it.|Das Wort ist alt.|An English idiom.|I lose my keys.|A clownfish swims.|Losing time is no loss.
The patient walked a path.|Worthy words.|Trasse und Wortlaut|Le chemin est long.|La palabra es corta.|Er sagte kein Wort.|Une histoire ancienne.|El perro duerme.
They shoot the film at night.|I beat the eggs.|We kill time.|Nous allons frapper.|Ich will den Nagel schlagen."""


def test_ordinary_sentences_and_threats():
    model = toxicity.ToxicityModel({}, LEARNED, -3.0)
    for line in ORDINARY.replace("\n", "|").split("|"):
        assert model.score(line) < 0.5, line
    for line in ("I will kill you.", "You idiot", "idiot you are", "an idiot", "we will stab him"):
        assert model.score(line) > 0.5, line
    for line in ("never an idiot", "he called it stupid", "I will not kill you", "she said we will kill him tomorrow"):
        assert model.score(line) < 0.5, line


def test_the_grammar_decides():
    model, off = toxicity.ToxicityModel({}, LEARNED, -3.0), toxicity.ToxicityModel({}, LEARNED, -3.0)
    off.machine = {k: (after, c, 1.0) for k, (after, c, _) in off.machine.items()}
    texts = ["never an idiot", "he called it stupid", "We kill time", "an idiot", "a calm day"]
    changed = [t for t in texts if (model.score(t) >= 0.5) != (off.score(t) >= 0.5)]
    assert changed == texts[:3]


def test_machines_are_what_they_say():
    from itertools import product

    ahead, machine = toxicity.looking_ahead(), toxicity.grammar()
    for path in product((toxicity.OTHER, toxicity.INSULT, toxicity.THREAT, toxicity.TARGET, toxicity.NEGATION, toxicity.REPORT, toxicity.SPEAKER), repeat=5):
        state, marked = 0, []
        for c in reversed(path):
            state, given, _ = ahead.step[state, c]
            marked.insert(0, given)
        state, weights = 0, []
        for c in marked:
            state, _, factor = machine.step[state, c]
            weights.append(factor)
        for k, c in enumerate(path):
            expected = 1
            if c in (toxicity.INSULT, toxicity.THREAT):
                expected = toxicity.NEGATED if toxicity.NEGATION in path[max(0, k - toxicity.NEGATION_REACH):k] else 1
                expected *= toxicity.REPORTED if toxicity.REPORT in path[:k] else 1
            reports = [i for i in range(k) if path[i] == toxicity.REPORT]
            since = path[reports[-1] + 1 if reports else 0 : k]
            if c == toxicity.INSULT and toxicity.TARGET in since + path[k:]:
                expected *= toxicity.TARGETED
            if c == toxicity.THREAT:
                with_object = toxicity.TARGET in path[k + 1 : k + 1 + toxicity.OBJECT_REACH]
                expected *= (toxicity.SPOKEN if toxicity.SPEAKER in since else 1) if with_object else 0
            assert weights[k] == pytest.approx(expected)


def test_table(spark, labelled):
    rows = spark.createDataFrame([(1, "zorbling", "a"), (1, "zorbling", "a"), (2, None, "a"), (3, "", "a"), (None, "alo", "a")], "id long, raw_text string, score string")
    model = toxicity.fit_toxicity(labelled.drop("toxic"), labelled.select("id", "toxic"))
    kept = toxicity.drop_toxic(rows, model)
    assert kept.columns == rows.columns and kept.count() == 3
    out = toxicity.score_toxicity(labelled.drop("toxic"), labelled.select("id", "toxic"))
    assert out.where("score < 0 OR score > 1 OR score IS NULL OR toxic <> int(score >= 0.5)").count() == 0
    assert out.count() == labelled.count() and out.limit(0).count() == 0


def test_labels_without_a_text_take_no_places(spark):
    rows = spark.createDataFrame([(i, f"you {chr(97 + i % 26) * 3}{chr(97 + i // 26) * 2} zorgling there") for i in range(40)] + [(100 + i, f"a calm day {i} at sea") for i in range(40)], "id long, raw_text string")
    here = [(i, 1) for i in range(40)] + [(100 + i, 0) for i in range(40)]
    gone = [(1000 + i, 1) for i in range(2000)] + [(5000 + i, 0) for i in range(2000)]
    kinds = "id long, toxic int"
    model = toxicity.fit_toxicity(rows, spark.createDataFrame(here + gone, kinds), max_toxic=40, max_clean=40)
    alone = toxicity.fit_toxicity(rows, spark.createDataFrame(here, kinds), max_toxic=40, max_clean=40)
    assert (model.stems, model.words, model.prior) == (alone.stems, alone.words, alone.prior) and (alone.stems or alone.words)
