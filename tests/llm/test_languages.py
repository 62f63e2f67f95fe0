import numpy as np

from contactmill.llm import languages

TEXT = {"en": "the cat and the dog went with her to the house", "de": "der hund und die katze gingen mit ihr nach hause", "fr": "le chien et le chat sont allés avec elle à la maison"}


def test_filter_gives_all_languages():
    keys = languages.grams("the der le")
    masks = (1 + np.arange(len(keys)) % 7).astype(np.uint64)
    model = languages.LanguageFilter.of(["a", "b", "c"], keys, masks, 1 << 14)
    assert ((model.containing(keys) & masks) == masks).all()
    other = languages.grams("".join(chr(c) for c in range(0x4E00, 0x5600)))
    shares = [np.mean((model.containing(other) >> np.uint64(i)) & np.uint64(1)) for i in range(3)]
    assert max(shares) < 0.01


def test_table(spark):
    examples = spark.createDataFrame([(t + f" {'ab'[i % 2]}", lang, "x") for lang, t in TEXT.items() for i in range(6)] + [(None, "en", "x"), ("x", None, "x")], "raw_text string, language string, id string")
    rows = spark.createDataFrame(
        [(1, "the dog and the house", 0), (2, "die katze nach hause", 0), (3, "elle est à la maison", 0), (4, None, 0), (5, "", 0), (6, "12 !?", 0), (1, "the dog and the house", 0), (None, "the " * 50000, 0)],
        "id long, raw_text string, language int",
    )
    out = {r["id"]: (r["language"], r["score"]) for r in languages.identify_language(rows, examples).collect()}
    assert [out[i][0] for i in (1, 2, 3, 4, 5, 6, None)] == ["en", "de", "fr", "und", "und", "und", "en"]
    assert out[4][1] == 0 and all(0 <= s <= 1 for _, s in out.values())
    assert languages.identify_language(rows, examples).count() == 8
    untaught = languages.identify_language(rows, examples.limit(0)).collect()
    assert {r["language"] for r in untaught} == {"und"}
    assert languages.identify_language(rows.limit(0), examples).count() == 0


def test_more_languages_than_bits_of_a_word(spark):
    names = [f"l{i:03}" for i in range(131)]
    word = lambda i, k: "".join(chr(0x4E00 + 20 * i + (k + j) % 20) for j in range(12))
    examples = spark.createDataFrame([(word(i, k), name) for i, name in enumerate(names) for k in range(3)], "raw_text string, language string")
    rows = spark.createDataFrame([(i, word(i, 1)) for i in range(len(names))], "id long, raw_text string")
    out = {r["id"]: r["language"] for r in languages.identify_language(rows, examples).collect()}
    assert [out[i] for i in range(len(names))] == names


def test_every_language_is_learned_whatever_the_size(spark):
    few = [("ζωη και φως", "el"), ("ζωη και νερο", "el"), ("ζωη και γη", "el"), ("жизнь", "ru")]
    hot = [(TEXT["de"], "de")] * 900
    many = [(f"{TEXT['en']} {chr(97 + i % 26)}{chr(97 + i // 26)}x", "en") for i in range(400)]
    examples = spark.createDataFrame(few + hot + many, "raw_text string, language string")
    model = languages.fit_language_filter(examples, max_examples=40)
    assert model.languages == ["de", "el", "en", "ru"]
    assert [model.predict(t)[0] for t in ("die katze", "φως και ζωη", "the dog", "жизнь")] == ["de", "el", "en", "ru"]
    alone = languages.fit_language_filter(examples.where("language <> 'en'"), max_examples=40)
    bits = lambda m, name: np.flatnonzero(languages.holding(m.slots, m.languages.index(name)))
    assert all((bits(model, name) == bits(alone, name)).all() for name in ("el", "ru"))


def test_rare_language_keeps_its_own_n_grams(spark):
    examples = spark.createDataFrame([(t, "en") for t in [TEXT["en"]] * 3] + [("ζωη", "el")], "raw_text string, language string")
    model = languages.fit_language_filter(examples, max_grams=3)
    assert model.predict("ζωη")[0] == "el" and model.predict("the")[0] == "en"
