import os
import random
import re

import pytest

from contactmill.llm import private

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def brute(text):
    out = []
    for rank, (kind, pattern) in enumerate(PLAIN.items(), 1):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            good = {
                "email": True, "ip": kind != "ip" or all(int(p) <= 255 for p in m[0].split(".")),
                "card": 12 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15,
            }[kind]
            if good:
                out.append((m.start(), rank, kind, m.end()))
    return sorted(out)


TEXTS = [
    None, "", "nothing here", "a@b.c_d@e.f b._x@y.z @x.y a@b a@b.c.", "1.2.3.4.5.6.7.8 256.1.1.1 001.02.3.255 1.2.3",
    "4111 1111 1111 1111 and 4111-1111-1111-1112, 1 - 2", "+1 (988) 555-2485 +12 +1 234 567 890 123 456 7 +49 30 1234567.",
    "é😀 x@y.zz +1 988 555 2485", "7" * 20_000, "a" * 50_000 + "@b.c", "x.y@" * 50, "1.2.3.4 1.2.3.4 a@b.co", "00000000.1.1.1",
]


def test_fixed_formats(spark):
    rows = spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)] * 2, "id long, raw_text string, key string")
    out = private.find_private_data(rows).collect()
    assert len(out) == 2 * len(TEXTS)
    for r in out:
        assert [tuple(s) for s in r["spans"] if s["kind"] != "id"] == brute(TEXTS[r["id"]]), TEXTS[r["id"]]
    assert private.find_private_data(rows.limit(0)).count() == 0


def test_finds_identifiers_from_their_surroundings(spark):
    texts = [f"contact me at user{i}@mail.example now" for i in range(5)]
    texts += [f"contact me at QZXW{i}7788AB now" for i in range(4)]  # after "at", as the addresses
    texts += ["bare QZXW97788CD here", "the build 12 of 1999", "serial RRTT11223344 said"]  # letters vouch; too short; nothing vouches
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, raw_text string")
    found = {r["id"]: [texts[r["id"]][s["start"]:s["end"]] for s in r["spans"] if s["kind"] == "id"] for r in private.find_private_data(rows).collect()}
    assert [found[i] for i in range(5, 9)] == [[f"QZXW{i}7788AB"] for i in range(4)]
    assert found[9] == ["QZXW97788CD"] and not any(found[i] for i in (*range(5), 10, 11))


def test_masks(spark):
    texts = ["call +1 (988) 555-2485 or a@b.co!", None, "", "plain", "é 4111111111111111 é", "x@1.2.3.4"]
    rows = spark.createDataFrame([(i, t, "k") for i, t in enumerate(texts)], "id long, raw_text string, spans string")
    out = private.mask_private_data(rows)
    assert out.columns == rows.columns
    got = {r["id"]: r["raw_text"] for r in out.collect()}
    assert [got[i] for i in range(6)] == ["call <phone> or <email>!", None, "", "plain", "é <card> é", "<email>"]


def test_finds_short_grouped_and_digit_free_identifiers(spark):
    texts = [f"login: user{i}@mail.example now" for i in range(5)]
    wanted = ["jsmith", "m.jones", "X12345", "4821", "C01X000", "DE89 3704 0044 0532 0130 00", "GB29 NWBK 6016 1331 9268 19", "123 45 6789", "12.345.678"]
    texts += [f"login: {w} now" for w in wanted]
    ordinary = [f"{w} 77 and note: {w} title: this" for w in ("alpha", "beta", "gamma", "delta")] + ["login: 77 now", "login: 1999 now", "room 4 of 1999", "title: 3.14"]
    texts += ordinary
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, raw_text string")
    found = {r["id"]: [texts[r["id"]][s["start"]:s["end"]] for s in r["spans"] if s["kind"] == "id"] for r in private.find_private_data(rows).collect()}
    assert [found[5 + i] for i in range(len(wanted))] == [[w] for w in wanted]
    assert not any(found[5 + len(wanted) + i] for i in range(len(ordinary)))


def found_in(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, raw_text string")
    return [[texts[r["id"]][s["start"]:s["end"]] for s in r["spans"] if s["kind"] == "id"] for r in private.find_private_data(rows).orderBy("id").collect()]


def test_random_strings_make_their_key_known(spark):
    rng = random.Random(1)
    keys = ["".join(rng.choice("0123456789abcdef") for _ in range(32)) for _ in range(5)]
    texts = [f'the secret = "{k}" was set' for k in keys] + ["the secret = ab12 was set"]  # one kind alone, no address beside it
    texts += [f"see chapter{i}-of-the-long-manual here and {keys[0][::-1]} there" for i in range(5)]  # no key before them
    texts += [f"file: notes-of-the-meeting-20{i} today" for i in range(5)] + ["dial +1 or +49 now", "dial a@b.co now"] * 3
    out = found_in(spark, texts)
    assert out[:6] == [[k] for k in keys] + [["ab12"]]
    assert not any(out[6:])


@pytest.mark.parametrize("scale", ["sf0.001", "sf0.01", "sf0.1"])
def test_recall_of_planted_tokens(spark, scale):
    path = f"/root/testdata/{scale}/documents.parquet"
    if not os.path.exists(path):
        pytest.skip("no tables here")
    planted = re.compile(r"token = \"([0-9a-f]{40})\"", re.I)
    documents = spark.read.parquet(path)
    rows = private.find_private_data(documents.selectExpr("doc_id AS id", "text AS raw_text"))
    out = rows.join(documents.selectExpr("doc_id AS id", "text"), "id").where("lower(text) LIKE '%token = %' OR exists(spans, s -> s.kind = 'id')").collect()
    wanted, caught, others = 0, 0, []
    for r in out:
        spans = {(s["start"], s["end"]) for s in r["spans"] if s["kind"] == "id"}
        tokens = {m.span(1) for m in planted.finditer(r["text"])}
        wanted, caught = wanted + len(tokens), caught + len(tokens & spans)
        others += [r["text"][a:b] for a, b in spans - tokens]
    assert caught >= 0.9 * wanted, (wanted, caught)
    # Besides, only numbers as long as a card's that stand where cards do.
    assert all(re.fullmatch("[0-9]{16}", other) for other in others) and len(others) <= 0.2 * caught, others
