"""Cards are written by many tasks into one flat folder."""

import os

from contactmill.sources import files


def test_cards_lie_flat_and_keys_share_a_file(spark, tmp_path):
    path = str(tmp_path / "cards")
    rows = [(k, f"# Firm {k}\nFit score: {k}") for k in range(40)] + [(3, "# Second"), (None, "# None"), (50, None)]
    files.write_company_cards(spark.createDataFrame(rows, "card long, value string"), path)
    names = [n for n in os.listdir(path) if n.endswith(".txt")]
    assert not [n for n in os.listdir(path) if os.path.isdir(os.path.join(path, n))]
    assert len(names) == 42 and len({n.split("-")[1] for n in names}) > 1
    got = sorted(((r["title"], r["fit_score"]) for r in files.read_company_cards(spark, path).collect()), key=str)
    want = [(f"Firm {k}", k) for k in range(40)] + [("None", None), ("", None)]
    assert got == sorted(want, key=str)
