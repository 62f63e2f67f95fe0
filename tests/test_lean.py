"""What is written and made besides the result stays small."""

from test_evidence import rows

from contactmill.sources import evidence
from contactmill.streaming import commands


def test_hashes_are_no_text_in_the_tables_between(spark, tmp_path, monkeypatch):
    made, cut = [], evidence.cut_lineage
    monkeypatch.setattr(evidence, "cut_lineage", lambda df: made.append(df.dtypes) or cut(df))
    evidence.append_evidence_once(spark, str(tmp_path / "e"), rows(spark, ["a", "b"]), 4)
    assert len(made) == 3 and not any("hash" in name and kind == "string" for table in made for name, kind in table)


def test_commands_without_steps_to_release_make_no_tables():
    assert list(commands.OrderedCommandStates(1).handleInputRows((1,), iter([]), None)) == []
