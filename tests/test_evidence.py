"""Evidence is added once, and most stored files stay closed."""

from datetime import datetime, timedelta

from contactmill.sources import evidence
from contactmill.sources.tables import RAW_SOURCES

T0 = datetime(2024, 1, 1)


def rows(spark, texts, shift=0):
    return spark.createDataFrame([(i, None, "note", None, None, t, None, "ok", 0.5, T0 + timedelta(minutes=i + shift)) for i, t in enumerate(texts)], RAW_SOURCES)


def stored(spark, root):
    return sorted((r.id, r.raw_text, r.created_at) for r in evidence.read_evidence(spark, root).collect())


def test_twice_is_once(spark, tmp_path):
    root = str(tmp_path / "e")
    first = rows(spark, ["a", "b", "a", None, "", "c" * 100_000])
    assert evidence.append_evidence_once(spark, root, first, 4) == 0
    # NULL and an empty text are the same content; of equal rows the earliest stays, ids follow the arrival.
    want = [(1, "a", T0), (2, "b", T0 + timedelta(minutes=1)), (3, None, T0 + timedelta(minutes=3)), (4, "c" * 100_000, T0 + timedelta(minutes=5))]
    assert stored(spark, root) == want
    for again in (first, rows(spark, ["b", "a"], 50), first.limit(0)):
        evidence.append_evidence_once(spark, root, again, 4)
        assert stored(spark, root) == want
    evidence.append_evidence_once(spark, root, rows(spark, ["b", "d"], 90), 4)
    assert stored(spark, root) == [*want, (5, "d", T0 + timedelta(minutes=91))]


def test_files_without_the_hash_stay_closed(spark, tmp_path):
    root = str(tmp_path / "e")
    evidence.append_evidence_once(spark, root, rows(spark, [f"t{i}" for i in range(400)]), 16)
    assert len(evidence.files_that_may_hold(spark, root, spark.range(0).selectExpr("cast(id as string) AS content_hash"), 16)) == 0
    opened = evidence.append_evidence_once(spark, root, rows(spark, ["t7", "new"], 900), 16)
    assert 1 <= opened <= 3 and len(stored(spark, root)) == 401
    every = evidence.read_evidence(spark, root).select("content_hash")
    assert len(evidence.files_that_may_hold(spark, root, every, 16)) == 17


def test_rows_without_a_side_folder_do_not_exist(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "e")

    def fails(*_):
        raise OSError("lost")

    with monkeypatch.context() as m:
        m.setattr(evidence, "files_at", fails)
        try:
            evidence.append_evidence_once(spark, root, rows(spark, ["a"]), 4)
        except OSError:
            pass
    assert stored(spark, root) == []
    evidence.append_evidence_once(spark, root, rows(spark, ["a"]), 4)
    assert len(stored(spark, root)) == 1
