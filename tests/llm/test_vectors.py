import math

import numpy as np
import pytest

from contactmill.llm import vectors


def brute(rows, threshold):
    unit = {k: vectors.unit_rows(np.array([v], float))[0] for k, v in enumerate(v for _, v in rows) if v and None not in v and all(map(math.isfinite, v)) and any(v)}
    ids = [i for i, _ in rows]
    links = {k: [j for j in unit if j != k and len(unit[j]) == len(unit[k]) and (unit[j] @ unit[k] >= threshold or rows[j][1] == rows[k][1])] for k in unit}
    out = []
    for k, i in enumerate(ids):
        seen, todo = {k}, [k]
        while todo:
            for j in links.get(todo.pop(), []):
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        low = min(ids[j] for j in seen)
        out.append((i, len(links.get(k, [])), low, i == low))
    return sorted(out)


@pytest.mark.parametrize("tile_rows", [4, 2048])
def test_like_brute_force(spark, tile_rows):
    rng = np.random.default_rng(2)
    rows = []
    for _ in range(12):
        centre = rng.normal(size=8)
        rows += [(centre + rng.normal(size=8) * s).tolist() for s in (0, 0.05, 0.1, 0.15, 0.2, 0.25, 0.3)]
    rows += [rows[0], [x * 1e200 for x in rows[1]], [x * 1e-200 for x in rows[2]], [1.0, 0.0], [0.95, math.sqrt(1 - 0.95**2)], [1.0, 0.0]]
    rows += [None, [], [0.0, 0.0], [1.0, None], [float("nan"), 1.0], [float("inf"), 1.0]]
    rows = list(enumerate(rows, 10))
    table = spark.createDataFrame([(i, v, "x") for i, v in rows], "id long, vector array<double>, tile string")
    out = sorted(tuple(r) for r in vectors.near_vectors(table.repartition(3), tile_rows=tile_rows).collect())
    expected = brute(rows, 0.95)
    at_threshold = {10 + len(rows) - 9, 10 + len(rows) - 8, 10 + len(rows) - 7}
    assert [r for r in out if r[0] not in at_threshold] == [r for r in expected if r[0] not in at_threshold]


def test_bound_holds_every_pair():
    rng = np.random.default_rng(3)
    unit = vectors.unit_rows(np.concatenate([rng.normal(size=(60, 16)), rng.normal(size=(1, 16)) + 0.3 * rng.normal(size=(60, 16))]))
    tile = vectors.Tile(np.arange(120), np.ones(120, np.int64), unit)
    for threshold in (0.8, 0.9, 0.95):
        rows, columns = vectors.linked(tile, tile, threshold)
        exact = np.einsum("ik,jk->ij", unit, unit) >= threshold
        assert set(zip(rows.tolist(), columns.tolist())) == set(zip(*map(list, (a.tolist() for a in np.nonzero(exact)))))


def test_odd_tables(spark):
    rows = [(1, [1.0, 0.0]), (1, [1.0, 0.0]), (None, [1.0, 0.01]), (None, [0.0, 1.0]), (None, None)]
    table = spark.createDataFrame(rows, "id long, vector array<float>")
    out = sorted(((r["id"] or 0), r["n_links"], r["component_id"] or 0, r["kept"]) for r in vectors.near_vectors(table).collect())
    assert out == [(0, 0, 0, False), (0, 0, 0, False), (0, 2, 1, False), (1, 2, 1, True), (1, 2, 1, True)]
    assert vectors.near_vectors(table.limit(0)).count() == 0
