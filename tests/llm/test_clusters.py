import hashlib
import math

import numpy as np
import pytest

from contactmill.llm import clusters


def brute(rows, k=40, rounds=5, dims=64, seed=2):
    """Lloyd's rounds in whole numbers, every distance worked out."""
    kept = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if v is not None and len(v) == dims and None not in v and all(map(math.isfinite, v))]
    rank = lambda r: hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest() if r[0] is not None else "g"
    centroids = [v for _, v in sorted(kept, key=lambda r: (rank(r), r[1]))[:k]]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    for done in range(rounds + 1):
        given = [min((far(v, c), j) for j, c in enumerate(centroids)) for _, v in kept]
        for j in range(len(centroids) if done < rounds else 0):
            mine = [v for (_, v), (_, g) in zip(kept, given) if g == j]
            if mine:
                centroids[j] = [sum(column) // len(mine) for column in zip(*mine)]
    total = sum(d for d, _ in given)
    own = [sum(d for d, g in given if g == j) for j in range(len(centroids))]
    return sorted(((i, g, d, own[g], total, centroids[g]) for (i, _), (d, g) in zip(kept, given)), key=repr)


def run(spark, rows, schema="id long, vector array<float>", **given):
    return sorted((tuple(r) for r in clusters.cluster_vectors(spark.createDataFrame(rows, schema), **given).collect()), key=repr)


@pytest.mark.parametrize("scale", [1.0, 2000.0])
def test_like_brute_force(spark, scale):
    rng = np.random.default_rng(3)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(i % 5, 0.6, 8) * scale]) for i in range(400)]
    assert run(spark, rows, dims=8, k=12) == brute(rows, dims=8, k=12)


def test_odd_rows_and_ties(spark):
    """Null and broken vectors, repeated rows, points between two centroids, fewer vectors than centroids, no rows."""
    a, b = [0.0] * 4, [1.0, 0.0, 0.0, 0.0]
    rows = [(1, a), (1, a), (2, b), (3, [0.5, 0.0, 0.0, 0.0]), (None, b), (4, None), (5, [1.0]), (6, [None, 0.0, 0.0, 0.0]), (7, [math.nan] * 4), (8, [math.inf] * 4), (9, [])]
    for k in (2, 40):
        assert run(spark, rows, dims=4, k=k) == brute(rows, dims=4, k=k)
    assert run(spark, []) == [] and run(spark, rows[5:], dims=4) == []
    wide = spark.createDataFrame([(i, v, "x") for i, v in rows], "id long, vector array<double>, cluster string")
    assert sorted((tuple(r) for r in clusters.cluster_vectors(wide, dims=4).collect()), key=repr) == brute(rows, dims=4)
    with pytest.raises(Exception, match="do not fit"):
        run(spark, [(1, [1e9, 0.0, 0.0, 0.0])], dims=4)


def test_bounds_hold_and_spare_work():
    """After every round a loosened bound lies below the true distance, and most distances are never worked out."""
    rng = np.random.default_rng(5)
    points = np.floor(rng.normal(0, 20, (600, 6)) + 400 * rng.integers(0, 4, (600, 1))).astype(np.int64)
    history = [points[:16].copy()]
    found, spared = clusters.first_assignment(points, history[0]), []
    for _ in range(6):
        history.append(np.array([points[found[0] == j].sum(0) // max(1, (found[0] == j).sum()) if (found[0] == j).any() else history[-1][j] for j in range(16)]))
        found, worked = clusters.next_assignment(points, found[0], found[2], found[3], history)
        true = clusters.squared_distances(points, history[-1])
        assert (found[0] == true.argmin(1)).all() and (found[1] == true.min(1)).all()
        loose = found[2].astype(float) - clusters.moved(history)[found[3], np.arange(16)]
        assert (loose <= np.sqrt(true)).all()
        spared.append(worked / true.size)
    assert spared[-1] < 0.5


def test_total_displacement_is_tighter_than_the_sum_of_moves():
    """A centroid that comes back loosens nothing."""
    there, away = np.array([[0, 0], [10, 0]]), np.array([[300, 0], [10, 0]])
    assert clusters.moved([there, away, there])[0][0] == 0.0
