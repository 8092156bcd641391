"""K-means of several starts against plain rounds and Spark ML."""

import numpy as np
import pytest
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import VectorAssembler

from cohortwise.operators import kmeans

COLS = ["x", "y"]


def frame(spark, data, parts=3):
    rows = [(i, *map(float, p)) for i, p in enumerate(data)]
    return spark.createDataFrame(rows, "id long, x double, y double").repartition(parts)


def clouds(n=60):
    rng = np.random.default_rng(0)
    return np.concatenate([rng.normal(c, 0.6, (n, 2)) for c in (0, 2, 4, 6, 8)])


def plain(data, centres, tol):
    """Lloyd's rounds in numpy from given centres."""
    centres = np.array(centres)
    while True:
        near = ((data[:, None] - centres) ** 2).sum(-1).argmin(1)
        new = np.array([data[near == i].mean(0) if (near == i).any() else c for i, c in enumerate(centres)])
        moved, centres = ((new - centres) ** 2).sum(), new
        if moved <= tol:
            return centres


def test_no_dearer_than_the_best_of_ml(spark):
    points = frame(spark, clouds())
    best = kmeans.best_kmeans(points, "id", COLS, k=5, n_init=10)
    vectors = VectorAssembler(inputCols=COLS, outputCol="features").transform(points)
    costs = [KMeans(k=5, seed=i, maxIter=300, tol=1e-9).fit(vectors).summary.trainingCost for i in range(5)]
    assert best.cost == pytest.approx(min(costs), rel=1e-6)


@pytest.mark.parametrize("first_base", [1, 2, 1000])
def test_rounds_with_settled_points_are_plain_rounds(spark, monkeypatch, first_base):
    monkeypatch.setattr(kmeans, "_FIRST_BASE", first_base)
    data = np.random.default_rng(1).uniform(0, 1, (500, 2))
    points = frame(spark, data)
    held = kmeans._Held(points)
    starts = kmeans.draw_starts(held, "id", COLS, 4, 42, 3)
    assert all(tuple(c) in {tuple(p) for p in data} for s in starts for c in s.centres)
    want = [plain(data, s.centres, 1e-16) for s in starts]
    rounds = kmeans._Rounds(held, COLS)
    kmeans._run(rounds, starts, 1e-16, 300)
    rounds.close()
    held.release()
    for start, centres in zip(starts, want, strict=True):
        np.testing.assert_allclose(start.centres, centres, atol=1e-9)


def test_settled_points_are_not_read_again(spark):
    held = kmeans._Held(frame(spark, clouds()))
    starts = kmeans.draw_starts(held, "id", COLS, 4, 42, 2)
    rounds = kmeans._Rounds(held, COLS)
    for _ in range(12):
        rounds.advance(starts)
    rounds.rebase(starts)
    rounds.advance(starts)
    limits = {s.number: kmeans._open_bands(s.farthest()) for s in starts}
    stay = sum(v[0] for (n, _, band), v in rounds.settled.items() if band >= limits[n])
    assert stay > 0.5 * 2 * 300
    rounds.close()
    held.release()


def test_result_does_not_depend_on_partitions(spark):
    fits = [kmeans.best_kmeans(frame(spark, clouds(20), parts), "id", COLS, n_init=3) for parts in (1, 7)]
    np.testing.assert_allclose(fits[0].centres, fits[1].centres, atol=1e-9)


def test_few_points(spark):
    assert kmeans.best_kmeans(frame(spark, [], 1), "id", COLS).centres == []
    same = kmeans.best_kmeans(frame(spark, [(1, 2)] * 5), "id", COLS)
    assert same.centres == [(1.0, 2.0)] and same.cost == pytest.approx(0)
    two = kmeans.best_kmeans(frame(spark, [(1, 2)] * 5 + [(3, 4)]), "id", COLS)
    assert sorted(two.centres) == [(1.0, 2.0), (3.0, 4.0)]
    found = kmeans.assigned(frame(spark, [(1, 2), (3, 4)]), COLS, two.centres, "c").collect()
    assert all(two.centres[r["c"]] == (r["x"], r["y"]) for r in found)


def test_warns_when_stopped(spark):
    with pytest.warns(UserWarning, match="stopped after 1 rounds"):
        kmeans.best_kmeans(frame(spark, clouds()), "id", COLS, n_init=2, max_iter=1, still=1e-30)
