"""Batched k-means against single plain fits."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from retainer.operators import kmeans as KM


@pytest.fixture(scope="module")
def blobs(spark):
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(c, 0.4, (90, 3)) for c in ((0, 0, 0), (4, 0, 1), (0, 5, 2), (4, 5, 3), (9, 9, 9))])
    return x, spark.createDataFrame([(v.tolist(),) for v in x], "v array<double>").repartition(4)


def plainly(x, centres):
    while True:
        near = ((x[:, None] - centres[None]) ** 2).sum(2).argmin(1)
        moved = np.array([x[near == i].mean(0) if (near == i).any() else c for i, c in enumerate(centres)])
        if np.abs(moved - centres).max() <= 1e-10:
            return moved, ((x - moved[near]) ** 2).sum()
        centres = moved


def test_runs_together_equal_single_runs(blobs):
    x, df = blobs
    first = KM.draw_centres(df, [1, 2, 3], 6)
    runs = KM.fit_runs(df, [2, 5, 6], [1, 2, 3], tolerance=0)
    assert len(runs) == 9
    for r in runs:
        centres, inertia = plainly(x, first[r.start][: r.k])
        assert r.inertia == pytest.approx(inertia, rel=1e-9)
        assert np.allclose(r.centres, sorted(map(tuple, centres)), atol=1e-8)
    best = KM.best_of(runs)
    assert best[5].inertia == min(r.inertia for r in runs if r.k == 5) < best[2].inertia


def test_five_blobs_are_found_and_named_alike(blobs):
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    x, df = blobs
    best = KM.best_of(KM.fit_runs(df, [5], range(5)))[5]
    vectors = df.select(array_to_vector("v").alias("features"))
    theirs = min(KMeans(k=5, seed=s, maxIter=300).fit(vectors).summary.trainingCost for s in range(5))
    assert best.inertia <= theirs * (1 + 1e-6)
    sizes = df.groupBy(KM.nearest(F.col("v"), best.centres).alias("c")).count().collect()
    assert sorted((r["c"], r["count"]) for r in sizes) == [(i, 90) for i in range(5)]


def test_starts_do_not_depend_on_the_layout(blobs):
    _, df = blobs
    a, b = KM.draw_centres(df, [7], 4), KM.draw_centres(df.coalesce(1), [7], 4)
    assert np.array_equal(a[7], b[7])


def test_fewer_vectors_than_clusters(spark):
    df = spark.createDataFrame([([1.0, 2.0],)] * 5 + [([3.0, 4.0],)], "v array<double>")
    [run] = KM.fit_runs(df, [4], [1])
    assert len(run.centres) == 2 and run.inertia == 0.0
    assert KM.fit_runs(df.limit(0), [4], [1]) == []


def test_products_choose_as_exact_differences_do():
    """Nearest centres by matrix products, equal and almost equal centres included, far from the origin too."""
    rng = np.random.default_rng(8)
    x = np.round(rng.random((700, 3)) * 4) + 1e4
    runs = [x[rng.choice(len(x), k, False)] + rng.choice([0.0, 0.5], (k, 1)) for k in (2, 5, 5, 6)]
    runs[1][3] = runs[1][0]
    for centres, got in zip(runs, KM._members(x, runs)):
        near = ((x[:, None] - centres[None]) ** 2).sum(2).argmin(1)
        assert got[:, 0].tolist() == np.bincount(near, minlength=len(centres)).tolist()
        assert np.allclose(got[:, 1:], [x[near == i].sum(0) for i in range(len(centres))])
