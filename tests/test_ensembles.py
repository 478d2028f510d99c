"""Shared-histogram trees and the batched logistic search against plain fits."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL

from retainer.operators import ensembles as EN
from retainer.operators import logistic as LG
from retainer.operators import models as M
from retainer.plans import catalog
from retainer.sources import files as IO

DIM = 6


def toy(n=400, seed=3):
    rng = np.random.default_rng(seed)
    x = np.round(rng.random((n, DIM)) * 20)
    y = ((x[:, 0] + x[:, 1] * x[:, 2] / 10 + 6 * rng.random(n)) > 18).astype(np.int64)
    fold = rng.integers(0, 3, n)
    cuts = [sorted(set(x[:, i]) - {x[:, i].max()}) for i in range(DIM)]
    return x, EN.Rows(np.arange(n), EN.binned(x, cuts), y, 15 - (1 << fold).astype(np.int64), fold), cuts


def tree_plainly(rows, w, z, h, rules, seed):
    """One tree by recursion over lists; returns a function from a row of bins to (s, w, h) of its leaf."""
    def node(at, path, depth):
        total = (sum(z[i] * w[i] for i in at), sum(w[i] for i in at), sum(h[i] * w[i] for i in at))
        best = (1e-10, None, None)
        if depth < rules.max_depth and len(at) >= max(rules.min_split, 2 * rules.min_leaf):
            for f in EN.choose(seed, np.array([path], np.uint64), DIM, rules.features)[0]:
                for cut in range(EN.BINS - 1):
                    left = [i for i in at if rows.bins[i, f] <= cut]
                    right = [i for i in at if rows.bins[i, f] > cut]
                    if min(len(left), len(right)) < rules.min_leaf:
                        continue
                    wl, wr = (sum(w[i] for i in side) for side in (left, right))
                    ml, mr = (sum(z[i] * w[i] for i in side) / EN.UNIT / sum(w[i] for i in side) for side in (left, right))
                    gain = wl * wr / (wl + wr) * (ml - mr) ** 2
                    if gain > best[0] * (1 + 1e-12):
                        best = (gain, int(f), cut)
        if best[1] is None:
            return lambda b: total
        _, f, cut = best
        paths = EN.mix(np.repeat(np.array([path], np.uint64), 2) * np.uint64(2) + np.arange(2, dtype=np.uint64))
        left = node([i for i in at if rows.bins[i, f] <= cut], paths[0], depth + 1)
        right = node([i for i in at if rows.bins[i, f] > cut], paths[1], depth + 1)
        return lambda b: (left if b[f] <= cut else right)(b)

    return node([i for i in range(len(rows)) if w[i]], np.uint64(1), 0)


def setting(**more):
    return {"n_estimators": 4, "max_depth": None, "min_samples_split": 2, "min_samples_leaf": 1} | more


def predicted(growth, rows, s):
    return next(p for _, p in growth.prefixes(rows, [s]))


def test_forest_equals_a_plain_one():
    _, rows, _ = toy(200)
    for limits in ({}, {"max_depth": 3, "min_samples_split": 9, "min_samples_leaf": 4}):
        s = setting(**limits)
        [(growth, _)] = EN.growths("forest", [s], [1], DIM)
        shared = predicted(EN.grow_here(growth, rows), rows, s)
        mine, plain = rows.take(np.flatnonzero(growth.used(rows))), np.zeros(len(rows))
        for t in range(4):
            w = EN.poisson(mine.rid, growth.seed_of(t)) * growth.used(mine)
            leaf = tree_plainly(mine, w, mine.y * EN.UNIT, 0 * w, EN.Rules(2, s["max_depth"] or 99, s["min_samples_leaf"], s["min_samples_split"]), growth.seed_of(t))
            plain += [leaf(b)[0] / EN.UNIT / leaf(b)[1] for b in rows.bins]
        assert np.allclose(shared, plain / 4, atol=1e-12)


def test_boosted_trees_equal_plain_ones():
    _, rows, _ = toy(150)
    growth = EN.grow_here(EN.Boosted(0, 7, EN.Rules(DIM, 2, 1), 3, rate=0.3, subsample=0.8), rows)
    mine = rows.take(np.flatnonzero(growth.used(rows)))
    score = np.full(len(rows), np.log(mine.y.mean() / (1 - mine.y.mean())))
    for t in range(3):
        n, _, z, h = growth.stats(rows, score, t)
        leaf = tree_plainly(rows, n, z, h, growth.rules, growth.seed_of(t))
        score = score + [0.3 * leaf(b)[0] / leaf(b)[2] for b in rows.bins]
    assert np.allclose(predicted(growth, rows, {"n_estimators": 3}), 1 / (1 + np.exp(-score)), atol=1e-9)


def test_one_growth_serves_all_limits_and_sizes():
    """Sizes, depths and split limits read off one growth equal separate fits."""
    _, rows, _ = toy()
    grid = [setting(n_estimators=n, max_depth=d, min_samples_split=m) for n in (2, 5) for d in (2, 4, None) for m in (2, 30)]
    [(growth, served)] = EN.growths("forest", grid, [0], DIM)
    assert served == grid
    for s, p in EN.grow_here(growth, rows).prefixes(rows, grid):
        alone = EN.Forest(0, 42, EN.Rules(2, s["max_depth"] or 99, 1, s["min_samples_split"]), s["n_estimators"])
        assert np.array_equal(p, predicted(EN.grow_here(alone, rows), rows, s))
    grid = [{"n_estimators": n, "learning_rate": 0.2, "max_depth": 3, "subsample": 0.9} for n in (3, 10)]
    [(growth, _)] = EN.growths("boosted", grid, [0], DIM)
    for s, p in EN.grow_here(growth, rows).prefixes(rows, grid):
        alone = EN.Boosted(0, 42, EN.Rules(DIM, 3, 1), s["n_estimators"], rate=0.2, subsample=0.9)
        assert np.array_equal(p, predicted(EN.grow_here(alone, rows), rows, s))


@pytest.fixture(scope="module")
def table(spark):
    x, rows, cuts = toy()
    data = [(int(i), [float(v) for v in x[i]], int(rows.y[i]), int(rows.mask[i]), int(rows.held[i])) for i in range(len(x))]
    return spark.createDataFrame(data, "rid long, x array<double>, y int, mask long, held int").repartition(5), cuts


def test_published_grids():
    assert [len(M.PUBLISHED[k]) for k in ("logistic", "forest", "boosting")] == [8, 81, 81]
    assert len(EN.growths("forest", M.PUBLISHED["forest"], range(5), 20)) == 15
    assert len(EN.growths("boosted", M.PUBLISHED["boosting"], range(5), 20)) == 135


def test_rows_apart_grow_the_same_trees(spark, table):
    """Histograms added up over tasks, in small steps, give the trees that one task grows."""
    data, cuts = table
    rows = EN.binned_rows(data, "x", cuts)

    def plan():
        both = EN.growths("forest", [setting(n_estimators=2, max_depth=5)], [0], DIM)
        return [g for g, _ in both + EN.growths("boosted", [{"n_estimators": 4, "learning_rate": 0.3, "max_depth": 2, "subsample": 0.9}], [1], DIM)]

    here = EN.train(rows, plan(), DIM)
    apart = EN.grow_apart(rows, plan(), DIM, cells=2_000, carry=2)
    for a, b in zip(here, apart, strict=True):
        assert len(a.trees) == len(b.trees) and a.prior == b.prior
        for s, t in zip(a.trees, b.trees):
            for part in EN._PARTS:
                assert np.array_equal(getattr(s, part), getattr(t, part)), part


def test_fold_counts_of_both_ways_agree(spark, table):
    data, cuts = table
    rows = EN.binned_rows(data, "x", cuts)
    grid = [setting(n_estimators=1, max_depth=4, min_samples_split=m) for m in (2, 20)]
    got = [sorted(map(tuple, EN.fold_counts(rows, EN.growths("forest", grid, range(3), DIM), DIM, small).collect())) for small in (0, EN.SMALL)]
    assert got[0] == got[1] and len(got[0]) == 6


def test_search_keeps_the_best_and_its_models_can_be_saved(spark, table, tmp):
    from pyspark.ml import PipelineModel
    from pyspark.ml.functions import array_to_vector

    data, _ = table
    grid = [setting(n_estimators=n, max_depth=d) for n in (1, 6) for d in (1, 6)]
    found = M.grid_search("forest", grid, data, n_folds=3)
    assert found["tuning_score"] == max(found["scores"].values()) and len(found["scores"]) == 4 and len(found["folds"]) == 3
    IO.save_model(PipelineModel([found["model"]]), f"{tmp}/m")
    vectors = data.select("rid", array_to_vector("x").alias("features"))
    one, two = (sorted(m.transform(vectors).select("rid", "probability", "prediction").collect()) for m in (found["model"], IO.load_model(f"{tmp}/m")))
    assert one == two and {r["prediction"] for r in one} == {0.0, 1.0}
    shares = found["model"].featureImportances.toArray()
    assert shares.sum() == pytest.approx(1.0) and shares[:3].sum() > shares[3:].sum()


def test_logistic_models_fitted_together_equal_single_fits(spark, table):
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    data, _ = table
    settings = [(f, {"C": c, "penalty": p}) for f, c in ((0, 0.1), (3, 100.0)) for p in ("l1", "l2")]
    together = LG.fit_all(data, settings)
    vectors = data.select(array_to_vector("x").alias("features"), F.col("y").cast("double").alias("label"), "mask")
    for (fold, s), got in zip(settings, together):
        [alone] = LG.fit_all(data, [(fold, s)])
        assert np.allclose(got.weights, alone.weights, atol=1e-6)
        part = vectors.where(F.getbit("mask", F.lit(fold)) == 1)
        n = part.count()
        other = LogisticRegression(maxIter=1000, tol=1e-12, standardization=False, regParam=1 / (s["C"] * n), elasticNetParam=float(s["penalty"] == "l1")).fit(part)
        theirs = np.r_[other.coefficients.toArray(), other.intercept]

        def cost(w):
            x, y = (np.array(v) for v in zip(*[(r["features"].toArray(), r["label"]) for r in rows]))
            z = x @ w[:-1] + w[-1]
            return np.mean(np.logaddexp(0, z) - y * z) + (np.abs(w[:-1]).sum() if s["penalty"] == "l1" else (w[:-1] ** 2).sum() / 2) / (s["C"] * n)

        rows = part.collect()
        assert cost(got.weights) <= cost(theirs) + 1e-9
        assert np.allclose(got.weights, theirs, atol=2e-3, rtol=2e-3)
        stage = LG.stage(spark, got)
        assert stage.transform(part).filter("prediction = label").count() / n > 0.6


@pytest.mark.parametrize("name", ["train_comparison", "enhanced_model"])
def test_training_queries_search_the_published_grids_to_the_end(spark, name):
    rows = catalog.REGISTRY[name][0](spark, SF_SMALL).collect()
    if name == "train_comparison":
        assert {r["Model"] for r in rows} == {"logistic", "forest", "boosting"}
        assert all(set(json.loads(r["best_params"])) == set(M.PUBLISHED[r["Model"]][0]) and r["Tuning_Score"] > 0.5 for r in rows)
    else:
        assert len(rows) == 150 and all(0 <= r["ensemble_probability"] <= 1 and 0 <= r["ChurnProbability"] <= 1 for r in rows)


def test_siblings_share_a_histogram(monkeypatch):
    """Below the root of a boosted tree at most half of the rows are counted a level."""
    _, rows, _ = toy()
    counted, plain = [], EN.histogram
    monkeypatch.setattr(EN, "histogram", lambda c, at, slot, *more: (counted.append(len(slot)), plain(c, at, slot, *more))[1])
    growth = EN.grow_here(EN.Boosted(0, 7, EN.Rules(DIM, 4, 1), 1), rows)
    n = int(growth.used(rows).sum())
    assert len(counted) == 4 and counted[0] == n and all(c <= n / 2 for c in counted[1:])


def test_trees_of_a_forest_apart_grow_together(spark, table, monkeypatch):
    data, cuts = table
    steps, plain = [], EN._step
    monkeypatch.setattr(EN, "_step", lambda *more: (steps.append(1), plain(*more))[1])
    [(growth, _)] = EN.growths("forest", [setting(n_estimators=6, max_depth=2)], [0], DIM)
    EN.grow_apart(EN.binned_rows(data, "x", cuts), [growth], DIM)
    assert len(growth.trees) == 6 and len(steps) == 2


def test_features_counted_together_give_the_same_sums():
    rng = np.random.default_rng(8)
    columns = np.stack([rng.integers(0, b, 3000) for b in (32, 2, 3, 32, 2, 7, 1)]).astype(np.uint8)
    part = rng.integers(-EN.UNIT, EN.UNIT, 3000).astype(float)
    joint = EN.Joint(columns)
    assert len(joint.groups) == 2 and sorted(sum(joint.groups, [])) == list(range(7))
    features = np.broadcast_to(np.arange(7), (3, 7))
    rows = rng.permutation(3000)[:2000]
    slot = np.sort(rng.integers(0, 3, 2000))
    for a, b in zip(EN.histogram(columns, rows, slot, [part], features, joint), EN.histogram(columns, rows, slot, [part[rows]], features)):
        assert np.array_equal(a, b)
    one = np.zeros(3000, np.int64)
    for a, b in zip(EN.histogram(columns, None, one, [part], features[:1], joint), EN.histogram(columns, None, one, [part], features[:1])):
        assert np.array_equal(a, b)


@pytest.mark.parametrize("sample", [1.0, 0.8])
def test_boosted_sums_are_those_of_all_rows(sample):
    """Targets, curvature and samples of the rows kept by node are those of ``stats``."""
    _, rows, _ = toy()
    growth, score = EN.Boosted(0, 7, EN.Rules(DIM, 3, 1), 1, subsample=sample), np.random.default_rng(1).normal(size=len(rows))
    mine = rows.take(np.flatnonzero(growth.used(rows)))
    score = score[: len(mine)]
    shared = EN.Residuals(growth, np.ascontiguousarray(mine.bins.T), mine)
    live, rest = shared.set(score, 3)
    n, _, z, h = growth.stats(mine, score, 3)
    assert np.array_equal(live, np.flatnonzero(n)) and np.array_equal(np.sort(np.r_[live, rest]), np.arange(len(mine)))
    assert np.array_equal(shared.target[live], z[live]) and np.array_equal(shared.curve[live], h[live])


def test_tables_of_hundreds_of_thousands_of_rows_need_no_job_a_level(spark, monkeypatch):
    rows = spark.range(0, 300_000, 1, 8).select(F.col("id").alias("rid"), F.array((F.col("id") % 7).cast("double"), (F.col("id") % 5).cast("double")).alias("x"),
                                                (F.col("id") % 7 > 3).cast("int").alias("y"), F.lit(2).cast("long").alias("mask"), F.lit(0).alias("held"))
    monkeypatch.setattr(EN, "grow_apart", lambda *more: pytest.fail("a job a level"))
    grid = [{"n_estimators": 2, "learning_rate": 1.0, "max_depth": 2, "subsample": 1.0}]
    plan = [(EN.Boosted(1, 42, EN.Rules(2, 2, 1), 2, rate=1.0), grid)]
    table = EN.binned_rows(rows, "x", [[0.0, 1.0, 2.0, 3.0, 4.0, 5.0], [0.0, 1.0, 2.0, 3.0]])
    assert EN.fold_counts(table, plan, 2).count() == 1
    [grown] = EN.train(table, [EN.Boosted(1, 42, EN.Rules(2, 2, 1), 2)], 2)
    assert len(grown.trees) == 2


def test_forests_to_keep_are_grown_in_parts(spark, table, monkeypatch):
    data, cuts = table
    rows = EN.binned_rows(data, "x", cuts)
    whole = EN.grow_here(EN.Forest(0, 42, EN.Rules(2, 5, 1), 5), EN._rows_of(rows.orderBy("rid").toArrow(), DIM))
    monkeypatch.setattr(EN, "BAGS", 2)
    [parts] = EN.train(rows, [EN.Forest(0, 42, EN.Rules(2, 5, 1), 5)], DIM)
    assert len(EN._pieces([EN.Forest(0, 42, EN.Rules(2, 5, 1), 5)])) == 3 and len(parts.trees) == 5
    for s, t in zip(parts.trees, whole.trees, strict=True):
        assert all(np.array_equal(getattr(s, part), getattr(t, part)) for part in EN._PARTS)
