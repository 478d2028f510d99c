"""All logistic regressions of a search in one pass over the rows per iteration.

The coefficients of every setting and fold form one matrix.  A pass multiplies each batch of rows by it and adds up, for each
model, the loss, gradient and curvature (1 + d + d*d numbers); sums are made per task, then per model, and the
driver takes a Newton step for every model (for an l1 penalty the minimum of its quadratic form, by coordinate descent and a solve).  Steps that do
not lower a model's objective are halved; models leave the pass when they have converged.  All start from zero together:
as Newton steps need few passes, warm starts along C would only put passes one after the other.

Objective: mean log loss over a model's rows + (1 / (C n)) * (|w|_1, or |w|^2 / 2), intercept free, as published with C times the
sum of losses.  Columns are divided by their deviation inside the fit only, with penalties to match.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_PASSES, TOLERANCE = 100, 1e-9


@dataclass
class Fitted:
    """One model: the fold whose rows it leaves out, its setting, and coefficients with the intercept last."""

    fold: int
    setting: dict
    weights: np.ndarray


def _arrays(batch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    n = len(batch)
    x = np.asarray(batch.column("x").flatten()).reshape(n, -1) if n else np.zeros((0, 1))
    return x, *(np.asarray(batch.column(c).to_pylist(), np.int64) for c in ("y", "mask", "held"))


def _pass(rows: DataFrame, scale: np.ndarray, folds: Sequence[int], weights: np.ndarray) -> np.ndarray:
    """Sums of each model: loss, gradient, curvature, in one job."""
    sent = rows.sparkSession.sparkContext.broadcast((scale, np.asarray(folds), weights))

    def partial(batches):
        scale, folds, weights = sent.value
        d = len(scale) + 1
        total = np.zeros((len(folds), 1 + d + d * d))
        for batch in batches:
            x, y, mask, _ = _arrays(batch)
            if not len(x):
                continue
            x = np.concatenate([x / scale, np.ones((len(x), 1))], axis=1)
            z = x @ weights.T
            use = ((mask[:, None] >> folds) & 1).astype(float)
            p = 1.0 / (1.0 + np.exp(-np.clip(z, -500, 500)))
            total[:, 0] += (use * (np.logaddexp(0.0, z) - y[:, None] * z)).sum(axis=0)
            total[:, 1 : 1 + d] += (use * (p - y[:, None])).T @ x
            curve = use * p * (1 - p)
            for m in range(len(folds)):
                total[m, 1 + d :] += ((x * curve[:, m : m + 1]).T @ x).ravel()
        yield pa.RecordBatch.from_arrays([pa.array(range(len(folds)), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], names=["model", "sums"])

    def join(table: pa.Table) -> pa.Table:
        parts = np.sort(np.stack(table.column("sums").to_numpy()), axis=0)  # in one order, whatever the tasks'
        return pa.table({"model": table.column("model")[:1], "sums": pa.array([parts.sum(axis=0)], pa.list_(pa.float64()))})

    got = rows.mapInArrow(partial, "model int, sums array<double>").groupBy("model").applyInArrow(join, "model int, sums array<double>").collect()
    return np.array([r["sums"] for r in sorted(got, key=lambda r: r["model"])])


def _lasso_steps(g: np.ndarray, h: np.ndarray, w: np.ndarray, cost: np.ndarray, sweeps: int = 25, rounds: int = 8) -> np.ndarray:
    """For each model (axis 0) argmin over v of g(v-w) + (v-w)'h(v-w)/2 + sum(cost |v|).

    Rounds of coordinate descent on all models at once propose which entries are zero and the others' signs; with those fixed
    the minimum is a linear system.  A model is done when its solution has these signs and meets the conditions at zeros;
    one that is not after all rounds keeps what descent has reached (the next Newton step goes on from there)."""
    v, r = w.copy(), g.copy()  # r: gradient of the quadratic at v
    live = np.arange(len(v))
    for _ in range(rounds):
        for _ in range(sweeps):
            for j in range(v.shape[1]):
                curve = h[live, j, j]
                at = v[live, j] - r[live, j] / curve
                new = np.sign(at) * np.maximum(np.abs(at) - cost[live, j] / curve, 0.0)
                r[live] += h[live, :, j] * (new - v[live, j])[:, None]
                v[live, j] = new
        still = []
        for m in live:
            on = (v[m] != 0) | (cost[m] == 0)
            sign, off = np.sign(v[m][on]), ~on
            exact = np.zeros_like(v[m])
            exact[on] = w[m][on] - np.linalg.lstsq(h[m][np.ix_(on, on)], g[m][on] - h[m][np.ix_(on, off)] @ w[m][off] + cost[m][on] * sign, rcond=None)[0]
            pull = g[m] + h[m] @ (exact - w[m])
            if (cost[m][on] * (np.sign(exact[on]) != sign) == 0).all() and (np.abs(pull[off]) <= cost[m][off] * (1 + 1e-9)).all():
                v[m] = exact
            else:
                still.append(m)
        live = np.array(still, int)
        if not len(live):
            break
    return v


def fit_all(rows: DataFrame, models: Sequence[tuple[int, dict]]) -> list[Fitted]:
    """Fit every (fold, setting: C, penalty) on ``rows`` (x, y, mask, held)."""
    dim = len(rows.first()["x"])
    folds = np.array([f for f, _ in models])
    stats = rows.agg(*[F.stddev_pop(F.col("x")[i]).alias(f"s{i}") for i in range(dim)], *[F.sum(F.getbit("mask", F.lit(int(f)))).alias(f"n{f}") for f in set(folds)]).first()
    scale = np.array([stats[f"s{i}"] or 1.0 for i in range(dim)])
    n = np.array([float(stats[f"n{f}"]) for f in folds])
    penalty = 1.0 / (np.array([s["C"] for _, s in models]) * n)
    lasso = np.array([s["penalty"] == "l1" for _, s in models])
    cost = np.concatenate([1.0 / scale, [0.0]])

    def objective(m, loss, w):
        return loss / n[m] + penalty[m] * (np.sum(cost * np.abs(w)) if lasso[m] else np.sum((cost * w) ** 2) / 2)

    def targets(models, sums):
        """Where the Newton steps of ``models`` lead."""
        d, w = dim + 1, weights[models]
        g = sums[:, 1 : 1 + d] / n[models, None]
        h = sums[:, 1 + d :].reshape(-1, d, d) / n[models, None, None] + 1e-13 * np.eye(d)
        out, one = np.empty_like(w), lasso[models]
        if one.any():
            out[one] = _lasso_steps(g[one], h[one], w[one], penalty[models][one, None] * cost)
        for k in np.flatnonzero(~one):
            m = models[k]
            out[k] = w[k] - np.linalg.lstsq(h[k] + penalty[m] * np.diag(cost**2), g[k] + penalty[m] * cost**2 * w[k], rcond=None)[0]
        return out

    weights = np.zeros((len(models), dim + 1))
    base, aim, value, part = weights.copy(), weights.copy(), np.full(len(models), np.inf), np.ones(len(models))
    open_ = np.arange(len(models))
    for _ in range(MAX_PASSES):
        sums = _pass(rows, scale, folds[open_], weights[open_])
        now = np.array([objective(m, x[0], weights[m]) for m, x in zip(open_, sums)])
        worse = now > value[open_] + 1e-12 * np.abs(value[open_])
        level = np.abs(now - value[open_]) <= 1e-10 * np.abs(now)
        part[open_[worse]] /= 2  # too far: go half as far from the last good point
        good = open_[~worse]
        base[good], value[good], part[good] = weights[good], now[~worse], 1.0
        aim[good] = targets(good, sums[~worse])
        ended = np.zeros(len(models), bool)
        ended[good] = level[~worse] | (np.abs(aim[good] - base[good]).max(axis=1) <= TOLERANCE * np.maximum(1.0, np.abs(base[good]).max(axis=1)))
        ended |= part < 1e-4
        part[part < 1e-4] = 0.0  # nothing lower on the way: the last good point stays
        weights[open_] = base[open_] + part[open_, None] * (aim[open_] - base[open_])
        open_ = open_[~ended[open_]]
        if not len(open_):
            break
    return [Fitted(int(f), s, np.concatenate([w[:-1] / scale, w[-1:]])) for (f, s), w in zip(models, weights)]


def fold_counts(rows: DataFrame, fitted: Sequence[Fitted]) -> DataFrame:
    """(setting, fold, tp, fp, fn) on the rows each fold holds out, in one pass."""
    sent = rows.sparkSession.sparkContext.broadcast([(f.fold, json.dumps(f.setting, sort_keys=True), f.weights) for f in fitted])

    def count(batches):
        models = sent.value
        total = np.zeros((len(models), 3), np.int64)
        for batch in batches:
            x, y, _, held = _arrays(batch)
            if len(x):
                said = x @ np.stack([w[:-1] for _, _, w in models]).T + np.array([w[-1] for _, _, w in models]) > 0
                out = held[:, None] == np.array([f for f, _, _ in models])
                total += np.stack([(said & out & (y == 1)[:, None]).sum(0), (said & out & (y == 0)[:, None]).sum(0), (~said & out & (y == 1)[:, None]).sum(0)], axis=1)
        yield pa.RecordBatch.from_arrays([pa.array([s for _, s, _ in models]), pa.array([f for f, _, _ in models], pa.int32()), *(pa.array(total[:, i]) for i in range(3))],
                                         names=["setting", "fold", "tp", "fp", "fn"])

    return rows.mapInArrow(count, "setting string, fold int, tp long, fp long, fn long").groupBy("setting", "fold").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")])


def stage(spark, fitted: Fitted):
    """The model as Spark's own pipeline stage, which can be saved."""
    from pyspark.ml.classification import LogisticRegressionModel
    from pyspark.ml.common import _py2java
    from pyspark.ml.linalg import Vectors
    from pyspark.ml.util import Identifiable

    class Named(Identifiable):
        pass

    java = spark._jvm.org.apache.spark.ml.classification.LogisticRegressionModel(
        Named().uid, _py2java(spark.sparkContext, Vectors.dense(fitted.weights[:-1])), float(fitted.weights[-1]))
    return LogisticRegressionModel(java)
