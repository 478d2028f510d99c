"""K-means for many numbers of clusters and starts in one pass over the rows per iteration.

The centres of all runs (k, start) form one matrix; a pass finds the nearest centre of every run for each row and adds up sums
and counts, first by task, then by run.  Distances come from one matrix product; where two centres are as near as its rounding
can tell, they are compared by exact differences.  Runs leave the pass when their centres stay; a last pass gives the inertia
of all.  Starts follow k-means++: the
next centre of a start is drawn with chances in proportion to squared distance, by the smallest exponential lot
(a hash of the vector and the start, so retries and layouts draw the same).  Runs of one start share their first centres
whatever k is, so the starts of all runs take as many passes as the largest k.

Only centres and sums, k x columns numbers a run, reach the driver.  Equal vectors have equal lots, so a start never draws one
vector twice; with fewer distinct vectors than k, a run has fewer centres.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from retainer.operators.ensembles import mix

#: A run ends when its centres together move by no more than this share of the columns' mean variance (squared).
MAX_PASSES, TOLERANCE = 300, 1e-4


@dataclass
class Clusters:
    """A finished run: its centres (rows in ascending order) and the sum of squared distances to them."""

    k: int
    start: int
    centres: np.ndarray
    inertia: float


def _vectors(batch) -> np.ndarray:
    return np.asarray(batch.column("v").flatten()).reshape(len(batch), -1) if len(batch) else np.zeros((0, 1))


def _distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances, without the cancellation of the expanded form."""
    out, columns = np.zeros((len(centres), len(x))), np.ascontiguousarray(x.T)
    for j, column in enumerate(columns):
        step = column[None, :] - centres[:, j, None]
        step *= step
        out += step
    return out.T


def _lots(x: np.ndarray, start: int) -> np.ndarray:
    """An exponential lot for each vector."""
    bits, state = (np.ascontiguousarray(x) + 0.0).view(np.uint64), np.full(len(x), np.uint64(start))  # + 0.0: no negative zero
    for j in range(bits.shape[1]):
        state = mix(state ^ mix(bits[:, j] + np.uint64(j)))
    return -np.log1p(-((state >> np.uint64(11)).astype(float) / (1 << 53)))


def draw_centres(vectors: DataFrame, starts: Sequence[int], most: int) -> dict[int, np.ndarray]:
    """Up to ``most`` k-means++ centres of each start; one pass a centre for all starts."""
    chosen: dict[int, list] = {s: [] for s in starts}
    for step in range(most):
        sent = vectors.sparkSession.sparkContext.broadcast({s: np.array(c) for s, c in chosen.items()})

        def lowest(batches):
            best = {}
            for batch in batches:
                x = _vectors(batch)
                for s, centres in sent.value.items() if len(x) else ():
                    weight = _distances(x, centres).min(axis=1) if len(centres) else np.ones(len(x))
                    with np.errstate(divide="ignore", invalid="ignore"):
                        lot = np.where(weight > 0, _lots(x, s * 1_000 + step) / weight, np.inf)
                    at = int(lot.argmin())
                    if lot[at] < np.inf:
                        best[s] = min(best.get(s, (np.inf, ())), (float(lot[at]), tuple(x[at].tolist())))
            yield pa.RecordBatch.from_arrays([pa.array(best, pa.int64()), pa.array([b[0] for b in best.values()], pa.float64()),
                                              pa.array([list(b[1]) for b in best.values()], pa.list_(pa.float64()))], names=["start", "lot", "v"])

        found = vectors.mapInArrow(lowest, "start long, lot double, v array<double>").groupBy("start").agg(F.min(F.struct("lot", "v")).alias("x"))
        for r in found.collect():  # one row a start
            chosen[r["start"]].append(r["x"]["v"])
    return {s: np.array(c) for s, c in chosen.items()}


#: Rows of one matrix product; relative rounding of a product, well above what 53 bits leave.
BLOCK, ROUNDING = 512, 1e-11


def _chosen(x: np.ndarray, runs: np.ndarray) -> np.ndarray:
    """1.0 at the nearest centre (the first of equals) of each run for each row; ``runs``: (run, k, column); result (run, k, row)."""
    r, k, d = runs.shape
    norm = (runs**2).sum(axis=2)
    score = ((-2.0 * runs.reshape(r * k, d)) @ x.T).reshape(r, k, len(x)) + norm[:, :, None]
    limit = score.min(axis=1) + ROUNDING * ((x**2).sum(axis=1)[None, :] + norm.max(axis=1)[:, None])
    near = score <= limit[:, None, :]
    run, row = np.nonzero(near.view(np.uint8).sum(axis=1, dtype=np.int32) > 1)
    if len(run):
        exact = np.zeros((len(run), k))
        for j in range(d):
            exact += (x[row, j, None] - runs[run, :, j]) ** 2
        near[run, :, row] = np.arange(k) == exact.argmin(axis=1)[:, None]
    return near.astype(float)


def _by_size(runs: list[np.ndarray]) -> list[tuple[list[int], np.ndarray]]:
    """Runs with as many centres together: (numbers, centres by run)."""
    sizes: dict[int, list[int]] = {}
    for i, r in enumerate(runs):
        sizes.setdefault(len(r), []).append(i)
    return [(at, np.stack([runs[i] for i in at])) for at in sizes.values()]


def _summed(vectors: DataFrame, runs: list[np.ndarray], sums) -> list[np.ndarray]:
    """``sums(x, runs)`` (an array for each run) of all rows x, added up by task, then by run."""
    sent = vectors.sparkSession.sparkContext.broadcast(runs)

    def partial(batches):
        runs, total = sent.value, None
        for batch in batches:
            x = _vectors(batch)
            if len(x):
                new = sums(x, runs)
                total = new if total is None else [a + b for a, b in zip(total, new)]
        total = total or []
        yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array([t.ravel() for t in total], pa.list_(pa.float64()))], names=["run", "sums"])

    def join(table: pa.Table) -> pa.Table:
        parts = np.sort(np.stack(table.column("sums").to_numpy()), axis=0)  # in one order, whatever the tasks'
        return pa.table({"run": table.column("run")[:1], "sums": pa.array([parts.sum(axis=0)], pa.list_(pa.float64()))})

    got = vectors.mapInArrow(partial, "run int, sums array<double>").groupBy("run").applyInArrow(join, "run int, sums array<double>").collect()
    return [np.array(r["sums"]) for r in sorted(got, key=lambda r: r["run"])]


def _members(x: np.ndarray, runs: list[np.ndarray]) -> list[np.ndarray]:
    """Number and sum of the rows nearest to each centre of each run."""
    total = [np.zeros((len(r), r.shape[1] + 1)) for r in runs]
    groups = _by_size(runs)
    for i in range(0, len(x), BLOCK):
        rows = x[i : i + BLOCK]
        ones = np.concatenate([np.ones((len(rows), 1)), rows], axis=1)
        for at, centres in groups:
            near = _chosen(rows, centres)
            for j, t in zip(at, (near.reshape(-1, len(rows)) @ ones).reshape(*near.shape[:2], -1)):
                total[j] += t
    return total


def _costs(x: np.ndarray, runs: list[np.ndarray]) -> list[np.ndarray]:
    return [_distances(x, r).min(axis=1).sum(keepdims=True) for r in runs]


def _pass(vectors: DataFrame, runs: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray]]:
    """(counts, sums) of each run's centres."""
    tables = [t.reshape(len(r), -1) for t, r in zip(_summed(vectors, runs, _members), runs)]
    return [(t[:, 0], t[:, 1:]) for t in tables]


def fit_runs(vectors: DataFrame, ks: Sequence[int], starts: Sequence[int], max_passes: int = MAX_PASSES, tolerance: float = TOLERANCE) -> list[Clusters]:
    """Every (k, start) over ``vectors`` (v: array of doubles), each until its centres stay (``tolerance``) or ``max_passes``."""
    first = draw_centres(vectors, starts, max(ks))
    dim = max((len(c[0]) for c in first.values() if len(c)), default=0)
    spread = vectors.agg(*[F.var_pop(F.col("v")[j]) for j in range(dim)]).first() if dim else ()
    still = max(tolerance * float(np.mean(spread or [0.0])), 1e-20)
    names = [(k, s) for k in ks for s in starts if len(first[s])]
    centres = [first[s][:k] for k, s in names]
    open_ = list(range(len(names)))
    for _ in range(max_passes):
        going = []
        for i, (count, total) in zip(open_, _pass(vectors, [centres[i] for i in open_])):
            moved = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], centres[i])
            if ((moved - centres[i]) ** 2).sum() > still:
                going.append(i)
                centres[i] = moved
        open_ = going
        if not open_:
            break
    inertia = _summed(vectors, centres, _costs) if names else []
    return [Clusters(k, s, np.array(sorted(map(tuple, c))), float(x[0])) for (k, s), c, x in zip(names, centres, inertia)]


def best_of(runs: Sequence[Clusters]) -> dict[int, Clusters]:
    """The run of least inertia for each k; the first start of equals."""
    out: dict[int, Clusters] = {}
    for r in runs:
        if r.k not in out or r.inertia < out[r.k].inertia:
            out[r.k] = r
    return out


def nearest(vector: Column, centres: np.ndarray) -> Column:
    """Number of the centre nearest to an array column, the first of equals; plain expressions over k x columns constants."""
    def distance(c):
        return sum((((vector[j] - F.lit(float(x))) * (vector[j] - F.lit(float(x)))) for j, x in enumerate(c)), F.lit(0.0))

    return F.array_min(F.array(*[F.struct(distance(c).alias("d"), F.lit(i).alias("i")) for i, c in enumerate(centres)]))["i"]
