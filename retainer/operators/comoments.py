"""Mergeable co-moments: all pairs of columns in one pass over the rows.

Each task keeps five matrices for its rows (counts, means, squares and products of deviations, each
over the rows in which both columns of a pair have a value) and emits one row.  States merge pairwise
(Chan et al.), so neither a large mean nor the number of columns costs precision or further passes.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MERGERS = 32        # tasks of the first round of merging


class CoMoments:
    """``n[a, b]`` rows with both values; over them the mean ``base[a, b] + off[a, b]`` and ``m2[a, b]`` of column a, ``c[a, b]`` of
    the pair.  The base is a value of the column: means in two parts stay exact where they are large beside the spread."""

    def __init__(self, n: np.ndarray, base: np.ndarray, off: np.ndarray, m2: np.ndarray, c: np.ndarray):
        self.n, self.base, self.off, self.m2, self.c = n, base, off, m2, c

    @classmethod
    def of(cls, x: np.ndarray) -> CoMoments:
        """Of a block of rows; NaN is a missing value."""
        has = ~np.isnan(x)
        mask = has.astype(float)
        # deviations from a value of the column, then from their mean: exactly 0 for a constant column
        first = np.where(has.any(axis=0), x[has.argmax(axis=0), np.arange(x.shape[1])], 0.0)
        d = np.where(has, x - first, 0.0)
        mu = d.sum(axis=0) / np.maximum(mask.sum(axis=0), 1)
        d = np.where(has, d - mu, 0.0)
        n = mask.T @ mask
        some = np.maximum(n, 1)
        s = d.T @ mask
        m2 = np.maximum((d * d).T @ mask - s * s / some, 0.0)
        return cls(n, np.broadcast_to(first[:, None], n.shape), mu[:, None] + s / some, m2, d.T @ d - s * s.T / some)

    def merge(self, other: CoMoments) -> CoMoments:
        n = self.n + other.n
        some = np.maximum(n, 1)
        delta = np.where((self.n > 0) & (other.n > 0), (other.base - self.base) + (other.off - self.off), 0.0)
        both = self.n * other.n / some
        base = np.where(self.n == 0, other.base, self.base)
        off = np.where(self.n == 0, other.off, self.off + delta * other.n / some)
        return CoMoments(n, base, off, self.m2 + other.m2 + delta * delta * both, self.c + other.c + delta * delta.T * both)

    def correlation(self) -> np.ndarray:
        """Pearson's r of each pair; NaN where a column has no spread among the rows of the pair."""
        spread = np.sqrt(self.m2) * np.sqrt(self.m2.T)
        return np.divide(self.c, spread, out=np.full_like(self.c, np.nan), where=spread > 0)

    def batch(self) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([np.ascontiguousarray(m).tobytes()], pa.binary()) for m in (self.n, self.base, self.off, self.m2, self.c)],
                                          names=["n", "base", "off", "m2", "c"])


_STATE = "n binary, base binary, off binary, m2 binary, c binary"


def _states(batch: pa.RecordBatch) -> Iterator[CoMoments]:
    for i in range(len(batch)):
        flat = [np.frombuffer(batch.column(j)[i].as_py()) for j in range(5)]
        width = int(len(flat[0]) ** 0.5)
        yield CoMoments(*[m.reshape(width, width) for m in flat])


def _fold(states: Iterator[CoMoments]) -> Iterator[pa.RecordBatch]:
    total = None
    for state in states:
        total = state if total is None else total.merge(state)
    if total is not None:
        yield total.batch()


def _take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return _fold(CoMoments.of(np.column_stack([c.to_numpy(zero_copy_only=False).astype(float) for c in b.columns])) for b in batches if len(b))


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return _fold(state for b in batches for state in _states(b))


def co_moments(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """One row with the state of all rows (none if there are no rows); nulls and NaN are missing values."""
    parts = df.select(*[F.col(c).cast("double") for c in cols]).mapInArrow(_take, _STATE)
    return parts.repartition(MERGERS).mapInArrow(_merge, _STATE).repartition(1).mapInArrow(_merge, _STATE)


def correlations(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(i, j, r) for each pair i > j of positions in ``cols``; r over the rows that have both values, null
    without spread; no rows give null for every pair."""
    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = np.full((len(cols), len(cols)), np.nan)
        for b in batches:
            for state in _states(b):
                r = state.correlation()
        i, j = np.tril_indices(len(cols), -1)
        yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(r[i, j], from_pandas=True)], names=["i", "j", "r"])

    return co_moments(df, cols).repartition(1).mapInArrow(pairs, "i int, j int, r double")
