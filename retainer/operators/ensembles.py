"""Forests and boosted trees, many of them grown together on shared histograms.

Features are binned to bytes once.  A tree grows level by level: for each open node one histogram over (feature, bin) of four
whole numbers -- rows, weight, target, curvature -- decides its split.  Targets are fixed-point integers, so sums do not
depend on the order of rows, tasks or retries, and every way of running gives the same trees.

Settings share work:

* a node's split does not depend on ``min_samples_split`` or on a depth limit below it, so one tree grown without them serves
  all their values: a row stops at the first node that is too small or too deep (``Forest.stops``);
* the first 50 or 100 trees or rounds of an ensemble are the ensemble of that size, so one ensemble of the largest size serves
  all sizes (``prefixes``).

A published grid of 81 forests is thus 3 growths a fold, one of 81 boosted ensembles 27.

``train`` runs the growths in one of two ways.  Up to ``SMALL`` rows, the binned table (at most ``SMALL`` x features
bytes) is broadcast and each growth (of forests to keep: each 25 trees) is a task.  Boosted trees keep their rows by node there and count few-valued
features together (``Joint``); the larger of two siblings has its parent's histogram less that of the smaller.  Above, rows stay where they are: each step sends the trees so far to
all tasks, which add up histograms of their rows for open nodes of every growth (of forests: of all trees at once); they are summed and
split by node, and only splits reach the driver, which holds the trees (as Spark ML does).  Boosted scores travel with the rows and are
written to the shared folder every ``CARRY`` rounds.

Bootstrap weights (Poisson), row samples (Bernoulli) and feature choices are hashes of (seed, tree, row or node).
"""

from __future__ import annotations

import base64
import io
import json
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import keyword_only
from pyspark.ml import Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retainer.session import written

BINS = 32
#: Rows of a binned table that may be broadcast; rounds between writes of boosted scores; histogram cells of one step;
#: rows that a task handles at once; values of a code for several features.
SMALL, CARRY, CELLS, CHUNK, JOINT = 2_000_000, 8, 1 << 22, 1 << 16, 1 << 10
UNIT = 1 << 24
#: The most levels of a tree without a depth limit.
DEEPEST = 1_000


# binning ------------------------------------------------------------------------------------------------

def fit_cuts(df: DataFrame, vector: str, dim: int, bins: int = BINS) -> list[list[float]]:
    """Up to ``bins - 1`` cut points for each entry of an array column: distinct quantiles, below the largest value."""
    probs = [i / bins for i in range(bins)]
    row = df.agg(*[F.percentile_approx(F.col(vector)[i], probs, 10_000).alias(f"q{i}") for i in range(dim)],
                 *[F.max(F.col(vector)[i]).alias(f"m{i}") for i in range(dim)]).first()
    return [sorted({float(x) for x in row[f"q{i}"] or [] if x < row[f"m{i}"]})[: bins - 1] for i in range(dim)]


def binned(values: np.ndarray, cuts: Sequence[Sequence[float]]) -> np.ndarray:
    """Bin of each value: the number of cut points below it."""
    return np.stack([np.searchsorted(np.asarray(c), values[:, i], side="left").astype(np.uint8) for i, c in enumerate(cuts)], axis=1)


# hashes -------------------------------------------------------------------------------------------------

def mix(x: np.ndarray) -> np.ndarray:
    x = np.asarray(x, np.uint64)
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def uniform(ids: np.ndarray, seed: int) -> np.ndarray:
    """A number in [0, 1) for each id."""
    with np.errstate(over="ignore"):
        return (mix(mix(ids.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)) + np.uint64(seed)) >> np.uint64(11)).astype(float) / (1 << 53)


_POISSON = np.cumsum(np.exp(-1) / np.cumprod(np.r_[1.0, np.arange(1.0, 17.0)]))


def poisson(ids: np.ndarray, seed: int) -> np.ndarray:
    """Poisson(1) counts, as a bootstrap sample gives each row."""
    return np.searchsorted(_POISSON, uniform(ids, seed), side="right").astype(np.int64)


# one tree -----------------------------------------------------------------------------------------------

_PARTS = {"feature": np.int32, "cut": np.int32, "left": np.int32, "right": np.int32, "depth": np.int32, "path": np.uint64, "gain": float,
          "n": np.int64, "w": np.int64, "s": np.int64, "h": np.int64}


class Tree:
    """Nodes in the order of levels; ``left`` is -1 at a leaf.  A row goes left if its bin is at most ``cut``."""

    def __init__(self, parts: dict | None = None):
        self.__dict__.update(parts or {k: np.zeros(0, t) for k, t in _PARTS.items()})

    def add(self, **parts) -> np.ndarray:
        at = np.arange(len(self.left), len(self.left) + len(parts["path"]))
        for k, t in _PARTS.items():
            new = parts.get(k, -1 if k in ("left", "right", "feature", "cut") else 0)
            setattr(self, k, np.concatenate([getattr(self, k), np.broadcast_to(np.asarray(new, t), len(at))]))
        return at

    def advance(self, bins: np.ndarray, at: np.ndarray, stop: np.ndarray | None = None) -> np.ndarray:
        """Each row's node, moved from ``at`` down as far as the tree goes (or to a node in ``stop``)."""
        moving = np.flatnonzero((self.left[at] >= 0) & ~stop[at] if stop is not None else self.left[at] >= 0)
        while len(moving):
            node = at[moving]
            at[moving] = np.where(bins[moving, self.feature[node]] <= self.cut[node], self.left[node], self.right[node])
            node = at[moving]
            moving = moving[(self.left[node] >= 0) & ~stop[node] if stop is not None else self.left[node] >= 0]
        return at


def parted(column: np.ndarray, rows: np.ndarray, cut: int) -> tuple[np.ndarray, np.ndarray]:
    """``rows`` to the left and right of a cut."""
    right = column[rows] > cut
    return rows[~right], rows[right]


def landed(tree: Tree, columns: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each leaf that rows reach, and its rows; ``columns``: bins by feature."""
    left, feature, cut = tree.left.tolist(), tree.feature.tolist(), tree.cut.tolist()
    right, todo = tree.right.tolist(), [(0, np.arange(columns.shape[1]))]
    while todo:
        node, rows = todo.pop()
        if left[node] < 0:
            yield node, rows
            continue
        todo += [(child, some) for child, some in zip((left[node], right[node]), parted(columns[feature[node]], rows, cut[node])) if len(some)]


@dataclass(frozen=True)
class Rules:
    """What a tree may do: features looked at in a node, and its limits."""

    features: int
    max_depth: int
    min_leaf: int
    min_split: int = 2


def choose(seed: int, paths: np.ndarray, dim: int, m: int) -> np.ndarray:
    """The ``m`` features of each node, in rising order: those of the smallest hashes."""
    if m >= dim:
        return np.broadcast_to(np.arange(dim), (len(paths), dim))
    with np.errstate(over="ignore"):
        lots = mix(mix(paths[:, None] + np.uint64(seed)) + np.arange(dim, dtype=np.uint64)[None, :])
    return np.sort(np.argsort(lots, axis=1, kind="stable")[:, :m], axis=1)


def best_splits(hist: np.ndarray, min_leaf: int) -> dict[str, np.ndarray]:
    """Of each node (axis 0), the split of largest decrease of squared error (half the decrease of Gini impurity), first of
    equals.  ``hist``: whole numbers by (node, feature, bin, [n, w, s, h])."""
    left = np.cumsum(hist, axis=2)
    total = left[:, 0, -1]
    left = left[:, :, :-1]
    right = total[:, None, None] - left
    wl, wr = left[..., 1].astype(float), right[..., 1].astype(float)
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = wl * wr / (wl + wr) * (left[..., 2] / UNIT / wl - right[..., 2] / UNIT / wr) ** 2
    gain = np.where((left[..., 0] >= min_leaf) & (right[..., 0] >= min_leaf) & (wl > 0) & (wr > 0), gain, 0.0)
    flat = gain.reshape(len(gain), -1)
    pick = flat.argmax(axis=1) if flat.shape[1] else np.zeros(len(flat), int)
    rows, (which, cut) = np.arange(len(flat)), np.unravel_index(pick, gain.shape[1:])
    return {"gain": flat[rows, pick], "which": which, "cut": cut, "left": left[rows, which, cut], "total": total}


class Joint:
    """Features counted together: each group of features is one code of at most ``JOINT`` values, whose counts add up to those of its features."""

    def __init__(self, columns: np.ndarray):
        self.bins = [int(c.max(initial=0)) + 1 for c in columns]
        self.groups: list[list[int]] = []
        for i in sorted(range(len(columns)), key=lambda i: (-self.bins[i], i)):
            fits = next((g for g in self.groups if self.bins[i] * np.prod([self.bins[j] for j in g]) <= JOINT), None)
            if fits is None:
                self.groups.append([i])
            else:
                fits.append(i)
        self.codes = []
        for group in self.groups:
            code = np.zeros(columns.shape[1], np.uint16)
            for i in group:
                code = code * np.uint16(self.bins[i]) + columns[i]
            self.codes.append(code)

    def sums(self, rows: np.ndarray | None, slot: np.ndarray, slots: int, part: np.ndarray) -> list[np.ndarray]:
        """As ``histogram`` of all features; ``slot`` rises, ``part`` has whole numbers up to ``UNIT`` (2**29 of them add up exactly)."""
        out = [np.zeros((slots, len(self.bins), BINS), np.int64) for _ in range(2)]
        cells = [int(np.prod([self.bins[i] for i in g])) for g in self.groups]
        ends = np.searchsorted(slot, np.arange(slots + 1)).tolist()
        for at in range(slots):
            total = [(np.zeros(c, np.int64), np.zeros(c)) for c in cells]
            for a in range(ends[at], ends[at + 1], CHUNK):  # what a chunk gathers stays in the cache
                some = slice(a, min(a + CHUNK, ends[at + 1])) if rows is None else rows[a : min(a + CHUNK, ends[at + 1])]
                weight = part[some]
                for (n, s), code, c in zip(total, self.codes, cells):
                    key = code[some].astype(np.intp)
                    n += np.bincount(key, minlength=c)
                    s += np.bincount(key, weights=weight, minlength=c)
            for group, sums in zip(self.groups, total):
                shape = [self.bins[i] for i in group]
                for k, i in enumerate(group):
                    others = tuple(j for j in range(len(group)) if j != k)
                    for x, y in zip(out, sums):
                        x[at, i, : shape[k]] = y.reshape(shape).sum(axis=others)
        return out


def histogram(columns: np.ndarray, rows: np.ndarray | None, slot: np.ndarray, parts: Sequence[np.ndarray], features: np.ndarray, joint: Joint | None = None) -> list[np.ndarray]:
    """Number of ``rows`` (None: all) and whole-number sums of ``parts`` by (slot, feature of the slot, bin); ``columns``: bins by feature.
    With ``joint`` (of all features), ``parts`` is one part of all rows and ``slot`` rises."""
    slots, m = features.shape
    if joint is not None:
        return joint.sums(rows, slot, slots, parts[0])
    flat, n = columns.ravel(), columns.shape[1]
    start = np.ascontiguousarray(features.T).astype(np.int64) * n
    out = [np.zeros((slots, m, BINS), np.int64) for _ in range(len(parts) + 1)]
    # what a chunk gathers stays in the cache; sums of 2**20 rows stay below 2**53, so they are exact in doubles
    step = min(1 << 20, max(CHUNK, 4 * slots * BINS))
    for i in range(0, len(slot), step):
        here = slot[i : i + step]
        at = np.arange(i, i + len(here)) if rows is None else rows[i : i + step]
        base, weights = here * BINS, [part[i : i + step] for part in parts]
        for k in range(m):
            key = base + (columns[features[0, k]][at] if slots == 1 or m == len(columns) else flat[start[k][here] + at])
            out[0][:, k] += np.bincount(key, minlength=slots * BINS).reshape(slots, BINS)
            for x, weight in zip(out[1:], weights):
                x[:, k] += np.bincount(key, weights=weight, minlength=slots * BINS).reshape(slots, BINS).astype(np.int64)
    return out


def grow(rules: Rules, seed: int, dim: int):
    """A generator that grows one tree: yields (tree, open nodes, their features), is sent ``best_splits`` and returns the tree."""
    tree = Tree()
    open_ = tree.add(path=np.ones(1, np.uint64))
    while len(open_):
        features = choose(seed, tree.path[open_], dim, rules.features)
        found = yield tree, open_, features
        if len(tree.left) == 1:
            tree.n, tree.w, tree.s, tree.h = (found["total"][:, j].copy() for j in range(4))
        split = np.flatnonzero(found["gain"] > 1e-10)
        node, left = open_[split], found["left"][split]
        right = np.stack([tree.n[node], tree.w[node], tree.s[node], tree.h[node]], axis=1) - left
        both = np.stack([left, right], axis=1).reshape(-1, 4)
        with np.errstate(over="ignore"):
            path = mix(np.repeat(tree.path[node], 2) * np.uint64(2) + np.tile(np.arange(2, dtype=np.uint64), len(node)))
        new = tree.add(path=path, depth=np.repeat(tree.depth[node] + 1, 2), n=both[:, 0], w=both[:, 1], s=both[:, 2], h=both[:, 3])
        tree.feature[node], tree.cut[node] = features[split, found["which"][split]], found["cut"][split]
        tree.gain[node], tree.left[node], tree.right[node] = found["gain"][split], new[0::2], new[1::2]
        pure = (tree.s[new] == 0) | (tree.s[new] == tree.w[new] * UNIT)
        open_ = new[(tree.n[new] >= max(rules.min_split, 2 * rules.min_leaf)) & (tree.depth[new] < rules.max_depth) & ~pure]
    return tree


# growths ------------------------------------------------------------------------------------------------

@dataclass
class Rows:
    """Binned rows: ids, bins, label (0/1), which folds train on them (bits), and the fold that holds them out (-1: none)."""

    rid: np.ndarray
    bins: np.ndarray
    y: np.ndarray
    mask: np.ndarray
    held: np.ndarray

    def take(self, at) -> Rows:
        return Rows(self.rid[at], self.bins[at], self.y[at], self.mask[at], self.held[at])

    def __len__(self) -> int:
        return len(self.rid)


@dataclass
class Growth:
    """One ensemble to grow on the rows of one fold, and the settings that it serves."""

    fold: int
    seed: int
    rules: Rules
    size: int
    trees: list = field(default_factory=list)
    prior: float = 0.0

    def seed_of(self, t: int) -> int:
        return (self.seed * 1_000_003 + t * 7_919) & 0x7FFFFFFF

    def used(self, rows: Rows) -> np.ndarray:
        return (rows.mask >> self.fold) & 1

    def steps(self, t: int, dim: int):
        """The requests of ``grow`` for tree ``t``."""
        return grow(self.rules, self.seed_of(t), dim)


@dataclass
class Forest(Growth):
    """Bagged trees on class labels; a row's score is the mean share of class 1 in its leaves."""

    kind = "forest"

    def stats(self, rows: Rows, score: np.ndarray | None, t: int) -> list[np.ndarray]:
        w = poisson(rows.rid, self.seed_of(t)) * self.used(rows)
        return [(w > 0).astype(np.int64), w, w * rows.y * UNIT, np.zeros(len(rows), np.int64)]

    @staticmethod
    def parts(stats: Sequence[np.ndarray]) -> list[np.ndarray]:
        """Weights (at most 17 a row) and targets of sampled rows as one number: 2**20 rows stay below 2**51."""
        return [(stats[1] << 26) + stats[2] // UNIT]

    @staticmethod
    def table(n: np.ndarray, both: np.ndarray) -> np.ndarray:
        """n, w, s, h of the sums of ``parts``."""
        return np.stack([n, both >> 26, (both & ((1 << 26) - 1)) * UNIT, np.zeros_like(n)], axis=-1)

    def value(self, tree: Tree) -> np.ndarray:
        return tree.s / UNIT / np.maximum(tree.w, 1)

    @staticmethod
    def stops(tree: Tree, max_depth: int, min_split: int) -> np.ndarray:
        """Nodes where a row of a forest with these limits ends."""
        return (tree.depth >= max_depth) | (tree.n < min_split)

    @staticmethod
    def ends(tree: Tree, stop: np.ndarray) -> np.ndarray:
        """Of each node the first node in ``stop`` on the way to it, or itself."""
        end = np.arange(len(tree.left))
        for depth in range(int(tree.depth.max()) + 1):
            node = np.flatnonzero((tree.depth == depth) & (tree.left >= 0))
            held = stop[end[node]]
            for child in (tree.left[node], tree.right[node]):
                end[child] = np.where(held, end[node], child)
        return end

    def prefixes(self, rows: Rows, settings: Sequence[dict]) -> Iterator[tuple[dict, np.ndarray]]:
        """(setting, probability of class 1) for each setting: n_estimators, max_depth, min_samples_split.

        A row goes down each tree once; limits only say which node on its way counts."""
        limits = sorted({(s["max_depth"] or DEEPEST, s["min_samples_split"]) for s in settings})
        total = {x: np.zeros(len(rows)) for x in limits}
        for t, tree in enumerate(self.trees):
            value, leaf = self.value(tree), tree.advance(rows.bins, np.zeros(len(rows), np.int64))
            for x in limits:
                total[x] += value[self.ends(tree, self.stops(tree, *x))][leaf]
            for s in settings:
                if s["n_estimators"] == t + 1:
                    yield s, total[s["max_depth"] or DEEPEST, s["min_samples_split"]] / (t + 1)


@dataclass
class Boosted(Growth):
    """Trees on the residuals of a logistic score, with one Newton step a leaf."""

    rate: float = 0.1
    subsample: float = 1.0
    kind = "boosted"

    def stats(self, rows: Rows, score: np.ndarray, t: int) -> list[np.ndarray]:
        w = self.used(rows)
        if self.subsample < 1:
            w = w * (uniform(rows.rid, self.seed_of(t)) < self.subsample)
        p = 1.0 / (1.0 + np.exp(-score))
        return [w, w, w * np.rint((rows.y - p) * UNIT).astype(np.int64), w * np.rint(p * (1.0 - p) * UNIT).astype(np.int64)]

    @staticmethod
    def parts(stats: Sequence[np.ndarray]) -> list[np.ndarray]:
        return [stats[2], stats[3]]

    @staticmethod
    def table(n: np.ndarray, s: np.ndarray, h: np.ndarray | None = None) -> np.ndarray:
        return np.stack([n, n, s, np.zeros_like(n) if h is None else h], axis=-1)

    def value(self, tree: Tree) -> np.ndarray:
        return self.rate * tree.s / np.maximum(tree.h, 1)

    def prefixes(self, rows: Rows, settings: Sequence[dict]) -> Iterator[tuple[dict, np.ndarray]]:
        columns, score = np.ascontiguousarray(rows.bins.T), np.full(len(rows), self.prior)
        for t, tree in enumerate(self.trees):
            value = self.value(tree)
            for leaf, at in landed(tree, columns):
                score[at] += value[leaf]
            for s in settings:
                if s["n_estimators"] == t + 1:
                    yield s, 1.0 / (1.0 + np.exp(-score))

    def add(self, score: np.ndarray, tree: Tree, rows: Rows) -> np.ndarray:
        return score + self.value(tree)[tree.advance(rows.bins, np.zeros(len(rows), np.int64))]


def growths(kind: str, settings: Sequence[dict], folds: Sequence[int], dim: int, seed: int = 42) -> list[tuple[Growth, list[dict]]]:
    """The ensembles that serve ``settings`` in each fold, each with its settings."""
    groups: dict[tuple, list[dict]] = {}
    for s in settings:
        groups.setdefault((s["min_samples_leaf"],) if kind == "forest" else (s["learning_rate"], s["max_depth"], s["subsample"]), []).append(s)
    out = []
    for fold in folds:
        for x, served in groups.items():
            size = max(s["n_estimators"] for s in served)
            if kind == "forest":
                rules = Rules(max(1, int(dim**0.5)), max(s["max_depth"] or DEEPEST for s in served), x[0], min(s["min_samples_split"] for s in served))
                out.append((Forest(fold, seed, rules, size), served))
            else:
                out.append((Boosted(fold, seed, Rules(dim, x[1], 1), size, rate=x[0], subsample=x[2]), served))
    return out


def prior_of(ones: int, n: int) -> float:
    """Log odds of class 1, kept finite."""
    share = min(max(ones / max(n, 1), 1e-6), 1 - 1e-6)
    return float(np.log(share / (1 - share)))


class Descent:
    """Rows of one tree in a task, level by level: ``rows`` (places in ``columns``) and the node ``at`` of each."""

    def __init__(self, columns: np.ndarray, rows: np.ndarray | None):
        self.flat, self.n = columns.ravel(), columns.shape[1]
        self.rows = np.arange(self.n) if rows is None else rows
        self.at = np.zeros(len(self.rows), np.int64)

    def down(self, tree: Tree) -> None:
        """One level: rows in a split node go to a child."""
        self_, leaf = np.arange(len(tree.left)), tree.left < 0
        child = np.stack([np.where(leaf, self_, tree.left), np.where(leaf, self_, tree.right)], axis=1).ravel()
        right = self.flat[(np.maximum(tree.feature, 0).astype(np.int64) * self.n)[self.at] + self.rows] > tree.cut[self.at]
        self.at = child[2 * self.at + right]

    def keep(self, places: np.ndarray) -> None:
        self.rows, self.at = self.rows[places], self.at[places]


def _slots(tree: Tree, nodes: np.ndarray) -> np.ndarray:
    slot = np.full(len(tree.left), -1)
    slot[nodes] = np.arange(len(nodes))
    return slot


def _grow_forest_tree(growth: Growth, columns: np.ndarray, rows: Rows, t: int) -> Tree:
    stats = growth.stats(rows, None, t)
    [part], drawn = growth.parts(stats), np.flatnonzero(stats[1] > 0)
    part, way = part.astype(float), Descent(columns, drawn)
    steps = growth.steps(t, len(columns))
    request = next(steps)
    while True:
        tree, open_, features = request
        slot = _slots(tree, open_)[way.at]
        if len(tree.left) > 1:  # rows in finished nodes are done
            here = np.flatnonzero(slot >= 0)
            way.keep(here)
            slot = slot[here]
        found = best_splits(growth.table(*histogram(columns, way.rows, slot, [part[way.rows]], features)), growth.rules.min_leaf)
        try:
            request = steps.send(found)
        except StopIteration as done:
            return done.value
        way.down(request[0])


class Residuals:
    """What the rounds of a boosted growth share: codes, labels, hashes of ids; and of one round the targets and curvature of all rows and
    which rows are sampled, as ``Boosted.stats`` has them."""

    def __init__(self, growth: Boosted, columns: np.ndarray, rows: Rows):
        self.growth, self.columns, self.joint = growth, columns, Joint(columns)
        self.y, self.every = rows.y.astype(float), np.arange(len(rows))
        with np.errstate(over="ignore"):
            self.lots = mix(rows.rid.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)) if growth.subsample < 1 else None
        self.target, self.curve = np.empty(len(rows)), np.empty(len(rows))

    def set(self, score: np.ndarray, t: int) -> tuple[np.ndarray, np.ndarray]:
        """Sampled and other rows of round ``t``."""
        taken = np.empty(len(score), bool)
        most, seed = np.uint64(int(np.ceil(self.growth.subsample * (1 << 53)))), np.uint64(self.growth.seed_of(t))
        for a in range(0, len(score), CHUNK >> 1):
            some = slice(a, a + (CHUNK >> 1))
            p = 1.0 / (1.0 + np.exp(-score[some]))
            np.rint((self.y[some] - p) * UNIT, out=self.target[some])
            np.rint(p * (1.0 - p) * UNIT, out=self.curve[some])
            if self.lots is not None:
                with np.errstate(over="ignore"):
                    taken[some] = mix(self.lots[some] + seed) >> np.uint64(11) < most
        if self.lots is None:
            return self.every, self.every[:0]
        return np.flatnonzero(taken), np.flatnonzero(~taken)


def _grow_boosted_tree(growth: Growth, shared: Residuals, score: np.ndarray, t: int) -> Tree:
    """The tree; its leaves' values are added to ``score``.  Rows are kept by node.  Histograms leave out the curvature, which only leaves need."""
    lists, former, steps = {0: shared.set(score, t)}, None, growth.steps(t, len(shared.columns))

    def part(tree: Tree) -> None:
        for node in [k for k in lists if tree.left[k] >= 0]:
            column, (live, rest) = shared.columns[tree.feature[node]], lists.pop(node)
            sides = zip(parted(column, live, tree.cut[node]), parted(column, rest, tree.cut[node]))
            lists[int(tree.left[node])], lists[int(tree.right[node])] = sides

    def sums(nodes: np.ndarray, features: np.ndarray) -> np.ndarray:
        live = [lists[int(k)][0] for k in nodes]
        slot = np.repeat(np.arange(len(nodes)), [len(x) for x in live])
        at = None if live[0] is shared.every else live[0] if len(live) == 1 else np.concatenate(live)
        return growth.table(*histogram(shared.columns, at, slot, [shared.target], features[: len(nodes)], shared.joint))

    request = next(steps)
    while True:
        tree, open_, features = request
        if former is None:
            hist = sums(open_, features)
        else:  # the larger sibling: its parent less the smaller
            nodes, above = former
            place = np.flatnonzero(tree.left[nodes] >= 0)
            left = tree.left[nodes[place]].astype(np.int64)  # children are numbered in pairs, in the order of their parents
            pairs, mine = np.unique((open_ - left[0]) // 2, return_inverse=True)
            less = left[pairs] + (tree.n[left[pairs] + 1] < tree.n[left[pairs]])
            few = sums(less, features)
            hist = np.where((open_ == less[mine])[:, None, None, None], few[mine], above[place[pairs]][mine] - few[mine])
        former = open_, hist
        try:
            request = steps.send(best_splits(hist, growth.rules.min_leaf))
        except StopIteration as done:
            tree = done.value
            part(tree)
            h = np.zeros(len(tree.left), np.int64)
            for node, (live, _) in lists.items():
                h[node] = int(shared.curve[live].sum())  # whole numbers: exact below 2**53
            for depth in range(int(tree.depth.max()) - 1, -1, -1):
                node = np.flatnonzero((tree.depth == depth) & (tree.left >= 0))
                h[node] = h[tree.left[node]] + h[tree.right[node]]
            tree.h = h
            value = growth.value(tree)
            for node, both in lists.items():
                for rows in both:
                    score[rows] += value[node]
            return tree
        part(request[0])


def grow_here(growth: Growth, rows: Rows) -> Growth:
    """Run a growth on rows held in this task."""
    rows = rows.take(np.flatnonzero(growth.used(rows)))
    growth.prior = prior_of(int(rows.y.sum()), len(rows))
    columns, score = np.ascontiguousarray(rows.bins.T), np.full(len(rows), growth.prior)
    shared = Residuals(growth, columns, rows) if growth.kind == "boosted" else None
    for t in range(len(growth.trees), growth.size):
        growth.trees.append(_grow_boosted_tree(growth, shared, score, t) if shared else _grow_forest_tree(growth, columns, rows, t))
    return growth


# rows in Spark ------------------------------------------------------------------------------------------

ROWS = "rid long, bins binary, y int, mask long, held int"


def binned_rows(data: DataFrame, vector: str, cuts: Sequence[Sequence[float]]) -> DataFrame:
    """``data`` (rid, y, mask, held and an array of doubles) with the array as bytes of bins."""
    def encode(batches):
        for batch in batches:
            flat = np.asarray(batch.column(vector).values).reshape(len(batch), -1) if len(batch) else np.zeros((0, len(cuts)))
            packed = binned(flat, cuts).tobytes()
            k = len(cuts)
            yield pa.RecordBatch.from_arrays([batch.column("rid"), pa.array([packed[i : i + k] for i in range(0, len(packed), k)], pa.binary()),
                                              *(batch.column(c) for c in ("y", "mask", "held"))], names=["rid", "bins", "y", "mask", "held"])

    typed = data.select(F.col("rid").cast("long"), F.col(vector), F.col("y").cast("int"), F.col("mask").cast("long"), F.col("held").cast("int"))
    return written(typed.mapInArrow(encode, ROWS), "binned-rows")


def _rows_of(table: pa.Table | pa.RecordBatch, dim: int) -> Rows:
    table = table if isinstance(table, pa.Table) else pa.Table.from_batches([table])
    packed = [np.zeros(0, np.uint8)]
    for c in table.column("bins").chunks:
        if len(c):
            first = np.frombuffer(c.buffers()[1], np.int32)[c.offset]
            packed.append(np.frombuffer(c.buffers()[2], np.uint8)[first : first + len(c) * dim])
    return Rows(table.column("rid").to_numpy(), np.concatenate(packed).reshape(-1, dim),
                *(table.column(n).to_numpy().astype(np.int64) for n in ("y", "mask", "held")))


def _tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Batches joined into tables of about ``CHUNK`` rows."""
    some: list[pa.RecordBatch] = []
    for batch in batches:
        some.append(batch)
        if sum(len(b) for b in some) >= CHUNK:
            yield pa.Table.from_batches(some)
            some = []
    if sum(len(b) for b in some):
        yield pa.Table.from_batches(some)


def _counts(growth: Growth, rows: Rows, settings: Sequence[dict]) -> Iterator[tuple]:
    """(setting, fold, tp, fp, fn) on the rows that the fold holds out."""
    rows = rows.take(np.flatnonzero(rows.held == growth.fold))
    for s, p in growth.prefixes(rows, settings):
        said = p > 0.5
        yield json.dumps(s, sort_keys=True), growth.fold, int((said & (rows.y == 1)).sum()), int((said & (rows.y == 0)).sum()), int((~said & (rows.y == 1)).sum())


_COUNTS = "setting string, fold int, tp long, fp long, fn long"


def _batch(rows: list, names: Sequence[str], types: Sequence[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=list(names))


_COUNT_TYPES = [pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
_COUNT_NAMES = ["setting", "fold", "tp", "fp", "fn"]


def fold_counts(rows: DataFrame, plan: list[tuple[Growth, list[dict]]], dim: int, small: int = SMALL) -> DataFrame:
    """(setting, fold, tp, fp, fn) of every setting in every fold."""
    spark = rows.sparkSession
    if rows.count() <= small:
        held = spark.sparkContext.broadcast(rows.toArrow())  # at most `small` rows of `dim` bytes

        def fit(batches):
            table = _rows_of(held.value, dim)
            for batch in batches:
                yield _batch([c for i in batch.column("job").to_pylist() for c in _counts(grow_here(plan[i][0], table), table, plan[i][1])], _COUNT_NAMES, _COUNT_TYPES)

        plan = sorted(plan, key=lambda p: -p[0].size * p[0].rules.max_depth)  # the longest first, one a task
        jobs = spark.range(0, len(plan), 1, len(plan)).withColumnRenamed("id", "job")
        return written(jobs.mapInArrow(fit, _COUNTS), "fold-counts")
    grown = grow_apart(rows, [g for g, _ in plan], dim)

    def score(batches):
        for batch in _tables(batches):
            table = _rows_of(batch, dim)
            yield _batch([c for g, (_, served) in zip(grown, plan) for c in _counts(g, table, served)], _COUNT_NAMES, _COUNT_TYPES)

    return written(rows.mapInArrow(score, _COUNTS).groupBy("setting", "fold").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")]), "fold-counts")


def train(rows: DataFrame, wanted: list[Growth], dim: int, small: int = SMALL) -> list[Growth]:
    """The growths, grown; their trees are on the driver."""
    spark = rows.sparkSession
    if rows.count() > small:
        return grow_apart(rows, wanted, dim)
    held = spark.sparkContext.broadcast(rows.toArrow())  # at most `small` rows of `dim` bytes
    pieces = _pieces(wanted)

    def fit(batches):
        table = _rows_of(held.value, dim)
        for batch in batches:
            for i in batch.column("job").to_pylist():
                grown = grow_here(pieces[i][1], table)
                grown.trees = [t for t in grown.trees if t is not None]
                yield _batch([(i, pack(grown))], ["job", "model"], [pa.int64(), pa.string()])

    jobs = spark.range(0, len(pieces), 1, max(1, len(pieces))).withColumnRenamed("id", "job")
    got = {r["job"]: unpack(r["model"]) for r in jobs.mapInArrow(fit, "job long, model string").collect()}
    for i, (at, _) in enumerate(pieces):
        wanted[at].trees, wanted[at].prior = wanted[at].trees + got[i].trees, got[i].prior
    return wanted


#: Trees of a forest that one task grows: bags do not depend on each other.
BAGS = 25


def _pieces(wanted: Sequence[Growth]) -> list[tuple[int, Growth]]:
    """(growth, the part of it that one task grows), in the order of trees; trees of other parts are None."""
    out = []
    for i, g in enumerate(wanted):
        for a in range(len(g.trees), g.size, BAGS if g.kind == "forest" else max(1, g.size)):
            out.append((i, replace(g, size=min(g.size, a + BAGS), trees=[None] * a) if g.kind == "forest" else g))
    return out


# rows that stay apart -------------------------------------------------------------------------------------

def grow_apart(rows: DataFrame, wanted: list[Growth], dim: int, cells: int = CELLS, carry: int = CARRY) -> list[Growth]:
    """Run growths together, one histogram step after another, on rows that no task holds whole.

    A step takes open nodes of all growths in turn, as many as ``cells`` allows; the rest wait for the next.
    """
    spark = rows.sparkSession
    folds = sorted({g.fold for g in wanted})
    sums = rows.agg(*[F.sum(F.getbit("mask", F.lit(f))).alias(f"n{f}") for f in folds], *[F.sum(F.getbit("mask", F.lit(f)) * F.col("y")).alias(f"y{f}") for f in folds]).first()
    for g in wanted:
        g.prior = prior_of(int(sums[f"y{g.fold}"] or 0), int(sums[f"n{g.fold}"] or 0))
    boosted = [i for i, g in enumerate(wanted) if g.kind == "boosted"]
    state = rows.withColumn("scores", F.array(*[F.lit(wanted[i].prior) for i in boosted]).cast("array<double>"))
    added = dict.fromkeys(boosted, 0)  # trees already in the written scores
    asks: dict[tuple[int, int], list] = {}  # open tree: its generator, request and the splits found so far
    for i, g in enumerate(wanted):
        for t in range(len(g.trees), g.size if g.kind == "forest" else min(g.size, len(g.trees) + 1)):
            steps = g.steps(t, dim)
            asks[i, t] = [steps, next(steps), []]
            if g.kind == "forest":  # bags do not wait for each other
                g.trees.append(None)
    while asks:
        late = [i for i in boosted if len(wanted[i].trees) - added[i] >= carry]
        if late:
            state = _with_scores(state, wanted, boosted, added, dim)
            added = {i: len(wanted[i].trees) for i in boosted}
        room, work = cells, []
        for (i, t), (_, (tree, open_, features), got) in asks.items():
            done = sum(len(x["gain"]) for x in got)
            n = min(len(open_) - done, max(1, room // (features.shape[1] * BINS)))
            if room <= 0:
                break
            room -= n * features.shape[1] * BINS
            work.append((i, t, tree, open_[done : done + n], features[done : done + n]))
        for (i, t), found in _step(state, wanted, boosted, added, work, dim).items():
            steps, (tree, open_, features), got = asks[i, t]
            got.append(found)
            if sum(len(x["gain"]) for x in got) < len(open_):
                continue
            try:
                asks[i, t][1:] = steps.send({k: np.concatenate([x[k] for x in got]) for k in found}), []
            except StopIteration as done:
                del asks[i, t]
                g = wanted[i]
                if g.kind == "forest":
                    g.trees[t] = done.value
                    continue
                g.trees.append(done.value)
                if len(g.trees) < g.size:
                    steps = g.steps(t + 1, dim)
                    asks[i, t + 1] = [steps, next(steps), []]
    return wanted


def _scores(batch, rows: Rows, wanted, boosted, added) -> dict[int, np.ndarray]:
    kept = np.concatenate([np.asarray(c.flatten()) for c in batch.column("scores").chunks]).reshape(len(rows), -1) if boosted and len(rows) else np.zeros((len(rows), len(boosted)))
    out = {}
    for j, i in enumerate(boosted):
        score = kept[:, j].copy()
        for tree in wanted[i].trees[added[i]:]:
            score = wanted[i].add(score, tree, rows)
        out[i] = score
    return out


def _lean(wanted, added) -> list[Growth]:
    """The growths as tasks need them: of boosted ones the trees not yet in the written scores, of forests their number only."""
    out = []
    for i, g in enumerate(wanted):
        new = type(g)(**{k: v for k, v in g.__dict__.items() if k != "trees"})
        new.trees = [t if i in added and at >= added[i] else None for at, t in enumerate(g.trees)]
        out.append(new)
    return out


def _with_scores(state: DataFrame, wanted, boosted, added, dim: int) -> DataFrame:
    models = state.sparkSession.sparkContext.broadcast(_lean(wanted, added))

    def update(batches):
        for batch in batches:
            rows = _rows_of(batch, dim)
            scores = _scores(pa.Table.from_batches([batch]), rows, models.value, boosted, added)
            flat = np.stack([scores[i] for i in boosted], axis=1).ravel() if len(rows) else np.zeros(0)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * len(boosted)), pa.array(flat, pa.float64()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("rid", "bins", "y", "mask", "held")), lists], names=["rid", "bins", "y", "mask", "held", "scores"])

    return written(state.mapInArrow(update, ROWS + ", scores array<double>"), "boosted-scores")


#: Nodes of one histogram row between tasks.
GROUP = 64


def _step(state: DataFrame, wanted, boosted, added, work: list, dim: int) -> dict[int, dict]:
    """Best splits of the open nodes in ``work``: histograms by task, summed and split by group of nodes."""
    sent = state.sparkSession.sparkContext.broadcast((_lean(wanted, added), work))

    def partial(batches):
        models, todo = sent.value
        sums: dict[tuple, list] = {}
        for batch in _tables(batches):
            rows = _rows_of(batch, dim)
            scores, columns = _scores(batch, rows, models, [i for i in boosted], added), np.ascontiguousarray(rows.bins.T)
            for i, t, tree, open_, features in todo:
                stats = models[i].stats(rows, scores.get(i), t)
                live = np.flatnonzero(stats[1] > 0)
                way = Descent(columns, live)
                for _ in range(int(tree.depth.max())):
                    way.down(tree)
                slot = _slots(tree, open_)[way.at]
                here = np.flatnonzero(slot >= 0)
                hist = histogram(columns, way.rows[here], slot[here], [x[live[here]].astype(float) for x in models[i].parts(stats)], features)
                for k in range(0, len(open_), GROUP):
                    some = [x[k : k + GROUP] for x in hist]
                    sums[i, t, k] = [x + y for x, y in zip(sums[i, t, k], some)] if (i, t, k) in sums else some
        yield _batch([(i, t, k, np.stack(h).tobytes()) for (i, t, k), h in sums.items()], ["model", "tree", "first", "hist"],
                     [pa.int64(), pa.int64(), pa.int64(), pa.binary()])

    shapes = {i: features.shape[1] for i, _, _, _, features in work}
    leaf = {i: wanted[i].rules.min_leaf for i in shapes}
    tables = {i: (type(wanted[i]).table, 3 if i in boosted else 2) for i in shapes}

    def join(table: pa.Table) -> pa.Table:
        i, t, k = (table.column(c)[0].as_py() for c in ("model", "tree", "first"))
        make, n = tables[i]
        total = sum(np.frombuffer(x, np.int64) for x in table.column("hist").to_pylist()).reshape(n, -1, shapes[i], BINS)
        found = best_splits(make(*total), leaf[i])
        out = io.BytesIO()
        np.savez(out, **found)
        return pa.table({**{c: table.column(c)[:1] for c in ("model", "tree", "first")}, "found": pa.array([out.getvalue()], pa.binary())})

    keys = "model long, tree long, first long"
    parts = state.mapInArrow(partial, keys + ", hist binary").groupBy("model", "tree", "first").applyInArrow(join, keys + ", found binary").collect()
    by: dict[tuple, list] = {}
    for r in sorted(parts, key=lambda r: (r["model"], r["tree"], r["first"])):
        by.setdefault((r["model"], r["tree"]), []).append(dict(np.load(io.BytesIO(bytes(r["found"])))))
    return {i: {k: np.concatenate([x[k] for x in xs]) for k in xs[0]} for i, xs in by.items()}


# fitted models --------------------------------------------------------------------------------------------

def pack(growth: Growth) -> str:
    """A grown ensemble as text."""
    out = io.BytesIO()
    sizes = np.array([len(t.left) for t in growth.trees])
    np.savez_compressed(out, sizes=sizes, **{k: np.concatenate([getattr(t, k) for t in growth.trees]) for k in _PARTS})
    head = {k: v for k, v in growth.__dict__.items() if k not in ("trees", "rules")} | {"kind": growth.kind, "rules": growth.rules.__dict__}
    return json.dumps(head) + "\n" + base64.b64encode(out.getvalue()).decode()


def unpack(text: str) -> Growth:
    head, body = text.split("\n", 1)
    head, parts = json.loads(head), dict(np.load(io.BytesIO(base64.b64decode(body))))
    growth = {"forest": Forest, "boosted": Boosted}[head.pop("kind")](**head | {"rules": Rules(**head["rules"])})
    ends = np.cumsum(parts.pop("sizes"))
    growth.trees = [Tree({k: v[a:b] for k, v in parts.items()}) for a, b in zip(np.r_[0, ends[:-1]], ends)]
    return growth


class TreeEnsembleModel(Model, DefaultParamsReadable, DefaultParamsWritable):
    """A grown ensemble as a pipeline stage: features (vector) -> probability, prediction."""

    ensemble = Param(Params._dummy(), "ensemble", "the packed trees", TypeConverters.toString)
    setting = Param(Params._dummy(), "setting", "the setting as JSON", TypeConverters.toString)
    cuts = Param(Params._dummy(), "cuts", "cut points of each feature as JSON", TypeConverters.toString)

    @keyword_only
    def __init__(self, *, ensemble: str | None = None, setting: str | None = None, cuts: str | None = None):
        super().__init__()
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def grown(self) -> Growth:
        return unpack(self.getOrDefault(self.ensemble))

    @property
    def featureImportances(self):
        """Share of each feature in the decrease of impurity, mean over trees."""
        from pyspark.ml.linalg import Vectors

        dim, total = len(json.loads(self.getOrDefault(self.cuts))), 0.0
        for t in self.grown().trees:
            split = t.left >= 0
            gains = np.bincount(t.feature[split], weights=t.gain[split], minlength=dim)
            total = total + gains / max(gains.sum(), 1e-300)
        return Vectors.dense(total / max(np.sum(total), 1e-300))

    def _transform(self, dataset: DataFrame) -> DataFrame:
        from pyspark.ml.functions import array_to_vector, vector_to_array
        from pyspark.sql.functions import pandas_udf

        sent = dataset.sparkSession.sparkContext.broadcast((self.grown(), json.loads(self.getOrDefault(self.setting)), json.loads(self.getOrDefault(self.cuts))))

        @pandas_udf("double")
        def probability(values: pd.Series) -> pd.Series:
            growth, setting, cuts = sent.value
            if not len(values):
                return pd.Series([], dtype=float)
            bins, none = binned(np.stack(values.to_numpy()), cuts), np.zeros(len(values), np.int64)
            *_, (_, p) = growth.prefixes(Rows(none, bins, none, none, none), [setting])
            return pd.Series(p)

        p = probability(vector_to_array(F.col("features")))
        return (dataset.withColumn("_p1", p).withColumn("probability", array_to_vector(F.array(1.0 - F.col("_p1"), F.col("_p1"))))
                .withColumn("prediction", (F.col("_p1") > 0.5).cast("double")).drop("_p1"))
