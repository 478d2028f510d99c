"""Thinned curves, rank index, co-moments, row fingerprints and names carried across refits, against plain forms."""

import itertools
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from retainer.operators import evaluate as EV
from retainer.operators import rankindex as RI
from retainer.operators import segments as SG
from retainer.operators.comoments import CoMoments, correlations
from retainer.operators.describe import profile


def _area(x, y):
    return float((np.diff(x) * (np.array(y)[1:] + np.array(y)[:-1])).sum() / 2)


def _curve(p, y):
    order = sorted(set(p), reverse=True)
    pos = np.array([0] + [sum(b for a, b in zip(p, y) if a >= t) for t in order])
    neg = np.array([0] + [sum(1 - b for a, b in zip(p, y) if a >= t) for t in order])
    return [None, *order], neg, pos


@pytest.mark.parametrize("rule", ["collinear", "equal_steps"])
def test_thinned_curve_keeps_its_area(spark, rule):
    rng = np.random.default_rng(4)
    p = [round(float(x), 3) for x in rng.random(1200)]
    y = [int(a > 0.9 or (a > 0.2 and rng.random() < a)) for a in p]       # straight at both ends
    df = spark.createDataFrame(list(zip(p, y)), "p double, label int").repartition(7)
    rows = sorted(EV.roc_points(df, rule=rule).collect(), key=lambda r: (r.cum_neg + r.cum_pos))
    t, neg, pos = _curve(p, y)
    full = list(zip(neg, pos))
    keep = []
    for i in range(len(full)):
        if i in (0, len(full) - 1):
            keep.append(i)
            continue
        a, b = np.subtract(full[i], full[i - 1]), np.subtract(full[i + 1], full[i])
        straight = a[0] * b[1] == a[1] * b[0] if rule == "collinear" else (a == b).all() and i > 1
        if not straight:
            keep.append(i)
    assert [(r.threshold, r.cum_neg, r.cum_pos) for r in rows] == [(t[i], *full[i]) for i in keep]
    assert rows[0].n_scores == len(t) - 1 and len(rows) < len(t) - 20
    assert abs(_area([r.fpr for r in rows], [r.tpr for r in rows]) - _area(neg / neg[-1], pos / pos[-1])) < 1e-12
    sketch = sorted(EV.roc_sketch(df, bins=50).collect(), key=lambda r: -r.threshold)
    off = abs(_area([0, *[r.fpr for r in sketch]], [0, *[r.tpr for r in sketch]]) - _area(neg / neg[-1], pos / pos[-1]))
    assert len(sketch) <= 50 and off <= sketch[0].area_error < 0.05


def test_curves_of_one_class_and_of_no_rows(spark):
    one = spark.createDataFrame([(0.5, 1), (0.4, 1), (None, 0)], "p double, label int")
    assert [(r.fpr, r.tpr) for r in EV.roc_points(one).orderBy("cum_pos").collect()] == [(None, 0.0), (None, 1.0)]
    none = one.where("false")
    assert EV.roc_points(none).count() == 1 and EV.roc_sketch(none).count() == 0
    with pytest.raises(ValueError):
        EV.roc_points(one, rule="other")


def _results(spark, n=950):
    rng = np.random.default_rng(6)
    rows = [(f"C{i:04d}", float(round(rng.random(), 2)) if i % 50 else None, ["Low", "High"][i % 2], "ABC"[i % 7 % 3]) for i in range(n)]
    return spark.createDataFrame(rows, "CustomerId string, ChurnProbability double, RiskLevel string, Segment string"), rows


def test_rank_index_pages(spark, tmp):
    df, rows = _results(spark)
    RI.write_ranked(df, f"{tmp}/index", rows=100)
    ranked = sorted(rows, key=lambda r: (r[1] is None, -(r[1] or 0), r[0]))
    for page, per, risk, segment in [(1, 5, None, None), (23, 10, None, None), (4, 25, "High", None), (9, 7, "Low", "B"), (10_000, 10, None, None)]:
        kept = [r for r in ranked if risk in (None, r[2]) and segment in (None, r[3])]
        want = [(i + 1, *kept[i]) for i in range((page - 1) * per, min(page * per, len(kept)))]
        got = RI.read_page(spark, f"{tmp}/index", page, per, risk, segment).collect()
        assert sorted((r.rank, r.CustomerId, r.ChurnProbability, r.RiskLevel, r.Segment) for r in got) == want
        assert all(r.total_pages == -(-len(kept) // per) for r in got)
    blocks, before, total = RI.page_blocks(spark, f"{tmp}/index", 88, 10)
    assert (blocks, before, total) == ([8], 800, 950)                 # a deep page opens one block
    plan = RI.read_page(spark, f"{tmp}/index", 88, 10)._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^]]*block#\d+L? = 8\)", plan)
    got = sorted(r.CustomerId for r in RI.read_range(spark, f"{tmp}/index", 0.3, 0.35, risk="High").collect())
    assert got == sorted(r[0] for r in rows if r[1] is not None and 0.3 <= r[1] <= 0.35 and r[2] == "High")


def test_rank_index_of_no_rows(spark, tmp):
    df, _ = _results(spark)
    RI.write_ranked(df.where("false"), f"{tmp}/index")
    assert RI.read_page(spark, f"{tmp}/index").count() == 0 and RI.read_range(spark, f"{tmp}/index", 0, 1).count() == 0


def test_correlations_of_many_columns(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(0, 1, (500, 60))
    x[:, 1] = 1e9 + x[:, 0] * 1e-3 + x[:, 1] * 1e-3        # a large mean and a tiny spread
    x[:, 2] = 0.1                                        # constant
    x[rng.random(500) < 0.2, 3] = np.nan
    cols = [f"c{i}" for i in range(60)]
    df = spark.createDataFrame([tuple(None if np.isnan(v) else float(v) for v in r) for r in x], ", ".join(f"{c} double" for c in cols)).repartition(9)
    got = {(r.i, r.j): r.r for r in correlations(df, cols).collect()}
    assert len(got) == 60 * 59 // 2
    for (i, j), r in got.items():
        both = ~np.isnan(x[:, i]) & ~np.isnan(x[:, j])
        if 2 in (i, j):
            assert r is None
        else:
            a, b = x[both, i] - x[both, i][0], x[both, j] - x[both, j][0]
            assert abs(r - np.corrcoef(a, b)[0, 1]) < 1e-9
    assert {r.r for r in correlations(df.where("false"), cols[:3]).collect()} == {None}
    parts = [CoMoments.of(x[a : a + 100]) for a in range(0, 500, 100)]
    whole, merged = CoMoments.of(x), parts[0]
    for part in parts[1:]:
        merged = merged.merge(part)
    assert np.allclose(whole.n, merged.n) and np.allclose(whole.c, merged.c) and np.allclose(whole.m2, merged.m2)


def test_row_fingerprints_count_duplicates(spark):
    rows = [(1, None, "a"), (None, 1, "a"), (1, None, "a"), (None, None, None), (None, None, None), (2, 0, ""), (2, 0, None)]
    got = profile(spark.createDataFrame(rows * 40 + [(9, 9, "z")], "x int, y int, s string").repartition(5)).first()
    assert tuple(got) == (281, 3, 40 * 10, 281 - 6)
    assert profile(spark.createDataFrame([], "x int, y int")).first()["duplicate_rows"] == 0


def test_least_assignment_is_the_cheapest():
    rng = np.random.default_rng(3)
    for rows, cols in [(1, 1), (3, 3), (4, 6), (5, 5), (6, 7)]:
        for _ in range(20):
            cost = rng.integers(0, 9, (rows, cols)).astype(float)
            got = SG.assign_least(cost.tolist())
            best = min(sum(cost[i, j] for i, j in enumerate(p)) for p in itertools.permutations(range(cols), rows))
            assert len(set(got)) == rows and sum(cost[i, j] for i, j in enumerate(got)) == best


def test_names_survive_another_order_and_other_numbers_of_clusters(spark):
    former = spark.createDataFrame([(0, 10.0, 0.0, "young"), (1, 50.0, 5.0, "rich"), (2, 90.0, 0.0, "old")],
                                   "CustomerSegment int, avg_a double, avg_b double, SegmentName string")

    def named(rows):
        new = spark.createDataFrame(rows, "CustomerSegment int, avg_a double, avg_b double")
        return {r.CustomerSegment: r.SegmentName for r in SG.carry_names(new, former, [20.0, 1.0], ["a", "b"]).collect()}

    assert named([(0, 88.0, 0.1), (1, 12.0, 0.2), (2, 55.0, 4.0)]) == {0: "old", 1: "young", 2: "rich"}
    assert named([(0, 55.0, 4.0), (1, 88.0, 0.1)]) == {0: "rich", 1: "old"}
    assert named([(0, 88.0, 0.1), (1, 12.0, 0.2), (2, 55.0, 4.0), (3, 30.0, 2.0)]) == {0: "old", 1: "young", 2: "rich", 3: "Segment 3"}
