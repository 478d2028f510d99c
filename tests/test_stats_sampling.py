"""Order statistics, split/folds and SMOTE against brute force."""

import numpy as np
from pyspark.sql import functions as F

from retainer import schema as S
from retainer.operators import features as FE
from retainer.operators import sampling as SM
from retainer.operators.stats import exact_quantiles, row_positions, running_totals
from retainer.sources import tables as TB

from conftest import SF_SMALL


def _skewed(spark, n=3000, seed=7):
    rng = np.random.default_rng(seed)
    # one key holds a third of the rows, and many repeated values
    keys = np.where(rng.random(n) < 0.34, "hot", rng.choice(["a", "b", "c", "d"], n))
    vals = np.round(rng.normal(0, 10, n), 1)
    rows = [(i, str(k), float(v)) for i, (k, v) in enumerate(zip(keys, vals))]
    return spark.createDataFrame(rows, "id long, k string, v double"), rows


def test_exact_quantiles(spark):
    df, rows = _skewed(spark)
    got = {r.k: r for r in exact_quantiles(df, ["k"], ["v"], [0.1, 0.5, 0.9]).collect()}
    for k in {r[1] for r in rows}:
        vals = np.array([r[2] for r in rows if r[1] == k])
        for i, p in enumerate([0.1, 0.5, 0.9]):
            assert abs(got[k][f"q{i}"] - np.quantile(vals, p)) < 1e-9


def test_running_totals_and_positions(spark):
    df, rows = _skewed(spark)
    out = running_totals(df, ["k"], ["v", "id"], ["v"], partitions=6).collect()
    by = {r.id: r.cum_v for r in out}
    for k in {r[1] for r in rows}:
        grp = sorted((r for r in rows if r[1] == k), key=lambda r: (r[2], r[0]))
        acc = 0.0
        for r in grp:
            acc += r[2]
            assert abs(by[r[0]] - acc) < 1e-6
    pos = row_positions(df, ["v", "id"], partitions=7).select("id", "_pos").collect()
    assert sorted(r._pos for r in pos) == list(range(len(rows)))
    order = [r[0] for r in sorted(rows, key=lambda r: (r[2], r[0]))]
    assert [r.id for r in sorted(pos, key=lambda r: r._pos)] == order


def test_split_and_folds_are_stratified(spark):
    s = SM.stratified_split(TB.churn_customers(spark, SF_SMALL))
    counts = {(r.Exited, r.split): r["count"] for r in s.groupBy("Exited", "split").count().collect()}
    for y in (0, 1):
        n = counts[(y, "train")] + counts[(y, "test")]
        assert abs(counts[(y, "test")] - 0.2 * n) <= 1
    f = SM.stratified_folds(s.where("split = 'train'"))
    sizes = {(r.Exited, r.fold): r["count"] for r in f.groupBy("Exited", "fold").count().collect()}
    for y in (0, 1):
        vals = [sizes.get((y, k), 0) for k in range(5)]
        assert max(vals) - min(vals) <= 1


def _points(spark, seed=3):
    rng = np.random.default_rng(seed)
    pts = rng.normal(0, 1, (120, 4))
    pts[:30] = pts[0]                      # a hot spot of 30 identical points
    pts[30:60] = rng.normal(5, 0.01, (30, 4))   # a dense cluster
    return pts


def test_knn_matches_brute_force(spark):
    pts = _points(spark)
    uniq, counts = np.unique(pts, axis=0, return_counts=True)
    rows = [(i, [float(x) for x in v], int(c)) for i, (v, c) in enumerate(zip(uniq, counts))]
    df = spark.createDataFrame(rows, "_id long, _v array<double>, _m long")
    k = 5
    got = {}
    for r in SM.knn_within(df, k, 4).collect():
        got.setdefault(r._id, []).append((r.nbr_rank, r.dist))
    for i, (v, c) in enumerate(zip(uniq, counts)):
        if c - 1 >= k:
            continue                        # all neighbours are copies
        d = []
        for j, (w, cj) in enumerate(zip(uniq, counts)):
            n = cj - 1 if j == i else cj
            d += [float(np.sqrt(((v - w) ** 2).sum()))] * n
        want = sorted(d)[:k]
        have = [dist for _, dist in sorted(got[i])]
        assert np.allclose(have, want), (i, have, want)


def test_smote_counts_and_segments(spark):
    feats = FE.training_features(TB.churn_customers(spark, SF_SMALL))
    train = SM.stratified_split(feats).where("split = 'train'").drop("split")
    out = SM.smote(train, S.FEATURES, "Exited", k=5)
    counts = {r.Exited: r["count"] for r in out.groupBy("Exited").count().collect()}
    assert counts[0] == counts[1]
    base = train.toPandas()
    minority = 1 if (base.Exited == 1).sum() < (base.Exited == 0).sum() else 0
    X = base[base.Exited == minority][S.FEATURES].to_numpy(dtype=float)
    new = out.where("synthetic = 1").toPandas()[S.FEATURES].to_numpy(dtype=float)
    assert len(new) == counts[0] - len(X)
    D = np.sqrt(((X[:, None, :] - X[None, :, :]) ** 2).sum(-1))
    np.fill_diagonal(D, np.inf)
    kth = np.sort(D, axis=1)[:, 4]
    int_cols = [i for i, f in enumerate(S.FEATURES) if f not in
                ("Balance", "EstimatedSalary", "Balance_to_Salary_Ratio", "Credit_to_Salary_Ratio",
                 "Age_to_Tenure_Ratio", "Products_per_Tenure")]
    flt = [i for i in range(len(S.FEATURES)) if i not in int_cols]
    for z in new[:60]:
        ok = False
        for a in range(len(X)):
            for b in np.where(D[a] <= kth[a] + 1e-9)[0]:
                d = X[b, flt] - X[a, flt]
                t = z[flt] - X[a, flt]
                nz = np.abs(d) > 1e-12
                if not np.allclose(t[~nz], 0, atol=1e-6):
                    continue
                u = t[nz] / d[nz] if nz.any() else np.array([0.0])
                if np.all(u > -1e-6) and np.all(u < 1 + 1e-6) and np.ptp(u) < 1e-6:
                    ok = True
                    break
            if ok:
                break
        assert ok


def _many(spark, path, n=300_000):
    """Many rows in several files, with a column that is no key, a hot value and a null group."""
    (spark.range(0, n, 1, 4).select("id", F.xxhash64("id").alias("k"), F.when(F.col("id") % 50 > 0, F.col("id") % 50).alias("g"),
                                    F.when(F.col("id") % 3 == 0, 7.0).otherwise(F.rand(1) * 100).alias("v"), F.lit("x" * 20).alias("junk"))
     .write.parquet(path))
    return spark.read.parquet(path)


def test_positions_do_not_depend_on_the_partitions(spark, tmp):
    df = _many(spark, f"{tmp}/rows")
    for n in (4, 16, 200):
        for _ in range(2):
            r = row_positions(df, ["k"], partitions=n).agg(F.count("*"), F.countDistinct("_pos"), F.min("_pos"), F.max("_pos")).first()
            assert tuple(r) == (300_000, 300_000, 0, 299_999)
    one = running_totals(df.withColumn("one", F.lit(1)), ["g"], ["k"], ["one"], partitions=16)
    assert one.count() == 300_000
    assert one.groupBy("g").agg(F.max("cum_one").alias("m"), F.countDistinct("cum_one").alias("d")).filter("m <> 6000 or d <> 6000").count() == 0


def test_quantiles_of_many_rows(spark, tmp):
    df = _many(spark, f"{tmp}/rows")
    want = df.agg(*[F.expr(f"percentile(v, {p})") for p in (0.0, 0.25, 0.5, 0.99, 1.0)]).first()
    got = exact_quantiles(df, [], ["v", "k"], [0.0, 0.25, 0.5, 0.99, 1.0]).where("column = 'v'").first()
    assert np.allclose([got[f"q{i}"] for i in range(5)], want, rtol=0, atol=1e-9)
    by = {r.g: r.m for r in df.groupBy("g").agg(F.expr("percentile(v, 0.8)").alias("m")).collect()}
    assert all(abs(r.q0 - by[r.g]) < 1e-9 for r in exact_quantiles(df, ["g"], ["v"], [0.8]).collect()) and len(by) == 50


def test_auc_of_a_continuous_score(spark):
    from retainer.operators import evaluate as EV

    rng = np.random.default_rng(0)
    p = rng.random(4000)
    y = (rng.random(4000) < p).astype(int)
    df = spark.createDataFrame([(float(a), int(b)) for a, b in zip(p, y)], "p double, label int").repartition(5)
    order = np.argsort(p)
    rank = np.empty(4000)
    rank[order] = np.arange(1, 4001)
    want = (rank[y == 1].sum() - y.sum() * (y.sum() + 1) / 2) / (y.sum() * (4000 - y.sum()))
    assert abs(EV.roc_auc(df).first()[0] - want) < 1e-6


def test_knn_with_many_features_and_an_outlier(spark):
    rng = np.random.default_rng(8)
    pts = rng.normal(0, 1, (80, 20))
    pts[0] = 5000.0
    pts[1:4] = pts[4]
    df = spark.createDataFrame([(i, [float(x) for x in v], 1) for i, v in enumerate(pts)], "_id long, _v array<double>, _m long")
    got = {}
    for r in SM.knn_within(df, 5, 20).collect():
        got.setdefault(r._id, []).append((r.nbr_rank, r.dist))
    d = np.sqrt(((pts[:, None] - pts[None]) ** 2).sum(-1))
    np.fill_diagonal(d, np.inf)
    for i in range(80):
        assert np.allclose([x for _, x in sorted(got[i])], np.sort(d[i])[:5])


def test_smote_does_not_depend_on_the_partitions(spark):
    rng = np.random.default_rng(9)
    rows = [(i, int(i < 40), *[float(x) for x in np.round(rng.normal(0, 1, 3), 3)]) for i in range(200)]
    df = spark.createDataFrame(rows, "CustomerId long, Exited int, a double, b double, c double")
    kept = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        made = []
        for n in (4, 16):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            new = SM.smote(df.repartition(n), ["a", "b", "c"]).where("synthetic = 1").select("a", "b", "c").collect()
            made.append(sorted(tuple(r) for r in new))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", kept)
    assert len(made[0]) == 120 and made[0] == made[1]


def _slab(n, seed=12):
    """20 columns: flags that carry most of the spread, and two narrow columns in which the points differ."""
    rng = np.random.default_rng(seed)
    pts = np.zeros((n, 20))
    pts[:, :3] = rng.integers(0, 2, (n, 3)) * 10.0
    pts[:, 3:5] = rng.random((n, 2))
    pts[: n // 3, 3:5] *= 0.001                 # a third of the points in one corner
    return pts


def _frame(spark, pts):
    return spark.createDataFrame([(i, [float(x) for x in v], 1) for i, v in enumerate(pts)], "_id long, _v array<double>, _m long")


def test_knn_in_split_cells(spark):
    pts = _slab(1500)
    pts[700:703] = pts[699] * 1e6              # far points, some alike
    got = {}
    for r in SM.knn_within(_frame(spark, pts), 4, cell=20, fan=6).collect():
        got.setdefault(r._id, []).append((r.nbr_rank, r.dist))
    d = np.sqrt(((pts[:, None] - pts[None]) ** 2).sum(-1))
    np.fill_diagonal(d, np.inf)
    want = np.sort(d, axis=1)[:, :4]
    assert all(np.allclose([x for _, x in sorted(got[i])], want[i]) for i in range(1500))


def test_knn_of_few_and_no_points(spark):
    assert SM.knn_within(_frame(spark, []), 3).count() == 0
    assert SM.knn_within(_frame(spark, [[1.0, 2.0]]), 3).count() == 0
    alike = _frame(spark, [[1.0]] * 100)        # cells that no pivot can split
    assert [r[0] for r in SM.knn_within(alike, 3).groupBy("_id").count().select("count").distinct().collect()] == [3]


def test_knn_compares_a_bounded_number_of_points_each(spark):
    from retainer.operators.neighbours import candidate_pairs

    few, many = (candidate_pairs(_frame(spark, _slab(n)), 5) / n for n in (1500, 6000))
    print(f"candidates a point: {few:.0f} of 1,500 points, {many:.0f} of 6,000")
    assert many < 1.5 * few and many < 600


def test_points_of_a_cell_are_compared_in_blocks(spark, monkeypatch):
    """A cell that many points search is dealt to several groups; no distance is an expression on single pairs."""
    import numpy as np

    from retainer.operators import neighbours as NB

    monkeypatch.setattr(NB, "SEARCHED", 7)
    x = np.round(np.random.default_rng(5).random((90, 3)) * 9, 1)
    x = np.unique(x, axis=0)
    found = NB.knn_within(_frame(spark, x.tolist()), 4, cell=20, fan=4)
    assert "zip_with" not in found._jdf.queryExecution().toString()
    got = {(r["_id"], r["nbr_rank"]): r["dist"] for r in found.collect()}
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    np.fill_diagonal(d, np.inf)
    near = np.sort(d, axis=1)[:, :4]
    assert len(got) == near.size and all(abs(got[i, j + 1] - near[i, j]) < 1e-12 for i in range(len(x)) for j in range(4))
