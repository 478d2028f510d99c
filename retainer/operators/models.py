"""Classifiers, grid search, scoring, importances,
ensembles.

Models are Spark ML stages over one assembled vector column; searches
over many settings share their passes over the rows (``logistic``, ``ensembles``).
Grid search uses a fold column produced by ``sampling.stratified_folds`` so folds
are stratified and reproducible.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from retainer import schema as S
from retainer.functions import columns as C

R6 = C.bround6


# D1 --------------------------------------------------------------------------------------------------

def assemble(df: DataFrame, features: Sequence[str] = S.FEATURES, label: str = "Exited",
             out: str = "features") -> DataFrame:
    """Feature vector + ``label`` double column (other columns kept)."""
    from pyspark.ml.feature import VectorAssembler

    va = VectorAssembler(inputCols=list(features), outputCol=out, handleInvalid="error")
    x = va.transform(df)
    return x.withColumn("label", F.col(label).cast("double")) if label in df.columns else x


# D6 / D7 / D8 grids -------------------------------------------------------------------------------------

def _grid(**lists) -> list[dict]:
    from itertools import product

    return [dict(zip(lists, values)) for values in product(*lists.values())]


#: The published search (solvers share an optimum, so they are no setting here).
PUBLISHED = {
    "logistic": _grid(C=[0.1, 1.0, 10.0, 100.0], penalty=["l1", "l2"]),
    "forest": _grid(n_estimators=[50, 100, 200], max_depth=[10, 20, None], min_samples_split=[2, 5, 10], min_samples_leaf=[1, 2, 4]),
    "boosting": _grid(n_estimators=[50, 100, 200], learning_rate=[0.01, 0.1, 0.2], max_depth=[3, 5, 7], subsample=[0.8, 0.9, 1.0]),
}


# D9 ---------------------------------------------------------------------------------------------------------

def training_rows(data: DataFrame, n_folds: int, prepare=None) -> DataFrame:
    """(rid, x, y, mask, held) of ``data`` (features, label, fold), written once.  Bit i of ``mask``: the row trains the model of
    fold i (bit ``n_folds``: the final model).  ``prepare`` (e.g. oversampling) is applied once to the rows of each fold, whatever the settings."""
    from pyspark.ml.functions import vector_to_array

    from retainer.session import written

    whole, plain = 1 << n_folds, data.select("features", "label", "fold")
    if prepare is None:
        rows = plain.select("features", "label", (F.lit(2 * whole - 1).cast("long") - F.expr(f"shiftleft(1L, fold)")).alias("mask"), F.col("fold").alias("held"))
    else:
        rows = plain.select("features", "label", F.lit(0).cast("long").alias("mask"), F.col("fold").alias("held"))
        for i in range(n_folds + 1):
            part = prepare(data.where(F.col("fold") != i) if i < n_folds else data)
            rows = rows.unionByName(part.select("features", "label", F.lit(1 << i).cast("long").alias("mask"), F.lit(-1).alias("held")))
    return written(rows.select(F.monotonically_increasing_id().alias("rid"), vector_to_array("features").alias("x"), F.col("label").cast("int").alias("y"),
                               "mask", F.col("held").cast("int").alias("held")), "training-matrix")


def held_out_scores(models: Sequence, data: DataFrame) -> DataFrame:
    """(fold, label, p, pred): every row scored by the model that did not see it."""
    parts = [score(m, data.where(F.col("fold") == i)).select("fold", "label", F.col("ChurnProbability").alias("p"), "pred")
             for i, m in enumerate(models)]
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out


def tuning_scores(counts: DataFrame, n_folds: int) -> dict[str, float]:
    """Mean class-1 F1 over the folds of each setting (0 where undefined); one row a setting reaches the driver."""
    f1 = F.coalesce(F.try_divide(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")), F.lit(0.0))
    table = counts.groupBy("setting").agg((F.sum(f1) / n_folds).alias("score"))
    return {r["setting"]: r["score"] for r in table.collect()}


def grid_search(name: str, settings: Sequence[dict], rows: DataFrame, n_folds: int = 5, seed: int = 42, cuts=None, small: int | None = None) -> dict:
    """Search ``settings`` of a model family by mean class-1 F1 over the folds of ``rows`` (``training_rows``); the first of
    equal settings wins.  Logistic settings share every pass, trees their growth (``logistic``, ``ensembles``).  Returns
    params, tuning_score, seconds, the fold models of the best setting and the model of all rows."""
    import json
    import time

    from retainer.operators import ensembles as EN
    from retainer.operators import logistic as LG

    t0, spark, folds = time.time(), rows.sparkSession, range(n_folds)
    every = range(n_folds + 1)  # the last one is trained on all rows
    if name == "logistic":
        fitted = LG.fit_all(rows, [(f, s) for s in settings for f in every])
        scores = tuning_scores(LG.fold_counts(rows, [f for f in fitted if f.fold < n_folds]), n_folds)
    else:
        kind, small = {"forest": "forest", "boosting": "boosted"}[name], EN.SMALL if small is None else small
        dim = len(rows.first()["x"])
        cuts = EN.fit_cuts(rows, "x", dim) if cuts is None else cuts
        table = EN.binned_rows(rows, "x", cuts)
        scores = tuning_scores(EN.fold_counts(table, EN.growths(kind, settings, folds, dim, seed), dim, small), n_folds)
    best = max(settings, key=lambda s: scores[json.dumps(s, sort_keys=True)])
    if name == "logistic":
        made = [LG.stage(spark, f) for f in sorted((f for f in fitted if f.setting == best), key=lambda f: f.fold)]
    else:
        grown = EN.train(table, [g for g, _ in EN.growths(kind, [best], every, dim, seed)], dim, small)
        made = [EN.TreeEnsembleModel(ensemble=EN.pack(g), setting=json.dumps(best), cuts=json.dumps(cuts)) for g in grown]
    return {"params": best, "tuning_score": scores[json.dumps(best, sort_keys=True)], "scores": scores, "folds": made[:n_folds], "model": made[n_folds],
            "seconds": time.time() - t0}


# D10 ----------------------------------------------------------------------------------------------------------

def score(model, df: DataFrame, features_col: str = "features") -> DataFrame:
    """Adds ChurnProbability = P(class 1) and the predicted class (p > 0.5)."""
    from pyspark.ml.functions import vector_to_array

    out = model.transform(df)
    p = vector_to_array(F.col("probability"))[1]
    return out.withColumn("ChurnProbability", p).withColumn("pred", F.col("prediction").cast("int"))


# D19 / D20 -----------------------------------------------------------------------------------------------------

def feature_importance(spark, model, features: Sequence[str] = S.FEATURES) -> DataFrame:
    """Tree importances, else |coefficients|, else 0; sorted descending.
    The vector has one entry per feature, so the table is bounded by the
    feature count."""
    if hasattr(model, "featureImportances"):
        vals = model.featureImportances.toArray().tolist()
    elif hasattr(model, "coefficients"):
        vals = [abs(v) for v in model.coefficients.toArray().tolist()]
    else:
        vals = [0.0] * len(features)
    rows = [(f, float(v)) for f, v in zip(features, vals)]
    return spark.createDataFrame(rows, S.FEATURE_IMPORTANCE_SCHEMA).orderBy(
        F.col("Importance").desc(), F.col("Feature"))


def correlation_importance(df: DataFrame, features: Sequence[str], label: str) -> DataFrame:
    """Model-free importance: |Pearson r(feature, label)| normalised to sum 1
    (constant features 0); one aggregate pass, result has one row per feature."""
    y = F.col(label).cast("double")
    aggs = []
    for i, f in enumerate(features):
        x = F.col(f).cast("double")
        den = F.stddev_pop(x) * F.stddev_pop(y)
        aggs.append(F.coalesce(F.abs(F.try_divide(F.covar_pop(x, y), F.when(den != 0, den))),
                               F.lit(0.0)).alias(f"a{i}"))
    wide = df.agg(*aggs)
    pairs = ", ".join(f"'{f}', a{i}" for i, f in enumerate(features))
    long = wide.selectExpr(f"stack({len(features)}, {pairs}) AS (Feature, a)")
    from pyspark.sql import Window

    total = F.sum("a").over(Window.partitionBy())     # over the feature rows only
    return long.select("Feature", R6(F.coalesce(F.try_divide(F.col("a"), F.when(total != 0, total)),
                                                F.lit(0.0))).alias("Importance"))


def top_features(importance: DataFrame, n: int = 10) -> DataFrame:
    return importance.orderBy(F.col("Importance").desc(), F.col("Feature").asc()).limit(n)


# D21 -----------------------------------------------------------------------------------------------------------

def weighted_vote(scored: Sequence[DataFrame], weights: Sequence[float], key: str = "CustomerId",
                  score: str = "ChurnProbability") -> DataFrame:
    """Sum(w_i p_i) / Sum(w_i) over the models' scored tables joined on ``key``.
    Default weights in the training pipeline are the models' CV F1."""
    if len(scored) != len(weights) or not scored:
        raise ValueError("one weight per scored table is required")
    parts = [t.select(key, F.col(score).alias(f"_p{i}")) for i, t in enumerate(scored)]
    j = parts[0]
    for p in parts[1:]:
        j = j.join(p, key)
    num: Column | None = None
    for i, w in enumerate(weights):
        term = F.lit(float(w)) * F.col(f"_p{i}")
        num = term if num is None else num + term
    total = 0.0
    for w in weights:
        total += float(w)
    return j.select(key, (num / F.lit(total)).alias("ensemble_probability"))


def chained_vote(df: DataFrame, scorers: Sequence, weights: Sequence[float], out: str = "ensemble_probability") -> DataFrame:
    """The weighted vote of several scorers on one table: each adds its
    probability to the same row, so nothing is joined or shuffled."""
    if len(scorers) != len(weights) or not scorers:
        raise ValueError("one weight per scorer is required")
    x, names = df, [f"_p{i}" for i in range(len(scorers))]
    for name, scorer in zip(names, scorers):
        x = scorer.transform(x, name)
    votes = sum((F.lit(float(w)) * F.col(n) for n, w in zip(names, weights)), F.lit(0.0))
    return x.withColumn(out, votes / F.lit(float(sum(weights)))).drop(*names)


# training pipeline ----------------------------------------------------------------------------------------------

RAW_INPUTS = ["CreditScore", "Geography", "Gender", "Age", "Tenure", "Balance", "NumOfProducts",
              "HasCrCard", "IsActiveMember", "EstimatedSalary"]


def feature_stage(balance_median: float, salary_median: float):
    """The raw columns -> 20 features as a pipeline stage that can be saved;
    the fitted medians are part of it, so serving uses the training rule."""
    from pyspark.ml.feature import SQLTransformer

    flag = "CASE WHEN {} THEN 1 ELSE 0 END AS {}"
    derived = [
        flag.format("Geography = 'Germany'", "Geography_Germany"), flag.format("Geography = 'Spain'", "Geography_Spain"),
        flag.format("Gender = 'Male'", "Gender_Male"),
        "try_divide(Balance, EstimatedSalary + 1) AS Balance_to_Salary_Ratio",
        "try_divide(CreditScore, EstimatedSalary + 1) AS Credit_to_Salary_Ratio",
        "try_divide(Age, Tenure + 1) AS Age_to_Tenure_Ratio", "try_divide(NumOfProducts, Tenure + 1) AS Products_per_Tenure",
        flag.format(f"Balance > {balance_median!r}D AND EstimatedSalary > {salary_median!r}D", "IsHighValueCustomer"),
        flag.format("Tenure > 5", "IsLongTermCustomer"), flag.format("NumOfProducts > 1", "HasMultipleProducts"),
        flag.format("Age < 30 AND IsActiveMember = 0", "IsYoungInactive"), flag.format("Age > 60 AND IsActiveMember = 0", "IsOldInactive"),
    ]
    return SQLTransformer(statement=f"SELECT *, {', '.join(derived)} FROM __THIS__")


def vector_stages(rows: DataFrame, scale: bool, features: Sequence[str] = S.FEATURES) -> list:
    """Assembler (nulls become NaN, so one bad row does not stop a job) and, if
    asked for, a scaler fitted on ``rows``."""
    from pyspark.ml.feature import StandardScaler, VectorAssembler

    name = "raw_features" if scale else "features"
    stages = [VectorAssembler(inputCols=list(features), outputCol=name, handleInvalid="keep")]
    if scale:
        stages.append(StandardScaler(inputCol=name, outputCol="features", withMean=True, withStd=True).fit(stages[0].transform(rows)))
    return stages


@dataclass
class Training:
    """What a training run leaves: one saved-able pipeline per model, the
    comparison table, the parameters and the name of the best model."""

    models: dict
    comparison: DataFrame
    parameters: DataFrame
    weights: dict
    best: str


def train_and_compare(spark, customers: DataFrame, resample_scope: str = "train",
                      models: Sequence[str] = ("logistic", "forest", "boosting"), grids: dict[str, list[dict]] | None = None,
                      scale: bool = False, n_folds: int = 5, label: str = "Exited", small: int | None = None) -> Training:
    """Features -> stratified split -> SMOTE -> grid search per model -> test and
    cross-validated metrics -> best model by CV F1.

    ``resample_scope`` 'train' oversamples before the folds (as the reproduced
    script does); 'fold' oversamples the training side of every fold, so no
    held-out row is synthetic.  ``grids``: the settings to search, by model (default: the published ones)."""
    import json

    from pyspark.ml import PipelineModel

    from retainer.operators import evaluate as EV
    from retainer.operators import features as FE
    from retainer.operators import sampling as SM
    from retainer.operators.stats import exact_median
    from retainer.session import written

    if resample_scope not in ("train", "fold"):
        raise ValueError("resample_scope is 'train' or 'fold'")
    clean = FE.drop_invalid_rows(customers.select("CustomerId", *RAW_INPUTS, label))
    med = exact_median(clean, [], ["Balance", "EstimatedSalary"]).first()
    prepare_features = feature_stage(float(med["Balance_median"]), float(med["EstimatedSalary_median"]))
    split = written(SM.stratified_split(prepare_features.transform(clean), label), "training-split")
    train = split.where(F.col("split") == "train").select("CustomerId", *S.FEATURES, label)

    def balanced(rows: DataFrame) -> DataFrame:
        return SM.smote(rows, S.FEATURES, label)

    whole = balanced(train)
    vectors = vector_stages(whole, scale)

    def assembled(rows: DataFrame) -> DataFrame:
        for stage in vectors:
            rows = stage.transform(rows)
        return rows.withColumn("label", F.col(label).cast("double"))

    if resample_scope == "train":
        # a row number, as identical synthetic rows would share a hash and thus a fold
        numbered = written(whole.withColumn("_rid", F.monotonically_increasing_id()), "training-rows")
        data, prepare = assembled(SM.stratified_folds(numbered, label, "_rid")).select("features", "label", "fold"), None
    else:
        kept = [*S.FEATURES, label, "features", "label", "fold"]
        data = assembled(SM.stratified_folds(train, label, "CustomerId")).select("CustomerId", *kept)

        def prepare(rows: DataFrame) -> DataFrame:
            return assembled(balanced(rows.select("CustomerId", *S.FEATURES, label))).select("features", "label")

    data = written(data, "training-data")
    test = written(assembled(split.where(F.col("split") == "test")).select("features", "label"), "training-test")
    matrix = training_rows(data, n_folds, prepare)
    fitted, rows, folds, params = {}, None, None, []
    for i, name in enumerate(models):
        found = grid_search(name, (grids or PUBLISHED)[name], matrix, n_folds, small=small)
        fitted[name] = PipelineModel([prepare_features, *vectors, found["model"]])
        params.append((name, i, json.dumps(found["params"], sort_keys=True), found["tuning_score"], found["seconds"]))
        on_test = score(found["model"], test).select(F.lit(name).alias("model"), "label", F.col("ChurnProbability").alias("p"), "pred")
        on_folds = held_out_scores(found["folds"], data).withColumn("model", F.lit(name))
        rows = on_test if rows is None else rows.unionByName(on_test)
        folds = on_folds if folds is None else folds.unionByName(on_folds)
    tests = EV.metrics_by(written(rows, "training-scores"), ["model"], "label", "p", "pred")
    cv = EV.cv_summary(EV.metrics_by(written(folds, "training-folds"), ["model", "fold"], "label", "p", "pred"))
    parameters = spark.createDataFrame(params, "Model string, pos int, best_params string, Tuning_Score double, tuning_seconds double")
    order = parameters.select(F.col("Model").alias("model"), "pos")
    table = EV.comparison_table(tests, cv, order).drop("Tuning_Score").join(parameters.select("Model", R6(F.col("Tuning_Score")).alias("Tuning_Score")), "Model")
    comparison = written(table, "training-comparison")
    weights = {r["Model"]: r["CV_F1"] for r in comparison.select("Model", "CV_F1").collect()}     # one row per model
    best = EV.best_model(comparison).first()["Model"]
    return Training(fitted, comparison, parameters, weights, best)


def enhanced_table(customers: DataFrame, model, segments: DataFrame) -> DataFrame:
    """Every customer with the model's probability, risk level (text and number) and cluster segment
    (``segments``: CustomerId, CustomerSegment, SegmentName)."""
    from retainer.operators.batch import ModelScorer

    scored = ModelScorer(model).transform(customers)
    scored = scored.withColumn("RiskLevel", C.risk_level(F.col("ChurnProbability")))
    return scored.withColumn("RiskLevelNumeric", C.risk_level_numeric(F.col("RiskLevel"))).join(segments, "CustomerId", "left")
