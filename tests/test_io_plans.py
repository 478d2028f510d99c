"""Sources and sinks (A1, A2, A7-A9, A11), plan shape, streaming, ML properties."""

import glob
import json
import os

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from retainer import schema as S
from retainer.operators import batch as B
from retainer.operators import models as M
from retainer.operators import segments as SG
from retainer.plans import catalog
from retainer.sources import files as IO
from retainer.sources import tables as TB

from conftest import SF_SMALL


def test_csv_round_trip(spark, tmp):
    src = TB.churn_customers(spark, SF_SMALL)
    IO.write_table(src, f"{tmp}/c.csv", "csv")
    assert len(glob.glob(f"{tmp}/c.csv/part-*")) >= 1
    back = IO.read_table(spark, f"{tmp}/c.csv", src.schema, "csv")
    assert back.exceptAll(src).count() == 0 and src.exceptAll(back).count() == 0


def test_scoring_csv_by_header(spark, tmp):
    # Test.csv shape: 10 columns, no id, flags as numbers
    src = catalog.scoring_input(spark, SF_SMALL).drop("CustomerId").limit(22)
    src.write.option("header", "true").csv(f"{tmp}/t.csv")
    df = IO.read_scoring_input(spark, f"{tmp}/t.csv")
    assert df.columns == S.REQUIRED_FIELDS
    out = B.score_batch(df)
    assert out.count() == 22 and out.columns == ["CustomerId", *S.BATCH_RESULT_COLUMNS]


@pytest.mark.parametrize("fmt", ["json", "orc", "parquet"])
def test_scoring_input_by_name_without_inference(spark, tmp, fmt):
    src = catalog.scoring_input(spark, SF_SMALL)
    turned = src.select(*reversed(src.columns), F.lit(1).alias("extra")).withColumn("Age", F.col("Age").cast("long"))
    path = f"{tmp}/s.{fmt}"
    turned.write.format(fmt).save(path)
    group, tracker = f"infer-{fmt}", spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup(group, "read")
    df = IO.read_scoring_input(spark, path)
    jobs = tracker.getJobIdsForGroup(group)
    spark.sparkContext.setJobGroup("other", "other")
    if fmt != "parquet":  # whose footers Spark itself reads in a job
        assert not list(jobs)
    want = src.select([F.col(f.name).cast(f.dataType) for f in S.SCORING_INPUT_SCHEMA])
    got = df.select(want.columns)
    assert got.dtypes == want.dtypes and got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0
    assert B.score_batch(df).count() == src.count()


def test_json_without_a_required_key_is_refused(spark, tmp):
    src = catalog.scoring_input(spark, SF_SMALL).drop("Age", "CustomerId").withColumn(
        "Balance", F.when(F.col("Tenure") > 3, F.col("Balance")))  # null in some records, not in all
    src.write.json(f"{tmp}/s.json")
    df = IO.read_scoring_input(spark, f"{tmp}/s.json")
    assert B.require_columns(df) is df
    with pytest.raises(ValueError, match="Missing required fields: Age$"):
        B.require_columns(df, filled=True)


def test_json_records_and_nested_sink(spark, tmp):
    rec = {"CreditScore": 650, "Geography": "Germany", "Gender": "Male", "Age": 62, "Tenure": 1,
           "Balance": 5000.0, "NumOfProducts": 1, "HasCrCard": "Yes", "IsActiveMember": "No",
           "EstimatedSalary": 40000.0, "CustomerId": "X1"}
    os.makedirs(f"{tmp}/rec")
    with open(f"{tmp}/rec/a.json", "w") as fh:
        fh.write(json.dumps(rec) + "\n")
    df = IO.read_records(spark, f"{tmp}/rec")
    scored = B.RuleScorer().transform(df.withColumn("HasCrCard", F.lit(1)).withColumn("IsActiveMember", F.lit(0)))
    from retainer.operators import describe as D
    from retainer.operators import rules as H

    enh = TB.enhanced_customers(spark, SF_SMALL)
    rep = H.customer_report(scored, D.segment_performance(D.segment_details(enh)), D.segment_churn_pct(enh))
    IO.write_nested_json(rep, f"{tmp}/rep")
    got = spark.read.json(f"{tmp}/rep").first()
    factors = [f.factor for f in got.analysis.churn_factors]
    assert factors == ["Inactive Account Status", "Senior Age Group", "Low Tenure"]
    assert got.prediction.customer_segment == "At-Risk Seniors"


def test_template_schema(spark):
    t = IO.input_template(spark)
    assert t.count() == 3 and t.schema == S.SCORING_INPUT_SCHEMA


def test_model_save_load_same_scores(spark, tmp):
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    from retainer.operators import features as FE

    feats = FE.training_features(TB.churn_customers(spark, SF_SMALL)).withColumn(
        "label", F.col("Exited").cast("double"))
    pipe = Pipeline(stages=[VectorAssembler(inputCols=S.FEATURES, outputCol="features"),
                            LogisticRegression(maxIter=50)]).fit(feats)
    IO.save_model(pipe, f"{tmp}/m")
    again = IO.load_model(f"{tmp}/m")
    a = M.score(pipe, feats).select("CustomerId", "ChurnProbability").orderBy("CustomerId").collect()
    b = M.score(again, feats).select("CustomerId", "ChurnProbability").orderBy("CustomerId").collect()
    assert a == b
    assert all(0.0 <= r.ChurnProbability <= 1.0 for r in a)
    imp = M.feature_importance(spark, pipe.stages[-1]).collect()
    assert len(imp) == 20 and imp[0].Importance >= imp[-1].Importance


def test_kmeans_properties(spark):
    vec = SG.scaled_vectors(TB.churn_customers(spark, SF_SMALL)).cache()
    curve = {r.k: r.inertia for r in SG.elbow_curve(vec, [2, 6], n_init=2).collect()}
    assert curve[6] < curve[2]
    segs = SG.kmeans_segments(TB.churn_customers(spark, SF_SMALL), k=4, n_init=1)
    names = {r.SegmentName for r in segs.select("SegmentName").distinct().collect()}
    assert names == set(S.SEGMENTS)


PY_UDF_MARKERS = ("BatchEvalPython", "ArrowEvalPython", "PythonUDF", "FlatMapGroupsInPandas",
                  "MapInPandas", "CartesianProduct", "BroadcastNestedLoopJoin")


@pytest.mark.parametrize("name", ["batch_score", "segment_insights", "churn_factors", "retention_strategies",
                                  "customer_ltv", "financial_impact", "high_risk_profile", "roc_curve",
                                  "model_comparison", "segment_density", "correlation_pairs", "profile_table",
                                  "assign_customer_ids", "stratified_folds", "result_page", "weighted_vote"])
def test_plans_stay_in_jvm(spark, name):
    df = E.queries()[name](spark, SF_SMALL)
    plan = df._jdf.queryExecution().executedPlan().toString()
    for marker in PY_UDF_MARKERS:
        assert marker not in plan, (name, marker)


def test_scan_prunes_columns(spark):
    df = E.queries()["rule_segment"](spark, SF_SMALL)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "c_comment" not in plan and "o_comment" not in plan


def test_streaming_scoring(spark, tmp):
    from retainer.streaming import scoring as ST

    src = catalog.scoring_input(spark, SF_SMALL).withColumn("CustomerId", F.col("CustomerId").cast("string"))
    src.select(F.to_json(F.struct(*src.columns)).alias("value")).write.text(f"{tmp}/in")
    qy = ST.start_scoring(spark, f"{tmp}/in", f"{tmp}/out", f"{tmp}/ck", trigger_once=True)
    qy.awaitTermination(120)
    got = spark.read.parquet(f"{tmp}/out")
    want = B.score_batch(catalog.scoring_input(spark, SF_SMALL))
    assert got.count() == want.count()
    assert got.exceptAll(want).count() == 0
    q2 = ST.start_rollup(spark, f"{tmp}/in", "rollup_t", f"{tmp}/ck2", trigger_once=True)
    q2.awaitTermination(120)
    assert spark.table("rollup_t").agg(F.sum("count")).first()[0] == want.count()


def _learnable(spark):
    from retainer.plans.ml import learnable

    return learnable(spark, SF_SMALL)


def test_training_leaves_models_that_score_batches(spark, tmp):
    """Two models (small grids), saved, loaded and used by the batch scorer; null inputs give null."""
    grids = {"logistic": [{"C": c, "penalty": "l2"} for c in (1.0, 100.0)],
             "forest": [{"n_estimators": 50, "max_depth": 10, "min_samples_split": 2, "min_samples_leaf": x} for x in (1, 4)]}
    run = M.train_and_compare(spark, _learnable(spark), models=("logistic", "forest"), n_folds=3, grids=grids, scale=True)
    rows = {r.Model: r for r in run.comparison.collect()}
    assert set(rows) == {"logistic", "forest"} == set(run.models) and run.best in rows
    for r in rows.values():
        assert all(0.0 <= r[f"{side}_{m}"] <= 1.0 for side in ("Test", "CV") for m in ("Accuracy", "Precision", "Recall", "F1", "ROC_AUC"))
        assert r.Test_ROC_AUC > 0.8 and r.Tuning_Score > 0.5
    assert all(json.loads(r.best_params) and r.tuning_seconds > 0 for r in run.parameters.collect())
    IO.save_model(run.models["logistic"], f"{tmp}/m")
    scorer = B.ModelScorer(IO.load_model(f"{tmp}/m"))
    src = catalog.scoring_input(spark, SF_SMALL)
    out = B.score_batch(src, scorer)
    assert out.columns == ["CustomerId", *S.BATCH_RESULT_COLUMNS] and out.count() == src.count()
    assert out.filter("ChurnProbability is null or ChurnProbability < 0 or ChurnProbability > 1").count() == 0
    bad = B.score_batch(src.withColumn("Balance", F.lit(None).cast("double")), scorer)
    assert bad.filter("ChurnProbability is not null or RiskLevel is not null").count() == 0
    vote = M.chained_vote(src.withColumn("HasCrCard", F.lit(1)).withColumn("IsActiveMember", F.lit(1)),
                          [B.ModelScorer(m) for m in run.models.values()], [1.0, 3.0])
    assert vote.columns == [*src.columns, "ensemble_probability"] and vote.filter("ensemble_probability between 0 and 1").count() == src.count()


def test_boosting_with_resampling_inside_the_folds(spark, monkeypatch):
    """Oversampling runs once a fold (and once for all rows), whatever the number of settings."""
    from retainer.operators import sampling as SM

    grid = [{"n_estimators": n, "learning_rate": r, "max_depth": 3, "subsample": 1.0} for n in (10, 20) for r in (0.1, 0.2)]
    calls, smote = [], SM.smote
    monkeypatch.setattr(SM, "smote", lambda *a: calls.append(1) or smote(*a))
    run = M.train_and_compare(spark, _learnable(spark), models=("boosting",), resample_scope="fold", n_folds=2, grids={"boosting": grid})
    row = run.comparison.first()
    assert row.Model == "boosting" and 0.0 <= row.CV_F1 <= 1.0
    assert len(calls) == 4  # two folds, all rows, and the scaling
    with pytest.raises(ValueError):
        M.train_and_compare(spark, _learnable(spark), resample_scope="none")


def test_synthetic_customers(spark):
    df = IO.synthetic_customers(spark, 500, noise=False)
    assert df.count() == 500 and df.select("CustomerId").distinct().count() == 500
    assert df.filter("Age < 18 or Age >= 95 or CreditScore < 300 or CreditScore >= 900 or Exited not in (0, 1)").count() == 0


def test_csv_with_other_header_order_fails_and_bad_records_are_kept(spark, tmp):
    os.makedirs(f"{tmp}/c")
    with open(f"{tmp}/c/a.csv", "w") as fh:
        fh.write("a,b\n1,2\nx,3\n")
    df = IO.read_table(spark, f"{tmp}/c", "a int, b int", "csv", corrupt_column="_bad")
    assert [(r.a, r.b, r._bad) for r in df.collect()] == [(1, 2, None), (None, 3, "x,3")]
    with open(f"{tmp}/c/b.csv", "w") as fh:
        fh.write("b,a\n1,2\n")
    with pytest.raises(Exception, match="(?i)header"):
        IO.read_table(spark, f"{tmp}/c", "a int, b int", "csv").collect()


def test_levels_are_bounded(spark):
    from retainer.operators import features as FE

    with pytest.raises(ValueError):
        FE.fit_levels(spark.range(20).select(F.col("id").cast("string").alias("c")), "c", max_levels=10)
