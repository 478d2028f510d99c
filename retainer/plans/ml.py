"""Registered queries with a fitted step that has no SQL equivalent
(C1, C2/C4, C5, D3, D10/D19) and the nested records (E15, F8) --
checked by row count and by the property tests in ``tests/``.

``train_comparison``, ``enhanced_model`` and ``batch_score_model`` search the
published grids (8, 81 and 81 settings).
"""

from __future__ import annotations

from pyspark.sql import functions as F

from retainer import schema as S
from retainer.functions import columns as C
from retainer.operators import batch as B
from retainer.operators import describe as D
from retainer.operators import evaluate as EV
from retainer.operators import features as FE
from retainer.operators import models as M
from retainer.operators import sampling as SM
from retainer.operators import segments as SG
from retainer.plans.catalog import SCORING_CTES, register, scoring_input
from retainer.plans.oracle import q
from retainer.sources import files as IO
from retainer.sources import tables as TB
from retainer.session import scratch_path, written


# C1 ----------------------------------------------------------------------------------------------------

@register("elbow_curve", None)
def elbow_curve(spark, d):
    return SG.elbow_curve(SG.scaled_vectors(written(TB.churn_customers(spark, d), "customers")), range(2, 11))


# C2 / C3 / C4 ------------------------------------------------------------------------------------------

@register("kmeans_segments", None)
def kmeans_segments(spark, d):
    return SG.kmeans_segments(TB.churn_customers(spark, d), k=4)


@register("kmeans_refit_names", None)
def kmeans_refit_names(spark, d):
    """The names of a first run carried to the clusters of a second one with other starts: customers of each
    pair of names; both runs and their profiles are computed here."""
    cust = TB.churn_customers(spark, d)
    first = written(SG.kmeans_segments(cust, k=4), "first-run")
    former = SG.segment_profile(first.join(cust, "CustomerId"), "CustomerSegment", S.CLUSTER_FEATURES)
    former = written(former.join(first.select("CustomerSegment", "SegmentName").distinct(), "CustomerSegment"), "former")
    again = SG.kmeans_segments(cust, k=4, seed=1042, former=former)
    both = first.select("CustomerId", F.col("SegmentName").alias("former_name")).join(again, "CustomerId")
    return both.groupBy("former_name", F.col("SegmentName").alias("new_name")).agg(F.count(F.lit(1)).alias("customers"))


# C5 ----------------------------------------------------------------------------------------------------

@register("pca_projection", None)
def pca_projection(spark, d):
    return SG.pca_projection(SG.scaled_vectors(TB.churn_customers(spark, d)))


# D3 ----------------------------------------------------------------------------------------------------

@register("smote_balance", None)
def smote_balance(spark, d):
    feats = FE.training_features(written(TB.churn_customers(spark, d), "customers"))
    train = SM.stratified_split(feats).where(F.col("split") == "train").drop("split")
    return SM.smote(train, S.FEATURES, "Exited")


# D6 / D10 / D19 / D20 ---------------------------------------------------------------------------------

def _fit(spark, d, kind: str):
    feats = FE.training_features(TB.churn_customers(spark, d))
    split = SM.stratified_split(feats)
    train = M.assemble(split.where(F.col("split") == "train"))
    if kind == "forest":
        from pyspark.ml.classification import RandomForestClassifier

        est = RandomForestClassifier(numTrees=100, maxDepth=10, seed=42)
    else:
        from pyspark.ml.classification import LogisticRegression

        n = train.count()
        est = LogisticRegression(maxIter=1000, regParam=1.0 / n, standardization=False)
    return est.fit(train), split


@register("model_scores", None)
def model_scores(spark, d):
    """Logistic model trained on the train split, scoring every customer:
    CustomerId, ChurnProbability, pred, RiskLevel."""
    model, split = _fit(spark, d, "logistic")
    scored = M.score(model, M.assemble(split))
    return scored.select("CustomerId", "split", "Exited", "ChurnProbability", "pred",
                         C.risk_level(F.col("ChurnProbability")).alias("RiskLevel"))


@register("model_feature_importance", None)
def model_feature_importance(spark, d):
    model, _ = _fit(spark, d, "forest")
    return M.top_features(M.feature_importance(spark, model), 20)


@register("model_test_metrics", None)
def model_test_metrics(spark, d):
    model, split = _fit(spark, d, "forest")
    test = M.score(model, M.assemble(split.where(F.col("split") == "test")))
    return EV.classification_metrics(test, "label", "ChurnProbability", "pred")


# D6-D10, D12-D14, D21, G1 with fitted models --------------------------------------------------------------

def learnable(spark, d):
    """Customers with the label that the inputs explain (FIXTURES 3)."""
    rows = TB.churn_scored(spark, d)
    return rows.withColumn("Exited", C.as_flag(F.col("ChurnProbability") >= 0.5)).drop("ChurnProbability")


@register("train_comparison", None)
def train_comparison(spark, d):
    """Three tuned models: test and cross-validated metrics, parameters, tuning score."""
    run = M.train_and_compare(spark, written(learnable(spark, d), "customers"))
    return run.comparison.join(run.parameters.select("Model", "best_params"), "Model")


@register("enhanced_model", None)
def enhanced_model(spark, d):
    """All customers scored by the best of three models, with risk level, cluster segment and the weighted vote."""
    customers = written(learnable(spark, d), "enhanced-input")
    run = M.train_and_compare(spark, customers)
    table = M.enhanced_table(customers, run.models[run.best], SG.kmeans_segments(customers))
    names = list(run.models)
    return M.chained_vote(table, [B.ModelScorer(run.models[n]) for n in names], [run.weights[n] for n in names])


@register("batch_score_model", None)
def batch_score_model(spark, d):
    """Train a model, save it, load it and score the batch input with it."""
    run = M.train_and_compare(spark, learnable(spark, d), models=("logistic",), scale=True)
    path = scratch_path(spark, "model")
    IO.save_model(run.models["logistic"], path)
    return B.score_batch(scoring_input(spark, d), B.ModelScorer(IO.load_model(path)))


# A2: JSON records derived from the customer table ----------------------------------------------------------

@register("record_scoring", q("SELECT * FROM batch", SCORING_CTES))
def record_scoring(spark, d):
    src = scoring_input(spark, d).withColumn("CustomerId", F.col("CustomerId").cast("string"))
    msgs = src.select(F.to_json(F.struct(*src.columns)).alias("value"))
    return B.score_batch(IO.parse_records(msgs))


# E15 / F8 / H9 nested records ------------------------------------------------------------------------------

@register("evaluation_report", None)
def evaluation_report(spark, d):
    from retainer.plans import evaluation as E

    enh = written(TB.enhanced_customers(spark, d), "report")
    comp = written(E.comparison(spark, d), "report-comparison")
    s = E.split_table(spark, d)
    return D.nested_record(spark, {
        "dataset_info": D.dataset_overview(s, s),
        "best_model": EV.best_model(comp).select("Model", "CV_F1", "Test_F1", "Test_ROC_AUC"),
        "model_comparison": D.collect_small(comp, "model_comparison"),
        "top_features": D.collect_small(
            M.top_features(M.correlation_importance(FE.training_features(TB.churn_customers(spark, d)),
                                                    S.FEATURES, "Exited"), 10), "top_features"),
        "segment_insights": D.collect_small(D.segment_insights(enh), "segment_insights"),
        "risk_distribution": D.collect_small(D.risk_distribution(enh), "risk_distribution"),
    })


@register("dashboard_payload", None)
def dashboard_payload(spark, d):
    enh = written(TB.enhanced_customers(spark, d), "dashboard")
    perf = D.segment_performance(D.segment_details(enh))
    share, churn = D.segment_share(enh), D.segment_churn_pct(enh)
    imp = M.top_features(M.correlation_importance(FE.training_features(TB.churn_customers(spark, d)),
                                                  S.FEATURES, "Exited"), 5)
    return D.nested_record(spark, {
        "overall_churn_rate": D.overall_churn_rate(enh).withColumnRenamed("churn_rate_pct", "overall_churn_rate"),
        "segment_distribution": D.collect_small(share, "segment_distribution"),
        "segment_churn": D.collect_small(churn, "segment_churn"),
        "risk_distribution": D.collect_small(D.risk_share(enh), "risk_distribution"),
        "top_features": D.collect_small(imp, "top_features"),
        "segment_details": D.collect_small(D.segment_details(enh), "segment_details"),
        "high_risk_count": D.high_risk_count(enh).withColumnRenamed("high_risk_customers", "high_risk_count"),
        "segment_performance": D.collect_small(perf, "segment_performance"),
        "segment_roi": D.collect_small(D.segment_roi(perf, share, churn), "segment_roi"),
    })
