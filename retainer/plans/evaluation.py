"""Registered queries D2-D5, D11-D18, D20-D22 and E14.

The evaluation runs on the deterministic proxy score of ``churn_scored``
against the real label ``Exited`` (no fitted model), so every metric has an
exact SQL oracle.  Two "models" are two decision thresholds on that score.
Fitted Spark ML models go through the same operators (``plans.ml``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retainer import schema as S
from retainer.functions import columns as C
from retainer.operators import batch as B
from retainer.operators import evaluate as EV
from retainer.operators import features as FE
from retainer.operators import models as M
from retainer.operators import sampling as SM
from retainer.plans.catalog import register
from retainer.plans.oracle import q
from retainer.session import written
from retainer.sources import tables as TB

MODELS = [("rule_t50", 0.5), ("rule_t30", 0.3)]
FOLD_PROBS = [0.2, 0.4, 0.6, 0.8]


# Spark side --------------------------------------------------------------------------------------------

def split_table(spark, d) -> DataFrame:
    s = TB.churn_scored(spark, d).select("CustomerId", "Exited", "ChurnProbability")
    return SM.stratified_split(s)


def fold_table(spark, d) -> DataFrame:
    return SM.stratified_folds(split_table(spark, d).where(F.col("split") == "train"))


def with_models(df: DataFrame) -> DataFrame:
    m = F.explode(F.array(*[F.struct(F.lit(n).alias("model"), F.lit(i).alias("pos"), F.lit(t).alias("t"))
                            for i, (n, t) in enumerate(MODELS)]))
    x = df.select("*", m.alias("_m"))
    return x.select(*df.columns, "_m.model", "_m.pos",
                    F.col("Exited").alias("label"), F.col("ChurnProbability").alias("p"),
                    F.when(F.col("ChurnProbability") > F.col("_m.t"), 1).otherwise(0).cast("int").alias("pred"))


def test_preds(spark, d, model: str | None = None) -> DataFrame:
    x = with_models(split_table(spark, d).where(F.col("split") == "test"))
    return x if model is None else x.where(F.col("model") == model)


def fold_metrics(spark, d) -> DataFrame:
    return EV.metrics_by(with_models(fold_table(spark, d)), ["model", "fold"], "label", "p", "pred")


def comparison(spark, d) -> DataFrame:
    split = written(split_table(spark, d), "evaluation-split")     # scored and split once for test and folds
    folds = written(SM.stratified_folds(split.where(F.col("split") == "train")), "evaluation-folds")
    test = EV.metrics_by(with_models(split.where(F.col("split") == "test")), ["model"], "label", "p", "pred")
    cv = EV.cv_summary(EV.metrics_by(with_models(folds), ["model", "fold"], "label", "p", "pred"))
    order = spark.createDataFrame([(n, i) for i, (n, _) in enumerate(MODELS)], "model string, pos int")
    return EV.comparison_table(test, cv, order)


# SQL side ------------------------------------------------------------------------------------------------

def _h(salt: str) -> str:
    return f"('0x' || substr(md5(concat(CAST(CustomerId AS VARCHAR), '{salt}')), 1, 8))::BIGINT"


_fold_sum = " + ".join(f"(CASE WHEN s.hf > f.c[{i + 1}] THEN 1 ELSE 0 END)" for i in range(len(FOLD_PROBS)))
_models_values = ", ".join(f"('{n}', {i}, CAST({t!r} AS DOUBLE))" for i, (n, t) in enumerate(MODELS))

EVAL_CTES = f"""
ev_h AS (SELECT CustomerId, Exited, ChurnProbability, {_h('42')} AS h, {_h('fold42')} AS hf FROM churn_scored),
ev_cut AS (SELECT Exited, quantile_cont(CAST(h AS DOUBLE), 0.8) AS cut FROM ev_h GROUP BY Exited),
ev_split AS (SELECT e.CustomerId, e.Exited, e.ChurnProbability, e.hf,
                    CASE WHEN e.h <= c.cut THEN 'train' ELSE 'test' END AS split
             FROM ev_h e JOIN ev_cut c ON e.Exited = c.Exited),
ev_fcut AS (SELECT Exited, quantile_cont(CAST(hf AS DOUBLE), {FOLD_PROBS}) AS c
            FROM ev_split WHERE split = 'train' GROUP BY Exited),
ev_folds AS (SELECT s.CustomerId, s.Exited, s.ChurnProbability, CAST({_fold_sum} AS INT) AS fold
             FROM ev_split s JOIN ev_fcut f ON s.Exited = f.Exited WHERE s.split = 'train'),
ev_models AS (SELECT * FROM (VALUES {_models_values}) AS v(model, pos, t)),
ev_test AS (SELECT m.model, m.pos, 0 AS fold, s.Exited AS label, s.ChurnProbability AS p,
                   CASE WHEN s.ChurnProbability > m.t THEN 1 ELSE 0 END AS pred
            FROM ev_split s, ev_models m WHERE s.split = 'test'),
ev_cv AS (SELECT m.model, m.pos, s.fold, s.Exited AS label, s.ChurnProbability AS p,
                 CASE WHEN s.ChurnProbability > m.t THEN 1 ELSE 0 END AS pred
          FROM ev_folds s, ev_models m)"""


def metrics_cte(name: str, src: str) -> str:
    """Per (model, fold) metrics of ``src`` as CTE ``name``."""
    return f"""
{name}_cnt AS (SELECT model, pos, fold, count_if(label = 1 AND pred = 1) AS tp, count_if(label = 0 AND pred = 1) AS fp,
                      count_if(label = 0 AND pred = 0) AS tn, count_if(label = 1 AND pred = 0) AS fn
               FROM {src} GROUP BY model, pos, fold),
{name}_auc AS (
  SELECT model, fold, sum(neg * (cum_pos - pos / 2e0)) / NULLIF(CAST(sum(pos) AS DOUBLE) * sum(neg), 0) AS roc_auc
  FROM (SELECT model, fold, p, pos, neg,
               sum(pos) OVER (PARTITION BY model, fold ORDER BY p DESC ROWS UNBOUNDED PRECEDING) AS cum_pos
        FROM (SELECT model, fold, p, CAST(sum(CASE WHEN label = 1 THEN 1 ELSE 0 END) AS BIGINT) AS pos,
                     CAST(sum(CASE WHEN label = 1 THEN 0 ELSE 1 END) AS BIGINT) AS neg
              FROM {src} GROUP BY model, fold, p) g) r
  GROUP BY model, fold),
{name} AS (
  SELECT c.model, c.pos, c.fold,
         (tp + tn) / NULLIF(tp + fp + tn + fn, 0) AS accuracy,
         COALESCE(tp / NULLIF(tp + fp, 0), 0e0) AS precision,
         COALESCE(tp / NULLIF(tp + fn, 0), 0e0) AS recall,
         COALESCE(tp * 2 / NULLIF(tp * 2 + fp + fn, 0), 0e0) AS f1,
         a.roc_auc
  FROM {name}_cnt c LEFT JOIN {name}_auc a ON c.model = a.model AND c.fold = a.fold)"""


CV_LONG = """
cv_long AS (
  SELECT model, pos, fold, 'accuracy' AS metric, accuracy AS value FROM cvm
  UNION ALL SELECT model, pos, fold, 'precision', precision FROM cvm
  UNION ALL SELECT model, pos, fold, 'recall', recall FROM cvm
  UNION ALL SELECT model, pos, fold, 'f1', f1 FROM cvm
  UNION ALL SELECT model, pos, fold, 'roc_auc', roc_auc FROM cvm),
cv_sum AS (SELECT model, pos, metric, ROUND(avg(value), 6) AS mean, ROUND(stddev_pop(value), 6) AS std
           FROM cv_long GROUP BY model, pos, metric)"""

ALL_EVAL = EVAL_CTES + "," + metrics_cte("tm", "ev_test") + "," + metrics_cte("cvm", "ev_cv") + "," + CV_LONG

COMPARISON_CTE = """
cmp AS (
  SELECT t.model AS Model, t.pos,
         ROUND(t.accuracy, 6) AS Test_Accuracy, ROUND(t.precision, 6) AS Test_Precision,
         ROUND(t.recall, 6) AS Test_Recall, ROUND(t.f1, 6) AS Test_F1, ROUND(t.roc_auc, 6) AS Test_ROC_AUC,
         max(CASE WHEN c.metric = 'accuracy' THEN c.mean END) AS CV_Accuracy,
         max(CASE WHEN c.metric = 'precision' THEN c.mean END) AS CV_Precision,
         max(CASE WHEN c.metric = 'recall' THEN c.mean END) AS CV_Recall,
         max(CASE WHEN c.metric = 'f1' THEN c.mean END) AS CV_F1,
         max(CASE WHEN c.metric = 'roc_auc' THEN c.mean END) AS CV_ROC_AUC,
         max(CASE WHEN c.metric = 'f1' THEN c.mean END) AS Tuning_Score
  FROM tm t JOIN cv_sum c ON t.model = c.model
  GROUP BY t.model, t.pos, t.accuracy, t.precision, t.recall, t.f1, t.roc_auc)"""


# D2 / D5 / D4 / E14 ----------------------------------------------------------------------------------------

@register("stratified_split", q("SELECT CustomerId, Exited, split FROM ev_split", EVAL_CTES))
def stratified_split(spark, d):
    return split_table(spark, d).select("CustomerId", "Exited", "split")


@register("stratified_folds", q("SELECT CustomerId, Exited, fold FROM ev_folds", EVAL_CTES))
def stratified_folds(spark, d):
    return fold_table(spark, d).select("CustomerId", "Exited", "fold")


@register("class_distribution", q("""
SELECT 'before' AS stage, Exited, count(*) AS count FROM ev_split WHERE split = 'train' GROUP BY Exited
UNION ALL
SELECT 'after', Exited, (SELECT max(n) FROM (SELECT count(*) AS n FROM ev_split WHERE split = 'train' GROUP BY Exited) m)
FROM ev_split WHERE split = 'train' GROUP BY Exited""", EVAL_CTES))
def class_distribution(spark, d):
    feats = FE.training_features(written(TB.churn_customers(spark, d), "customers"))
    train = written(SM.stratified_split(feats).where(F.col("split") == "train").drop("split"), "train")
    before = SM.class_distribution(train, "Exited", "before")
    after = SM.class_distribution(SM.smote(train, S.FEATURES, "Exited"), "Exited", "after")
    return before.unionByName(after)


@register("dataset_overview", q("""
SELECT count(*) AS total_samples, 20 AS features, ROUND(avg(Exited), 6) AS churn_rate,
       CAST(count_if(split = 'train') AS BIGINT) AS train_size, CAST(count_if(split = 'test') AS BIGINT) AS test_size FROM ev_split""", EVAL_CTES))
def dataset_overview(spark, d):
    from retainer.operators.describe import dataset_overview as ov

    s = split_table(spark, d)
    return ov(s, s)


# D11 / D12 / D13 / D14 / D22 ------------------------------------------------------------------------------

@register("classification_metrics", q("""
SELECT ROUND(accuracy, 6) AS accuracy, ROUND(precision, 6) AS precision, ROUND(recall, 6) AS recall,
       ROUND(f1, 6) AS f1, ROUND(roc_auc, 6) AS roc_auc FROM tm WHERE model = 'rule_t50'""", ALL_EVAL))
def classification_metrics(spark, d):
    return EV.classification_metrics(test_preds(spark, d, "rule_t50"))


@register("cv_metrics", q("SELECT model, metric, mean, std FROM cv_sum", ALL_EVAL))
def cv_metrics(spark, d):
    return EV.cv_summary(fold_metrics(spark, d))


@register("model_comparison", q("SELECT * FROM cmp", ALL_EVAL + "," + COMPARISON_CTE))
def model_comparison(spark, d):
    return comparison(spark, d)


@register("best_model", q("SELECT * FROM cmp ORDER BY CV_F1 DESC, pos ASC LIMIT 1",
                          ALL_EVAL + "," + COMPARISON_CTE))
def best_model(spark, d):
    return EV.best_model(comparison(spark, d))


def _tiers_sql(col: str, spec) -> str:
    arms = []
    for cut, text in spec:
        arms.append(f"ELSE '{text}'" if cut is None else f"WHEN {col} > {cut!r} THEN '{text}'")
    return "CASE " + " ".join(arms) + " END"


@register("performance_verdict", q(f"""
SELECT Model, {_tiers_sql('Test_ROC_AUC', S.VERDICT_AUC)} AS auc_verdict,
       {_tiers_sql('Test_F1', S.VERDICT_F1)} AS f1_verdict,
       CASE WHEN abs(CV_F1 - Test_F1) < {S.VERDICT_GAP!r} THEN '{S.VERDICT_GAP_OK}'
            ELSE '{S.VERDICT_GAP_BAD}' END AS generalization_verdict
FROM (SELECT * FROM cmp ORDER BY CV_F1 DESC, pos ASC LIMIT 1) b""", ALL_EVAL + "," + COMPARISON_CTE))
def performance_verdict(spark, d):
    return EV.performance_verdict(EV.best_model(comparison(spark, d)))


# D15 / D16 / D17 / D18 ------------------------------------------------------------------------------------

CUM_CTE = """
cum AS (
  SELECT p, sum(pos) OVER (ORDER BY p DESC ROWS UNBOUNDED PRECEDING) AS cum_pos,
         sum(neg) OVER (ORDER BY p DESC ROWS UNBOUNDED PRECEDING) AS cum_neg,
         sum(pos) OVER () AS tot_pos, sum(neg) OVER () AS tot_neg
  FROM (SELECT p, sum(CASE WHEN label = 1 THEN 1 ELSE 0 END) AS pos, sum(CASE WHEN label = 1 THEN 0 ELSE 1 END) AS neg
        FROM ev_test WHERE model = 'rule_t50' GROUP BY p) g)"""


@register("roc_curve", q("""
SELECT ROUND(p, 6) AS threshold, ROUND(cum_neg / NULLIF(tot_neg, 0), 6) AS fpr, ROUND(cum_pos / NULLIF(tot_pos, 0), 6) AS tpr
FROM cum""", EVAL_CTES + "," + CUM_CTE))
def roc_curve(spark, d):
    return EV.roc_curve(test_preds(spark, d, "rule_t50"))


THINNED = """
, steps AS (
  SELECT *, lead(pos) OVER w AS next_pos, lead(neg) OVER w AS next_neg, row_number() OVER w AS place, count(*) OVER () AS n_scores
  FROM (SELECT *, cum_pos - lag(cum_pos, 1, 0) OVER v AS pos, cum_neg - lag(cum_neg, 1, 0) OVER v AS neg FROM cum WINDOW v AS (ORDER BY p DESC)) c
  WINDOW w AS (ORDER BY p DESC)),
kept AS (
  SELECT p, cum_neg / NULLIF(tot_neg, 0) AS fpr, cum_pos / NULLIF(tot_pos, 0) AS tpr, n_scores FROM steps WHERE next_pos IS NULL OR {rule}
  UNION ALL SELECT CAST(NULL AS DOUBLE), 0e0, 0e0, (SELECT count(*) FROM cum))"""
CURVE = "SELECT ROUND(p, 6) AS threshold, ROUND(fpr, 6) AS fpr, ROUND(tpr, 6) AS tpr, CAST(n_scores AS BIGINT) AS n_scores FROM kept"


def _thinned(spark, d, rule):
    points = EV.roc_points(test_preds(spark, d, "rule_t50"), rule=rule)
    return points.select(*[C.bround6(F.col(c)).alias(c) for c in ("threshold", "fpr", "tpr")], "n_scores")


@register("roc_curve_thinned", q(CURVE, EVAL_CTES + "," + CUM_CTE + THINNED.format(
    rule="place = 1 OR pos <> next_pos OR neg <> next_neg")))
def roc_curve_thinned(spark, d):
    return _thinned(spark, d, "equal_steps")


@register("roc_curve_corners", q(CURVE, EVAL_CTES + "," + CUM_CTE + THINNED.format(rule="pos * next_neg <> next_pos * neg")))
def roc_curve_corners(spark, d):
    return _thinned(spark, d, "collinear")


@register("roc_curve_sketch", q("""
SELECT ROUND(bin / 1e3, 6) AS threshold, ROUND(sum(neg) OVER w / NULLIF(sum(neg) OVER (), 0), 6) AS fpr,
       ROUND(sum(pos) OVER w / NULLIF(sum(pos) OVER (), 0), 6) AS tpr,
       ROUND(sum(pos * neg) OVER () / 2e0 / NULLIF(sum(pos) OVER () * sum(neg) OVER (), 0), 6) AS area_error
FROM (SELECT CAST(LEAST(GREATEST(floor(p * 1000), 0), 999) AS INT) AS bin, sum(CASE WHEN label = 1 THEN 1 ELSE 0 END) AS pos,
             sum(CASE WHEN label = 1 THEN 0 ELSE 1 END) AS neg FROM ev_test WHERE model = 'rule_t50' GROUP BY 1) g
WINDOW w AS (ORDER BY bin DESC)""", EVAL_CTES))
def roc_curve_sketch(spark, d):
    points = EV.roc_sketch(test_preds(spark, d, "rule_t50"), bins=1000)
    return points.select(*[C.bround6(F.col(c)).alias(c) for c in points.columns])


@register("roc_auc", q("SELECT ROUND(roc_auc, 6) AS roc_auc FROM tm WHERE model = 'rule_t50'", ALL_EVAL))
def roc_auc(spark, d):
    return EV.roc_auc(test_preds(spark, d, "rule_t50"))


@register("pr_curve", q("""
SELECT ROUND(p, 6) AS threshold, ROUND(cum_pos / NULLIF(cum_pos + cum_neg, 0), 6) AS precision,
       ROUND(cum_pos / NULLIF(tot_pos, 0), 6) AS recall FROM cum
UNION ALL SELECT CAST(NULL AS DOUBLE), 1e0, 0e0""", EVAL_CTES + "," + CUM_CTE))
def pr_curve(spark, d):
    return EV.pr_curve(test_preds(spark, d, "rule_t50"))


@register("score_histogram", q("""
SELECT model, bin, count(*) AS n
FROM (SELECT c.model, CAST(CASE WHEN r.hi - r.lo = 0 THEN 1
                           ELSE LEAST(CAST(floor((c.f1 - r.lo) * 10e0 / (r.hi - r.lo)) AS INT) + 1, 10) END AS INT) AS bin
      FROM cvm c JOIN (SELECT model, min(f1) AS lo, max(f1) AS hi FROM cvm GROUP BY model) r ON c.model = r.model) t
GROUP BY model, bin""", ALL_EVAL))
def score_histogram(spark, d):
    fm = fold_metrics(spark, d).select("model", F.col("f1").alias("value"))
    return EV.score_histogram(fm, "value", "model", 10)


@register("confusion_matrix", q("""
SELECT g.actual, g.predicted, CAST(COALESCE(c.n, 0) AS BIGINT) AS count
FROM (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) AS g(actual, predicted)
LEFT JOIN (SELECT label AS actual, pred AS predicted, count(*) AS n FROM ev_test WHERE model = 'rule_t50'
           GROUP BY label, pred) c ON g.actual = c.actual AND g.predicted = c.predicted""", EVAL_CTES))
def confusion_matrix(spark, d):
    return EV.confusion_matrix(test_preds(spark, d, "rule_t50"), "label", "pred")


# D20 / D21 -------------------------------------------------------------------------------------------------

TRAIN_FEATURES_CTE = """
tf AS (
  SELECT CustomerId, Exited, CreditScore, Age, Tenure, Balance, NumOfProducts, HasCrCard, IsActiveMember, EstimatedSalary,
         CAST(CASE WHEN Geography = 'Germany' THEN 1 ELSE 0 END AS INT) AS Geography_Germany,
         CAST(CASE WHEN Geography = 'Spain' THEN 1 ELSE 0 END AS INT) AS Geography_Spain,
         CAST(CASE WHEN Gender = 'Male' THEN 1 ELSE 0 END AS INT) AS Gender_Male,
         Balance / NULLIF(EstimatedSalary + 1, 0) AS Balance_to_Salary_Ratio,
         CreditScore / NULLIF(EstimatedSalary + 1, 0) AS Credit_to_Salary_Ratio,
         Age / NULLIF(Tenure + 1, 0) AS Age_to_Tenure_Ratio,
         NumOfProducts / NULLIF(Tenure + 1, 0) AS Products_per_Tenure,
         CAST(CASE WHEN Balance > (SELECT median(Balance) FROM churn_customers)
                    AND EstimatedSalary > (SELECT median(EstimatedSalary) FROM churn_customers) THEN 1 ELSE 0 END AS INT)
           AS IsHighValueCustomer,
         CAST(CASE WHEN Tenure > 5 THEN 1 ELSE 0 END AS INT) AS IsLongTermCustomer,
         CAST(CASE WHEN NumOfProducts > 1 THEN 1 ELSE 0 END AS INT) AS HasMultipleProducts,
         CAST(CASE WHEN Age < 30 AND IsActiveMember = 0 THEN 1 ELSE 0 END AS INT) AS IsYoungInactive,
         CAST(CASE WHEN Age > 60 AND IsActiveMember = 0 THEN 1 ELSE 0 END AS INT) AS IsOldInactive
  FROM churn_customers)"""


def _importance_sql(n: int) -> str:
    parts = [f"SELECT '{f}' AS Feature, COALESCE(abs(covar_pop(CAST({f} AS DOUBLE), CAST(Exited AS DOUBLE)) "
             f"/ NULLIF(stddev_pop(CAST({f} AS DOUBLE)) * stddev_pop(CAST(Exited AS DOUBLE)), 0e0)), 0e0) AS a FROM tf"
             for f in S.FEATURES]
    return q(f"""
SELECT Feature, ROUND(COALESCE(a / NULLIF(sum(a) OVER (), 0e0), 0e0), 6) AS Importance
FROM ({' UNION ALL '.join(parts)}) u
ORDER BY Importance DESC, Feature ASC LIMIT {n}""", TRAIN_FEATURES_CTE)


@register("top_features", _importance_sql(10))
def top_features(spark, d):
    feats = FE.training_features(TB.churn_customers(spark, d))
    return M.top_features(M.correlation_importance(feats, S.FEATURES, "Exited"), 10)


@register("weighted_vote", q("""
SELECT a.CustomerId,
       ROUND((7e-1 * a.p1 + 3e-1 * b.p2) / (7e-1 + 3e-1), 6) AS ensemble_probability
FROM (SELECT CustomerId, ChurnProbability AS p1 FROM churn_scored) a
JOIN (SELECT CustomerId, LEAST(1e0, GREATEST(0e0, 2e-2
    + 1e-1  * (1 - IsActiveMember)
    + 5e-2  * (CASE WHEN Age < 30 THEN 1 ELSE 0 END)
    + 8e-2  * (CASE WHEN Age > 60 THEN 1 ELSE 0 END)
    + 1e-1  * (CASE WHEN Balance < 10000 THEN 1 ELSE 0 END)
    + 15e-2 * (CASE WHEN NumOfProducts = 1 THEN 1 ELSE 0 END)
    - 1e-1  * (CASE WHEN Tenure > 5 THEN 1 ELSE 0 END)
    - 5e-2  * HasCrCard
    + 1e-1  * (CASE WHEN Geography = 'Germany' THEN 1 ELSE 0 END))) AS p2 FROM churn_customers) b
  ON a.CustomerId = b.CustomerId"""))
def weighted_vote(spark, d):
    out = M.chained_vote(TB.churn_customers(spark, d), [B.RuleScorer(), B.AdditiveScorer()], [0.7, 0.3])
    return out.select("CustomerId", C.bround6(F.col("ensemble_probability")).alias("ensemble_probability"))
