"""Classification metrics, curves and verdicts.

Everything reduces the scored rows first: confusion counts are one
aggregate; ROC / PR / AUC group the rows by distinct score (per key) and
only then take running sums, with ``stats.running_totals`` so the ordered
pass is range-partitioned instead of one global window.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from retainer import schema as S
from retainer.functions import columns as C
from retainer.operators.stats import running_totals

R6 = C.bround6
METRICS = ["accuracy", "precision", "recall", "f1", "roc_auc"]


def predict(p: Column, threshold: float = 0.5) -> Column:
    """Class 1 when P(class 1) > threshold (argmax of two classes at 0.5)."""
    return F.when(p > F.lit(threshold), F.lit(1)).otherwise(F.lit(0)).cast("int")


def _zero(x: Column) -> Column:
    return F.coalesce(x, F.lit(0.0))


def auc_by(df: DataFrame, keys: Sequence[str], label: str, score: str) -> DataFrame:
    """ROC-AUC per key group by the tie-aware rank-sum formula:
    sum over score groups of neg_g * (pos above g + pos_g / 2) / (P * N)."""
    keys = list(keys)
    g = df.groupBy(*keys, score).agg(
        F.sum(F.when(F.col(label) == 1, 1).otherwise(0)).cast("bigint").alias("_npos"),
        F.sum(F.when(F.col(label) == 1, 0).otherwise(1)).cast("bigint").alias("_nneg"))
    r = running_totals(g, keys, [F.col(score).desc()], ["_npos"], prefix="_cum")
    term = F.col("_nneg") * (F.col("_cum_npos") - F.col("_npos") / F.lit(2.0))
    return r.groupBy(*keys).agg(
        F.try_divide(F.sum(term), F.sum("_npos").cast("double") * F.sum("_nneg")).alias("roc_auc"))


def metrics_by(df: DataFrame, keys: Sequence[str], label: str = "label", score: str = "p",
               pred: str = "pred") -> DataFrame:
    """accuracy, precision, recall, F1 (of class 1; 0 when undefined) and
    ROC-AUC per key group."""
    keys = list(keys)
    y, yh = F.col(label), F.col(pred)
    cnt = df.groupBy(*keys).agg(
        F.count_if((y == 1) & (yh == 1)).alias("tp"), F.count_if((y == 0) & (yh == 1)).alias("fp"),
        F.count_if((y == 0) & (yh == 0)).alias("tn"), F.count_if((y == 1) & (yh == 0)).alias("fn"))
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    m = cnt.select(*keys,
                   F.try_divide(tp + tn, tp + fp + tn + fn).alias("accuracy"),
                   _zero(F.try_divide(tp, tp + fp)).alias("precision"),
                   _zero(F.try_divide(tp, tp + fn)).alias("recall"),
                   _zero(F.try_divide(tp * 2, tp * 2 + fp + fn)).alias("f1"))
    if keys:
        return m.join(auc_by(df, keys, label, score), keys, "left")
    one = df.withColumn("_all", F.lit(0))
    return (metrics_by(one, ["_all"], label, score, pred)).drop("_all")


def classification_metrics(df: DataFrame, label: str = "label", score: str = "p", pred: str = "pred") -> DataFrame:
    out = metrics_by(df, [], label, score, pred)
    return out.select(*[R6(F.col(c)).alias(c) for c in METRICS])


def long_metrics(wide: DataFrame, keys: Sequence[str]) -> DataFrame:
    pairs = ", ".join(f"'{m}', {m}" for m in METRICS)
    return wide.selectExpr(*keys, f"stack({len(METRICS)}, {pairs}) AS (metric, value)")


def cv_summary(fold_metrics: DataFrame, keys: Sequence[str] = ("model",)) -> DataFrame:
    """Mean and population std (numpy ddof=0) of every metric over folds."""
    long = long_metrics(fold_metrics, [*keys, "fold"])
    return long.groupBy(*keys, "metric").agg(R6(F.avg("value")).alias("mean"),
                                             R6(F.stddev_pop("value")).alias("std"))


# D15 / D16 -----------------------------------------------------------------------------------------

def _cumulative(df: DataFrame, label: str, score: str) -> DataFrame:
    g = df.groupBy(score).agg(F.sum(F.when(F.col(label) == 1, 1).otherwise(0)).cast("bigint").alias("pos"),
                              F.sum(F.when(F.col(label) == 1, 0).otherwise(1)).cast("bigint").alias("neg"))
    r = running_totals(g, [], [F.col(score).desc()], ["pos", "neg"], prefix="cum_")
    tot = C.row_scalars(g.agg(F.sum("pos").alias("P"), F.sum("neg").alias("N")))
    return r.select(F.col(score).alias("threshold"), "cum_pos", "cum_neg",
                    tot["P"].alias("P"), tot["N"].alias("N"))


def roc_curve(df: DataFrame, label: str = "label", score: str = "p") -> DataFrame:
    """One point per distinct score (threshold): fpr, tpr of score >= threshold.
    Collinear points are kept (same area as the thinned curve)."""
    c = _cumulative(df, label, score)
    return c.select(R6(F.col("threshold")).alias("threshold"),
                    R6(F.try_divide(F.col("cum_neg"), F.col("N"))).alias("fpr"),
                    R6(F.try_divide(F.col("cum_pos"), F.col("P"))).alias("tpr"))


def roc_points(df: DataFrame, label: str = "label", score: str = "p", rule: str = "collinear") -> DataFrame:
    """The ROC curve without the points that its shape does not need, from the origin (threshold null):
    threshold, cum_neg, cum_pos, fpr, tpr, n_scores (distinct scores, hence points before thinning).

    ``collinear`` drops every point on the straight line between its neighbours; ``equal_steps``
    drops those that repeat the step before them (but never the first score), as plotting libraries do.
    Either way the polyline and its area stay the same.  The next step of a slice's last score
    is the first of the next slice.  Rows without a score take no part."""
    if rule not in ("collinear", "equal_steps"):
        raise ValueError(f"unknown rule: {rule}")
    g = df.where(F.col(score).isNotNull()).groupBy(F.col(score).alias("threshold")).agg(
        F.count_if(F.coalesce(F.col(label) == 1, F.lit(False))).alias("pos"), F.count(F.lit(1)).alias("n"))
    g = g.select("threshold", "pos", (F.col("n") - F.col("pos")).alias("neg"))
    r = running_totals(g, [], [F.col("threshold").desc()], ["pos", "neg"], prefix="cum_", ahead=["pos", "neg"])
    wide = {c: F.col(c).cast("decimal(19,0)") for c in ("pos", "neg", "next_pos", "next_neg")}
    if rule == "collinear":
        turns = wide["pos"] * wide["next_neg"] != wide["next_pos"] * wide["neg"]
    else:
        turns = (F.col("pos") != F.col("next_pos")) | (F.col("neg") != F.col("next_neg")) \
            | ((F.col("pos") == F.col("cum_pos")) & (F.col("neg") == F.col("cum_neg")))
    kept = r.where(F.col("next_pos").isNull() | turns).select("threshold", "cum_neg", "cum_pos")
    zero = F.lit(0).cast("bigint")
    start = df.sparkSession.range(1).select(F.lit(None).cast(g.schema["threshold"].dataType).alias("threshold"), zero.alias("cum_neg"), zero.alias("cum_pos"))
    t = C.row_scalars(g.agg(F.sum("pos").alias("P"), F.sum("neg").alias("N"), F.count(F.lit(1)).alias("scores")))
    return kept.unionByName(start).select(
        "threshold", "cum_neg", "cum_pos", F.try_divide("cum_neg", t["N"]).alias("fpr"),
        F.try_divide("cum_pos", t["P"]).alias("tpr"), t["scores"].alias("n_scores"))


def roc_sketch(df: DataFrame, label: str = "label", score: str = "p", bins: int = 1000) -> DataFrame:
    """The ROC curve of scores in [0, 1] counted in ``bins`` equal bins, for a curve of bounded length: threshold
    (lower end of the bin), fpr, tpr, and ``area_error``, which the area under the sketch is at most off by.

    Counts of bins add up over any parts of the rows.  Inside a bin the true curve lies in the box of its
    negatives and positives, and its diagonal is at most half the box away: the error is the sum of half boxes."""
    at = F.least(F.greatest(F.floor(F.col(score) * bins), F.lit(0)), F.lit(bins - 1)).cast("int")
    g = df.where(F.col(score).isNotNull()).groupBy(at.alias("bin")).agg(
        F.count_if(F.coalesce(F.col(label) == 1, F.lit(False))).alias("pos"), F.count(F.lit(1)).alias("n"))
    g = g.select("bin", "pos", (F.col("n") - F.col("pos")).alias("neg"))
    upto = Window.orderBy(F.col("bin").desc()).rowsBetween(Window.unboundedPreceding, 0)      # at most ``bins`` rows
    every = Window.partitionBy()
    x = g.select("bin", F.sum("pos").over(upto).alias("cp"), F.sum("neg").over(upto).alias("cn"), F.sum("pos").over(every).alias("P"),
                 F.sum("neg").over(every).alias("N"), F.sum(F.col("pos") * F.col("neg").cast("double")).over(every).alias("boxes"))
    return x.select((F.col("bin") / F.lit(float(bins))).alias("threshold"), F.try_divide("cn", "N").alias("fpr"), F.try_divide("cp", "P").alias("tpr"),
                    F.try_divide(F.col("boxes") / 2, F.col("P") * F.col("N").cast("double")).alias("area_error"))


def roc_auc(df: DataFrame, label: str = "label", score: str = "p") -> DataFrame:
    return auc_by(df, [], label, score).select(R6(F.col("roc_auc")).alias("roc_auc"))


def pr_curve(df: DataFrame, label: str = "label", score: str = "p") -> DataFrame:
    """precision / recall per threshold, plus the final (recall 0, precision 1) point."""
    c = _cumulative(df, label, score)
    pts = c.select(R6(F.col("threshold")).alias("threshold"),
                   R6(F.try_divide(F.col("cum_pos"), F.col("cum_pos") + F.col("cum_neg"))).alias("precision"),
                   R6(F.try_divide(F.col("cum_pos"), F.col("P"))).alias("recall"))
    end = df.sparkSession.range(1).select(F.lit(None).cast("double").alias("threshold"),
                                          F.lit(1.0).alias("precision"), F.lit(0.0).alias("recall"))
    return pts.unionByName(end)


# D17 / D18 ------------------------------------------------------------------------------------------

def score_histogram(scores: DataFrame, value: str = "value", by: str = "model", bins: int = 10) -> DataFrame:
    """Counts of per-fold scores in ``bins`` equal-width bins per ``by`` group."""
    rng = scores.groupBy(by).agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    j = scores.join(rng, by)      # one row per group on the right
    b = C.equal_width_bucket(F.col(value), F.col("lo"), F.col("hi"), bins)
    return j.groupBy(by, b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def confusion_matrix(df: DataFrame, label: str = "label", pred: str = "pred") -> DataFrame:
    """All four cells, zero-filled: (actual, predicted, count)."""
    spark = df.sparkSession
    grid = spark.createDataFrame([(a, p) for a in (0, 1) for p in (0, 1)], "actual int, predicted int")
    c = df.groupBy(F.col(label).cast("int").alias("actual"), F.col(pred).cast("int").alias("predicted")) \
          .agg(F.count(F.lit(1)).alias("count"))
    return grid.join(c, ["actual", "predicted"], "left").select(
        "actual", "predicted", F.coalesce(F.col("count"), F.lit(0)).cast("bigint").alias("count"))


# D13 / D14 / D22 ---------------------------------------------------------------------------------------

def comparison_table(test: DataFrame, cv: DataFrame, order: DataFrame) -> DataFrame:
    """One row per model: Test_* and CV_* of the five metrics and the tuning
    score (mean CV F1); ``order`` (model, pos) keeps the listing order."""
    names = {"accuracy": "Accuracy", "precision": "Precision", "recall": "Recall", "f1": "F1",
             "roc_auc": "ROC_AUC"}
    t = test.select("model", *[R6(F.col(m)).alias(f"Test_{names[m]}") for m in METRICS])
    cvw = cv.groupBy("model").pivot("metric", METRICS).agg(F.first("mean"))
    cvw = cvw.select("model", *[F.col(m).alias(f"CV_{names[m]}") for m in METRICS])
    j = order.join(t, "model").join(cvw, "model")
    return j.select(F.col("model").alias("Model"), "pos", *[c for c in j.columns if c.startswith("Test_")],
                    *[c for c in j.columns if c.startswith("CV_")], F.col("CV_F1").alias("Tuning_Score"))


def best_model(comparison: DataFrame) -> DataFrame:
    """First model with the maximum CV F1."""
    return comparison.orderBy(F.col("CV_F1").desc(), F.col("pos").asc()).limit(1)


def performance_verdict(row: DataFrame, auc: str = "Test_ROC_AUC", f1: str = "Test_F1",
                        cv_f1: str = "CV_F1") -> DataFrame:
    def tiers(c: Column, spec) -> Column:
        expr = None
        for cut, text in spec:
            if cut is None:
                return expr.otherwise(F.lit(text))
            expr = F.when(c > cut, F.lit(text)) if expr is None else expr.when(c > cut, F.lit(text))
        return expr

    gap = F.abs(F.col(cv_f1) - F.col(f1))
    return row.select(
        "Model",
        tiers(F.col(auc), S.VERDICT_AUC).alias("auc_verdict"),
        tiers(F.col(f1), S.VERDICT_F1).alias("f1_verdict"),
        F.when(gap < S.VERDICT_GAP, F.lit(S.VERDICT_GAP_OK)).otherwise(F.lit(S.VERDICT_GAP_BAD))
         .alias("generalization_verdict"))
