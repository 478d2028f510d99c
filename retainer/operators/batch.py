"""G1-G12 batch scoring and the batch result analytics; A3 and A10.

``score_batch`` is a lazy DataFrame -> DataFrame plan with no action in it,
so the same function scores a file, a table or a stream.  The analytics
after it are single group-bys over the scored table; callers that run
several of them ``cache()`` or write the scored table once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from retainer import schema as S
from retainer.functions import columns as C
from retainer.operators import features as FE
from retainer.operators.stats import exact_median, row_positions

R6 = C.bround6
MODEL_INPUTS = ("CreditScore", "Geography", "Gender", "Age", "Tenure", "Balance", "NumOfProducts",
                "HasCrCard", "IsActiveMember", "EstimatedSalary")


# scorers -------------------------------------------------------------------------------------

class RuleScorer:
    """Deterministic stand-in for a fitted model (1.8 x the additive rule)."""

    def transform(self, df: DataFrame, out: str = "ChurnProbability") -> DataFrame:
        return df.withColumn(out, C.proxy_probability())


class AdditiveScorer:
    """The unscaled additive rule, clipped to [0, 1]."""

    def transform(self, df: DataFrame, out: str = "ChurnProbability") -> DataFrame:
        return df.withColumn(out, C.clip01(C.additive_risk_terms()))


class ModelScorer:
    """A fitted ``PipelineModel`` (``models.train_and_compare``) over the raw
    customer columns; adds P(class 1).  A row with a null input gets a null
    probability.  The row travels as one struct, so its columns cannot clash with
    those the pipeline makes."""

    def __init__(self, model, inputs: Sequence[str] = MODEL_INPUTS):
        self.model = model
        self.inputs = list(inputs)

    def transform(self, df: DataFrame, out: str = "ChurnProbability") -> DataFrame:
        from pyspark.ml.functions import vector_to_array

        raw = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row"), *self.inputs)
        scored = self.model.transform(raw)
        known = F.lit(True)
        for c in self.inputs:
            known = known & F.col(f"_row.{c}").isNotNull()
        p = F.when(known, vector_to_array(F.col("probability"))[1])
        return scored.select("_row.*", p.alias(out))


# A3 ------------------------------------------------------------------------------------------

def require_columns(df: DataFrame, required: Sequence[str] = S.REQUIRED_FIELDS, filled: bool = False) -> DataFrame:
    """Refuse input missing any required column: a schema check without a job.  With ``filled`` a column
    without a single value is missing too (one aggregate; an empty table then lacks all of them)."""
    missing = [c for c in required if c not in df.columns]
    if filled and not missing:
        has = df.agg(*[F.coalesce(F.max(F.col(c).isNotNull()), F.lit(False)).alias(c) for c in required]).first()
        missing = [c for c in required if not has[c]]
    if missing:
        raise ValueError(f"Missing required fields: {', '.join(missing)}")
    return df


# A10 -----------------------------------------------------------------------------------------

def assign_customer_ids(df: DataFrame, order: Sequence[str | Column],
                        prefix: str = S.CUSTOMER_ID_PREFIX, base: int = S.CUSTOMER_ID_BASE) -> DataFrame:
    """``CustomerId`` = prefix + (global position along ``order`` + base).

    Positions come from range partitioning plus per-partition prefix counts,
    never from an unpartitioned ``row_number``."""
    pos = row_positions(df.drop("CustomerId") if "CustomerId" in df.columns else df, order)
    cid = F.concat(F.lit(prefix), (F.col("_pos") + F.lit(base)).cast("string"))
    return pos.withColumn("CustomerId", cid).drop("_pos")


# G1 ------------------------------------------------------------------------------------------

def score_batch(df: DataFrame, scorer=None, id_order: Sequence[str | Column] | None = None) -> DataFrame:
    """Contract check -> flag normalisation -> serving features -> score ->
    risk level -> rule segment -> id -> the 12 result columns."""
    scorer = scorer or RuleScorer()
    require_columns(df)
    x = FE.normalize_flags(df, gender_column="Gender_Male")
    x = FE.serving_features(x)
    x = scorer.transform(x)
    x = (x.withColumn("RiskLevel", C.risk_level(F.col("ChurnProbability")))
          .withColumn("Segment", C.rule_segment()))
    if "CustomerId" in x.columns:
        x = x.withColumn("CustomerId", F.col("CustomerId").cast("string"))
    else:
        order = list(id_order) if id_order else [c for c in S.REQUIRED_FIELDS]
        x = assign_customer_ids(x, order)
    return x.select("CustomerId", *S.BATCH_RESULT_COLUMNS)


# G2 ------------------------------------------------------------------------------------------

def _key(name: str) -> str:
    return name.lower().replace(" risk", "").replace(" ", "_").replace("-", "_")


def batch_summary(results: DataFrame) -> DataFrame:
    """Totals, mean probability, high-risk count and the risk / segment
    percentages, from one aggregate pass."""
    n = F.count(F.lit(1))
    pct = {}
    for lv in S.RISK_LEVELS:
        pct[f"risk_pct_{_key(lv)}"] = F.count_if(F.col("RiskLevel") == lv) * 100.0 / n
    for sg in S.SEGMENTS:
        pct[f"segment_pct_{_key(sg)}"] = F.count_if(F.col("Segment") == sg) * 100.0 / n
    return results.agg(
        n.alias("total_customers"),
        R6(F.avg("ChurnProbability")).alias("avg_churn_probability"),
        F.count_if(C.is_high_risk(F.col("RiskLevel"))).alias("high_risk_count"),
        *[R6(v).alias(k) for k, v in pct.items()])


# G3 / G12 ----------------------------------------------------------------------------------------

def rank_order() -> list[Column]:
    """Descending probability, ties broken by the unique id."""
    return [F.col("ChurnProbability").desc(), F.col("CustomerId").asc()]


def top_risk_customers(results: DataFrame, n: int = 20) -> DataFrame:
    """Top-n by probability (ties by id): a distributed take-ordered."""
    return (results.orderBy(*rank_order()).limit(n)
                   .select("CustomerId", "Segment", "ChurnProbability", "RiskLevel"))


def result_page(results: DataFrame, page: int = 1, per_page: int = 5) -> DataFrame:
    """One page of the ranked results plus the page count."""
    total = results.agg(F.count(F.lit(1)).alias("n"))
    pages = F.ceil(total.select("n").scalar() / F.lit(float(per_page))).cast("bigint")
    start = (page - 1) * per_page
    rows = results.orderBy(*rank_order()).offset(start).limit(per_page)
    ranked = rows.withColumn("_r", F.row_number().over(Window.orderBy(*rank_order())))
    return ranked.select((F.col("_r") + F.lit(start)).cast("bigint").alias("rank"),
                         "CustomerId", "Segment", "ChurnProbability", "RiskLevel",
                         pages.alias("total_pages"))


# G4 / G5 -------------------------------------------------------------------------------------------

def batch_segment_insights(results: DataFrame) -> DataFrame:
    return results.groupBy("Segment").agg(
        R6(F.avg("ChurnProbability") * 100.0).alias("avg_churn"),
        F.count(F.lit(1)).alias("count"))


def batch_risk_insights(results: DataFrame) -> DataFrame:
    return results.groupBy("RiskLevel").agg(
        R6(F.avg("ChurnProbability") * 100.0).alias("avg_probability"),
        F.count(F.lit(1)).alias("count"))


# G6 -------------------------------------------------------------------------------------------------

def segment_analysis(results: DataFrame) -> DataFrame:
    """Per segment: count, age mean/min/max, balance mean/median, churn
    mean/median/sample-std in percent.  Medians are exact and distributed."""
    g = results.groupBy("Segment").agg(
        F.count(F.lit(1)).alias("count"),
        F.avg("Age").alias("age_mean"), F.min("Age").alias("age_min"), F.max("Age").alias("age_max"),
        F.avg("Balance").alias("balance_mean"),
        (F.avg("ChurnProbability") * 100.0).alias("churn_mean"),
        (F.stddev_samp("ChurnProbability") * 100.0).alias("churn_std"))
    med = exact_median(results, ["Segment"], ["Balance", "ChurnProbability"])
    j = g.join(med, "Segment", "left")
    return j.select("Segment", "count", R6(F.col("age_mean")).alias("age_mean"),
                    "age_min", "age_max", R6(F.col("balance_mean")).alias("balance_mean"),
                    R6(F.col("Balance_median")).alias("balance_median"),
                    R6(F.col("churn_mean")).alias("churn_mean"),
                    R6(F.col("ChurnProbability_median") * 100.0).alias("churn_median"),
                    R6(F.col("churn_std")).alias("churn_std"))


def segment_risk_share(results: DataFrame) -> DataFrame:
    """Percent of each risk level within each segment."""
    c = results.groupBy("Segment", "RiskLevel").agg(F.count(F.lit(1)).alias("n"))
    tot = F.sum("n").over(Window.partitionBy("Segment"))
    return c.select("Segment", "RiskLevel", R6(F.col("n") * 100.0 / tot).alias("pct"))


# G7 / G8 --------------------------------------------------------------------------------------------

def financial_impact(results: DataFrame, performance: DataFrame) -> DataFrame:
    """Expected churn, revenue at risk, retention cost, savings and ROI per
    segment.  ``performance`` (one row per segment) supplies ltv and unit
    cost; absent segments fall back to 5000 / 300."""
    g = results.groupBy("Segment").agg(
        F.count(F.lit(1)).alias("customer_count"),
        F.avg("ChurnProbability").alias("p"),
        F.count_if(C.is_high_risk(F.col("RiskLevel"))).alias("high_risk_count"))
    perf = performance.select(F.col("segment").alias("Segment"), "ltv", "retention_cost")
    j = g.join(perf, "Segment", "left")
    ltv = F.coalesce(F.col("ltv").cast("double"), F.lit(S.FINANCE_DEFAULT_LTV))
    unit = F.coalesce(F.col("retention_cost").cast("double"), F.lit(S.FINANCE_DEFAULT_UNIT_COST))
    x = j.select("Segment", "customer_count", "p", "high_risk_count", ltv.alias("ltv"),
                 (F.col("customer_count") * F.col("p")).alias("expected"),
                 (F.col("high_risk_count") * unit).alias("cost"))
    saved = F.when(F.col("cost") > 0, F.col("expected") * F.lit(0.3) * F.col("ltv")).otherwise(F.lit(0.0))
    roi = F.when(F.col("cost") > 0, (saved - F.col("cost")) / F.col("cost") * F.lit(100)).otherwise(F.lit(0.0))
    return x.select(
        "Segment", "customer_count", R6(F.col("p")).alias("expected_churn_rate"),
        R6(F.col("expected")).alias("expected_churn_count"), "ltv",
        R6(F.col("expected") * F.col("ltv")).alias("potential_revenue_loss"),
        "high_risk_count", R6(F.col("cost")).alias("retention_cost"),
        R6(saved).alias("potential_savings"), R6(roi).alias("roi"))


def portfolio_totals(impact: DataFrame, results: DataFrame) -> DataFrame:
    """Sums over the segment finance rows plus overall ROI and high-risk %."""
    tot = impact.agg(F.sum("potential_revenue_loss").alias("loss"),
                     F.sum("retention_cost").alias("cost"),
                     F.sum("potential_savings").alias("savings"))
    summ = results.agg(F.count(F.lit(1)).alias("n"),
                       F.count_if(C.is_high_risk(F.col("RiskLevel"))).alias("hr"),
                       F.avg("ChurnProbability").alias("p"))
    t, sm = C.row_scalars(tot), C.row_scalars(summ)
    loss, cost, savings = t["loss"], t["cost"], t["savings"]
    n, hr, p = sm["n"], sm["hr"], sm["p"]
    roi = F.when(cost > 0, (savings - cost) / cost * F.lit(100)).otherwise(F.lit(0.0))
    hr_pct = F.when(n > 0, hr * F.lit(100.0) / n).otherwise(F.lit(0.0))
    return results.sparkSession.range(1).select(
        n.alias("total_customers"), R6(p * F.lit(100.0)).alias("avg_churn_pct"),
        hr.alias("high_risk_count"), R6(hr_pct).alias("high_risk_pct"),
        R6(loss).alias("total_revenue_loss"), R6(cost).alias("total_retention_cost"),
        R6(savings).alias("total_potential_savings"), R6(roi).alias("overall_roi"))


# G9 / G10 / G11 ----------------------------------------------------------------------------------------

def filter_results(results: DataFrame, risk: str | None = None, segment: str | None = None,
                   band: str | None = None) -> DataFrame:
    """Conjunctive filter: risk level, segment, probability band in percent
    ``'min-max'`` (inclusive) or ``'min-'`` (open-ended; max 0 also open)."""
    cond: Column = F.lit(True)
    if risk:
        cond = cond & (F.col("RiskLevel") == risk)
    if segment:
        cond = cond & (F.col("Segment") == segment)
    if band:
        lo_s, _, hi_s = band.partition("-")
        lo = float(lo_s) if lo_s.strip() else 0.0
        hi = float(hi_s) if hi_s.strip() else 0.0
        pct = F.coalesce(F.col("ChurnProbability"), F.lit(0.0)) * F.lit(100.0)
        cond = cond & (pct >= lo)
        if hi:
            cond = cond & (pct <= hi)
    return results.filter(cond)


def _fixed_dim(spark, kind: str, values: Sequence[str]) -> DataFrame:
    return spark.createDataFrame([(kind, v, i) for i, v in enumerate(values)],
                                 "kind string, key string, pos int")


def filtered_distribution(filtered: DataFrame) -> DataFrame:
    """Percent of rows per risk level and per segment, all 8 keys present."""
    spark = filtered.sparkSession
    dims = _fixed_dim(spark, "risk", S.RISK_LEVELS).unionByName(_fixed_dim(spark, "segment", S.SEGMENTS))
    total = filtered.agg(F.count(F.lit(1)).alias("n")).select("n").scalar()
    counts = (filtered.groupBy(F.col("RiskLevel").alias("key")).agg(F.count(F.lit(1)).alias("c"))
              .withColumn("kind", F.lit("risk"))
              .unionByName(filtered.groupBy(F.col("Segment").alias("key"))
                           .agg(F.count(F.lit(1)).alias("c")).withColumn("kind", F.lit("segment"))))
    j = dims.join(counts, ["kind", "key"], "left")
    pct = F.when(total > 0, F.coalesce(F.col("c"), F.lit(0)) * F.lit(100.0) / total).otherwise(F.lit(0.0))
    return j.select("kind", "key", R6(pct).alias("pct"))


def filtered_segment_churn(filtered: DataFrame) -> DataFrame:
    """Mean probability in percent per fixed segment; 0 for an empty segment."""
    dims = _fixed_dim(filtered.sparkSession, "segment", S.SEGMENTS).select(F.col("key").alias("Segment"))
    avg = filtered.groupBy("Segment").agg(F.avg(F.coalesce(F.col("ChurnProbability"), F.lit(0.0))).alias("p"))
    j = dims.join(avg, "Segment", "left")
    return j.select("Segment", R6(F.coalesce(F.col("p") * F.lit(100.0), F.lit(0.0))).alias("avg_churn"))
