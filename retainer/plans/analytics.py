"""Registered queries E3-E14 (descriptive analytics) and F1-F9 (dashboard).

All read ``enhanced`` -- scored customers with the rule segment and the risk
level -- and reduce it with one group-by each.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from retainer import schema as S
from retainer.operators import describe as D
from retainer.plans.catalog import HIGH, PERF_CTES, SEG_CHURN_CTE, register
from retainer.plans.oracle import q
from retainer.sources import tables as TB

ENH = TB.enhanced_customers

NUMERIC_PROFILE = ["CreditScore", "Age", "Tenure", "Balance", "NumOfProducts", "HasCrCard",
                   "IsActiveMember", "EstimatedSalary", "Exited", "ChurnProbability"]
CORR_COLUMNS = ["CreditScore", "Age", "Tenure", "Balance", "NumOfProducts", "HasCrCard",
                "IsActiveMember", "EstimatedSalary", "Exited", "ChurnProbability", "RiskLevelNumeric"]
RISK_NUM_SQL = ("CASE RiskLevel WHEN 'Low Risk' THEN 0 WHEN 'Medium Risk' THEN 1 "
                "WHEN 'High Risk' THEN 2 WHEN 'Very High Risk' THEN 3 END")


def _pct_sql(col: str, out: str) -> str:
    return (f"SELECT {col} AS {out}, count(*) AS count, "
            f"ROUND(count(*) * 100e0 / sum(count(*)) OVER (), 6) AS percent FROM enhanced GROUP BY {col}")


# E3 / F2 -------------------------------------------------------------------------------------------

@register("risk_distribution", q(_pct_sql("RiskLevel", "RiskLevel")))
def risk_distribution(spark, d):
    return D.risk_distribution(ENH(spark, d))


@register("risk_share", q(_pct_sql("RiskLevel", "RiskLevel")))
def risk_share(spark, d):
    return D.risk_share(ENH(spark, d))


@register("segment_share", q(_pct_sql("SegmentName", "segment")))
def segment_share(spark, d):
    return D.segment_share(ENH(spark, d))


# E4 / F1 / F3 ----------------------------------------------------------------------------------------

@register("churn_by_segment", q(
    "SELECT SegmentName, ROUND(avg(Exited), 6) AS churn_rate FROM enhanced GROUP BY SegmentName"))
def churn_by_segment(spark, d):
    return D.churn_by_segment(ENH(spark, d))


@register("overall_churn_rate", q("SELECT ROUND(avg(Exited) * 100e0, 6) AS churn_rate_pct FROM enhanced"))
def overall_churn_rate(spark, d):
    return D.overall_churn_rate(ENH(spark, d))


@register("segment_churn_pct", q(
    "SELECT SegmentName AS segment, ROUND(avg(Exited) * 100e0, 6) AS churn_pct FROM enhanced GROUP BY SegmentName"))
def segment_churn_pct(spark, d):
    return D.segment_churn_pct(ENH(spark, d))


# E5 ----------------------------------------------------------------------------------------------------

def _crosstab_sql() -> str:
    keys = D.RISK_KEYS
    counts = ", ".join(f"CAST(count_if(RiskLevel = '{lv}') AS BIGINT) AS n_{k}" for lv, k in zip(S.RISK_LEVELS, keys))
    total = " + ".join(f"n_{k}" for k in keys)
    shares = ", ".join(f"ROUND(n_{k} / ({total}), 6) AS share_{k}" for k in keys)
    ns = ", ".join(f"n_{k}" for k in keys)
    return q(f"SELECT SegmentName, {ns}, {shares} FROM "
             f"(SELECT SegmentName, {counts} FROM enhanced GROUP BY SegmentName) t")


@register("risk_segment_crosstab", _crosstab_sql())
def risk_segment_crosstab(spark, d):
    return D.risk_segment_crosstab(ENH(spark, d))


# E6 ----------------------------------------------------------------------------------------------------

@register("probability_histogram", q("""
SELECT bin, Exited, count(*) AS n,
       ROUND(lo + (bin - 1) * ((hi - lo) / 30e0), 6) AS bin_start,
       ROUND(lo + bin * ((hi - lo) / 30e0), 6) AS bin_end
FROM (SELECT Exited, lo, hi,
             CAST(CASE WHEN hi - lo = 0 THEN 1
                       ELSE LEAST(CAST(floor((ChurnProbability - lo) * 30e0 / (hi - lo)) AS INT) + 1, 30) END AS INT) AS bin
      FROM enhanced, (SELECT min(ChurnProbability) AS lo, max(ChurnProbability) AS hi FROM enhanced) r) t
GROUP BY bin, Exited, lo, hi"""))
def probability_histogram(spark, d):
    return D.probability_histogram(ENH(spark, d))


# E7 ----------------------------------------------------------------------------------------------------

DENSITY_FEATURES = ["Age", "Balance", "EstimatedSalary", "Tenure"]


def _density_sql(grid: int = 50, bins: int = 512) -> str:
    long = "\n    UNION ALL ".join(
        f"SELECT SegmentName AS segment, '{f}' AS feature, CAST({f} AS DOUBLE) AS x FROM enhanced"
        for f in DENSITY_FEATURES)
    return q(f"""
SELECT segment, feature, CAST(g AS INTEGER) AS grid_index, ROUND(gx, 6) AS x,
       ROUND(k / NULLIF(n * h * sqrt(2 * pi()), 0) * 1e6, 6) AS density_e6
FROM (SELECT p.segment, p.feature, p.g, p.gx, p.n, p.h,
             sum(b.cnt * exp(-5e-1 * ((p.gx - b.c) / p.h) * ((p.gx - b.c) / p.h))) AS k
      FROM pts p JOIN binned b ON p.segment = b.segment AND p.feature = b.feature
      GROUP BY p.segment, p.feature, p.g, p.gx, p.n, p.h) t""", f"""
long AS (SELECT * FROM ({long}) u WHERE x IS NOT NULL),
st AS (SELECT segment, feature, count(*) AS n, min(x) AS lo, max(x) AS hi, stddev_samp(x) AS sd
       FROM long GROUP BY segment, feature),
bucketed AS (
  SELECT l.segment, l.feature, st.lo, st.hi,
         CASE WHEN st.hi - st.lo = 0 THEN 1
              ELSE LEAST(CAST(floor((l.x - st.lo) * {float(bins)} / (st.hi - st.lo)) AS INT) + 1, {bins}) END AS b
  FROM long l JOIN st ON l.segment = st.segment AND l.feature = st.feature),
binned AS (
  SELECT segment, feature, count(*) AS cnt,
         lo + (b - 5e-1) * ((hi - lo) / {float(bins)}) AS c
  FROM bucketed GROUP BY segment, feature, b, lo, hi),
pts AS (
  SELECT segment, feature, n, lo, hi, sd * pow(CAST(n AS DOUBLE), -2e-1) AS h, g,
         lo + g * (hi - lo) / {float(grid - 1)} AS gx
  FROM st, (SELECT unnest(range(0, {grid})) AS g) gg)""")


@register("segment_density", _density_sql())
def segment_density(spark, d):
    return D.segment_density(ENH(spark, d), DENSITY_FEATURES)


# E8 ----------------------------------------------------------------------------------------------------

def _corr_sql() -> str:
    cols = CORR_COLUMNS
    src = f"(SELECT *, {RISK_NUM_SQL} AS RiskLevelNumeric FROM enhanced) e"
    parts = []
    for i, a in enumerate(cols):
        for b in cols[:i]:
            parts.append(
                f"SELECT '{a}' AS col_a, '{b}' AS col_b, ROUND(covar_pop(CAST({a} AS DOUBLE), CAST({b} AS DOUBLE)) "
                f"/ NULLIF(stddev_pop(CAST({a} AS DOUBLE)) * stddev_pop(CAST({b} AS DOUBLE)), 0e0), 6) AS r FROM {src}")
    return q("\nUNION ALL\n".join(parts))


@register("correlation_pairs", _corr_sql())
def correlation_pairs(spark, d):
    return D.correlation_pairs(ENH(spark, d), CORR_COLUMNS)


# E9 ----------------------------------------------------------------------------------------------------

@register("risk_by_age_balance", q(
    f"SELECT CustomerId, Age, Balance, CAST({RISK_NUM_SQL} AS INT) AS RiskLevelNumeric FROM enhanced"))
def risk_by_age_balance(spark, d):
    return D.risk_by_age_balance(ENH(spark, d))


# E10 ---------------------------------------------------------------------------------------------------

@register("segment_insights", q(f"""
SELECT segment, size, ROUND(size / sum(size) OVER (), 6) AS share,
       ROUND(churn_rate, 6) AS churn_rate, ROUND(avg_age, 6) AS avg_age,
       ROUND(avg_balance, 6) AS avg_balance, ROUND(avg_tenure, 6) AS avg_tenure,
       ROUND(high_risk_pct, 6) AS high_risk_pct
FROM (SELECT SegmentName AS segment, count(*) AS size, avg(Exited) AS churn_rate, avg(Age) AS avg_age,
             avg(Balance) AS avg_balance, avg(Tenure) AS avg_tenure,
             avg(CASE WHEN {HIGH} THEN 1 ELSE 0 END) AS high_risk_pct
      FROM enhanced GROUP BY SegmentName) t"""))
def segment_insights(spark, d):
    return D.segment_insights(ENH(spark, d))


# E11 / E12 / E13 -------------------------------------------------------------------------------------------

@register("high_risk_customers", q(f"""
SELECT CustomerId, SegmentName, Age, Balance, ChurnProbability, RiskLevel
FROM enhanced WHERE {HIGH}"""))
def high_risk_customers(spark, d):
    return D.high_risk_customers(ENH(spark, d)).select(
        "CustomerId", "SegmentName", "Age", "Balance", "ChurnProbability", "RiskLevel")


def _describe_sql() -> str:
    parts = []
    for c in NUMERIC_PROFILE:
        v = f"CAST({c} AS DOUBLE)"
        parts.append(
            f"SELECT '{c}' AS column, count({c}) AS count, ROUND(avg({v}), 6) AS mean, "
            f"ROUND(stddev_samp({v}), 6) AS std, ROUND(min({v}), 6) AS min, "
            f"ROUND(quantile_cont({v}, 0.25), 6) AS p25, ROUND(quantile_cont({v}, 0.5), 6) AS p50, "
            f"ROUND(quantile_cont({v}, 0.75), 6) AS p75, ROUND(max({v}), 6) AS max FROM enhanced WHERE {HIGH}")
    return q("\nUNION ALL\n".join(parts))


@register("high_risk_profile", _describe_sql())
def high_risk_profile(spark, d):
    return D.describe_exact(D.high_risk_customers(ENH(spark, d)), NUMERIC_PROFILE)


@register("high_risk_summary", q(f"""
SELECT CAST(count_if({HIGH}) AS BIGINT) AS n_high_risk,
       ROUND(avg(CASE WHEN {HIGH} THEN 1 ELSE 0 END), 6) AS share,
       ROUND(avg(CASE WHEN {HIGH} THEN Age END), 6) AS avg_age,
       ROUND(avg(CASE WHEN {HIGH} THEN Balance END), 6) AS avg_balance,
       ROUND(avg(CASE WHEN {HIGH} THEN Tenure END), 6) AS avg_tenure,
       ROUND(avg(CASE WHEN {HIGH} THEN IsActiveMember END), 6) AS active_share
FROM enhanced"""))
def high_risk_summary(spark, d):
    return D.high_risk_summary(ENH(spark, d))


# F4 / F5 / F6 / F7 / F9 ----------------------------------------------------------------------------------

@register("segment_details", q("""
SELECT SegmentName AS segment, CAST(min(Age) AS VARCHAR) || '-' || CAST(max(Age) AS VARCHAR) || ' years' AS age_range,
       ROUND(avg(Balance), 6) AS avg_balance, ROUND(avg(NumOfProducts), 6) AS avg_products,
       ROUND(avg(HasCrCard) * 100e0, 6) AS digital_adoption, ROUND(avg(Tenure), 6) AS tenure,
       ROUND(avg(IsActiveMember) * 100e0, 6) AS active_rate, ROUND(avg(CreditScore), 6) AS credit_score
FROM enhanced GROUP BY SegmentName"""))
def segment_details(spark, d):
    x = D.segment_details(ENH(spark, d))
    return x.select("segment", "age_range", *[F.round(c, 6).alias(c) for c in x.columns[2:]])


@register("high_risk_count", q(f"SELECT CAST(count_if({HIGH}) AS BIGINT) AS high_risk_customers FROM enhanced"))
def high_risk_count(spark, d):
    return D.high_risk_count(ENH(spark, d))


@register("segment_performance", q("""
SELECT segment, ltv, retention_cost,
       CASE WHEN retention_cost > 0 THEN round_even(ltv / retention_cost, 1) ELSE 1e0 END AS profitability_index,
       CASE segment WHEN 'Young Professionals' THEN 'High' WHEN 'Established Savers' THEN 'Medium'
                    WHEN 'High-Value Clients' THEN 'Medium' ELSE 'Low' END AS growth_potential
FROM perf""", PERF_CTES))
def segment_performance(spark, d):
    return D.segment_performance(D.segment_details(ENH(spark, d)))


@register("segment_roi", q("""
SELECT segment, implementation_cost, projected_savings,
       GREATEST(CAST(trunc((projected_savings * 4e-1 - implementation_cost) / NULLIF(CAST(implementation_cost AS DOUBLE), 0) * 100) AS BIGINT), 10) AS roi_1year,
       GREATEST(CAST(trunc((projected_savings * 12e-1 - implementation_cost) / NULLIF(CAST(implementation_cost AS DOUBLE), 0) * 100) AS BIGINT), 50) AS roi_3year
FROM (SELECT segment, implementation_cost,
             CAST(trunc(implementation_cost * 25e-1 * (1 - churn)) AS BIGINT) AS projected_savings
      FROM (SELECT p.segment,
                   CAST(trunc((COALESCE(s.percent, 25e0) / 100) * 5000000) AS BIGINT) AS implementation_cost,
                   COALESCE(c.churn_pct, 15e0) / 100 AS churn
            FROM perf p
            LEFT JOIN (SELECT SegmentName AS segment,
                              ROUND(count(*) * 100e0 / sum(count(*)) OVER (), 6) AS percent
                       FROM enhanced GROUP BY SegmentName) s ON p.segment = s.segment
            LEFT JOIN (SELECT segment, ROUND(churn_pct, 6) AS churn_pct FROM seg_churn) c
                   ON p.segment = c.segment) a) b""", PERF_CTES + "," + SEG_CHURN_CTE))
def segment_roi(spark, d):
    enh = ENH(spark, d)
    perf = D.segment_performance(D.segment_details(enh))
    return D.segment_roi(perf, D.segment_share(enh), D.segment_churn_pct(enh))


@register("high_risk_estimate", q(f"""
SELECT CAST(ROUND(COALESCE(sum(CASE WHEN {HIGH} THEN percent ELSE 0e0 END), 0e0) / 100e0 * 10000) AS BIGINT)
       AS high_risk_estimate
FROM (SELECT RiskLevel, ROUND(count(*) * 100e0 / sum(count(*)) OVER (), 6) AS percent
      FROM enhanced GROUP BY RiskLevel) t"""))
def high_risk_estimate(spark, d):
    return D.high_risk_estimate(D.risk_share(ENH(spark, d)))
