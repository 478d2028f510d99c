"""The registered queries: name -> (spark callable, oracle SQL or None).

Every callable takes (spark, sf_dir), reads the driver tables (through the
customer views of ``sources.tables``) and returns a lazy DataFrame.  The
oracle SQL for the same name computes the same table in DuckDB.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from retainer import schema as S
from retainer.functions import columns as C
from retainer.operators import batch as B
from retainer.operators import describe as D
from retainer.operators import features as FE
from retainer.operators import rules as H
from retainer.plans.oracle import q
from retainer.sources import files as IO
from retainer.sources import tables as TB

REGISTRY: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def register(name: str, sql: str | None):
    def deco(fn):
        REGISTRY[name] = (fn, sql)
        return fn
    return deco


def round_doubles(df: DataFrame, places: int = 6) -> DataFrame:
    return df.select(*[F.round(F.col(f.name), places).alias(f.name)
                       if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else F.col(f.name)
                       for f in df.schema.fields])


# shared SQL text ---------------------------------------------------------------------------------

def proxy_sql(x: str = "") -> str:
    p = f"{x}." if x else ""
    return f"""ROUND(LEAST(1e0, GREATEST(0e0, 18e-1 * (2e-2
    + 1e-1  * (1 - {p}IsActiveMember)
    + 5e-2  * (CASE WHEN {p}Age < 30 THEN 1 ELSE 0 END)
    + 8e-2  * (CASE WHEN {p}Age > 60 THEN 1 ELSE 0 END)
    + 1e-1  * (CASE WHEN {p}Balance < 10000 THEN 1 ELSE 0 END)
    + 15e-2 * (CASE WHEN {p}NumOfProducts = 1 THEN 1 ELSE 0 END)
    - 1e-1  * (CASE WHEN {p}Tenure > 5 THEN 1 ELSE 0 END)
    - 5e-2  * {p}HasCrCard
    + 1e-1  * (CASE WHEN {p}Geography = 'Germany' THEN 1 ELSE 0 END)))), 6)"""


def risk_sql(p: str = "ChurnProbability") -> str:
    return (f"CASE WHEN {p} IS NULL THEN NULL WHEN {p} < 0.25 THEN 'Low Risk' "
            f"WHEN {p} < 0.5 THEN 'Medium Risk' WHEN {p} < 0.75 THEN 'High Risk' ELSE 'Very High Risk' END")


def segment_sql(salary: bool = False) -> str:
    extra = " OR EstimatedSalary > 100000" if salary else ""
    return ("CASE WHEN Age < 36 THEN 'Young Professionals' WHEN Age >= 60 THEN 'At-Risk Seniors' "
            f"WHEN Balance > 100000 OR CreditScore > 750{extra} THEN 'High-Value Clients' "
            "ELSE 'Established Savers' END")


HIGH = "RiskLevel IN ('High Risk', 'Very High Risk')"

# scoring input with text flags, and the batch results of scoring it
SCORING_CTES = f"""
scoring_input AS (
  SELECT CustomerId, CreditScore, Geography, Gender, Age, Tenure, Balance, NumOfProducts,
         CAST(HasCrCard AS VARCHAR) AS HasCrCard,
         CASE WHEN IsActiveMember = 1 THEN 'Yes' ELSE 'No' END AS IsActiveMember, EstimatedSalary
  FROM churn_customers),
normalized AS (
  SELECT CustomerId, CreditScore, Geography, Gender, Age, Tenure, Balance, NumOfProducts,
         CAST(CASE WHEN trim(HasCrCard) IN ('Yes', '1') THEN 1 WHEN trim(HasCrCard) IN ('No', '0') THEN 0 END AS INT) AS HasCrCard,
         CAST(CASE WHEN trim(IsActiveMember) IN ('Yes', '1') THEN 1 WHEN trim(IsActiveMember) IN ('No', '0') THEN 0 END AS INT) AS IsActiveMember,
         EstimatedSalary
  FROM scoring_input),
scored_batch AS (SELECT *, {proxy_sql()} AS ChurnProbability FROM normalized),
batch AS (
  SELECT CAST(CustomerId AS VARCHAR) AS CustomerId, CreditScore, Age, Tenure, Balance, NumOfProducts,
         HasCrCard, IsActiveMember, EstimatedSalary, ChurnProbability,
         {risk_sql()} AS RiskLevel, {segment_sql()} AS Segment
  FROM scored_batch)"""


def scoring_input(spark: SparkSession, sf_dir: str, invalid_every: int | None = None) -> DataFrame:
    """Scoring-shaped input derived from the customer view: HasCrCard as
    '1'/'0' text, IsActiveMember as 'Yes'/'No' text.  ``invalid_every``
    replaces the card flag by 'maybe' on ids divisible by it (a defect
    rule for the flag-normalisation check, not a filter)."""
    c = TB.churn_customers(spark, sf_dir)
    card = F.col("HasCrCard").cast("string")
    if invalid_every:
        card = F.when(F.col("CustomerId") % invalid_every == 0, F.lit("maybe")).otherwise(card)
    active = F.when(F.col("IsActiveMember") == 1, F.lit("Yes")).otherwise(F.lit("No"))
    return c.select("CustomerId", "CreditScore", "Geography", "Gender", "Age", "Tenure", "Balance",
                    "NumOfProducts", card.alias("HasCrCard"), active.alias("IsActiveMember"),
                    "EstimatedSalary")


def batch_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.score_batch(scoring_input(spark, sf_dir))


def performance_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.segment_performance(D.segment_details(TB.enhanced_customers(spark, sf_dir)))


PERF_CTES = """
details AS (
  SELECT SegmentName AS segment, avg(Balance) AS avg_balance, avg(NumOfProducts) AS avg_products,
         avg(IsActiveMember) * 100e0 AS active_rate
  FROM enhanced GROUP BY SegmentName),
perf0 AS (
  SELECT segment, CAST(trunc(avg_balance * 5e-2 + avg_products * 500 + (active_rate / 100) * 1000) AS BIGINT) AS ltv
  FROM details),
perf AS (
  SELECT segment, ltv,
         CAST(trunc(ltv * CASE segment WHEN 'High-Value Clients' THEN 8e-2 WHEN 'At-Risk Seniors' THEN 12e-2 ELSE 6e-2 END) AS BIGINT) AS retention_cost
  FROM perf0)"""

SEG_CHURN_CTE = """
seg_churn AS (SELECT SegmentName AS segment, avg(Exited) * 100e0 AS churn_pct FROM enhanced GROUP BY SegmentName)"""


# ===== A: sources ==================================================================================

@register("scan_customers", q("SELECT * FROM churn_customers"))
def scan_customers(spark, d):
    cust = IO.read_table(spark, f"{d}/customer.parquet",
                         "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string")
    orders = IO.read_table(spark, f"{d}/orders.parquet",
                           "o_custkey bigint, o_totalprice double, o_orderdate timestamp_ntz")
    return TB.customers_from_tables(cust, orders)


@register("additive_risk_score", q("""
SELECT CustomerId,
       ROUND(LEAST(1e0, GREATEST(0e0, s)), 6) AS risk_score,
       CAST(CASE WHEN LEAST(1e0, GREATEST(0e0, s)) > 0.5 THEN 1 ELSE 0 END AS INT) AS exited_rule
FROM (SELECT CustomerId, 2e-2
    + 1e-1  * (1 - IsActiveMember)
    + 5e-2  * (CASE WHEN Age < 30 THEN 1 ELSE 0 END)
    + 8e-2  * (CASE WHEN Age > 60 THEN 1 ELSE 0 END)
    + 1e-1  * (CASE WHEN Balance < 10000 THEN 1 ELSE 0 END)
    + 15e-2 * (CASE WHEN NumOfProducts = 1 THEN 1 ELSE 0 END)
    - 1e-1  * (CASE WHEN Tenure > 5 THEN 1 ELSE 0 END)
    - 5e-2  * HasCrCard
    + 1e-1  * (CASE WHEN Geography = 'Germany' THEN 1 ELSE 0 END) AS s FROM churn_customers) t"""))
def additive_risk_score(spark, d):
    s = C.clip01(C.additive_risk_terms())
    return TB.churn_customers(spark, d).select(
        "CustomerId", F.round(s, 6).alias("risk_score"), C.as_flag(s > 0.5).alias("exited_rule"))


@register("profile_table", q("""
SELECT count(*) AS n_rows, 13 AS n_columns,
       CAST(count_if(CustomerId IS NULL) + count_if(Surname IS NULL) + count_if(CreditScore IS NULL)
          + count_if(Geography IS NULL) + count_if(Gender IS NULL) + count_if(Age IS NULL)
          + count_if(Tenure IS NULL) + count_if(Balance IS NULL) + count_if(NumOfProducts IS NULL)
          + count_if(HasCrCard IS NULL) + count_if(IsActiveMember IS NULL)
          + count_if(EstimatedSalary IS NULL) + count_if(Exited IS NULL) AS BIGINT) AS null_cells,
       count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM defect_customers)) AS duplicate_rows
FROM defect_customers"""))
def profile_table(spark, d):
    from retainer.operators.describe import profile
    return profile(TB.defect_customers(spark, d))


@register("assign_customer_ids", q("""
SELECT 'CUST' || CAST(row_number() OVER (ORDER BY Surname) - 1 + 10000 AS VARCHAR) AS CustomerId,
       Surname, CreditScore, Age
FROM churn_customers"""))
def assign_customer_ids(spark, d):
    x = TB.churn_customers(spark, d).select("Surname", "CreditScore", "Age")
    return B.assign_customer_ids(x, ["Surname"]).select("CustomerId", "Surname", "CreditScore", "Age")


# ===== B: preprocessing ==============================================================================

@register("drop_identifiers", q("""
SELECT CustomerId, CreditScore, Geography, Gender, Age, Tenure, Balance, NumOfProducts,
       HasCrCard, IsActiveMember, EstimatedSalary, Exited FROM churn_customers"""))
def drop_identifiers(spark, d):
    return FE.drop_identifiers(TB.churn_customers(spark, d))


@register("one_hot_encode", q("""
SELECT CustomerId, CreditScore, Age, Tenure, Balance, NumOfProducts, HasCrCard, IsActiveMember,
       EstimatedSalary, Exited,
       CAST(CASE WHEN Geography = 'Germany' THEN 1 ELSE 0 END AS INT) AS Geography_Germany,
       CAST(CASE WHEN Geography = 'Spain' THEN 1 ELSE 0 END AS INT) AS Geography_Spain,
       CAST(CASE WHEN Gender = 'Male' THEN 1 ELSE 0 END AS INT) AS Gender_Male
FROM churn_customers"""))
def one_hot_encode(spark, d):
    return FE.one_hot_encode(FE.drop_identifiers(TB.churn_customers(spark, d)))


SERVING_FEATURES_SQL = """
  CreditScore, Age, Tenure, Balance, NumOfProducts, HasCrCard, IsActiveMember, EstimatedSalary,
  CAST(CASE WHEN Geography = 'Germany' THEN 1 ELSE 0 END AS INT) AS Geography_Germany,
  CAST(CASE WHEN Geography = 'Spain' THEN 1 ELSE 0 END AS INT) AS Geography_Spain,
  CAST(CASE WHEN Gender = 'Male' THEN 1 WHEN Gender = 'Female' THEN 0 END AS INT) AS Gender_Male,
  ROUND(Balance / NULLIF(EstimatedSalary + 1, 0), 6) AS Balance_to_Salary_Ratio,
  ROUND(CreditScore / NULLIF(EstimatedSalary + 1, 0), 6) AS Credit_to_Salary_Ratio,
  ROUND(Age / NULLIF(Tenure + 1, 0), 6) AS Age_to_Tenure_Ratio,
  ROUND(NumOfProducts / NULLIF(Tenure + 1, 0), 6) AS Products_per_Tenure,
  CAST(CASE WHEN Balance > 100000 OR EstimatedSalary > 100000 THEN 1 ELSE 0 END AS INT) AS IsHighValueCustomer,
  CAST(CASE WHEN Tenure > 5 THEN 1 ELSE 0 END AS INT) AS IsLongTermCustomer,
  CAST(CASE WHEN NumOfProducts > 1 THEN 1 ELSE 0 END AS INT) AS HasMultipleProducts,
  CAST(CASE WHEN Age < 30 AND IsActiveMember = 0 THEN 1 ELSE 0 END AS INT) AS IsYoungInactive,
  CAST(CASE WHEN Age > 60 AND IsActiveMember = 0 THEN 1 ELSE 0 END AS INT) AS IsOldInactive"""


@register("align_features", q(f"SELECT CustomerId, {SERVING_FEATURES_SQL} FROM normalized", SCORING_CTES))
def align_features(spark, d):
    x = FE.normalize_flags(scoring_input(spark, d))
    x = FE.serving_features(x)
    return round_doubles(FE.align_features(x))


@register("normalize_flags", q("""
SELECT CustomerId,
       CAST(CASE WHEN Gender = 'Male' THEN 1 WHEN Gender = 'Female' THEN 0 END AS INT) AS Gender_Male,
       CAST(CASE WHEN HasCrCard IN ('Yes', '1') THEN 1 WHEN HasCrCard IN ('No', '0') THEN 0 END AS INT) AS HasCrCard,
       CAST(CASE WHEN IsActiveMember IN ('Yes', '1') THEN 1 WHEN IsActiveMember IN ('No', '0') THEN 0 END AS INT) AS IsActiveMember
FROM (SELECT CustomerId, Gender,
             CASE WHEN CustomerId % 19 = 0 THEN 'maybe' ELSE CAST(HasCrCard AS VARCHAR) END AS HasCrCard,
             CASE WHEN IsActiveMember = 1 THEN 'Yes' ELSE 'No' END AS IsActiveMember
      FROM churn_customers) t"""))
def normalize_flags(spark, d):
    x = FE.normalize_flags(scoring_input(spark, d, invalid_every=19), gender_column="Gender_Male")
    return x.select("CustomerId", "Gender_Male", "HasCrCard", "IsActiveMember")


@register("ratio_features", q("""
SELECT CustomerId,
  ROUND(Balance / NULLIF(EstimatedSalary + 1, 0), 6) AS Balance_to_Salary_Ratio,
  ROUND(CreditScore / NULLIF(EstimatedSalary + 1, 0), 6) AS Credit_to_Salary_Ratio,
  ROUND(Age / NULLIF(Tenure + 1, 0), 6) AS Age_to_Tenure_Ratio,
  ROUND(NumOfProducts / NULLIF(Tenure + 1, 0), 6) AS Products_per_Tenure
FROM churn_customers"""))
def ratio_features(spark, d):
    x = FE.add_ratio_features(TB.churn_customers(spark, d))
    return round_doubles(x.select("CustomerId", *C.ratio_columns().keys()))


@register("high_value_median", q("""
SELECT CustomerId,
       CAST(CASE WHEN Balance > (SELECT median(Balance) FROM churn_customers)
                  AND EstimatedSalary > (SELECT median(EstimatedSalary) FROM churn_customers)
            THEN 1 ELSE 0 END AS INT) AS IsHighValueCustomer
FROM churn_customers"""))
def high_value_median(spark, d):
    return FE.add_high_value_median(TB.churn_customers(spark, d)).select("CustomerId", "IsHighValueCustomer")


@register("high_value_fixed", q("""
SELECT CustomerId, CAST(CASE WHEN Balance > 100000 OR EstimatedSalary > 100000 THEN 1 ELSE 0 END AS INT)
       AS IsHighValueCustomer FROM churn_customers"""))
def high_value_fixed(spark, d):
    return FE.add_high_value_fixed(TB.churn_customers(spark, d)).select("CustomerId", "IsHighValueCustomer")


@register("behavior_flags", q("""
SELECT CustomerId,
  CAST(CASE WHEN Tenure > 5 THEN 1 ELSE 0 END AS INT) AS IsLongTermCustomer,
  CAST(CASE WHEN NumOfProducts > 1 THEN 1 ELSE 0 END AS INT) AS HasMultipleProducts,
  CAST(CASE WHEN Age < 30 AND IsActiveMember = 0 THEN 1 ELSE 0 END AS INT) AS IsYoungInactive,
  CAST(CASE WHEN Age > 60 AND IsActiveMember = 0 THEN 1 ELSE 0 END AS INT) AS IsOldInactive
FROM churn_customers"""))
def behavior_flags(spark, d):
    return FE.add_behaviour_flags(TB.churn_customers(spark, d)).select(
        "CustomerId", *C.behaviour_flag_columns().keys())


@register("drop_invalid_rows", q("""
SELECT CustomerId, Surname, CreditScore, Geography, Gender, Age, Tenure, Balance, NumOfProducts,
       HasCrCard, IsActiveMember, EstimatedSalary, Exited,
       ROUND(Balance / NULLIF(EstimatedSalary + 1, 0), 6) AS Balance_to_Salary_Ratio,
       ROUND(Age / NULLIF(Tenure + 1, 0), 6) AS Age_to_Tenure_Ratio
FROM defect_customers
WHERE Balance IS NOT NULL AND isfinite(Balance) AND isfinite(EstimatedSalary)
  AND Balance / NULLIF(EstimatedSalary + 1, 0) IS NOT NULL"""))
def drop_invalid_rows(spark, d):
    x = TB.defect_customers(spark, d)
    r = C.ratio_columns()
    x = x.withColumn("Balance_to_Salary_Ratio", r["Balance_to_Salary_Ratio"]).withColumn(
        "Age_to_Tenure_Ratio", r["Age_to_Tenure_Ratio"])
    return round_doubles(FE.drop_invalid_rows(x))


@register("impute_missing", q("""
SELECT CustomerId, Surname, CreditScore, Geography, Gender, Age, Tenure,
       ROUND(COALESCE(Balance, (SELECT median(Balance) FROM defect_customers)), 6) AS Balance,
       NumOfProducts, HasCrCard, IsActiveMember, EstimatedSalary, Exited
FROM defect_customers"""))
def impute_missing(spark, d):
    return round_doubles(FE.impute_missing(TB.defect_customers(spark, d)))


CAP_CTE = """
qs AS (SELECT quantile_cont(Balance, 0.25) AS b1, quantile_cont(Balance, 0.75) AS b3,
              quantile_cont(EstimatedSalary, 0.25) AS s1, quantile_cont(EstimatedSalary, 0.75) AS s3,
              quantile_cont(CAST(CreditScore AS DOUBLE), 0.25) AS c1, quantile_cont(CAST(CreditScore AS DOUBLE), 0.75) AS c3,
              quantile_cont(CAST(Age AS DOUBLE), 0.25) AS a1, quantile_cont(CAST(Age AS DOUBLE), 0.75) AS a3
       FROM defect_customers)"""


@register("cap_outliers_iqr", q("""
SELECT CustomerId,
  ROUND(LEAST(GREATEST(Balance, b1 - 15e-1 * (b3 - b1)), b3 + 15e-1 * (b3 - b1)), 6) AS Balance,
  ROUND(LEAST(GREATEST(EstimatedSalary, s1 - 15e-1 * (s3 - s1)), s3 + 15e-1 * (s3 - s1)), 6) AS EstimatedSalary,
  ROUND(LEAST(GREATEST(CAST(CreditScore AS DOUBLE), c1 - 15e-1 * (c3 - c1)), c3 + 15e-1 * (c3 - c1)), 6) AS CreditScore,
  ROUND(LEAST(GREATEST(CAST(Age AS DOUBLE), a1 - 15e-1 * (a3 - a1)), a3 + 15e-1 * (a3 - a1)), 6) AS Age
FROM defect_customers, qs""", CAP_CTE))
def cap_outliers_iqr(spark, d):
    cols = ["Balance", "EstimatedSalary", "CreditScore", "Age"]
    x = FE.cap_outliers_iqr(TB.defect_customers(spark, d), cols)
    return round_doubles(x.select("CustomerId", *cols))


def _validate_sql() -> str:
    rules = [
        ("null_customer_id", "CustomerId IS NULL"),
        ("null_balance", "Balance IS NULL"),
        ("credit_score_out_of_range", "CreditScore < 300 OR CreditScore > 900"),
        ("age_out_of_range", "Age < 18 OR Age > 100"),
        ("tenure_out_of_range", "Tenure < 0 OR Tenure > 10"),
        ("balance_out_of_range", "Balance < 0 OR Balance > 250000"),
        ("products_out_of_range", "NumOfProducts < 1 OR NumOfProducts > 4"),
        ("salary_out_of_range", "EstimatedSalary < 0 OR EstimatedSalary > 1000000"),
        ("unknown_geography", "NOT COALESCE(Geography IN ('France', 'Germany', 'Spain'), false)"),
        ("unknown_gender", "NOT COALESCE(Gender IN ('Female', 'Male'), false)"),
        ("bad_card_flag", "NOT COALESCE(HasCrCard IN (0, 1), false)"),
        ("bad_active_flag", "NOT COALESCE(IsActiveMember IN (0, 1), false)"),
    ]
    parts = [f"SELECT '{n}' AS rule, CAST(count_if({c}) AS BIGINT) AS violations FROM defect_customers"
             for n, c in rules]
    parts.append("SELECT 'duplicate_customer_id' AS rule, CAST(count(*) - count(DISTINCT CustomerId) "
                 "- count_if(CustomerId IS NULL) AS BIGINT) AS violations FROM defect_customers")
    return q("\nUNION ALL\n".join(parts))


@register("validate_rules", _validate_sql())
def validate_rules(spark, d):
    return FE.validate_rules(TB.defect_customers(spark, d))


def _standardize_sql() -> str:
    cols = S.CLUSTER_FEATURES
    sel = ",\n  ".join(
        f"ROUND(({c} - avg({c}) OVER ()) / NULLIF(stddev_pop({c}) OVER (), 0), 6) AS {c}_z" for c in cols)
    return q(f"SELECT CustomerId,\n  {sel}\nFROM churn_customers")


@register("standardize", _standardize_sql())
def standardize(spark, d):
    return round_doubles(FE.standardize(TB.churn_customers(spark, d)))


@register("apply_defaults", q("""
SELECT CustomerId, COALESCE(Age, 35) AS Age, COALESCE(IsActiveMember, 1) AS IsActiveMember,
       COALESCE(NumOfProducts, 1) AS NumOfProducts, COALESCE(Balance, 75000e0) AS Balance,
       COALESCE(Geography, 'France') AS Geography, COALESCE(Tenure, 5) AS Tenure,
       COALESCE(CreditScore, 650) AS CreditScore, COALESCE(EstimatedSalary, 50000e0) AS EstimatedSalary
FROM defect_customers"""))
def apply_defaults(spark, d):
    x = FE.apply_defaults(TB.defect_customers(spark, d))
    return x.select("CustomerId", *S.FIELD_DEFAULTS.keys())


# ===== C: segments (rule based) / E1-E2 =====================================================================

@register("rule_segment", q(f"SELECT CustomerId, {segment_sql()} AS Segment FROM churn_customers"))
def rule_segment(spark, d):
    return TB.churn_customers(spark, d).select("CustomerId", C.rule_segment().alias("Segment"))


@register("rule_segment_salary", q(f"SELECT CustomerId, {segment_sql(True)} AS Segment FROM churn_customers"))
def rule_segment_salary(spark, d):
    return TB.churn_customers(spark, d).select(
        "CustomerId", C.rule_segment(salary=F.col("EstimatedSalary")).alias("Segment"))


@register("risk_level", q(f"SELECT CustomerId, ChurnProbability, {risk_sql()} AS RiskLevel FROM churn_scored"))
def risk_level(spark, d):
    return TB.churn_scored(spark, d).select(
        "CustomerId", "ChurnProbability", C.risk_level(F.col("ChurnProbability")).alias("RiskLevel"))


@register("risk_level_numeric", q("""
SELECT CustomerId, RiskLevel, CAST(CASE RiskLevel WHEN 'Low Risk' THEN 0 WHEN 'Medium Risk' THEN 1
       WHEN 'High Risk' THEN 2 WHEN 'Very High Risk' THEN 3 END AS INT) AS RiskLevelNumeric FROM enhanced"""))
def risk_level_numeric(spark, d):
    return TB.enhanced_customers(spark, d).select("CustomerId", "RiskLevel", "RiskLevelNumeric")


PROFILE_COLS = ["CreditScore", "Age", "Tenure", "Balance", "NumOfProducts", "HasCrCard",
                "IsActiveMember", "EstimatedSalary", "Exited", "ChurnProbability"]


@register("segment_profile", q(
    "SELECT SegmentName, count(*) AS n, "
    + ", ".join(f"ROUND(avg({c}), 6) AS avg_{c}" for c in PROFILE_COLS)
    + " FROM enhanced GROUP BY SegmentName"))
def segment_profile(spark, d):
    from retainer.operators.segments import segment_profile as prof
    return prof(TB.enhanced_customers(spark, d), "SegmentName", PROFILE_COLS)


# the other query groups register themselves on import
from retainer.plans import analytics, evaluation, ml, scoring  # noqa: E402,F401
