"""Driver tables and the customer views derived from them.

``churn_customers`` maps the TPC-H-like ``customer`` and ``orders`` tables onto
the bank-customer shape: one row per customer, features from orders placed
before a cut date, label = no order on or after it.  ``churn_scored`` adds a
deterministic rule probability that stands in for a fitted model.

Plan shape at scale: orders are reduced to one row per customer by a hash
aggregate with map-side partials (a customer holding a third of all orders is
collapsed before the shuffle), then left-joined to ``customer`` on the key.
Both sides are keyed by ``custkey``; neither is broadcast by hint -- AQE may
switch to a broadcast at run time only when the measured size allows it.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from retainer.functions import columns as C

CUT_DATE = dt.date(2001, 1, 1)
ACTIVE_SINCE = dt.date(2000, 7, 5)
CARD_SEGMENTS = ["BUILDING", "MACHINERY", "HOUSEHOLD"]

DRIVER_TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem",
                 "events", "documents", "embeddings", "pages", "benchmark", "labels",
                 "conversations"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One driver table; Catalyst prunes the columns the caller selects."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def order_features(orders: DataFrame, cut: dt.date = CUT_DATE) -> DataFrame:
    """Per-customer order counts and spend before / after the cut date."""
    d = F.col("o_orderdate").cast("date")
    before = d < F.lit(cut)
    return (orders
            .groupBy(F.col("o_custkey").alias("k"))
            .agg(F.sum(F.when(before, 1).otherwise(0)).alias("n_before"),
                 F.sum(F.when(before, F.col("o_totalprice")).otherwise(F.lit(0.0))).alias("spend"),
                 F.max(F.when(before, d)).alias("last_before"),
                 F.sum(F.when(~before, 1).otherwise(0)).alias("n_after")))


def customers_from_tables(customer: DataFrame, orders: DataFrame) -> DataFrame:
    """The raw labelled customer table (no RowNumber) built from driver tables."""
    o = order_features(orders)
    key = F.col("c_custkey")
    nb = F.coalesce(F.col("n_before"), F.lit(0))
    geo_bin = F.col("c_nationkey") % 10
    return (customer
            .join(o, key == F.col("k"), "left")
            .select(
                key.cast("bigint").alias("CustomerId"),
                F.col("c_name").alias("Surname"),
                (F.lit(300) + (key * 37) % 551).cast("int").alias("CreditScore"),
                F.when(geo_bin < 5, "France").when(geo_bin < 7, "Spain")
                 .otherwise("Germany").alias("Geography"),
                F.when(key % 2 == 0, "Male").otherwise("Female").alias("Gender"),
                (F.lit(18) + (key * 13) % 77).cast("int").alias("Age"),
                ((key * 7) % 11).cast("int").alias("Tenure"),
                F.round(F.greatest(F.col("c_acctbal"), F.lit(0.0)) * F.lit(25.0), 2).alias("Balance"),
                F.when(nb <= 7, 1).when(nb <= 10, 2).when(nb <= 13, 3).otherwise(4)
                 .cast("int").alias("NumOfProducts"),
                C.as_flag(F.col("c_mktsegment").isin(*CARD_SEGMENTS)).alias("HasCrCard"),
                C.as_flag(F.coalesce(F.col("last_before") >= F.lit(ACTIVE_SINCE), F.lit(False)))
                 .alias("IsActiveMember"),
                F.round(F.lit(1e4) + F.coalesce(F.col("spend"), F.lit(0.0)) / F.lit(35.0), 2)
                 .alias("EstimatedSalary"),
                C.as_flag(F.coalesce(F.col("n_after"), F.lit(0)) == 0).alias("Exited"),
            ))


def churn_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return customers_from_tables(table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders"))


def with_proxy_score(df: DataFrame) -> DataFrame:
    return df.withColumn("ChurnProbability", C.proxy_probability())


def churn_scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_proxy_score(churn_customers(spark, sf_dir))


def enhanced_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored customers with rule segment and risk level: the table the
    dashboard roll-ups read (``SegmentName`` from the batch segment rule)."""
    df = churn_scored(spark, sf_dir)
    return (df.withColumn("SegmentName", C.rule_segment())
              .withColumn("RiskLevel", C.risk_level(F.col("ChurnProbability")))
              .withColumn("RiskLevelNumeric", C.risk_level_numeric(F.col("RiskLevel"))))


def with_defects(df: DataFrame) -> DataFrame:
    """Inject nulls, outliers, an unknown level and duplicate rows (fixture
    rule): Balance NULL where id % 17 = 0, x10 where id % 97 = 0, Geography
    'Unknown' where id % 53 = 0, plus a second copy of rows with id % 101 = 0.

    These modulo rules *define defects*; they filter nothing out."""
    cid = F.col("CustomerId")
    bal: Column = (F.when(cid % 17 == 0, F.lit(None).cast("double"))
                   .when(cid % 97 == 0, F.col("Balance") * F.lit(10.0))
                   .otherwise(F.col("Balance")))
    geo = F.when(cid % 53 == 0, F.lit("Unknown")).otherwise(F.col("Geography"))
    copies = F.when(cid % 101 == 0, F.sequence(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    out = df.withColumn("Balance", bal).withColumn("Geography", geo)
    return out.withColumn("_copy", F.explode(copies)).drop("_copy")


def defect_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_defects(churn_customers(spark, sf_dir))
