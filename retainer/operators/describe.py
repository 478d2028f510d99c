"""E3-E15 descriptive analytics and F1-F9 dashboard roll-ups.

Each roll-up is one ``groupBy`` (the reference loops one filter per group);
hash aggregation with map-side partials means a segment holding a third of
the rows costs no more than any other.  Percent columns divide by a total
taken over the already-aggregated rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from retainer import schema as S
from retainer.functions import columns as C
from retainer.operators.comoments import correlations
from retainer.operators.stats import BROADCAST_ROWS, attach, exact_quantiles
from retainer.session import written

R6 = C.bround6


def _pct_of_total(count_col: str = "count") -> Column:
    # the window runs over the aggregated rows (one per group), not base rows
    return F.col(count_col) * F.lit(100.0) / F.sum(count_col).over(Window.partitionBy())


def dimension(df_session, name: str, values: Sequence[str]) -> DataFrame:
    """A fixed dimension (segment or risk names) with its display position."""
    return df_session.createDataFrame([(v, i) for i, v in enumerate(values)],
                                      f"{name} string, {name}_pos int")


# E3 / F2 -----------------------------------------------------------------------------------

def category_distribution(df: DataFrame, column: str, name: str | None = None) -> DataFrame:
    """Count and percent of each value of ``column``."""
    name = name or column
    counts = df.groupBy(F.col(column).alias(name)).agg(F.count(F.lit(1)).alias("count"))
    return counts.select(name, "count", R6(_pct_of_total()).alias("percent"))


def risk_distribution(df: DataFrame) -> DataFrame:
    return category_distribution(df, "RiskLevel").orderBy("RiskLevel")


# E4 / F3 -------------------------------------------------------------------------------------

def churn_by_segment(df: DataFrame, segment: str = "SegmentName") -> DataFrame:
    return (df.groupBy(segment).agg(R6(F.avg("Exited")).alias("churn_rate"))
              .orderBy(F.col("churn_rate").desc(), F.col(segment)))


def segment_churn_pct(df: DataFrame, segment: str = "SegmentName") -> DataFrame:
    return df.groupBy(F.col(segment).alias("segment")).agg(
        R6(F.avg("Exited") * 100.0).alias("churn_pct"))


# E5 ---------------------------------------------------------------------------------------------

RISK_KEYS = ["low", "medium", "high", "very_high"]


def risk_segment_crosstab(df: DataFrame, segment: str = "SegmentName") -> DataFrame:
    """Segment x risk-level counts (all four levels, zero-filled) and row shares."""
    wide = (df.groupBy(segment).pivot("RiskLevel", S.RISK_LEVELS).agg(F.count(F.lit(1)))
              .na.fill(0, subset=S.RISK_LEVELS))
    total = sum((F.col(f"`{lv}`") for lv in S.RISK_LEVELS), F.lit(0))
    out = [F.col(segment)]
    out += [F.col(f"`{lv}`").cast("bigint").alias(f"n_{k}") for lv, k in zip(S.RISK_LEVELS, RISK_KEYS)]
    out += [R6(F.col(f"`{lv}`") / total).alias(f"share_{k}") for lv, k in zip(S.RISK_LEVELS, RISK_KEYS)]
    return wide.select(*out)


# E6 ---------------------------------------------------------------------------------------------

def probability_histogram(df: DataFrame, value: str = "ChurnProbability", by: str = "Exited",
                          bins: int = 30) -> DataFrame:
    """Counts per (bin, outcome) over ``bins`` equal-width bins shared by both
    outcomes; min/max come from one scalar-subquery aggregate."""
    rng = df.agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    r = C.row_scalars(rng)
    lo, hi = r["lo"], r["hi"]
    b = C.equal_width_bucket(F.col(value), lo, hi, bins)
    width = (hi - lo) / F.lit(float(bins))
    return (df.groupBy(b.alias("bin"), F.col(by))
              .agg(F.count(F.lit(1)).alias("n"))
              .select("bin", by, "n",
                      R6(lo + (F.col("bin") - 1) * width).alias("bin_start"),
                      R6(lo + F.col("bin") * width).alias("bin_end")))


# E7 ---------------------------------------------------------------------------------------------

def segment_density(df: DataFrame, features: Sequence[str] = ("Age", "Balance", "EstimatedSalary", "Tenure"),
                    segment: str = "SegmentName", grid: int = 50, bins: int = 512) -> DataFrame:
    """Gaussian KDE (Scott bandwidth) of each feature per segment, evaluated
    on ``grid`` points over [min, max].

    Rows are first reduced to counts in ``bins`` equal-width bins per
    (segment, feature); the kernel sum runs over grid x bins, so the work is
    bounded by segments x features x grid x bins whatever the row count."""
    stacked = F.explode(F.array(*[
        F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("x")) for f in features]))
    long = df.select(F.col(segment).alias("segment"), stacked.alias("s")).select(
        "segment", "s.feature", "s.x").where(F.col("x").isNotNull())
    stats = long.groupBy("segment", "feature").agg(
        F.count(F.lit(1)).alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi"),
        F.stddev_samp("x").alias("sd"))
    b = C.equal_width_bucket(F.col("x"), F.col("lo"), F.col("hi"), bins)
    stats = written(stats, "density-stats")              # segments x features rows
    binned = (attach(long, stats, ["segment", "feature"])
                  .groupBy("segment", "feature", b.alias("b"))
                  .agg(F.count(F.lit(1)).alias("cnt"),
                       F.first("lo").alias("lo"), F.first("hi").alias("hi"))
                  .select("segment", "feature", "cnt",
                          (F.col("lo") + (F.col("b") - F.lit(0.5)) * ((F.col("hi") - F.col("lo")) / F.lit(float(bins)))).alias("c")))
    bw = F.col("sd") * F.pow(F.col("n").cast("double"), F.lit(-0.2))
    pts = stats.select("segment", "feature", "n", "lo", "hi", bw.alias("h"),
                       F.explode(F.sequence(F.lit(0), F.lit(grid - 1))).alias("g"))
    pts = pts.withColumn("gx", F.col("lo") + F.col("g") * (F.col("hi") - F.col("lo")) / F.lit(float(grid - 1)))
    z = (F.col("gx") - F.col("c")) / F.col("h")
    kern = F.col("cnt") * F.exp(F.lit(-0.5) * z * z)
    norm = F.col("n") * F.col("h") * F.lit((2 * 3.141592653589793) ** 0.5)
    dens = (pts.join(binned, ["segment", "feature"])
               .groupBy("segment", "feature", "g", "gx", "n", "h")
               .agg(F.sum(kern).alias("k"))
               .select("segment", "feature", F.col("g").alias("grid_index"),
                       R6(F.col("gx")).alias("x"),
                       R6(F.try_divide(F.col("k"), norm) * F.lit(1e6)).alias("density_e6")))
    return dens


# E8 ---------------------------------------------------------------------------------------------

def correlation_pairs(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Pearson r of every pair (a, b) with b before a in ``cols``, over the rows that have both, from
    one pass of mergeable co-moments; constant columns give NULL."""
    names = F.array(*[F.lit(c) for c in cols])
    return correlations(df, cols).select(names[F.col("i")].alias("col_a"), names[F.col("j")].alias("col_b"), R6(F.col("r")).alias("r"))


# E9 ---------------------------------------------------------------------------------------------

def risk_by_age_balance(df: DataFrame) -> DataFrame:
    return df.select("CustomerId", "Age", "Balance", "RiskLevelNumeric")


# E10 --------------------------------------------------------------------------------------------

def segment_insights(df: DataFrame, segment: str = "SegmentName") -> DataFrame:
    """Size, share, churn rate, averages and high-risk share per segment."""
    g = df.groupBy(F.col(segment).alias("segment")).agg(
        F.count(F.lit(1)).alias("size"),
        F.avg("Exited").alias("churn_rate"),
        F.avg("Age").alias("avg_age"),
        F.avg("Balance").alias("avg_balance"),
        F.avg("Tenure").alias("avg_tenure"),
        F.avg(C.is_high_risk(F.col("RiskLevel")).cast("int")).alias("high_risk_pct"))
    return g.select("segment", "size",
                    R6(F.col("size") / F.sum("size").over(Window.partitionBy())).alias("share"),
                    *[R6(F.col(c)).alias(c) for c in
                      ["churn_rate", "avg_age", "avg_balance", "avg_tenure", "high_risk_pct"]])


# E11 / E12 / E13 ----------------------------------------------------------------------------------

def high_risk_customers(df: DataFrame) -> DataFrame:
    return df.filter(C.is_high_risk(F.col("RiskLevel")))


def describe_exact(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """``describe()`` transposed: one row per column with count, mean,
    sample std, min, exact 25/50/75 % and max."""
    stacked = F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("v")) for c in cols]))
    long = df.select(stacked.alias("s")).select("s.column", "s.v")
    moments = long.groupBy("column").agg(
        F.count("v").alias("count"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("std"),
        F.min("v").alias("min"), F.max("v").alias("max"))
    qs = exact_quantiles(df, [], cols, [0.25, 0.5, 0.75]).select(
        "column", F.col("q0").alias("p25"), F.col("q1").alias("p50"), F.col("q2").alias("p75"))
    j = moments.join(qs, "column", "left")
    return j.select("column", "count", *[R6(F.col(c)).alias(c) for c in
                                         ["mean", "std", "min", "p25", "p50", "p75", "max"]])


def high_risk_summary(df: DataFrame) -> DataFrame:
    hr = C.is_high_risk(F.col("RiskLevel"))
    return df.agg(
        F.count_if(hr).alias("n_high_risk"),
        R6(F.avg(hr.cast("int"))).alias("share"),
        R6(F.avg(F.when(hr, F.col("Age")))).alias("avg_age"),
        R6(F.avg(F.when(hr, F.col("Balance")))).alias("avg_balance"),
        R6(F.avg(F.when(hr, F.col("Tenure")))).alias("avg_tenure"),
        R6(F.avg(F.when(hr, F.col("IsActiveMember")))).alias("active_share"))


# E14 ---------------------------------------------------------------------------------------------

def dataset_overview(df: DataFrame, split: DataFrame, n_features: int = len(S.FEATURES)) -> DataFrame:
    """Rows, feature count, churn rate and train/test sizes (``split`` has a
    ``split`` column with 'train'/'test')."""
    sizes = split.agg(F.count_if(F.col("split") == "train").alias("train_size"),
                      F.count_if(F.col("split") == "test").alias("test_size"))
    base = df.agg(F.count(F.lit(1)).alias("total_samples"), R6(F.avg("Exited")).alias("churn_rate"))
    sz = C.row_scalars(sizes)
    return base.select("total_samples", F.lit(n_features).alias("features"), "churn_rate",
                       sz["train_size"].alias("train_size"), sz["test_size"].alias("test_size"))


# F1 / F5 / F9 ---------------------------------------------------------------------------------------

def overall_churn_rate(df: DataFrame) -> DataFrame:
    return df.agg(R6(F.avg("Exited") * 100.0).alias("churn_rate_pct"))


def high_risk_count(df: DataFrame) -> DataFrame:
    return df.agg(F.count_if(C.is_high_risk(F.col("RiskLevel"))).alias("high_risk_customers"))


def high_risk_estimate(risk_share: DataFrame, base: int = S.DASHBOARD_CUSTOMER_BASE) -> DataFrame:
    """Head count implied by the High + Very High percentages on a fixed base."""
    pct = F.sum(F.when(C.is_high_risk(F.col("RiskLevel")), F.col("percent")).otherwise(F.lit(0.0)))
    return risk_share.agg(F.round(pct / F.lit(100.0) * F.lit(base)).cast("bigint").alias("high_risk_estimate"))


# F2 / F3 ---------------------------------------------------------------------------------------------

def segment_share(df: DataFrame) -> DataFrame:
    return category_distribution(df, "SegmentName", "segment")


def risk_share(df: DataFrame) -> DataFrame:
    return category_distribution(df, "RiskLevel")


# F4 / F6 / F7 -------------------------------------------------------------------------------------

def segment_details(df: DataFrame, segment: str = "SegmentName") -> DataFrame:
    g = df.groupBy(F.col(segment).alias("segment")).agg(
        F.min("Age").alias("age_min"), F.max("Age").alias("age_max"),
        F.avg("Balance").alias("avg_balance"), F.avg("NumOfProducts").alias("avg_products"),
        (F.avg("HasCrCard") * 100.0).alias("digital_adoption"),
        F.avg("Tenure").alias("tenure"),
        (F.avg("IsActiveMember") * 100.0).alias("active_rate"),
        F.avg("CreditScore").alias("credit_score"))
    return g.select("segment",
                    F.format_string("%d-%d years", "age_min", "age_max").alias("age_range"),
                    "avg_balance", "avg_products", "digital_adoption", "tenure", "active_rate",
                    "credit_score")


def _rate_case(segment: Column, rates: dict, other) -> Column:
    expr = None
    for k, v in rates.items():
        expr = F.when(segment == k, F.lit(v)) if expr is None else expr.when(segment == k, F.lit(v))
    return expr.otherwise(F.lit(other))


def segment_performance(details: DataFrame) -> DataFrame:
    """ltv / retention cost / profitability index / growth per segment."""
    seg = F.col("segment")
    ltv = (F.col("avg_balance") * F.lit(0.05) + F.col("avg_products") * F.lit(500)
           + (F.col("active_rate") / F.lit(100)) * F.lit(1000)).cast("bigint")
    rate = _rate_case(seg, S.RETENTION_COST_RATE, S.RETENTION_COST_RATE_OTHER)
    x = details.select(seg, ltv.alias("ltv")).withColumn(
        "retention_cost", (F.col("ltv") * rate).cast("bigint"))
    index = F.when(F.col("retention_cost") > 0,
                   F.bround(F.col("ltv") / F.col("retention_cost"), 1)).otherwise(F.lit(1.0))
    return x.select("segment", "ltv", "retention_cost", index.alias("profitability_index"),
                    _rate_case(seg, S.GROWTH_POTENTIAL, S.GROWTH_POTENTIAL_OTHER).alias("growth_potential"))


def segment_roi(performance: DataFrame, share: DataFrame, churn_pct: DataFrame) -> DataFrame:
    """Programme cost, savings and 1/3-year ROI per segment; missing share /
    churn fall back to 25 % / 15 %.  All three inputs hold one row per segment."""
    j = (performance.select("segment")
         .join(share.select("segment", "percent"), "segment", "left")
         .join(churn_pct.select("segment", "churn_pct"), "segment", "left"))
    size = F.coalesce(F.col("percent"), F.lit(S.ROI_DEFAULT_SHARE_PCT))
    churn = F.coalesce(F.col("churn_pct"), F.lit(S.ROI_DEFAULT_CHURN_PCT)) / F.lit(100)
    cost = ((size / F.lit(100)) * F.lit(S.ROI_PROGRAM_BUDGET)).cast("bigint")
    x = j.select("segment", cost.alias("implementation_cost"), churn.alias("_churn"))
    x = x.withColumn("projected_savings",
                     (F.col("implementation_cost") * F.lit(2.5) * (F.lit(1) - F.col("_churn"))).cast("bigint"))
    roi1 = F.try_divide(F.col("projected_savings") * F.lit(0.4) - F.col("implementation_cost"),
                        F.col("implementation_cost").cast("double")) * F.lit(100)
    roi3 = F.try_divide(F.col("projected_savings") * F.lit(1.2) - F.col("implementation_cost"),
                        F.col("implementation_cost").cast("double")) * F.lit(100)
    return x.select("segment", "implementation_cost", "projected_savings",
                    F.greatest(roi1.cast("bigint"), F.lit(10).cast("bigint")).alias("roi_1year"),
                    F.greatest(roi3.cast("bigint"), F.lit(50).cast("bigint")).alias("roi_3year"))


# F8 / E15 ------------------------------------------------------------------------------------------

def collect_small(df: DataFrame, name: str) -> DataFrame:
    """A one-row frame holding ``df``'s rows as an array of structs.  Only for
    roll-ups that are bounded by construction (segments, risk levels, top-k)."""
    return df.agg(F.collect_list(F.struct(*df.columns)).alias(name))


def nested_record(spark, parts: dict[str, DataFrame]) -> DataFrame:
    """One nested record from small frames: each part becomes a scalar
    subquery (a struct, or the single column named like the part), so no
    join is involved."""
    cols = []
    for name, part in parts.items():
        one = F.col(name) if part.columns == [name] else F.struct(*part.columns)
        cols.append(part.select(one).scalar().alias(name))
    return spark.range(1).select(*cols)


# A6 ------------------------------------------------------------------------------------------------

def profile(df: DataFrame) -> DataFrame:
    """Row count, column count, NULL cells and duplicate rows in one record.

    Duplicates = rows minus distinct rows (NULLs compare equal).  Two 64-bit hashes of each row are counted, so
    a row costs 16 bytes in the shuffle whatever its width; only rows whose hashes occur more than once are compared
    in full."""
    nulls = sum((F.count_if(F.col(c).isNull()) for c in df.columns), F.lit(0))
    base = df.agg(F.count(F.lit(1)).alias("n_rows"), nulls.cast("bigint").alias("null_cells"))
    row = [F.col(c) for c in df.columns]
    gaps = F.array(*[c.isNull() for c in row])              # hashes pass over nulls: their places count too
    marked = df.withColumns({"_h1": F.xxhash64(F.lit(1), gaps, *row), "_h2": F.xxhash64(F.lit(2), *reversed(row), gaps)})
    prints = written(marked.groupBy("_h1", "_h2").agg(F.count(F.lit(1)).alias("_n")), "row-prints")
    again = prints.where("_n > 1")
    few = F.broadcast(again) if again.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else again
    alike = marked.join(few.select("_h1", "_h2"), ["_h1", "_h2"], "left_semi").groupBy(*df.columns).agg(F.lit(1).alias("_x"))
    once = prints.where("_n = 1").agg(F.count(F.lit(1)).alias("d")).select("d").scalar()
    more = alike.agg(F.count(F.lit(1)).alias("d")).select("d").scalar()
    return base.select("n_rows", F.lit(len(df.columns)).alias("n_columns"), "null_cells",
                       (F.col("n_rows") - once - more).alias("duplicate_rows"))
