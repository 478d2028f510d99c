"""Projections, encodings, engineered features and cleaning.

Fit statistics (medians, means, modes, quartiles) are computed as Spark
scalar subqueries or small aggregates and applied as column expressions, so
every function here returns a lazy DataFrame.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from retainer import schema as S
from retainer.functions import columns as C
from retainer.operators.stats import exact_median, exact_quantiles

ID_COLUMNS = ["RowNumber", "Surname"]
NUMERIC_TYPES = (T.IntegerType, T.LongType, T.DoubleType, T.FloatType, T.ShortType,
                 T.ByteType, T.DecimalType)


def numeric_columns(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, NUMERIC_TYPES) and f.name not in exclude]


def string_columns(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, T.StringType) and f.name not in exclude]


# B1 ---------------------------------------------------------------------------

def drop_identifiers(df: DataFrame, keep_key: bool = True) -> DataFrame:
    """Drop RowNumber and Surname; CustomerId stays as the pass-through key
    unless ``keep_key`` is False."""
    drop = ID_COLUMNS + ([] if keep_key else ["CustomerId"])
    return df.drop(*[c for c in drop if c in df.columns])


# B2 / B3 -------------------------------------------------------------------------

def fit_levels(df: DataFrame, column: str, max_levels: int = 1000) -> list[str]:
    """Sorted distinct non-null levels of a categorical column (one small
    distributed ``distinct``).  A column with more than ``max_levels`` is no
    category to one-hot encode and raises, so the driver never holds more."""
    rows = df.select(column).where(F.col(column).isNotNull()).distinct().limit(max_levels + 1).collect()
    if len(rows) > max_levels:
        raise ValueError(f"{column} has more than {max_levels} levels")
    return sorted(r[0] for r in rows)


def one_hot(df: DataFrame, column: str, levels: Sequence[str], drop_first: bool = True,
            keep_source: bool = False) -> DataFrame:
    """0/1 int columns ``<column>_<level>`` for the sorted ``levels``; the
    first level is the dropped reference level when ``drop_first``."""
    lv = sorted(levels)[1:] if drop_first else sorted(levels)
    out = df.select("*", *[C.as_flag(F.col(column) == lvl).alias(f"{column}_{lvl}") for lvl in lv])
    return out if keep_source else out.drop(column)


def one_hot_encode(df: DataFrame, geography_levels: Sequence[str] = S.GEOGRAPHY_LEVELS,
                   gender_levels: Sequence[str] = S.GENDER_LEVELS) -> DataFrame:
    """Training encoding: Geography_Germany, Geography_Spain, Gender_Male."""
    return one_hot(one_hot(df, "Geography", geography_levels), "Gender", gender_levels)


def align_features(df: DataFrame, features: Sequence[str] = S.FEATURES,
                   keep: Sequence[str] = ("CustomerId",)) -> DataFrame:
    """Scoring-time alignment to the model's feature list, in order: dummy
    columns are derived from the raw categorical columns when present, any
    feature still absent is 0, and an unknown level yields all zeros."""
    cols = set(df.columns)
    exprs: list[Column] = [F.col(k) for k in keep if k in cols]
    for f in features:
        if f in cols:
            exprs.append(F.col(f))
            continue
        src, _, level = f.partition("_")
        if level and src in cols and src in ("Geography", "Gender"):
            exprs.append(C.as_flag(F.col(src) == level).alias(f))
        else:
            exprs.append(F.lit(0).alias(f))
    return df.select(*exprs)


# B4 -------------------------------------------------------------------------------

def normalize_flags(df: DataFrame, flags: Sequence[str] = ("HasCrCard", "IsActiveMember"),
                    gender_column: str | None = None) -> DataFrame:
    """Yes/No/'1'/'0' text flags -> 1/0 (other text -> NULL, numbers pass);
    optionally Gender Male/Female -> 1/0 into ``gender_column``."""
    out = df
    for f in flags:
        if f not in df.columns:
            continue
        dtype = df.schema[f].dataType
        if isinstance(dtype, T.StringType):
            out = out.withColumn(f, C.yes_no_flag(F.col(f)))
        else:
            out = out.withColumn(f, F.col(f).cast("int"))
    if gender_column and "Gender" in df.columns:
        out = out.withColumn(gender_column, C.gender_flag(F.col("Gender")))
    return out


# B5 / B7 / B8 ------------------------------------------------------------------------

def add_ratio_features(df: DataFrame) -> DataFrame:
    return df.withColumns(C.ratio_columns())


def add_behaviour_flags(df: DataFrame) -> DataFrame:
    return df.withColumns(C.behaviour_flag_columns())


def add_high_value_fixed(df: DataFrame) -> DataFrame:
    return df.withColumn("IsHighValueCustomer", C.high_value_fixed())


def serving_features(df: DataFrame) -> DataFrame:
    """B5 + B7 + B8 as applied to scoring input."""
    return add_behaviour_flags(add_high_value_fixed(add_ratio_features(df)))


# B6 ------------------------------------------------------------------------------------

def median_scalars(df: DataFrame, cols: Sequence[str]) -> dict[str, Column]:
    """Exact table-wide medians as lazy scalar-subquery columns."""
    med = C.row_scalars(exact_median(df, [], cols))
    return {c: med[f"{c}_median"] for c in cols}


def add_high_value_median(df: DataFrame) -> DataFrame:
    """Training rule: Balance and EstimatedSalary strictly above their medians."""
    m = median_scalars(df, ["Balance", "EstimatedSalary"])
    return df.withColumn("IsHighValueCustomer",
                         C.high_value_median(m["Balance"], m["EstimatedSalary"]))


def training_features(df: DataFrame) -> DataFrame:
    """B1 + B2 + B5 + B6 + B8 + B9: raw labelled customers -> the 20 model
    features (+ CustomerId, Exited)."""
    x = one_hot_encode(drop_identifiers(df))
    x = add_behaviour_flags(add_high_value_median(add_ratio_features(x)))
    x = drop_invalid_rows(x)
    keep = [c for c in ("CustomerId", "Exited") if c in x.columns]
    return x.select(*keep, *S.FEATURES)


# B9 --------------------------------------------------------------------------------------

def drop_invalid_rows(df: DataFrame) -> DataFrame:
    """±inf and NaN become NULL on float columns, then rows with any NULL go."""
    out = df
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.col(f.name)
            bad = F.isnan(c) | (c == float("inf")) | (c == float("-inf"))
            out = out.withColumn(f.name, F.when(bad, F.lit(None).cast(f.dataType)).otherwise(c))
    return out.na.drop(how="any")


# B10 ---------------------------------------------------------------------------------------

def mode_scalars(df: DataFrame, columns: Sequence[str]) -> dict[str, Column]:
    """Most frequent non-null value (smallest on ties) of each text column.

    One group-by over the stacked columns counts all of them; a second
    aggregate keeps the top value of each, so no column is scanned again."""
    stacked = F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).alias("v")) for c in columns]))
    counts = df.select(stacked.alias("s")).select("s.c", "s.v").where("v is not null").groupBy("c", "v").agg(F.count(F.lit(1)).alias("n"))
    most = counts.groupBy("c").agg(F.max("n").alias("n"))
    top = counts.join(F.broadcast(most), ["c", "n"]).groupBy("c").agg(F.min("v").alias("v"))   # most: one row per column
    return C.row_scalars(top.groupBy().pivot("c", list(columns)).agg(F.first("v")))


def impute_missing(df: DataFrame, numeric: Sequence[str] | None = None,
                   categorical: Sequence[str] | None = None,
                   exclude: Sequence[str] = ("CustomerId",)) -> DataFrame:
    """Median for numeric columns, mode for categorical ones."""
    numeric = list(numeric) if numeric is not None else numeric_columns(df, exclude)
    categorical = list(categorical) if categorical is not None else string_columns(df, exclude)
    med = median_scalars(df, numeric) if numeric else {}
    fills = {}
    for c in numeric:
        fills[c] = F.coalesce(F.col(c), med[c].cast(df.schema[c].dataType))
    modes = mode_scalars(df, categorical) if categorical else {}
    for c in categorical:
        fills[c] = F.coalesce(F.col(c), modes[c])
    return df.withColumns(fills)


# B11 ----------------------------------------------------------------------------------------

def cap_outliers_iqr(df: DataFrame, cols: Sequence[str], factor: float = 1.5) -> DataFrame:
    """Clamp each column to [Q1 - f*IQR, Q3 + f*IQR]; rows are kept, NULLs stay."""
    qs = exact_quantiles(df, [], cols, [0.25, 0.75])
    wide = C.row_scalars(qs.groupBy().pivot("column", list(cols)).agg(
        F.first(F.struct(F.col("q0").alias("q1"), F.col("q1").alias("q3")))))
    fills = {}
    for c in cols:
        q1 = wide[c].getField("q1")
        q3 = wide[c].getField("q3")
        lo = q1 - F.lit(factor) * (q3 - q1)
        hi = q3 + F.lit(factor) * (q3 - q1)
        fills[c] = F.least(F.greatest(F.col(c).cast("double"), lo), hi)
    return df.withColumns(fills)


# B12 -----------------------------------------------------------------------------------------

def validation_rules() -> list[tuple[str, Column]]:
    """(rule, violated) pairs checked by ``validate_rules``."""
    def outside(c: str, lo: float, hi: float) -> Column:
        return (F.col(c) < lo) | (F.col(c) > hi)

    return [
        ("null_customer_id", F.col("CustomerId").isNull()),
        ("null_balance", F.col("Balance").isNull()),
        ("credit_score_out_of_range", outside("CreditScore", 300, 900)),
        ("age_out_of_range", outside("Age", 18, 100)),
        ("tenure_out_of_range", outside("Tenure", 0, 10)),
        ("balance_out_of_range", outside("Balance", 0, 250000)),
        ("products_out_of_range", outside("NumOfProducts", 1, 4)),
        ("salary_out_of_range", outside("EstimatedSalary", 0, 1000000)),
        ("unknown_geography", ~F.coalesce(F.col("Geography").isin(*S.GEOGRAPHY_LEVELS), F.lit(False))),
        ("unknown_gender", ~F.coalesce(F.col("Gender").isin(*S.GENDER_LEVELS), F.lit(False))),
        ("bad_card_flag", ~F.coalesce(F.col("HasCrCard").isin(0, 1), F.lit(False))),
        ("bad_active_flag", ~F.coalesce(F.col("IsActiveMember").isin(0, 1), F.lit(False))),
    ]


def validate_rules(df: DataFrame, key: str = "CustomerId") -> DataFrame:
    """One aggregate pass: violations per rule, plus duplicate keys; returned
    long as (rule, violations)."""
    rules = validation_rules()
    aggs = [F.count_if(cond).alias(f"r{i}") for i, (_, cond) in enumerate(rules)]
    aggs.append((F.count(F.lit(1)) - F.count_distinct(F.col(key))
                 - F.count_if(F.col(key).isNull())).alias("dup"))
    wide = df.agg(*aggs)
    names = [r for r, _ in rules] + ["duplicate_customer_id"]
    cols = [f"r{i}" for i in range(len(rules))] + ["dup"]
    pairs = ", ".join(f"'{n}', {c}" for n, c in zip(names, cols))
    return wide.selectExpr(f"stack({len(names)}, {pairs}) AS (rule, violations)")


# B13 ----------------------------------------------------------------------------------------

def standardize(df: DataFrame, cols: Sequence[str] = S.CLUSTER_FEATURES,
                keep: Sequence[str] = ("CustomerId",), suffix: str = "_z") -> DataFrame:
    """(x - mean) / population std per column; constant columns give NULL."""
    stats = C.row_scalars(df.agg(*[F.avg(c).alias(f"m_{c}") for c in cols],
                                 *[F.stddev_pop(c).alias(f"s_{c}") for c in cols]))
    exprs = [F.col(k) for k in keep if k in df.columns]
    for c in cols:
        m = stats[f"m_{c}"]
        s = stats[f"s_{c}"]
        exprs.append(F.try_divide(F.col(c) - m, s).alias(f"{c}{suffix}"))
    return df.select(*exprs)


# B14 ----------------------------------------------------------------------------------------

def apply_defaults(df: DataFrame, defaults: dict | None = None) -> DataFrame:
    """Fill absent or NULL rule inputs with the rule defaults."""
    defaults = defaults or S.FIELD_DEFAULTS
    fills = {}
    for c, v in defaults.items():
        fills[c] = F.coalesce(F.col(c), F.lit(v)) if c in df.columns else F.lit(v)
    return df.withColumns(fills)
