"""Column expressions shared by the operators.

All of them are built-in Spark expressions (CASE, arithmetic, try_divide), so
they stay inside whole-stage codegen; none is a Python UDF.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from retainer import schema as S


def row_scalars(one_row) -> dict[str, Column]:
    """The columns of a one-row DataFrame as scalar-subquery columns.

    All of them read one struct-valued subquery, so Spark runs it once
    (ReuseSubquery) however many fields are used."""
    s = one_row.select(F.struct(*one_row.columns).alias("_s")).scalar()
    return {c: s.getField(c) for c in one_row.columns}


# -- B5 ratio features ------------------------------------------------------

def ratio_columns() -> dict[str, Column]:
    """Balance/(Salary+1), CreditScore/(Salary+1), Age/(Tenure+1), Products/(Tenure+1).

    ``try_divide`` gives NULL for a zero divisor (ANSI mode would raise)."""
    sal1 = F.col("EstimatedSalary") + F.lit(1)
    ten1 = F.col("Tenure") + F.lit(1)
    return {
        "Balance_to_Salary_Ratio": F.try_divide(F.col("Balance"), sal1),
        "Credit_to_Salary_Ratio": F.try_divide(F.col("CreditScore"), sal1),
        "Age_to_Tenure_Ratio": F.try_divide(F.col("Age"), ten1),
        "Products_per_Tenure": F.try_divide(F.col("NumOfProducts"), ten1),
    }


# -- B7 / B8 flags ------------------------------------------------------------

def as_flag(cond: Column) -> Column:
    return F.when(cond, F.lit(1)).otherwise(F.lit(0)).cast("int")


def high_value_fixed() -> Column:
    """Serving-time rule: Balance > 100000 OR EstimatedSalary > 100000."""
    return as_flag((F.col("Balance") > 100000) | (F.col("EstimatedSalary") > 100000))


def high_value_median(balance_median: Column, salary_median: Column) -> Column:
    """Training-time rule: strictly above both table-wide medians."""
    return as_flag((F.col("Balance") > balance_median) & (F.col("EstimatedSalary") > salary_median))


def behaviour_flag_columns() -> dict[str, Column]:
    inactive = F.col("IsActiveMember") == 0
    return {
        "IsLongTermCustomer": as_flag(F.col("Tenure") > 5),
        "HasMultipleProducts": as_flag(F.col("NumOfProducts") > 1),
        "IsYoungInactive": as_flag((F.col("Age") < 30) & inactive),
        "IsOldInactive": as_flag((F.col("Age") > 60) & inactive),
    }


# -- B4 flag normalisation -----------------------------------------------------

def yes_no_flag(c: Column) -> Column:
    """'Yes'/'1' -> 1, 'No'/'0' -> 0, anything else -> NULL (numbers pass through)."""
    s = F.trim(c.cast("string"))
    return (F.when(s.isin("Yes", "1"), F.lit(1))
            .when(s.isin("No", "0"), F.lit(0))
            .cast("int"))


def gender_flag(c: Column) -> Column:
    return F.when(c == "Male", F.lit(1)).when(c == "Female", F.lit(0)).cast("int")


# -- A5 generator label rule and the fixture's proxy scorer ----------------------

def additive_risk_terms() -> Column:
    """The additive churn score of the synthetic generator, without noise.

    Written left to right in the same order as the SQL oracle so that the
    floating-point sum is identical."""
    def ind(cond: Column) -> Column:
        return F.when(cond, F.lit(1)).otherwise(F.lit(0))

    return (F.lit(0.02)
            + F.lit(0.1) * (F.lit(1) - F.col("IsActiveMember"))
            + F.lit(0.05) * ind(F.col("Age") < 30)
            + F.lit(0.08) * ind(F.col("Age") > 60)
            + F.lit(0.1) * ind(F.col("Balance") < 10000)
            + F.lit(0.15) * ind(F.col("NumOfProducts") == 1)
            - F.lit(0.1) * ind(F.col("Tenure") > 5)
            - F.lit(0.05) * F.col("HasCrCard")
            + F.lit(0.1) * ind(F.col("Geography") == "Germany"))


def clip01(c: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), c))


def proxy_probability() -> Column:
    """Deterministic stand-in for a fitted model: 1.8 x the additive score,
    clipped to [0, 1] and rounded to 6 places."""
    return F.round(clip01(F.lit(1.8) * additive_risk_terms()), 6)


# -- E1 / E2 risk levels ------------------------------------------------------------

def risk_level(p: Column) -> Column:
    """< 0.25 Low, < 0.5 Medium, < 0.75 High, else Very High; NULL stays NULL."""
    low, mid, high = S.RISK_CUTS
    return (F.when(p.isNull(), F.lit(None).cast("string"))
            .when(p < low, F.lit(S.RISK_LEVELS[0]))
            .when(p < mid, F.lit(S.RISK_LEVELS[1]))
            .when(p < high, F.lit(S.RISK_LEVELS[2]))
            .otherwise(F.lit(S.RISK_LEVELS[3])))


def risk_level_numeric(level: Column) -> Column:
    expr = None
    for i, name in enumerate(S.RISK_LEVELS):
        expr = (F.when(level == name, F.lit(i)) if expr is None
                else expr.when(level == name, F.lit(i)))
    return expr.cast("int")


def is_high_risk(level: Column) -> Column:
    return level.isin(*S.HIGH_RISK_LEVELS)


# -- C6 / C7 rule segments -------------------------------------------------------------

def rule_segment(age: Column | None = None, balance: Column | None = None,
                 credit: Column | None = None, salary: Column | None = None) -> Column:
    """Age < 36 YP; Age >= 60 ARS; Balance > 100000 or CreditScore > 750
    (or, with ``salary``, EstimatedSalary > 100000) HVC; else ES."""
    age = F.col("Age") if age is None else age
    balance = F.col("Balance") if balance is None else balance
    credit = F.col("CreditScore") if credit is None else credit
    hv = (balance > 100000) | (credit > 750)
    if salary is not None:
        hv = hv | (salary > 100000)
    return (F.when(age < 36, F.lit(S.YP))
            .when(age >= 60, F.lit(S.ARS))
            .when(hv, F.lit(S.HVC))
            .otherwise(F.lit(S.ES)))


# -- T8 equal-width buckets -------------------------------------------------------------

def equal_width_bucket(x: Column, lo: Column, hi: Column, n: int) -> Column:
    """1-based bucket of ``x`` in ``n`` equal bins over [lo, hi]; the maximum
    falls in the last bin; a zero-width range puts everything in bin 1."""
    width = hi - lo
    raw = F.floor(F.try_divide((x - lo) * F.lit(float(n)), width)).cast("int") + F.lit(1)
    return F.when(width == 0, F.lit(1)).otherwise(F.least(raw, F.lit(n))).cast("int")


def bround6(c: Column) -> Column:
    return F.round(c, 6)
