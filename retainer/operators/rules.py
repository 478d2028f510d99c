"""H1-H9 per-customer rule analytics as whole-table column expressions.

Each customer's factor / strategy / recommendation list is an array built
from CASE expressions inside its own row (``array`` -> ``filter`` ->
``sort_array`` -> ``slice``), then ``posexplode``d into tidy rows when a
long table is wanted.  No self-join, no shuffle, no Python UDF.  The
segment-level lookups (churn %, ltv, unit cost) come from a table with one
row per segment, joined on the segment name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from retainer import schema as S
from retainer.functions import columns as C
from retainer.operators import describe as D

R6 = C.bround6


def _money2(c: Column) -> Column:
    return F.format_number(c.cast("double"), 2)


def _text(template: str, values: dict[str, Column]) -> Column:
    """Fill ``{name}`` slots of a fixed template with column values."""
    parts: list[Column] = []
    rest = template
    while "{" in rest:
        head, _, tail = rest.partition("{")
        name, _, rest = tail.partition("}")
        if head:
            parts.append(F.lit(head))
        parts.append(values[name])
    if rest:
        parts.append(F.lit(rest))
    return F.concat(*parts) if len(parts) > 1 else parts[0]


def with_rule_inputs(df: DataFrame) -> DataFrame:
    """Defaults for absent inputs, the single-record segment (with salary)
    and the risk level."""
    from retainer.operators.features import apply_defaults

    x = apply_defaults(df)
    return (x.withColumn("segment", C.rule_segment(salary=F.col("EstimatedSalary")))
             .withColumn("risk_level", C.risk_level(F.col("ChurnProbability"))))


# H1 ---------------------------------------------------------------------------------------------

def _factor(spec, cond: Column, values: dict[str, Column]) -> Column:
    name, impact, score, template = spec
    return F.when(cond, F.struct(F.lit(score).alias("impact_score"), F.lit(name).alias("factor"),
                                 F.lit(impact).alias("impact"),
                                 _text(template, values).alias("details")))


def factor_array(top: int = 3) -> Column:
    """Top ``top`` churn factors by score for the current row (needs the rule
    inputs and ChurnProbability)."""
    age, bal = F.col("Age"), F.col("Balance")
    prod, ten = F.col("NumOfProducts"), F.col("Tenure")
    vals = {"Age": age.cast("string"), "NumOfProducts": prod.cast("string"),
            "Tenure": ten.cast("string"), "CreditScore": F.col("CreditScore").cast("string"),
            "Balance": _money2(bal)}
    cands = F.array(
        _factor(S.FACTOR_INACTIVE, F.col("IsActiveMember") == 0, vals),
        _factor(S.FACTOR_SENIOR, age > 60, vals),
        _factor(S.FACTOR_YOUNG, (age <= 60) & (age < 30), vals),
        _factor(S.FACTOR_SINGLE_PRODUCT, prod == 1, vals),
        _factor(S.FACTOR_OVER_BANKED, (prod != 1) & (prod > 3), vals),
        _factor(S.FACTOR_LOW_BALANCE, bal < 10000, vals),
        _factor(S.FACTOR_WEALTHY_SENIOR, (bal >= 10000) & (bal > 150000) & (age > 55), vals),
        _factor(S.FACTOR_GERMANY, F.col("Geography") == "Germany", vals),
        _factor(S.FACTOR_LOW_TENURE, ten < 2, vals),
        _factor(S.FACTOR_LOW_CREDIT, F.col("CreditScore") < 600, vals),
    )
    hits = F.slice(F.sort_array(F.filter(cands, lambda s: s.isNotNull()), asc=False), 1, top)
    p = F.col("ChurnProbability")

    def general(spec) -> Column:
        name, impact, details = spec
        return F.array(F.struct(p.alias("impact_score"), F.lit(name).alias("factor"),
                                F.lit(impact).alias("impact"), F.lit(details).alias("details")))

    fallback = (F.when(p > 0.7, general(S.FACTOR_MULTIPLE))
                 .when(p > 0.4, general(S.FACTOR_MODERATE))
                 .otherwise(F.filter(general(S.FACTOR_MODERATE), lambda s: F.lit(False))))
    return F.when(F.size(hits) > 0, hits).otherwise(fallback)


def churn_factors(scored: DataFrame) -> DataFrame:
    """Long form: CustomerId, rank, factor, impact, impact_score, details."""
    x = with_rule_inputs(scored).select("CustomerId", F.posexplode(factor_array()).alias("pos", "f"))
    return x.select("CustomerId", (F.col("pos") + 1).alias("rank"), "f.factor", "f.impact",
                    R6(F.col("f.impact_score")).alias("impact_score"), "f.details")


# segment lookups -----------------------------------------------------------------------------

def with_segment_lookups(x: DataFrame, performance: DataFrame | None = None,
                         segment_churn: DataFrame | None = None) -> DataFrame:
    """Attach per-segment ltv / unit cost / churn % to every row.

    The lookup holds one row per segment -- at most the four rule segments,
    since ``segment`` is a four-way CASE -- so it is broadcast: a shuffle
    join on a four-valued key would put all rows into four tasks."""
    lk = None
    if performance is not None:
        lk = performance.select("segment", F.col("ltv").alias("seg_ltv"),
                                F.col("retention_cost").alias("seg_cost"))
    if segment_churn is not None:
        sc = segment_churn.select("segment", "churn_pct")
        lk = sc if lk is None else lk.join(sc, "segment", "full")
    return x.join(F.broadcast(lk), "segment", "left")


# H2 ---------------------------------------------------------------------------------------------

def similar_columns() -> dict[str, Column]:
    """Cohort size and estimated churn rate (needs rule inputs + churn_pct)."""
    age, seg = F.col("Age"), F.col("segment")
    base = D._rate_case(seg, S.SIMILAR_BASE_COUNT, S.SIMILAR_BASE_COUNT_OTHER)
    count = (F.when((age < 25) | (age > 70), (base * F.lit(0.3)).cast("bigint"))
              .when((age >= 30) & (age <= 50), (base * F.lit(1.2)).cast("bigint"))
              .otherwise(base.cast("bigint")))
    geo, prod, bal = F.col("Geography"), F.col("NumOfProducts"), F.col("Balance")
    adj = (F.lit(0.0)
           + F.when(F.col("IsActiveMember") == 0, F.lit(12.5)).otherwise(F.lit(0.0))
           + F.when(geo == "Germany", F.lit(8.2)).when(geo == "Spain", F.lit(3.1)).otherwise(F.lit(0.0))
           + F.when(prod == 1, F.lit(6.8)).when(prod > 3, F.lit(4.2)).otherwise(F.lit(0.0))
           + F.when(bal < 10000, F.lit(5.5)).when(bal > 200000, F.lit(2.8)).otherwise(F.lit(0.0))
           + F.when(age > 65, F.lit(8.9)).when(age < 25, F.lit(4.3)).otherwise(F.lit(0.0)))
    base_rate = F.coalesce(F.col("churn_pct"), F.lit(S.ROI_DEFAULT_CHURN_PCT))
    rate = F.least(base_rate + adj, F.lit(75.0)) / F.lit(100)
    return {"similar_count": count, "similar_churn_rate": rate}


def similar_customers(scored: DataFrame, segment_churn: DataFrame) -> DataFrame:
    """``segment_churn``: one row per segment (segment, churn_pct)."""
    x = with_segment_lookups(with_rule_inputs(scored), segment_churn=segment_churn)
    cols = similar_columns()
    return x.select("CustomerId", "segment", cols["similar_count"].alias("similar_count"),
                    R6(cols["similar_churn_rate"]).alias("similar_churn_rate"))


# H3 ---------------------------------------------------------------------------------------------

def _strategy(spec) -> Column:
    name, eff, details = spec
    return F.struct(F.lit(name).alias("strategy"), F.lit(eff).alias("effectiveness"),
                    F.lit(details).alias("details"))


def strategy_array(top: int = 4) -> Column:
    seg = F.col("segment")
    by_seg = None
    for name, specs in S.SEGMENT_STRATEGIES.items():
        arr = F.array(*[_strategy(s) for s in specs])
        by_seg = F.when(seg == name, arr) if by_seg is None else by_seg.when(seg == name, arr)
    by_seg = by_seg.otherwise(F.array(*[_strategy(s) for s in S.SEGMENT_STRATEGIES[S.ES]]))
    empty = F.filter(F.array(_strategy(S.STRATEGY_URGENT)), lambda s: F.lit(False))
    urgent = F.when(C.is_high_risk(F.col("risk_level")), F.array(_strategy(S.STRATEGY_URGENT))).otherwise(empty)
    react = F.when(F.col("IsActiveMember") == 0, F.array(_strategy(S.STRATEGY_REACTIVATION))).otherwise(empty)
    expand = F.when(F.col("NumOfProducts") == 1, F.array(_strategy(S.STRATEGY_EXPANSION))).otherwise(empty)
    return F.slice(F.concat(urgent, by_seg, react, expand), 1, top)


def retention_strategies(scored: DataFrame) -> DataFrame:
    x = with_rule_inputs(scored).select("CustomerId", F.posexplode(strategy_array()).alias("pos", "s"))
    return x.select("CustomerId", (F.col("pos") + 1).alias("rank"), "s.strategy",
                    "s.effectiveness", "s.details")


# H4 / H5 / H6 --------------------------------------------------------------------------------------

def finance_columns() -> dict[str, Column]:
    """Adjusted ltv, adjusted retention cost and 3-year churn impact (needs
    rule inputs + seg_ltv / seg_cost)."""
    bal, prod = F.col("Balance"), F.col("NumOfProducts")
    adj = (F.lit(1.0)
           + F.when(bal > 150000, F.lit(0.3)).when(bal < 25000, F.lit(-0.2)).otherwise(F.lit(0.0))
           + F.when(prod > 2, F.lit(0.15)).when(prod == 1, F.lit(-0.1)).otherwise(F.lit(0.0))
           + F.when(F.col("IsActiveMember") == 0, F.lit(-0.25)).otherwise(F.lit(0.0)))
    risk = F.col("risk_level")
    cadj = (F.lit(1.0) + F.when(risk == "Very High Risk", F.lit(0.5)).when(risk == "High Risk", F.lit(0.3))
            .when(risk == "Low Risk", F.lit(-0.2)).otherwise(F.lit(0.0)))
    ltv = (F.col("seg_ltv") * adj).cast("bigint")
    cost = (F.col("seg_cost") * cadj).cast("bigint")
    impact = (ltv * F.lit(3) * F.col("ChurnProbability") - cost).cast("bigint")
    return {"customer_ltv": ltv, "retention_cost": cost, "churn_impact": impact}


def customer_finance(scored: DataFrame, performance: DataFrame) -> DataFrame:
    """``performance``: one row per segment (segment, ltv, retention_cost)."""
    x = with_segment_lookups(with_rule_inputs(scored), performance=performance)
    cols = finance_columns()
    return x.select("CustomerId", "segment", "risk_level", "ChurnProbability",
                    *[v.alias(k) for k, v in cols.items()])


# H7 ----------------------------------------------------------------------------------------------

def recommendation_array(cost: Column) -> Column:
    vals = {"cost": F.format_number(cost, 0), "cost2": F.format_number(cost * 2, 0)}
    risk = F.col("risk_level")
    expr = None
    for lv in reversed(S.RISK_LEVELS):
        arr = F.array(*[_text(t, vals) for t in S.RISK_RECOMMENDATIONS[lv]])
        expr = F.when(risk == lv, arr) if expr is None else expr.when(risk == lv, arr)
    return expr


def recommendations(finance: DataFrame) -> DataFrame:
    """Four recommendations per customer by risk level (money from the
    adjusted retention cost)."""
    x = finance.select("CustomerId", F.posexplode(recommendation_array(F.col("retention_cost")))
                       .alias("pos", "recommendation"))
    return x.select("CustomerId", (F.col("pos") + 1).alias("rank"), "recommendation")


# H8 ----------------------------------------------------------------------------------------------

def playbook(spark) -> DataFrame:
    """The fixed strategy playbooks as one tidy table (kind, key, rank, text)."""
    rows = []
    for seg, items in S.PLAYBOOK_SEGMENT.items():
        rows += [("segment", seg, i + 1, t) for i, t in enumerate(items)]
    for lv, items in S.PLAYBOOK_RISK.items():
        rows += [("risk", lv, i + 1, t) for i, t in enumerate(items)]
    for seg, items in S.PLAYBOOK_BATCH_SEGMENT.items():
        rows += [("batch_segment", seg, i + 1, t) for i, t in enumerate(items)]
    rows += [("overall", "all", i + 1, t) for i, t in enumerate(S.PLAYBOOK_OVERALL)]
    return spark.createDataFrame(rows, "kind string, key string, rank int, text string")


def playbook_by_segment(enhanced: DataFrame) -> DataFrame:
    """Playbook entries with the number of customers each one applies to."""
    spark = enhanced.sparkSession
    pb = playbook(spark)
    seg = enhanced.groupBy(F.col("SegmentName").alias("key")).agg(F.count(F.lit(1)).alias("customers"))
    risk = enhanced.groupBy(F.col("RiskLevel").alias("key")).agg(F.count(F.lit(1)).alias("customers"))
    total = enhanced.agg(F.count(F.lit(1)).alias("n")).select("n").scalar()
    counts = (seg.withColumn("kind", F.lit("segment"))
              .unionByName(seg.withColumn("kind", F.lit("batch_segment")))
              .unionByName(risk.withColumn("kind", F.lit("risk"))))
    j = pb.join(counts, ["kind", "key"], "left")
    n = F.when(F.col("kind") == "overall", total).otherwise(F.coalesce(F.col("customers"), F.lit(0)))
    return j.select("kind", "key", "rank", "text", n.cast("bigint").alias("customers"))


# H9 ----------------------------------------------------------------------------------------------

def customer_report(scored: DataFrame, performance: DataFrame, segment_churn: DataFrame) -> DataFrame:
    """One nested row per customer: prediction, factors, strategies,
    recommendations, finance and similar-customer estimate -- all columns of
    one pass over the scored table plus the broadcast segment lookup."""
    x = with_segment_lookups(with_rule_inputs(scored), performance, segment_churn)
    fin, sim = finance_columns(), similar_columns()
    return x.select(
        "CustomerId",
        F.struct(F.col("ChurnProbability").alias("churn_probability"), F.col("risk_level"),
                 F.col("segment").alias("customer_segment")).alias("prediction"),
        F.struct(factor_array().alias("churn_factors"),
                 strategy_array().alias("retention_strategies"),
                 recommendation_array(fin["retention_cost"]).alias("recommendations")).alias("analysis"),
        F.struct(*[v.alias(k) for k, v in fin.items()]).alias("financial_impact"),
        F.struct(sim["similar_count"].alias("count"),
                 sim["similar_churn_rate"].alias("churn_rate")).alias("similar_customers"))
