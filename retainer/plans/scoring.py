"""Registered queries G1-G12 (batch scoring and its analytics) and H1-H8
(per-customer rule analytics over whole tables)."""

from __future__ import annotations

from pyspark.sql import functions as F

from retainer import schema as S
from retainer.operators import batch as B
from retainer.operators import describe as D
from retainer.operators import rankindex as RI
from retainer.operators import rules as H
from retainer.plans.catalog import (HIGH, PERF_CTES, SCORING_CTES, batch_results, performance_table,
                                    register, risk_sql, segment_sql)
from retainer.plans.oracle import q
from retainer.session import scratch_path
from retainer.sources import tables as TB


def _s(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _key(name: str) -> str:
    return B._key(name)


# G1 ------------------------------------------------------------------------------------------------

@register("batch_score", q("SELECT * FROM batch", SCORING_CTES))
def batch_score(spark, d):
    return batch_results(spark, d)


# G2 ------------------------------------------------------------------------------------------------

def _summary_sql() -> str:
    pcts = [f"ROUND(count_if(RiskLevel = '{lv}') * 100e0 / count(*), 6) AS risk_pct_{_key(lv)}"
            for lv in S.RISK_LEVELS]
    pcts += [f"ROUND(count_if(Segment = '{sg}') * 100e0 / count(*), 6) AS segment_pct_{_key(sg)}"
             for sg in S.SEGMENTS]
    return q(f"""SELECT count(*) AS total_customers, ROUND(avg(ChurnProbability), 6) AS avg_churn_probability,
       CAST(count_if({HIGH}) AS BIGINT) AS high_risk_count, {', '.join(pcts)} FROM batch""", SCORING_CTES)


@register("batch_summary", _summary_sql())
def batch_summary(spark, d):
    return B.batch_summary(batch_results(spark, d))


# G3 / G12 ----------------------------------------------------------------------------------------------

@register("top_risk_customers", q("""
SELECT CustomerId, Segment, ChurnProbability, RiskLevel FROM batch
ORDER BY ChurnProbability DESC, CustomerId ASC LIMIT 20""", SCORING_CTES))
def top_risk_customers(spark, d):
    return B.top_risk_customers(batch_results(spark, d))


@register("result_page", q("""
SELECT rank, CustomerId, Segment, ChurnProbability, RiskLevel,
       CAST(ceil((SELECT count(*) FROM batch) / 5e0) AS BIGINT) AS total_pages
FROM (SELECT CAST(row_number() OVER (ORDER BY ChurnProbability DESC, CustomerId ASC) AS BIGINT) AS rank,
             CustomerId, Segment, ChurnProbability, RiskLevel FROM batch) t
WHERE rank BETWEEN 6 AND 10""", SCORING_CTES))
def result_page(spark, d):
    return B.result_page(batch_results(spark, d), page=2, per_page=5)


@register("ranked_page", q("""
SELECT rank, CustomerId, Segment, ChurnProbability, RiskLevel, CAST(ceil(n / 2e1) AS BIGINT) AS total_pages
FROM (SELECT CAST(row_number() OVER (ORDER BY ChurnProbability DESC, CustomerId ASC) AS BIGINT) AS rank, count(*) OVER () AS n,
             CustomerId, Segment, ChurnProbability, RiskLevel FROM batch WHERE Segment = 'Established Savers') t
WHERE rank BETWEEN 61 AND 80""", SCORING_CTES))
def ranked_page(spark, d):
    """Page 4 of one segment, twenty rows a page, from a ranked result written in blocks."""
    path = scratch_path(spark, "ranked")
    RI.write_ranked(batch_results(spark, d), path)
    return RI.read_page(spark, path, page=4, per_page=20, segment=S.ES)


@register("ranked_range", q("""
SELECT CAST(rank AS BIGINT) AS rank, CustomerId, RiskLevel, ChurnProbability
FROM (SELECT row_number() OVER (ORDER BY ChurnProbability DESC, CustomerId ASC) AS rank, * FROM batch) t
WHERE ChurnProbability BETWEEN 25e-2 AND 5e-1""", SCORING_CTES))
def ranked_range(spark, d):
    """A probability band, from the blocks of the ranked result that reach into it."""
    path = scratch_path(spark, "ranked")
    RI.write_ranked(batch_results(spark, d), path)
    return RI.read_range(spark, path, 0.25, 0.5).select("rank", "CustomerId", "RiskLevel", "ChurnProbability")


# G4 / G5 ------------------------------------------------------------------------------------------------

@register("batch_segment_insights", q("""
SELECT Segment, ROUND(avg(ChurnProbability) * 100e0, 6) AS avg_churn, count(*) AS count
FROM batch GROUP BY Segment""", SCORING_CTES))
def batch_segment_insights(spark, d):
    return B.batch_segment_insights(batch_results(spark, d))


@register("batch_risk_insights", q("""
SELECT RiskLevel, ROUND(avg(ChurnProbability) * 100e0, 6) AS avg_probability, count(*) AS count
FROM batch GROUP BY RiskLevel""", SCORING_CTES))
def batch_risk_insights(spark, d):
    return B.batch_risk_insights(batch_results(spark, d))


# G6 ------------------------------------------------------------------------------------------------------

@register("segment_analysis", q("""
SELECT Segment, count(*) AS count, ROUND(avg(Age), 6) AS age_mean, min(Age) AS age_min, max(Age) AS age_max,
       ROUND(avg(Balance), 6) AS balance_mean, ROUND(median(Balance), 6) AS balance_median,
       ROUND(avg(ChurnProbability) * 100e0, 6) AS churn_mean,
       ROUND(median(ChurnProbability) * 100e0, 6) AS churn_median,
       ROUND(stddev_samp(ChurnProbability) * 100e0, 6) AS churn_std
FROM batch GROUP BY Segment""", SCORING_CTES))
def segment_analysis(spark, d):
    return B.segment_analysis(batch_results(spark, d))


@register("segment_risk_share", q("""
SELECT Segment, RiskLevel, ROUND(n * 100e0 / sum(n) OVER (PARTITION BY Segment), 6) AS pct
FROM (SELECT Segment, RiskLevel, count(*) AS n FROM batch GROUP BY Segment, RiskLevel) t""", SCORING_CTES))
def segment_risk_share(spark, d):
    return B.segment_risk_share(batch_results(spark, d))


# G7 / G8 ---------------------------------------------------------------------------------------------------

FIN_CTES = SCORING_CTES + "," + PERF_CTES + f""",
fin0 AS (
  SELECT b.Segment, b.customer_count, b.p, b.high_risk_count,
         COALESCE(CAST(perf.ltv AS DOUBLE), 5000e0) AS ltv,
         b.customer_count * b.p AS expected,
         b.high_risk_count * COALESCE(CAST(perf.retention_cost AS DOUBLE), 300e0) AS cost
  FROM (SELECT Segment, count(*) AS customer_count, avg(ChurnProbability) AS p,
               CAST(count_if({HIGH}) AS BIGINT) AS high_risk_count FROM batch GROUP BY Segment) b
  LEFT JOIN perf ON b.Segment = perf.segment),
fin AS (
  SELECT Segment, customer_count, ROUND(p, 6) AS expected_churn_rate,
         ROUND(expected, 6) AS expected_churn_count, ltv,
         ROUND(expected * ltv, 6) AS potential_revenue_loss, high_risk_count,
         ROUND(cost, 6) AS retention_cost,
         ROUND(CASE WHEN cost > 0 THEN expected * 3e-1 * ltv ELSE 0e0 END, 6) AS potential_savings,
         ROUND(CASE WHEN cost > 0 THEN ((expected * 3e-1 * ltv) - cost) / cost * 100 ELSE 0e0 END, 6) AS roi
  FROM fin0)"""


@register("financial_impact", q("SELECT * FROM fin", FIN_CTES))
def financial_impact(spark, d):
    return B.financial_impact(batch_results(spark, d), performance_table(spark, d))


@register("portfolio_totals", q(f"""
SELECT s.n AS total_customers, ROUND(s.p * 100e0, 6) AS avg_churn_pct, s.hr AS high_risk_count,
       ROUND(CASE WHEN s.n > 0 THEN s.hr * 100e0 / s.n ELSE 0e0 END, 6) AS high_risk_pct,
       ROUND(t.loss, 6) AS total_revenue_loss, ROUND(t.cost, 6) AS total_retention_cost,
       ROUND(t.savings, 6) AS total_potential_savings,
       ROUND(CASE WHEN t.cost > 0 THEN (t.savings - t.cost) / t.cost * 100 ELSE 0e0 END, 6) AS overall_roi
FROM (SELECT sum(potential_revenue_loss) AS loss, sum(retention_cost) AS cost,
             sum(potential_savings) AS savings FROM fin) t,
     (SELECT count(*) AS n, CAST(count_if({HIGH}) AS BIGINT) AS hr, avg(ChurnProbability) AS p FROM batch) s""", FIN_CTES))
def portfolio_totals(spark, d):
    res = batch_results(spark, d)
    return B.portfolio_totals(B.financial_impact(res, performance_table(spark, d)), res)


# G9 / G10 / G11 -----------------------------------------------------------------------------------------------

BATCH_COLS = "CustomerId, CreditScore, Age, Tenure, Balance, NumOfProducts, HasCrCard, IsActiveMember, " \
             "EstimatedSalary, ChurnProbability, RiskLevel, Segment"


@register("filter_results", q(f"""
SELECT {BATCH_COLS} FROM batch
WHERE Segment = 'At-Risk Seniors' AND COALESCE(ChurnProbability, 0e0) * 100e0 >= 30e0""", SCORING_CTES))
def filter_results(spark, d):
    return B.filter_results(batch_results(spark, d), segment=S.ARS, band="30-")


def _dims_values() -> str:
    rows = [f"('risk', {_s(v)})" for v in S.RISK_LEVELS] + [f"('segment', {_s(v)})" for v in S.SEGMENTS]
    return ", ".join(rows)


@register("filtered_distribution", q(f"""
SELECT d.kind, d.key,
       ROUND(CASE WHEN (SELECT count(*) FROM f) > 0
                  THEN COALESCE(c.c, 0) * 100e0 / (SELECT count(*) FROM f) ELSE 0e0 END, 6) AS pct
FROM (VALUES {_dims_values()}) AS d(kind, key)
LEFT JOIN (SELECT 'risk' AS kind, RiskLevel AS key, count(*) AS c FROM f GROUP BY RiskLevel
           UNION ALL
           SELECT 'segment' AS kind, Segment AS key, count(*) AS c FROM f GROUP BY Segment) c
  ON d.kind = c.kind AND d.key = c.key""", SCORING_CTES + """,
f AS (SELECT * FROM batch WHERE COALESCE(ChurnProbability, 0e0) * 100e0 >= 20e0
                            AND COALESCE(ChurnProbability, 0e0) * 100e0 <= 60e0)"""))
def filtered_distribution(spark, d):
    return B.filtered_distribution(B.filter_results(batch_results(spark, d), band="20-60"))


@register("filtered_segment_churn", q(f"""
SELECT d.Segment, ROUND(COALESCE(a.p * 100e0, 0e0), 6) AS avg_churn
FROM (VALUES {', '.join(f'({_s(v)})' for v in S.SEGMENTS)}) AS d(Segment)
LEFT JOIN (SELECT Segment, avg(COALESCE(ChurnProbability, 0e0)) AS p FROM batch
           WHERE RiskLevel = 'High Risk' GROUP BY Segment) a ON d.Segment = a.Segment""", SCORING_CTES))
def filtered_segment_churn(spark, d):
    return B.filtered_segment_churn(B.filter_results(batch_results(spark, d), risk="High Risk"))


# H: rule inputs of one scored table ----------------------------------------------------------------------------

RULE_CTE = f"""
rule_in AS (
  SELECT CustomerId, COALESCE(Age, 35) AS Age, COALESCE(IsActiveMember, 1) AS IsActiveMember,
         COALESCE(NumOfProducts, 1) AS NumOfProducts, COALESCE(Balance, 75000e0) AS Balance,
         COALESCE(Geography, 'France') AS Geography, COALESCE(Tenure, 5) AS Tenure,
         COALESCE(CreditScore, 650) AS CreditScore, COALESCE(EstimatedSalary, 50000e0) AS EstimatedSalary,
         ChurnProbability
  FROM churn_scored),
rule_x AS (
  SELECT *, {segment_sql(True)} AS segment, {risk_sql()} AS risk_level FROM rule_in)"""


def _template_sql(template: str) -> str:
    """A fixed text with {Field} slots -> SQL concatenation."""
    out, rest = [], template
    while "{" in rest:
        head, _, tail = rest.partition("{")
        name, _, rest = tail.partition("}")
        if head:
            out.append(_s(head))
        out.append("format('{:,.2f}', Balance)" if name == "Balance" else f"CAST({name} AS VARCHAR)")
    if rest:
        out.append(_s(rest))
    return " || ".join(out)


FACTOR_CONDITIONS = [
    (S.FACTOR_INACTIVE, "IsActiveMember = 0"),
    (S.FACTOR_SENIOR, "Age > 60"),
    (S.FACTOR_YOUNG, "Age <= 60 AND Age < 30"),
    (S.FACTOR_SINGLE_PRODUCT, "NumOfProducts = 1"),
    (S.FACTOR_OVER_BANKED, "NumOfProducts <> 1 AND NumOfProducts > 3"),
    (S.FACTOR_LOW_BALANCE, "Balance < 10000"),
    (S.FACTOR_WEALTHY_SENIOR, "Balance >= 10000 AND Balance > 150000 AND Age > 55"),
    (S.FACTOR_GERMANY, "Geography = 'Germany'"),
    (S.FACTOR_LOW_TENURE, "Tenure < 2"),
    (S.FACTOR_LOW_CREDIT, "CreditScore < 600"),
]


def _factors_sql() -> str:
    parts = [f"SELECT CustomerId, {_s(n)} AS factor, {_s(i)} AS impact, CAST({sc!r} AS DOUBLE) AS impact_score, "
             f"{_template_sql(t)} AS details FROM rule_x WHERE {cond}"
             for (n, i, sc, t), cond in FACTOR_CONDITIONS]
    hits = "\n  UNION ALL ".join(parts)
    m, mod = S.FACTOR_MULTIPLE, S.FACTOR_MODERATE
    return q(f"""
SELECT CustomerId, CAST(rank AS INT) AS rank, factor, impact, ROUND(impact_score, 6) AS impact_score, details
FROM (SELECT *, row_number() OVER (PARTITION BY CustomerId ORDER BY impact_score DESC) AS rank FROM (
  SELECT * FROM hits
  UNION ALL
  SELECT CustomerId,
         CASE WHEN ChurnProbability > 7e-1 THEN {_s(m[0])} ELSE {_s(mod[0])} END,
         CASE WHEN ChurnProbability > 7e-1 THEN {_s(m[1])} ELSE {_s(mod[1])} END,
         ChurnProbability,
         CASE WHEN ChurnProbability > 7e-1 THEN {_s(m[2])} ELSE {_s(mod[2])} END
  FROM rule_x WHERE ChurnProbability > 4e-1 AND CustomerId NOT IN (SELECT CustomerId FROM hits)) u) r
WHERE rank <= 3""", RULE_CTE + f",\nhits AS ({hits})")


@register("churn_factors", _factors_sql())
def churn_factors(spark, d):
    return H.churn_factors(TB.churn_scored(spark, d))


def _case_map(col: str, mapping: dict, other: str) -> str:
    arms = " ".join(f"WHEN {_s(k)} THEN {v}" for k, v in mapping.items())
    return f"CASE {col} {arms} ELSE {other} END"


SEG_CHURN_LOOKUP = """
seg_churn_r AS (SELECT SegmentName AS segment, ROUND(avg(Exited) * 100e0, 6) AS churn_pct
                FROM enhanced GROUP BY SegmentName)"""


@register("similar_customers", q(f"""
SELECT x.CustomerId, x.segment,
       CAST(CASE WHEN x.Age < 25 OR x.Age > 70 THEN trunc(x.base * 3e-1)
                 WHEN x.Age >= 30 AND x.Age <= 50 THEN trunc(x.base * 12e-1)
                 ELSE x.base END AS BIGINT) AS similar_count,
       ROUND(LEAST(COALESCE(c.churn_pct, 15e0) + x.adj, 75e0) / 100, 6) AS similar_churn_rate
FROM (SELECT *, {_case_map('segment', S.SIMILAR_BASE_COUNT, str(S.SIMILAR_BASE_COUNT_OTHER))} AS base,
             ((((0e0 + CASE WHEN IsActiveMember = 0 THEN 125e-1 ELSE 0e0 END)
                + CASE WHEN Geography = 'Germany' THEN 82e-1 WHEN Geography = 'Spain' THEN 31e-1 ELSE 0e0 END)
                + CASE WHEN NumOfProducts = 1 THEN 68e-1 WHEN NumOfProducts > 3 THEN 42e-1 ELSE 0e0 END)
                + CASE WHEN Balance < 10000 THEN 55e-1 WHEN Balance > 200000 THEN 28e-1 ELSE 0e0 END)
                + CASE WHEN Age > 65 THEN 89e-1 WHEN Age < 25 THEN 43e-1 ELSE 0e0 END AS adj
      FROM rule_x) x
LEFT JOIN seg_churn_r c ON x.segment = c.segment""", RULE_CTE + "," + SEG_CHURN_LOOKUP))
def similar_customers(spark, d):
    return H.similar_customers(TB.churn_scored(spark, d), D.segment_churn_pct(TB.enhanced_customers(spark, d)))


def _strategy_values() -> str:
    rows = []
    for seg, specs in S.SEGMENT_STRATEGIES.items():
        for i, (n, e, det) in enumerate(specs):
            rows.append(f"({_s(seg)}, {i + 1}, {_s(n)}, {_s(e)}, {_s(det)})")
    return ",\n  ".join(rows)


def _strategies_sql() -> str:
    u, r, e = S.STRATEGY_URGENT, S.STRATEGY_REACTIVATION, S.STRATEGY_EXPANSION
    return q(f"""
SELECT CustomerId, CAST(rank AS INT) AS rank, strategy, effectiveness, details
FROM (SELECT *, row_number() OVER (PARTITION BY CustomerId ORDER BY ord) AS rank FROM (
  SELECT CustomerId, 0 AS ord, {_s(u[0])} AS strategy, {_s(u[1])} AS effectiveness, {_s(u[2])} AS details
  FROM rule_x WHERE risk_level IN ('High Risk', 'Very High Risk')
  UNION ALL
  SELECT x.CustomerId, st.ord, st.strategy, st.effectiveness, st.details
  FROM rule_x x JOIN st ON st.segment = CASE WHEN x.segment IN
       ('Young Professionals', 'Established Savers', 'High-Value Clients', 'At-Risk Seniors')
       THEN x.segment ELSE 'Established Savers' END
  UNION ALL
  SELECT CustomerId, 4, {_s(r[0])}, {_s(r[1])}, {_s(r[2])} FROM rule_x WHERE IsActiveMember = 0
  UNION ALL
  SELECT CustomerId, 5, {_s(e[0])}, {_s(e[1])}, {_s(e[2])} FROM rule_x WHERE NumOfProducts = 1) u) t
WHERE rank <= 4""", RULE_CTE + f""",
st AS (SELECT * FROM (VALUES
  {_strategy_values()}) AS v(segment, ord, strategy, effectiveness, details))""")


@register("retention_strategies", _strategies_sql())
def retention_strategies(spark, d):
    return H.retention_strategies(TB.churn_scored(spark, d))


FINANCE_CTES = RULE_CTE + "," + PERF_CTES + """,
cfin AS (
  SELECT x.CustomerId, x.segment, x.risk_level, x.ChurnProbability,
         CAST(trunc(p.ltv * (((1e0 + CASE WHEN x.Balance > 150000 THEN 3e-1 WHEN x.Balance < 25000 THEN -2e-1 ELSE 0e0 END)
                             + CASE WHEN x.NumOfProducts > 2 THEN 15e-2 WHEN x.NumOfProducts = 1 THEN -1e-1 ELSE 0e0 END)
                             + CASE WHEN x.IsActiveMember = 0 THEN -25e-2 ELSE 0e0 END)) AS BIGINT) AS customer_ltv,
         CAST(trunc(p.retention_cost * (1e0 + CASE WHEN x.risk_level = 'Very High Risk' THEN 5e-1
                                                  WHEN x.risk_level = 'High Risk' THEN 3e-1
                                                  WHEN x.risk_level = 'Low Risk' THEN -2e-1 ELSE 0e0 END)) AS BIGINT)
           AS retention_cost
  FROM rule_x x LEFT JOIN perf p ON x.segment = p.segment)"""


def _finance(spark, d):
    return H.customer_finance(TB.churn_scored(spark, d), performance_table(spark, d))


@register("customer_ltv", q("SELECT CustomerId, segment, customer_ltv FROM cfin", FINANCE_CTES))
def customer_ltv(spark, d):
    return _finance(spark, d).select("CustomerId", "segment", "customer_ltv")


@register("customer_retention_cost", q("SELECT CustomerId, segment, risk_level, retention_cost FROM cfin",
                                       FINANCE_CTES))
def customer_retention_cost(spark, d):
    return _finance(spark, d).select("CustomerId", "segment", "risk_level", "retention_cost")


@register("churn_impact", q("""
SELECT CustomerId, CAST(trunc(customer_ltv * 3 * ChurnProbability - retention_cost) AS BIGINT) AS churn_impact
FROM cfin""", FINANCE_CTES))
def churn_impact(spark, d):
    return _finance(spark, d).select("CustomerId", "churn_impact")


def _recommendations_sql() -> str:
    rows = []
    for lv, texts in S.RISK_RECOMMENDATIONS.items():
        for i, t in enumerate(texts):
            rows.append(f"({_s(lv)}, {i + 1}, {_s(t)})")
    return q("""
SELECT c.CustomerId, CAST(r.rank AS INT) AS rank,
       replace(replace(r.text, '{cost2}', format('{:,}', c.retention_cost * 2)),
               '{cost}', format('{:,}', c.retention_cost)) AS recommendation
FROM cfin c JOIN rt r ON c.risk_level = r.risk""", FINANCE_CTES + f""",
rt AS (SELECT * FROM (VALUES {', '.join(rows)}) AS v(risk, rank, text))""")


@register("recommendations", _recommendations_sql())
def recommendations(spark, d):
    return H.recommendations(_finance(spark, d))


def _playbook_sql() -> str:
    rows = []
    for kind, table in (("segment", S.PLAYBOOK_SEGMENT), ("risk", S.PLAYBOOK_RISK),
                        ("batch_segment", S.PLAYBOOK_BATCH_SEGMENT), ("overall", {"all": S.PLAYBOOK_OVERALL})):
        for key, items in table.items():
            rows += [f"({_s(kind)}, {_s(key)}, {i + 1}, {_s(t)})" for i, t in enumerate(items)]
    return q(f"""
SELECT pb.kind, pb.key, CAST(pb.rank AS INT) AS rank, pb.text,
       CAST(CASE WHEN pb.kind = 'overall' THEN (SELECT count(*) FROM enhanced)
                 ELSE COALESCE(c.customers, 0) END AS BIGINT) AS customers
FROM (VALUES {', '.join(rows)}) AS pb(kind, key, rank, text)
LEFT JOIN (SELECT 'segment' AS kind, SegmentName AS key, count(*) AS customers FROM enhanced GROUP BY SegmentName
           UNION ALL
           SELECT 'batch_segment', SegmentName, count(*) FROM enhanced GROUP BY SegmentName
           UNION ALL
           SELECT 'risk', RiskLevel, count(*) FROM enhanced GROUP BY RiskLevel) c
  ON pb.kind = c.kind AND pb.key = c.key""")


@register("playbook_by_segment", _playbook_sql())
def playbook_by_segment(spark, d):
    return H.playbook_by_segment(TB.enhanced_customers(spark, d))


# H9 -------------------------------------------------------------------------------------------------------------

@register("customer_report", None)
def customer_report(spark, d):
    enh = TB.enhanced_customers(spark, d)
    return H.customer_report(TB.churn_scored(spark, d), performance_table(spark, d), D.segment_churn_pct(enh))
