"""Row rules at every threshold (FIXTURES §4) against plain-Python statements
of the same rules."""

import itertools

from pyspark.sql import functions as F

from retainer import schema as S
from retainer.functions import columns as C
from retainer.operators import batch as B
from retainer.operators import features as FE
from retainer.operators import rules as H

AGES = [24, 25, 29, 30, 35, 36, 50, 51, 55, 56, 59, 60, 61, 65, 66, 70, 71]
BALANCES = [0.0, 9999.99, 10000.0, 24999.99, 25000.0, 100000.0, 100000.01, 150000.0, 150000.01,
            200000.0, 200000.01]
PROBS = [0.0, 0.25, 0.4, 0.5, 0.7, 0.75, 1.0]


def py_risk(p):
    if p is None:
        return None
    return "Low Risk" if p < 0.25 else "Medium Risk" if p < 0.5 else "High Risk" if p < 0.75 else "Very High Risk"


def py_segment(age, bal, credit, salary=None):
    if age < 36:
        return "Young Professionals"
    if age >= 60:
        return "At-Risk Seniors"
    if bal > 100000 or credit > 750 or (salary is not None and salary > 100000):
        return "High-Value Clients"
    return "Established Savers"


def edge_rows(spark):
    rows = []
    for i, (age, bal) in enumerate(itertools.product(AGES, BALANCES)):
        rows.append((i, 599 + (i % 3) * 76, ["France", "Germany", "Spain", "Unknown"][i % 4],
                     ["Male", "Female"][i % 2], age, [0, 1, 2, 5, 6][i % 5], bal, 1 + i % 4, i % 2,
                     (i // 2) % 2, [100000.0, 100000.01, 50000.0][i % 3], PROBS[i % len(PROBS)]))
    schema = ("CustomerId long, CreditScore int, Geography string, Gender string, Age int, Tenure int, "
              "Balance double, NumOfProducts int, HasCrCard int, IsActiveMember int, EstimatedSalary double, "
              "ChurnProbability double")
    return spark.createDataFrame(rows, schema), rows


def test_risk_and_segments(spark):
    df, rows = edge_rows(spark)
    out = df.select("CustomerId", C.risk_level(F.col("ChurnProbability")).alias("r"),
                    C.rule_segment().alias("s"),
                    C.rule_segment(salary=F.col("EstimatedSalary")).alias("s2")).collect()
    by = {r.CustomerId: r for r in out}
    for row in rows:
        i, credit, _, _, age, _, bal, _, _, _, sal, p = row
        assert by[i].r == py_risk(p)
        assert by[i].s == py_segment(age, bal, credit)
        assert by[i].s2 == py_segment(age, bal, credit, sal)


def test_null_probability_gives_null_risk(spark):
    df = spark.createDataFrame([(None,)], "p double")
    assert df.select(C.risk_level(F.col("p"))).first()[0] is None


def test_flags(spark):
    df = spark.createDataFrame([("Yes",), ("No",), ("1",), ("0",), ("maybe",), (None,)], "f string")
    got = [r[0] for r in df.select(C.yes_no_flag(F.col("f"))).collect()]
    assert got == [1, 0, 1, 0, None, None]


def test_ratio_zero_divisor(spark):
    df = spark.createDataFrame([(5.0, -1.0, 600, 30, 0, 1)],
                               "Balance double, EstimatedSalary double, CreditScore int, Age int, "
                               "Tenure int, NumOfProducts int")
    r = FE.add_ratio_features(df).first()
    assert r.Balance_to_Salary_Ratio is None and r.Credit_to_Salary_Ratio is None
    assert r.Age_to_Tenure_Ratio == 30.0


def py_factors(age, bal, prod, ten, credit, geo, active, p):
    hits = []
    if active == 0:
        hits.append(("Inactive Account Status", 0.85))
    if age > 60:
        hits.append(("Senior Age Group", 0.72))
    elif age < 30:
        hits.append(("Young Demographics", 0.58))
    if prod == 1:
        hits.append(("Single Product Relationship", 0.65))
    elif prod > 3:
        hits.append(("Over-Banked Customer", 0.45))
    if bal < 10000:
        hits.append(("Low Account Balance", 0.55))
    elif bal > 150000 and age > 55:
        hits.append(("High Balance + Mature Age", 0.42))
    if geo == "Germany":
        hits.append(("Geographic Risk - Germany", 0.48))
    if ten < 2:
        hits.append(("Low Tenure", 0.68))
    if credit < 600:
        hits.append(("Low Credit Score", 0.52))
    if not hits:
        if p > 0.7:
            hits = [("Multiple Risk Indicators", p)]
        elif p > 0.4:
            hits = [("Moderate Risk Profile", p)]
    return [n for n, _ in sorted(hits, key=lambda t: -t[1])[:3]]


def test_churn_factors(spark):
    df, rows = edge_rows(spark)
    got = {}
    for r in H.churn_factors(df).collect():
        got.setdefault(r.CustomerId, []).append((r["rank"], r.factor))
    for row in rows:
        i, credit, geo, _, age, ten, bal, prod, _, active, _, p = row
        want = py_factors(age, bal, prod, ten, credit, geo, active, p)
        assert [f for _, f in sorted(got.get(i, []))] == want


def py_strategies(seg, risk, active, prod):
    out = []
    if risk in ("High Risk", "Very High Risk"):
        out.append("Emergency Retention Protocol")
    out += [s[0] for s in S.SEGMENT_STRATEGIES.get(seg, S.SEGMENT_STRATEGIES[S.ES])]
    if active == 0:
        out.append("Account Reactivation Campaign")
    if prod == 1:
        out.append("Strategic Product Expansion")
    return out[:4]


def test_strategies(spark):
    df, rows = edge_rows(spark)
    got = {}
    for r in H.retention_strategies(df).collect():
        got.setdefault(r.CustomerId, []).append((r["rank"], r.strategy))
    for row in rows:
        i, credit, _, _, age, _, bal, prod, _, active, sal, p = row
        want = py_strategies(py_segment(age, bal, credit, sal), py_risk(p), active, prod)
        assert [s for _, s in sorted(got[i])] == want


def test_require_columns_lists_missing(spark):
    df = spark.createDataFrame([(1, "France")], "CreditScore int, Geography string")
    try:
        B.require_columns(df)
    except ValueError as e:
        assert str(e).startswith("Missing required fields: Gender, Age, Tenure")
    else:
        raise AssertionError("expected ValueError")


def test_batch_score_assigns_ids(spark):
    from retainer.sources.files import input_template

    out = B.score_batch(input_template(spark).drop("CustomerId")).orderBy("CustomerId").collect()
    assert [r.CustomerId for r in out] == ["CUST10000", "CUST10001", "CUST10002"]
    assert all(0.0 <= r.ChurnProbability <= 1.0 for r in out)
    assert out[0].IsActiveMember == 1 and out[1].IsActiveMember == 0


def test_segment_performance_matches_formula(spark):
    from retainer.operators import describe as D

    rows = [("High-Value Clients", 40, 50, 150000.0, 2, 1, 5, 1, 700),
            ("At-Risk Seniors", 65, 70, 0.0, 1, 0, 2, 0, 500)]
    df = spark.createDataFrame(rows, "SegmentName string, Age int, Age2 int, Balance double, "
                               "NumOfProducts int, HasCrCard int, Tenure int, IsActiveMember int, CreditScore int")
    perf = {r.segment: r for r in D.segment_performance(D.segment_details(df)).collect()}
    hv = perf["High-Value Clients"]
    ltv = int(0.05 * 150000 + 500 * 2 + 1000 * 1.0)
    assert hv.ltv == ltv and hv.retention_cost == int(ltv * 0.08)
    assert hv.profitability_index == round(ltv / int(ltv * 0.08), 1)
    ars = perf["At-Risk Seniors"]
    assert ars.ltv == 500 and ars.retention_cost == 60 and ars.growth_potential == "Low"
