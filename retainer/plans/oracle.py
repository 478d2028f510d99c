"""DuckDB oracle SQL for the registered queries.

Only the driver's own tables are registered in the oracle, so every string
starts with the two customer views as CTEs.  ``BASE`` is the text of those
views; ``q(body, ctes)`` glues extra CTEs and the final SELECT onto it.
Doubles are rounded to 6 places on both sides; integer sums are cast to
BIGINT (DuckDB widens them to HUGEINT); ``int(x)`` is ``CAST(trunc(x) AS BIGINT)``.
"""

from __future__ import annotations

BASE = """WITH o AS (
  SELECT o_custkey AS k,
         SUM(CASE WHEN CAST(o_orderdate AS DATE) <  DATE '2001-01-01' THEN 1 ELSE 0 END) AS n_before,
         SUM(CASE WHEN CAST(o_orderdate AS DATE) <  DATE '2001-01-01' THEN o_totalprice ELSE 0e0 END) AS spend,
         MAX(CASE WHEN CAST(o_orderdate AS DATE) <  DATE '2001-01-01' THEN CAST(o_orderdate AS DATE) END) AS last_before,
         SUM(CASE WHEN CAST(o_orderdate AS DATE) >= DATE '2001-01-01' THEN 1 ELSE 0 END) AS n_after
  FROM orders GROUP BY o_custkey),
churn_customers AS (
SELECT CAST(c_custkey AS BIGINT) AS CustomerId,
       c_name AS Surname,
       CAST(300 + (c_custkey * 37) % 551 AS INT) AS CreditScore,
       CASE WHEN c_nationkey % 10 < 5 THEN 'France' WHEN c_nationkey % 10 < 7 THEN 'Spain' ELSE 'Germany' END AS Geography,
       CASE WHEN c_custkey % 2 = 0 THEN 'Male' ELSE 'Female' END AS Gender,
       CAST(18 + (c_custkey * 13) % 77 AS INT) AS Age,
       CAST((c_custkey * 7) % 11 AS INT) AS Tenure,
       ROUND(GREATEST(c_acctbal, 0e0) * 25e0, 2) AS Balance,
       CAST(CASE WHEN COALESCE(n_before, 0) <= 7 THEN 1 WHEN n_before <= 10 THEN 2 WHEN n_before <= 13 THEN 3 ELSE 4 END AS INT) AS NumOfProducts,
       CAST(CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY', 'HOUSEHOLD') THEN 1 ELSE 0 END AS INT) AS HasCrCard,
       CAST(CASE WHEN last_before >= DATE '2000-07-05' THEN 1 ELSE 0 END AS INT) AS IsActiveMember,
       ROUND(1e4 + COALESCE(spend, 0e0) / 35e0, 2) AS EstimatedSalary,
       CAST(CASE WHEN COALESCE(n_after, 0) = 0 THEN 1 ELSE 0 END AS INT) AS Exited
FROM customer LEFT JOIN o ON c_custkey = k),
churn_scored AS (
SELECT *, ROUND(LEAST(1e0, GREATEST(0e0, 18e-1 * (2e-2
    + 1e-1  * (1 - IsActiveMember)
    + 5e-2  * (CASE WHEN Age < 30 THEN 1 ELSE 0 END)
    + 8e-2  * (CASE WHEN Age > 60 THEN 1 ELSE 0 END)
    + 1e-1  * (CASE WHEN Balance < 10000 THEN 1 ELSE 0 END)
    + 15e-2 * (CASE WHEN NumOfProducts = 1 THEN 1 ELSE 0 END)
    - 1e-1  * (CASE WHEN Tenure > 5 THEN 1 ELSE 0 END)
    - 5e-2  * HasCrCard
    + 1e-1  * (CASE WHEN Geography = 'Germany' THEN 1 ELSE 0 END)))), 6) AS ChurnProbability
FROM churn_customers),
enhanced AS (
SELECT *,
       CASE WHEN Age < 36 THEN 'Young Professionals'
            WHEN Age >= 60 THEN 'At-Risk Seniors'
            WHEN Balance > 100000 OR CreditScore > 750 THEN 'High-Value Clients'
            ELSE 'Established Savers' END AS SegmentName,
       CASE WHEN ChurnProbability < 0.25 THEN 'Low Risk'
            WHEN ChurnProbability < 0.5 THEN 'Medium Risk'
            WHEN ChurnProbability < 0.75 THEN 'High Risk'
            ELSE 'Very High Risk' END AS RiskLevel
FROM churn_scored),
defects AS (
SELECT CustomerId, Surname, CreditScore,
       CASE WHEN CustomerId % 53 = 0 THEN 'Unknown' ELSE Geography END AS Geography,
       Gender, Age, Tenure,
       CASE WHEN CustomerId % 17 = 0 THEN CAST(NULL AS DOUBLE)
            WHEN CustomerId % 97 = 0 THEN Balance * 10e0
            ELSE Balance END AS Balance,
       NumOfProducts, HasCrCard, IsActiveMember, EstimatedSalary, Exited
FROM churn_customers),
defect_customers AS (
SELECT * FROM defects UNION ALL SELECT * FROM defects WHERE CustomerId % 101 = 0)"""

# SQL fragments reused by several oracle strings ---------------------------------

SEGMENTS_SQL = """(VALUES ('Young Professionals', 0), ('Established Savers', 1),
        ('High-Value Clients', 2), ('At-Risk Seniors', 3)) AS seg(segment, seg_pos)"""
RISKS_SQL = """(VALUES ('Low Risk', 0), ('Medium Risk', 1), ('High Risk', 2),
        ('Very High Risk', 3)) AS rl(risk, risk_pos)"""


def q(body: str, ctes: str = "") -> str:
    """BASE + optional extra CTEs (text starting after a comma) + final query."""
    extra = f",\n{ctes.strip().lstrip(',')}" if ctes.strip() else ""
    return f"{BASE}{extra}\n{body.strip()}"
