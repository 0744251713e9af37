"""Registered cost trend queries (C1-C6) with DuckDB oracles (window SQL)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.coerce import MONEY
from ..operators import cost, trends
from .inputs import cost_facts_raw
from .q_cost import MONTHLY_CTE
from .registry import REGISTRY, query

P_CTE = (
    MONTHLY_CTE
    + """,
p AS (
  SELECT tenant_id, workspace, account_id, service, period_start, unblended_cost AS cost,
         CAST(unblended_cost AS DOUBLE) AS x,
         row_number() OVER w AS rn, lag(unblended_cost) OVER w AS prev
  FROM cost_service_monthly
  WINDOW w AS (PARTITION BY tenant_id, workspace, account_id, service ORDER BY period_start))
"""
)

_SEL = """SELECT tenant_id, workspace, account_id, service, period_start, {check} AS check_id, '{method}' AS method,
       {signal} AS signal, {status} AS status, '{level}' AS severity_level, {score} AS severity_score,
       round(CAST({metric} AS DOUBLE), 2) AS metric, cost AS estimated_monthly_cost"""


def _sel(**kw):
    return _SEL.format(**kw)


def _anoms(spark, sf, detector, evaluate="all"):
    monthly = cost.monthly_service_cost(cost_facts_raw(spark, sf))
    return trends.cost_anomalies(monthly, evaluate=evaluate, detectors=(detector,))


C1_SQL = (
    P_CTE
    + """,
b AS (SELECT *, (x - CAST(prev AS DOUBLE)) / CAST(prev AS DOUBLE) * 100.0 AS pct
      FROM p WHERE rn >= 2 AND abs(cost - prev) >= 50 AND cost >= 25 AND prev > 0)
"""
    + _sel(check="'aws.cost.anomaly.spike'", method="threshold", signal="'spike'", status="'fail'", level="medium", score=60, metric="pct")
    + " FROM b WHERE pct >= 20.0 UNION ALL "
    + _sel(check="'aws.cost.anomaly.drop'", method="threshold", signal="'drop'", status="'info'", level="low", score=30, metric="pct")
    + " FROM b WHERE pct <= -20.0"
)


@query("c1_threshold_anomalies", oracle=C1_SQL)
def c1(spark, sf):
    return _anoms(spark, sf, "threshold")


C23_SQL = (
    P_CTE
    + """,
q AS (
  SELECT *, avg(x) OVER f AS m, stddev_pop(x) OVER f AS sd, count(x) OVER f AS wn
  FROM p
  WINDOW f AS (PARTITION BY tenant_id, workspace, account_id, service ORDER BY period_start ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING)),
q2 AS (SELECT *, (x - m) / sd AS z FROM q WHERE rn >= 3 AND wn >= 2 AND m > 0)
"""
    + _sel(
        check="CASE WHEN z > 0 THEN 'aws.cost.anomaly.spike' ELSE 'aws.cost.anomaly.drop' END",
        method="zscore",
        signal="CASE WHEN z > 0 THEN 'spike' ELSE 'drop' END",
        status="'fail'",
        level="medium",
        score=60,
        metric="z",
    )
    + " FROM q2 WHERE sd > 0 AND abs(z) >= 2.0 UNION ALL "
    + _sel(check="'aws.cost.anomaly.spike'", method="moving_avg", signal="'spike'", status="'fail'", level="medium", score=60, metric="m")
    + " FROM q2 WHERE NOT (sd > 0) AND x >= m * 1.5"
)


@query("c2_c3_zscore_moving_avg", oracle=C23_SQL)
def c23(spark, sf):
    return _anoms(spark, sf, "moving")


C4_SQL = (
    P_CTE
    + """,
j AS (
  SELECT c.*, (c.x - CAST(l.cost AS DOUBLE)) / CAST(l.cost AS DOUBLE) * 100.0 AS pct
  FROM p c JOIN p l
    ON c.tenant_id = l.tenant_id AND c.workspace = l.workspace AND c.account_id = l.account_id AND c.service = l.service
   AND c.period_start = CAST(l.period_start + INTERVAL 12 MONTH AS DATE)
  WHERE c.rn >= 12 AND l.cost > 0)
"""
    + _sel(
        check="CASE WHEN pct > 0 THEN 'aws.cost.anomaly.spike' ELSE 'aws.cost.anomaly.drop' END",
        method="yoy",
        signal="CASE WHEN pct > 0 THEN 'spike' ELSE 'drop' END",
        status="'fail'",
        level="high",
        score=70,
        metric="pct",
    )
    + " FROM j WHERE abs(pct) >= 30.0"
)


@query("c4_yoy_anomalies", oracle=C4_SQL)
def c4(spark, sf):
    return _anoms(spark, sf, "yoy")


C5_SQL = (
    P_CTE
    + """,
t AS (
  SELECT *, regr_slope(x, CAST(rn AS DOUBLE)) OVER f AS slope, avg(x) OVER f AS mean
  FROM p
  WINDOW f AS (PARTITION BY tenant_id, workspace, account_id, service ORDER BY period_start ROWS BETWEEN 5 PRECEDING AND CURRENT ROW))
"""
    + _sel(
        check="CASE WHEN slope > 0 THEN 'aws.cost.trend.increasing' ELSE 'aws.cost.trend.decreasing' END",
        method="regression",
        signal="CASE WHEN slope > 0 THEN 'increasing' ELSE 'decreasing' END",
        status="'fail'",
        level="medium",
        score=60,
        metric="slope",
    )
    + " FROM t WHERE rn >= 3 AND slope IS NOT NULL AND (abs(slope) >= 50.0 OR abs(slope) >= mean * 0.1)"
)


@query("c5_trend_regression", oracle=C5_SQL)
def c5(spark, sf):
    return _anoms(spark, sf, "trend")


C6_SQL = (
    P_CTE
    + _sel(check="'aws.cost.service.new'", method="discovery", signal="'new'", status="'info'", level="low", score=30, metric="prev")
    + " FROM p WHERE rn >= 2 AND prev < 25 AND cost >= 25 UNION ALL "
    + _sel(check="'aws.cost.service.absent'", method="discovery", signal="'absent'", status="'info'", level="low", score=30, metric="prev")
    + " FROM p WHERE rn >= 2 AND prev >= 25 AND cost < 25"
)


@query("c6_service_discovery", oracle=C6_SQL)
def c6(spark, sf):
    return _anoms(spark, sf, "discovery")


@query(
    "c1_c6_latest_period",
    oracle="WITH allx AS ("
    + "\nUNION ALL\n".join(
        f"SELECT * FROM ({q.replace('WITH cost_facts', 'WITH cost_facts', 1)})" for q in (C1_SQL, C23_SQL, C4_SQL, C5_SQL, C6_SQL)
    )
    + "), newest AS (SELECT tenant_id, workspace, account_id, service, max(period_start) AS period_start FROM ("
    + MONTHLY_CTE
    + " SELECT * FROM cost_service_monthly) GROUP BY ALL)"
    + " SELECT a.* FROM allx a JOIN newest n USING (tenant_id, workspace, account_id, service, period_start)",
)
def c_last(spark, sf):
    monthly = cost.monthly_service_cost(cost_facts_raw(spark, sf))
    return trends.cost_anomalies(monthly, evaluate="last")


# the same rule over bills a ten-thousandth as large, which come and go around its limits
_SMALL = "FROM (SELECT * REPLACE (CAST(unblended_cost * CAST(0.0001 AS DECIMAL(5,4)) AS DECIMAL(18,6)) AS unblended_cost) FROM cost_service_monthly)"


@query("c6_service_discovery_small_bills", oracle=C6_SQL.replace("FROM cost_service_monthly", _SMALL, 1))
def c6_small(spark, sf):
    monthly = cost.monthly_service_cost(cost_facts_raw(spark, sf))
    small = monthly.withColumn("unblended_cost", (F.col("unblended_cost") * F.lit("0.0001").cast("decimal(5,4)")).cast(MONEY))
    return trends.cost_anomalies(small, evaluate="all", detectors=("discovery",))


_TREND_RUN = "trends-1998"


@query(
    "c1_c6_trend_findings",
    oracle=REGISTRY["c1_c6_latest_period"].oracle.replace("SELECT a.* FROM allx a", "SELECT tenant_id, check_id, account_id AS resource_id, service, status, cost, fingerprint, "
      "sha256('{\"fingerprint\":\"' || fingerprint || '\",\"salt\":\"\",\"tenant_id\":\"' || tenant_id || '\"}') AS finding_id FROM ("
      "SELECT a.*, CAST(a.estimated_monthly_cost AS DECIMAL(18,6)) AS cost, sha256('{\"check_id\":\"' || check_id || '\",\"issue\":{\"method\":\"' || method || '\",\"period\":\"' || strftime(period_start, '%Y-%m') || '\",\"service\":\"' || COALESCE(service, '')"
      " || '\",\"signal\":\"' || signal || '\"},\"scope\":{\"account_id\":\"' || account_id || '\",\"billing_account_id\":\"\",\"cloud\":\"aws\",\"region\":\"global\",\"resource_arn\":\"\",\"resource_id\":\"' || account_id"
      " || '\",\"resource_type\":\"account\",\"service\":\"' || lower(COALESCE(service, '')) || '\"},\"tenant_id\":\"' || tenant_id || '\"}') AS fingerprint FROM allx a") + ")",
)
def c_findings(spark, sf):
    monthly = cost.monthly_service_cost(cost_facts_raw(spark, sf))
    f = trends.anomaly_findings(trends.cost_anomalies(monthly, evaluate="last"), _TREND_RUN)
    return f.select("tenant_id", "check_id", F.col("scope.resource_id").alias("resource_id"), F.col("scope.service").alias("service"), "status", F.col("estimated.monthly_cost").alias("cost"), "fingerprint", "finding_id")
