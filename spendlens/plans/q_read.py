"""Registered read queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import read
from ..sources.bind import binding_cte
from .inputs import findings
from .registry import query

FW = binding_cte("findings_flat")


@query(
    "q2_findings_summary",
    headline=True,
    oracle=FW
    + """
SELECT tenant_id,
       CASE WHEN GROUPING(status) = 0 AND GROUPING(severity_level) = 0 THEN 'matrix'
            WHEN GROUPING(severity_level) = 1 THEN 'status' ELSE 'severity' END AS dimension,
       status, severity_level, count(*) AS cnt
FROM findings_flat
GROUP BY GROUPING SETS ((tenant_id, status, severity_level), (tenant_id, status), (tenant_id, severity_level))
""",
)
def q2(spark, sf):
    return read.findings_summary(findings(spark, sf))


@query(
    "q3_top_savings",
    headline=True,
    oracle=FW
    + """
SELECT * FROM (
  SELECT tenant_id, finding_id, fingerprint, check_id, check_title AS check_name, status, severity_level,
         service, resource_type, resource_id, title,
         COALESCE(monthly_savings, CAST(0 AS DECIMAL(18,6))) AS est_monthly_savings,
         confidence AS est_confidence,
         row_number() OVER (PARTITION BY tenant_id
                            ORDER BY COALESCE(monthly_savings, CAST(0 AS DECIMAL(18,6))) DESC, finding_id) AS rank
  FROM findings_flat
  WHERE status = 'fail'
) t WHERE rank <= 50
""",
)
def q3(spark, sf):
    return read.top_savings(findings(spark, sf), limit=50, per_tenant=True)


@query(
    "q1_findings_page",
    oracle=FW
    + """
SELECT tenant_id, workspace_id, finding_id, fingerprint, run_id, run_ts, check_id, check_title AS check_name,
       category, '' AS sub_category, status, severity_level, severity_score, cloud, account_id, region, service,
       resource_type, resource_id, title, '' AS message, '' AS recommendation,
       COALESCE(monthly_savings, CAST(0 AS DECIMAL(18,6))) AS est_monthly_savings, confidence AS est_confidence,
       CAST(NULL AS DECIMAL(18,6)) AS actual_cost_30d, '' AS attribution_method, 0 AS attribution_confidence
FROM findings_flat
WHERE status = 'fail' AND severity_level = 'high'
ORDER BY run_ts DESC, finding_id
LIMIT 200 OFFSET 100
""",
)
def q1(spark, sf):
    return read.list_findings(findings(spark, sf), status="fail", severity_level="high", limit=200, offset=100)


@query(
    "s11_tenant_counts",
    oracle=FW + "SELECT tenant_id, count(*) AS rows FROM findings_flat GROUP BY tenant_id",
)
def s11(spark, sf):
    return read.tenant_counts(findings(spark, sf), required="tenant-0")


@query(
    "p3_p5_filtered_findings",
    oracle=FW
    + """
SELECT finding_id, check_id, region, service, title, monthly_savings AS est_monthly_savings
FROM findings_flat
WHERE region IN ('us-east-1', 'eu-west-1') AND service IN ('AmazonEC2', 'AmazonRDS')
  AND title ILIKE '%volume%' AND COALESCE(monthly_savings, 0) >= 100
""",
)
def p3_p5(spark, sf):
    flat = read.flat_view(findings(spark, sf))
    flat = read.multi_filters(flat, region=["us-east-1", "eu-west-1"], service=["AmazonEC2", "AmazonRDS"])
    flat = read.title_contains(flat, "volume")
    flat = read.min_savings(flat, 100, col="est_monthly_savings")
    return flat.select("finding_id", "check_id", "region", F.col("service"), "title", "est_monthly_savings")
