"""Registered remediation and recommendation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import recommend as R
from ..operators import remediation as M
from ..session import materialize
from ..sources.bind import ACTIONS_SQL
from .inputs import actions, runs
from .q_history import AS_OF, GOV_CTE, HIST_CTE, _current, _presence
from .registry import query

ACT_CTE = ",\nacts AS (" + ACTIONS_SQL.format(orders="orders", lineitem="lineitem") + ")"

RULES_VALUES = ",\nrules AS (SELECT * FROM (VALUES " + ", ".join(
    "('{}', '{}', '{}', {}, {})".format(r[0], r[1], r[4], r[9], "true" if r[11] else "false") for r in R.RECOMMENDATION_RULES
) + ") t(check_id, recommendation_type, action_type, rule_confidence, requires_approval))"


@query(
    "m1_action_ids",
    oracle=HIST_CTE
    + ACT_CTE
    + """
SELECT action_id, 'act_' || substr(sha256(tenant_id || '|' || workspace_id || '|' || fingerprint || '|' || action_type || '|0'), 1, 24) AS stable_id
FROM acts
""",
)
def m1(spark, sf):
    a = actions(spark, sf)
    return a.select(
        "action_id",
        M.stable_action_id(F.col("tenant_id"), F.col("workspace_id"), F.col("fingerprint"), F.col("action_type"), F.lit(False)).alias("stable_id"),
    )


IMPACT_CTE = (
    ACT_CTE
    + """,
rr1 AS (
  SELECT tenant_id, workspace_id AS workspace, run_id AS latest_run_id, run_ts AS latest_run_ts FROM (
    SELECT *, row_number() OVER (PARTITION BY tenant_id, workspace_id ORDER BY run_ts DESC, run_id DESC) AS r
    FROM runs WHERE status = 'ready') WHERE r = 1),
a AS (
  SELECT tenant_id, workspace_id AS workspace, action_id, trim(fingerprint) AS fingerprint, check_id, action_type,
         lower(trim(status)) AS action_status, updated_at AS finalized_at FROM acts),
base AS (
  SELECT a.tenant_id, a.workspace, a.action_id, a.fingerprint,
         COALESCE(
           arg_max(p.estimated_monthly_savings, (p.run_ts, p.run_id)) FILTER (WHERE p.run_ts <= a.finalized_at),
           arg_max(p.estimated_monthly_savings, (p.run_ts, p.run_id))
         ) AS baseline_raw
  FROM a JOIN pres p ON p.tenant_id = a.tenant_id AND p.workspace = a.workspace AND p.fingerprint = a.fingerprint
  GROUP BY ALL),
j AS (
  SELECT a.*, l.latest_run_id, l.latest_run_ts, b.baseline_raw, c.estimated_monthly_savings AS current_raw,
         CASE WHEN l.latest_run_id IS NULL THEN NULL ELSE c.fingerprint IS NOT NULL END AS present
  FROM a LEFT JOIN rr1 l USING (tenant_id, workspace)
         LEFT JOIN base b USING (tenant_id, workspace, action_id, fingerprint)
         LEFT JOIN pres c ON c.tenant_id = a.tenant_id AND c.workspace = a.workspace AND c.fingerprint = a.fingerprint AND c.run_id = l.latest_run_id),
k AS (
  SELECT *, greatest(0, COALESCE(baseline_raw, 0)) AS baseline, greatest(0, COALESCE(current_raw, 0)) AS cur,
         action_status <> 'completed' AS not_done,
         (latest_run_ts IS NULL OR latest_run_ts <= finalized_at) AS no_later
  FROM j),
impact AS (
  SELECT tenant_id, workspace, action_id, fingerprint, check_id, action_type, action_status, finalized_at, latest_run_id, latest_run_ts,
         present AS present_in_latest,
         CAST(baseline AS DECIMAL(18,6)) AS baseline_estimated_monthly_savings,
         CAST(CASE WHEN current_raw IS NOT NULL THEN cur END AS DECIMAL(18,6)) AS current_estimated_monthly_savings,
         CASE WHEN not_done THEN CASE WHEN action_status = 'failed' THEN 'execution_failed' ELSE 'pending_post_run' END
              WHEN no_later THEN 'pending_post_run'
              WHEN present THEN 'verified_persistent' ELSE 'verified_resolved' END AS verification_status,
         CAST(CASE WHEN not_done OR no_later THEN 0 WHEN present THEN greatest(0, baseline - cur) ELSE baseline END AS DECIMAL(18,6)) AS realized_monthly_savings
  FROM k),
impact2 AS (
  SELECT *, CASE WHEN baseline_estimated_monthly_savings > 0
                 THEN round(CAST(realized_monthly_savings AS DOUBLE) / CAST(baseline_estimated_monthly_savings AS DOUBLE) * 100.0, 6) END AS realization_rate_pct
  FROM impact)
"""
)


def _impact(spark, sf):
    return M.remediation_impact(actions(spark, sf), runs(spark, sf), _presence(spark, sf))


@query("m3_remediation_impact", headline=True, oracle=HIST_CTE + IMPACT_CTE + "SELECT * FROM impact2")
def m3(spark, sf):
    return _impact(spark, sf)


@query(
    "m5_impact_summary",
    oracle=HIST_CTE
    + IMPACT_CTE
    + """
SELECT tenant_id, workspace, count(*) AS actions_count,
       count(*) FILTER (WHERE verification_status = 'verified_resolved') AS resolved_count,
       count(*) FILTER (WHERE verification_status = 'verified_persistent') AS persistent_count,
       count(*) FILTER (WHERE verification_status = 'pending_post_run') AS pending_count,
       count(*) FILTER (WHERE verification_status = 'execution_failed') AS failed_count,
       CAST(COALESCE(sum(baseline_estimated_monthly_savings), 0) AS DECIMAL(38,6)) AS baseline_total_monthly_savings,
       CAST(COALESCE(sum(realized_monthly_savings), 0) AS DECIMAL(38,6)) AS realized_total_monthly_savings,
       CASE WHEN sum(baseline_estimated_monthly_savings) > 0
            THEN round(CAST(sum(realized_monthly_savings) AS DOUBLE) / CAST(sum(baseline_estimated_monthly_savings) AS DOUBLE) * 100.0, 6) END AS realization_rate_pct
FROM impact2 GROUP BY ALL
""",
)
def m5(spark, sf):
    return M.impact_summary(_impact(spark, sf))


@query(
    "m6_action_list",
    oracle=HIST_CTE + ACT_CTE + "SELECT * FROM acts WHERE status IN ('completed', 'failed') AND action_type = 'stop'",
)
def m6(spark, sf):
    return M.action_list(actions(spark, sf), statuses=["completed", "failed"], action_types=["stop"])


@query(
    "m2_initial_actions",
    oracle=HIST_CTE
    + GOV_CTE
    + RULES_VALUES
    + f"""
SELECT DISTINCT c.tenant_id, c.workspace,
       'act_' || substr(sha256(c.tenant_id || '|' || c.workspace || '|' || c.fingerprint || '|' || r.action_type || '|0'), 1, 24) AS action_id,
       c.fingerprint, c.check_id, r.action_type, r.recommendation_type,
       CASE WHEN NOT r.requires_approval THEN 'approved' ELSE 'pending_approval' END AS status,
       false AS dry_run, TIMESTAMP '{AS_OF}' AS requested_at
FROM cur2 c JOIN rules r USING (check_id)
WHERE c.effective_state NOT IN ('resolved', 'ignored')
""",
)
def m2(spark, sf):
    return M.initial_actions(_current(spark, sf), auto_approve=True, requested_at=AS_OF)


ITEMS_CTE = (
    RULES_VALUES
    + """,
items AS (
  SELECT c.*, r.recommendation_type, r.action_type, r.requires_approval,
         CAST(COALESCE(c.estimated_monthly_savings, 0) AS DECIMAL(18,6)) AS monthly_savings,
         CAST(round(COALESCE(c.estimated_monthly_savings, 0) * 12, 2) AS DECIMAL(20,2)) AS estimated_annual_savings,
         CAST(COALESCE(c.est_confidence, r.rule_confidence) AS INTEGER) AS confidence,
         CASE WHEN COALESCE(c.est_confidence, r.rule_confidence) >= 80 THEN 'high'
              WHEN COALESCE(c.est_confidence, r.rule_confidence) >= 60 THEN 'medium' ELSE 'low' END AS confidence_label
  FROM cur2 c JOIN rules r USING (check_id))
"""
)


@query(
    "n5_recommendation_list",
    oracle=HIST_CTE
    + GOV_CTE
    + ITEMS_CTE
    + """
SELECT tenant_id, workspace, fingerprint, check_id, recommendation_type, monthly_savings, estimated_annual_savings, confidence,
       confidence_label, row_number() OVER (PARTITION BY tenant_id ORDER BY estimated_annual_savings DESC NULLS LAST, fingerprint) AS rank_in_tenant
FROM items WHERE effective_state = 'open'
""",
)
def n5(spark, sf):
    lst = R.recommendation_list(_current(spark, sf), runs(spark, sf))
    return lst.select(
        "tenant_id", "workspace", "fingerprint", "check_id", "recommendation_type", "monthly_savings",
        "estimated_annual_savings", "confidence", "confidence_label", "rank_in_tenant",
    )


@query(
    "n6_composite_by_type",
    oracle=HIST_CTE
    + GOV_CTE
    + ITEMS_CTE
    + """
SELECT tenant_id, workspace, recommendation_type AS group_key, count(*) AS items,
       CAST(sum(monthly_savings) AS DECIMAL(38,6)) AS total_monthly_savings,
       CAST(sum(monthly_savings) * 12 AS DECIMAL(38,6)) AS total_annual_savings
FROM items WHERE effective_state = 'open' GROUP BY ALL
""",
)
def n6(spark, sf):
    return R.composite(R.recommendation_list(_current(spark, sf, "check_id", "estimated_monthly_savings", "est_confidence")), "recommendation_type")


@query(
    "n7_estimate_requested",
    oracle=HIST_CTE
    + GOV_CTE
    + ITEMS_CTE
    + """,
req AS (SELECT DISTINCT tenant_id, workspace, fingerprint FROM cur2 WHERE severity = 'critical'),
ch AS (SELECT i.* FROM items i WHERE (tenant_id, workspace, fingerprint) IN (SELECT * FROM req)),
agg AS (
  SELECT tenant_id, workspace, count(*) AS items, CAST(sum(monthly_savings) AS DECIMAL(38,6)) AS total_monthly_savings,
         CAST(sum(monthly_savings) * 12 AS DECIMAL(38,6)) AS total_annual_savings, round(avg(confidence), 6) AS mean_confidence,
         count(*) FILTER (WHERE requires_approval) AS approval_required_count, count(*) FILTER (WHERE confidence < 60) AS low_confidence_count
  FROM ch GROUP BY ALL),
miss AS (
  SELECT tenant_id, workspace, count(*) AS missing_count FROM req
  WHERE (tenant_id, workspace, fingerprint) NOT IN (SELECT tenant_id, workspace, fingerprint FROM items) GROUP BY ALL)
SELECT COALESCE(agg.tenant_id, miss.tenant_id) AS tenant_id, COALESCE(agg.workspace, miss.workspace) AS workspace,
       COALESCE(items, 0) AS items, COALESCE(total_monthly_savings, 0) AS total_monthly_savings,
       COALESCE(total_annual_savings, 0) AS total_annual_savings, mean_confidence,
       COALESCE(approval_required_count, 0) AS approval_required_count, COALESCE(low_confidence_count, 0) AS low_confidence_count,
       COALESCE(missing_count, 0) AS missing_count,
       CASE WHEN agg.items > 0 THEN 'single' ELSE 'unknown' END AS pricing_status
FROM agg FULL JOIN miss ON agg.tenant_id = miss.tenant_id AND agg.workspace = miss.workspace
""",
)
def n7(spark, sf):
    cur = materialize(_current(spark, sf).select("tenant_id", "workspace", "fingerprint", "check_id", "severity", "estimated_monthly_savings", "est_confidence"), "current")
    items = R.recommendation_items(cur)
    req = cur.where(F.col("severity") == "critical").select("tenant_id", "workspace", "fingerprint")
    return R.estimate(items, req)
