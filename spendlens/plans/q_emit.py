"""Registered end-to-end queries: detectors -> findings -> correlated meta-findings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import correlate as C
from ..operators.emit import CATALOG, RULES, drafts_to_findings
from ..session import materialize, materialize_union
from . import q_buckets, q_detect, q_filesystems, q_rightsize, q_vaults  # noqa: F401  (their queries are the detectors)
from .registry import REGISTRY, query

RUN_ID, RUN_TS = "scan-2024-02-01", "2024-02-01 00:00:00"
DETECTORS = [
    "d1_underutilized_instances", "d2_d4_ec2_instances", "d5_d8_security_groups", "d6_credit_issues", "d7_instance_tags_missing", "d9_d10_lambda",
    "d11_d13_ecs", "d14_d16_eks_clusters", "d17_eks_nodegroups", "d18_d20_ebs_volumes", "d21_d22_ebs_snapshots", "d23_d24_efs_use", "d25_d27_efs_configuration",
    "d28_d34_fsx",
    "d35_d37_s3_governance", "d38_bucket_storage", "d39_d42_d43_rds_config", "d40_d41_d44_rds_rightsizing", "d45_d46_rds_snapshots", "d47_d49_backup", "d50_vault_locks", "d51_vault_policies", "d52_d55_nat_gateways",
    "d56_d58_load_balancers", "d60_d61_cloudfront", "d62_d63_logs_and_custom_metrics", "d64_alarms_high_count", "d_ri1_ri2_reserved_instances", "d_sp1_sp2_savings_plans",
]


def scan(spark, sf) -> DataFrame:
    """Findings of all detectors of one run. Drafts are stored detector by detector: no plan holds all of them."""
    drafts = materialize_union({n: REGISTRY[n].fn(spark, sf) for n in DETECTORS}, "drafts")
    return drafts_to_findings(drafts, RUN_ID, F.lit(RUN_TS))


_DRAFTS = " UNION ALL ".join(f"SELECT * FROM ({REGISTRY[n].oracle})" for n in DETECTORS)
_TEXT = "(VALUES " + ", ".join(f"('{k}', '{c.title}', '{c.category}', '{','.join(c.parts)}', '{','.join(c.issue)}')" for k, c in CATALOG.items()) + ") AS t(check_id, check_title, check_category, parts, issue)"
_RULE_TEXT = "(VALUES " + ", ".join(f"('{c}', '{r}', '{title}', '{category}')" for (c, r), (title, category) in RULES.items()) + ") AS r(check_id, rule, rule_title, rule_category)"
_FINDINGS = f"""
WITH drafts AS MATERIALIZED ({_DRAFTS}),
cat AS (SELECT * FROM {_TEXT}),
said AS (
  SELECT d.*, parts, COALESCE(rule_title, check_title) AS title, COALESCE(rule_category, check_category) AS category,
         list_sort(list_concat(['"check_id":"' || d.check_id || '"', '"resource_id":"' || resource_id || '"'],
           CASE WHEN issue = '' THEN [] ELSE list_transform(string_split(issue, ','), lambda p: '"' || p || '":"' || string_split(d.detail, '|')[list_position(string_split(parts, ','), p)] || '"') END)) AS keys
  FROM drafts d JOIN cat USING (check_id) LEFT JOIN {_RULE_TEXT} ON r.check_id = d.check_id AND r.rule = string_split(d.detail, '|')[1]),
scanned AS MATERIALIZED (
  SELECT d.*,
    sha256('{{"check_id":"' || d.check_id || '","issue":{{' || array_to_string(d.keys, ',') || '}},"scope":{{"account_id":"' || account_id
      || '","billing_account_id":"","cloud":"aws","region":"' || region || '","resource_arn":"","resource_id":"' || resource_id || '","resource_type":"' || resource_type
      || '","service":"' || lower(service) || '"}},"tenant_id":"' || tenant_id || '"}}') AS fingerprint,
    CASE WHEN detail = '' THEN '' WHEN parts <> '' AND len(string_split(detail, '|')) = len(string_split(parts, ','))
         THEN array_to_string(list_sort(list_transform(list_zip(string_split(parts, ','), string_split(detail, '|')), lambda z: z[1] || '=' || z[2])), ';')
         ELSE 'detail=' || detail END AS dims
  FROM said d)
"""


@query(
    "x15_detected_findings",
    oracle=_FINDINGS
    + f"""SELECT tenant_id, '{RUN_ID}' AS run_id, check_id, resource_id, status, category, title, fingerprint,
       sha256('{{"fingerprint":"' || fingerprint || '","salt":"","tenant_id":"' || tenant_id || '"}}') AS finding_id, dims,
       COALESCE(monthly_cost, 0) AS monthly_cost, COALESCE(monthly_savings, 0) AS monthly_savings FROM scanned""",
)
def x15(spark, sf):
    dims = F.array_join(F.array_sort(F.transform(F.map_entries("dimensions"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ";")
    return scan(spark, sf).select(
        "tenant_id", "run_id", "check_id", F.col("scope.resource_id").alias("resource_id"), "status", "category", "title", "fingerprint", "finding_id",
        dims.alias("dims"), F.col("estimated.monthly_cost").alias("monthly_cost"), F.col("estimated.monthly_savings").alias("monthly_savings"),
    )


_KEYS = "tenant_id, account_id, region"


@query(
    "x15_r_correlated_detections",
    oracle=_FINDINGS
    + f""",
ebs AS (SELECT {_KEYS}, resource_id FROM scanned WHERE status = 'fail' AND check_id IN ('aws.ec2.ebs.unattached.volume', 'aws.ec2.ebs.volume.unencrypted')
        GROUP BY ALL HAVING count(DISTINCT check_id) = 2),
logs AS (SELECT {_KEYS}, count(*) AS n, count(*) FILTER (resource_id LIKE '/aws/lambda/%') AS lambda_n FROM scanned
         WHERE status = 'fail' AND check_id = 'aws.logs.log.groups.retention.missing' GROUP BY ALL),
idle AS (SELECT {_KEYS}, count(DISTINCT resource_id) AS n FROM scanned WHERE check_id IN ('aws.ec2.instances.stopped.long', 'aws.ec2.instances.underutilized') GROUP BY ALL)
SELECT 'aws.ec2.correlation.ebs.unattached.unencrypted' AS check_id, tenant_id, account_id, region, resource_id FROM ebs
UNION ALL SELECT 'aws.logs.correlation.retention.missing.sprawl', {_KEYS}, account_id FROM logs
UNION ALL SELECT 'aws.ec2.correlation.cloudwatch.monitoring.cost', {_KEYS}, account_id FROM idle
UNION ALL SELECT 'aws.lambda.correlation.cloudwatch.logs.cost', {_KEYS}, account_id FROM logs WHERE lambda_n > 0
""",
)
def x15_r(spark, sf):
    wanted = {"aws.ec2.correlation.ebs.unattached.unencrypted", "aws.logs.correlation.retention.missing.sprawl", "aws.ec2.correlation.cloudwatch.monitoring.cost", "aws.lambda.correlation.cloudwatch.logs.cost"}
    # every rule reads the findings: what the rules read is stored once
    f = materialize(scan(spark, sf).select(*C.RULE_READS), "signals")
    meta, _ = C.correlate(f, [r for r in C.BUILTIN_RULES if r.rule_id in wanted])
    return meta.select("check_id", "tenant_id", F.col("scope.account_id").alias("account_id"), F.col("scope.region").alias("region"), F.col("scope.resource_id").alias("resource_id"))
