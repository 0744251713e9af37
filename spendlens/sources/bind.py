"""Binding of the driver's TPC-H-style tables to the engine's input tables.

The engine works on cloud findings, billing facts, metric series, runs and
state events. The test data has none of those, so each input is *derived* from
the given tables by one SQL text that Spark SQL and DuckDB both accept (plain
CASE / CAST / % / || / date_trunc, no engine-specific functions, no hashing).
Spark runs the text with the tables passed as DataFrames (``spark.sql(text,
lineitem=df, ...)``); the DuckDB oracle inlines the same text as a CTE over its
views. The engine operators themselves are written separately in both places.

All derived tables grow with the source tables (one finding per line item, one
cost fact per line item, one metric point per event, ...).
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import table

# ---------------------------------------------------------------------------
# Check catalog used by the binding. (group = l_partkey % 6,
# returnflag) -> check id, resource type, service, category, title. The check
# ids are the engine's public check identifiers; the grouping is ours. Checks
# that correlation rules combine share a group so one resource carries both.
# ---------------------------------------------------------------------------
CHECK_CATALOG = [
    (0, "A", "aws.ec2.ebs.unattached.volume", "ebs_volume", "AmazonEC2", "waste", "Unattached EBS volume"),
    (0, "N", "aws.ec2.ebs.volume.unencrypted", "ebs_volume", "AmazonEC2", "security", "Unencrypted EBS volume"),
    (0, "R", "aws.ec2.ebs.gp2.to.gp3", "ebs_volume", "AmazonEC2", "rightsizing", "Migrate gp2 volume to gp3"),
    (1, "A", "aws.backup.vaults.no.lifecycle", "backup_vault", "AWSBackup", "governance", "Backup vault without lifecycle"),
    (1, "N", "aws.backup.vaults.access.policy.misconfig", "backup_vault", "AWSBackup", "security", "Backup vault access policy misconfigured"),
    (1, "R", "aws.backup.recovery.points.stale", "recovery_point", "AWSBackup", "waste", "Stale recovery point"),
    (2, "A", "aws.ec2.instances.underutilized", "instance", "AmazonEC2", "rightsizing", "Underutilized EC2 instance"),
    (2, "N", "aws.ec2.instances.stopped.long", "instance", "AmazonEC2", "waste", "EC2 instance stopped for a long time"),
    (2, "R", "aws.logs.log.groups.retention.missing", "log_group", "AmazonCloudWatch", "governance", "Log group without retention"),
    (3, "A", "aws.ec2.nat.gateways.idle", "nat_gateway", "AmazonVPC", "waste", "Idle NAT gateway"),
    (3, "N", "aws.ec2.nat.gateways.high.data.processing", "nat_gateway", "AmazonVPC", "waste", "NAT gateway with high data processing"),
    (3, "R", "aws.ec2.nat.gateways.cross.az", "nat_gateway", "AmazonVPC", "waste", "NAT gateway serving another AZ"),
    (4, "A", "aws.cloudwatch.custom.metrics.from.log.filters", "custom_metric", "AmazonCloudWatch", "waste", "Custom metric from log filter"),
    (4, "N", "aws.cloudwatch.alarms.high.count", "account", "AmazonCloudWatch", "waste", "High CloudWatch alarm count"),
    (4, "R", "aws.lambda.functions.unused", "function", "AWSLambda", "waste", "Unused Lambda function"),
    (5, "A", "aws.rds.instances.stopped.storage", "db_instance", "AmazonRDS", "waste", "Stopped RDS instance still billed for storage"),
    (5, "N", "aws.rds.storage.overprovisioned", "db_instance", "AmazonRDS", "rightsizing", "Overprovisioned RDS storage"),
    (5, "R", "aws.s3.bucket.lifecycle.missing", "bucket", "AmazonS3", "governance", "S3 bucket without lifecycle"),
]

# Regions by l_partkey % 5, in order.
REGIONS = ["us-east-1", "us-west-2", "eu-west-1", "eu-central-1", "ap-southeast-2"]

# Severity by l_quantity (lower bound, level, score), first match wins.
SEVERITY_BANDS = [(48, "critical", 950), (35, "high", 800), (20, "medium", 500), (8, "low", 250), (0, "info", 100)]


def _case_catalog(field: int) -> str:
    whens = " ".join(
        f"WHEN l.l_partkey % 6 = {g} AND l.l_returnflag = '{flag}' THEN '{row[field]}'"
        for row in CHECK_CATALOG
        for g, flag in [(row[0], row[1])]
    )
    return f"CASE {whens} END"


def _case_group(expr_by_group: dict[int, str], key: str = "l.l_partkey % 6") -> str:
    whens = " ".join(f"WHEN {key} = {g} THEN {v}" for g, v in sorted(expr_by_group.items()))
    return f"CASE {whens} END"


def _region_case(key: str) -> str:
    whens = " ".join(f"WHEN {key} % 5 = {i} THEN '{r}'" for i, r in enumerate(REGIONS))
    return f"CASE {whens} END"


def _severity_case(field: int) -> str:
    whens = " ".join(
        f"WHEN l.l_quantity >= {lo} THEN {repr(band[field]) if isinstance(band[field], str) else band[field]}"
        for band in SEVERITY_BANDS
        for lo in [band[0]]
    )
    return f"CASE {whens} END"


_SERVICE_BY_GROUP = {}
for _row in CHECK_CATALOG:
    _SERVICE_BY_GROUP.setdefault(_row[0], _row[4])


def _values(rows, alias: str, cols: str) -> str:
    def lit(v):
        return str(v) if isinstance(v, int) else "'" + str(v).replace("'", "''") + "'"

    body = ", ".join("(" + ", ".join(lit(v) for v in r) + ")" for r in rows)
    return f"(VALUES {body}) AS {alias}({cols})"


# Catalog joins replace long CASE chains (keeps the per-row expression small).
CATALOG_JOIN = (
    "JOIN "
    + _values(CHECK_CATALOG, "c", "grp, flag, check_id, resource_type, service, category, check_title")
    + " ON c.grp = l.l_partkey % 6 AND c.flag = l.l_returnflag"
)
REGION_JOIN = "JOIN " + _values(list(enumerate(REGIONS)), "g", "idx, region") + " ON g.idx = l.l_partkey % 5"
SERVICE_GROUP_JOIN = (
    "JOIN " + _values(sorted(_SERVICE_BY_GROUP.items()), "sg", "sgrp, gservice") + " ON sg.sgrp = l.l_partkey % 6"
)

_MONTH_TEXT = "CAST(year({c}) AS STRING) || '-' || lpad(CAST(month({c}) AS STRING), 2, '0')"
_YEAR_TEXT = "CAST(year({c}) AS STRING)"

# One finding per line item: lineitem ⋈ orders ⋈ part.
# The names made of other columns are put on by the outer select, so rows can be moved without them.
_FINDINGS_BASE_SQL = f"""  SELECT
    'tenant-' || CAST(o.o_custkey % 3 AS STRING) AS tenant_id,
    'prod' AS workspace_id,
    'run-' || {_YEAR_TEXT.format(c='o.o_orderdate')} AS run_id,
    CAST(date_trunc('year', o.o_orderdate) AS TIMESTAMP) AS run_ts,
    'aws' AS cloud,
    '999900000000' AS billing_account_id,
    CAST(100000000000 + l.l_partkey % 7 AS STRING) AS account_id,
    g.region AS region,
    c.service AS service,
    c.resource_type AS resource_type,
    'r-' || CAST(l.l_partkey AS STRING) AS resource_id,
    c.check_id AS check_id,
    c.category AS category,
    c.check_title AS check_title,
    CASE WHEN l.l_linestatus = 'F' THEN 'fail' WHEN l.l_linenumber % 3 = 0 THEN 'warn' ELSE 'info' END AS status,
    {_severity_case(1)} AS severity_level,
    {_severity_case(2)} AS severity_score,
    CASE WHEN l.l_tax > 0
         THEN CAST(CAST(l.l_extendedprice AS DECIMAL(18,2)) * CAST(l.l_tax AS DECIMAL(18,2)) AS DECIMAL(18,6))
    END AS monthly_savings,
    CAST(CAST(l.l_extendedprice AS DECIMAL(18,2)) * CAST(l.l_discount AS DECIMAL(18,2)) AS DECIMAL(18,6)) AS monthly_cost,
    l.l_linenumber * 12 AS confidence,
    CAST(l.l_shipdate AS TIMESTAMP) AS detected_at,
    CAST(p.p_size AS STRING) AS dim_size_gb,
    CASE p.p_size % 3 WHEN 0 THEN 'gp2' WHEN 1 THEN 'gp3' ELSE 'io1' END AS dim_volume_type,
    CAST(CAST(l.l_quantity AS BIGINT) AS STRING) AS dim_age_days,
    CASE WHEN l.l_partkey % 6 = 2 AND l.l_partkey % 4 < 2 THEN '/aws/lambda/' || p.p_name
         WHEN l.l_partkey % 6 = 2 THEN '/app/' || p.p_name
         WHEN l.l_partkey % 6 = 4 THEN 'Custom/' || CAST(l.l_partkey % 7 AS STRING)
         ELSE 'r-' || CAST(l.l_partkey AS STRING) END AS dim_name,
    p.p_name AS dim_metric_name,
    CAST(CAST(l.l_quantity AS BIGINT) * 10 AS STRING) AS dim_alarm_count,
    CAST(l.l_orderkey AS STRING) || '.' || CAST(l.l_linenumber AS STRING) AS line_ref
  FROM {{lineitem}} l
  JOIN {{orders}} o ON l.l_orderkey = o.o_orderkey
  JOIN {{part}} p ON l.l_partkey = p.p_partkey
  {CATALOG_JOIN}
  {REGION_JOIN}
"""
_FINDINGS_NAMES_SQL = """
SELECT b.*,
       b.tenant_id || ':' || b.account_id || ':' || b.check_id || ':' || b.resource_id AS fingerprint,
       b.tenant_id || ':' || b.account_id || ':' || b.check_id || ':' || b.resource_id || '@' || b.run_id || '#' || b.line_ref AS finding_id,
       'arn:aws:' || lower(b.service) || ':' || b.region || ':' || b.account_id || ':' || b.resource_id AS resource_arn,
       b.check_title || ' ' || b.resource_id AS title
FROM """
FINDINGS_SQL = f"{_FINDINGS_NAMES_SQL}(\n{_FINDINGS_BASE_SQL}) b\n"

# One billing fact per line item: lineitem ⋈ orders. Some facts carry the ARN
# instead of the id, some no resource, region or service (NULL-tolerant tiers).
COST_FACTS_SQL = f"""
SELECT
  'tenant-' || CAST(o.o_custkey % 3 AS STRING) AS tenant_id,
  'prod' AS workspace_id,
  {_MONTH_TEXT.format(c='l.l_shipdate')} AS billing_period,
  CAST(l.l_shipdate AS TIMESTAMP) AS usage_start,
  CAST(date_trunc('month', l.l_shipdate) AS TIMESTAMP) AS billing_period_start,
  '999900000000' AS payer_account_id,
  CAST(100000000000 + l.l_partkey % 7 AS STRING) AS account_id,
  CASE WHEN l.l_suppkey % 11 = 0 THEN NULL
       WHEN l.l_suppkey % 13 = 0 THEN upper(g.region)
       ELSE g.region END AS region,
  CASE WHEN l.l_orderkey % 5 = 0 THEN NULL ELSE sg.gservice END AS service,
  CASE WHEN l.l_linenumber % 7 = 0 THEN NULL
       WHEN l.l_linenumber % 4 = 0 THEN 'arn:aws:' || lower(c.service) || ':' || g.region
            || ':' || CAST(100000000000 + l.l_partkey % 7 AS STRING) || ':r-' || CAST(l.l_partkey AS STRING)
       ELSE 'r-' || CAST(l.l_partkey AS STRING) END AS resource_id,
  CASE l.l_linestatus WHEN 'F' THEN 'Usage' ELSE 'DiscountedUsage' END AS line_item_type,
  'USD' AS currency,
  CAST(CAST(l.l_extendedprice AS DECIMAL(18,2)) * (1 - CAST(l.l_discount AS DECIMAL(18,2))) AS DECIMAL(18,6)) AS cost_unblended,
  CASE WHEN l.l_linenumber % 2 = 0 THEN NULL
       ELSE CAST(CAST(l.l_extendedprice AS DECIMAL(18,2)) * (1 - CAST(l.l_discount AS DECIMAL(18,2)) - CAST(l.l_tax AS DECIMAL(18,2))) AS DECIMAL(18,6)) END AS cost_net,
  CASE WHEN l.l_linenumber % 3 = 0 THEN NULL
       ELSE CAST(CAST(l.l_extendedprice AS DECIMAL(18,2)) * CAST(0.9 AS DECIMAL(18,2)) AS DECIMAL(18,6)) END AS cost_amortized
FROM {{lineitem}} l
JOIN {{orders}} o ON l.l_orderkey = o.o_orderkey
{CATALOG_JOIN}
{REGION_JOIN}
{SERVICE_GROUP_JOIN}
"""

# Raw billing export in provider column spelling (schema drift: the "az"
# variant has no region column, only availability zones; tag columns carry
# blanks). One row per line item.
RAW_CUR_SQL = f"""
SELECT
  CAST(l.l_shipdate AS TIMESTAMP) AS line_item_usage_start_date,
  CAST(l.l_shipdate AS TIMESTAMP) + INTERVAL 1 DAY AS line_item_usage_end_date,
  CAST(date_trunc('month', l.l_shipdate) AS TIMESTAMP) AS bill_billing_period_start_date,
  '999900000000' AS bill_payer_account_id,
  CAST(100000000000 + l.l_partkey % 7 AS STRING) AS line_item_usage_account_id,
  sg.gservice AS line_item_product_code,
  {{region_column}}
  g.region || CASE l.l_linenumber % 3 WHEN 0 THEN 'a' WHEN 1 THEN 'b' ELSE 'c' END AS line_item_availability_zone,
  'r-' || CAST(l.l_partkey AS STRING) AS line_item_resource_id,
  CASE l.l_linestatus WHEN 'F' THEN 'Usage' ELSE 'DiscountedUsage' END AS line_item_line_item_type,
  'BoxUsage:' || l.l_returnflag AS line_item_usage_type,
  CASE WHEN l.l_linenumber % 5 = 0 THEN '' ELSE 'USD' END AS pricing_currency,
  CAST(CAST(l.l_extendedprice AS DECIMAL(18,2)) * (1 - CAST(l.l_discount AS DECIMAL(18,2))) AS DECIMAL(18,6)) AS line_item_unblended_cost,
  CASE WHEN l.l_linenumber % 2 = 0 THEN NULL
       ELSE CAST(CAST(l.l_extendedprice AS DECIMAL(18,2)) * (1 - CAST(l.l_discount AS DECIMAL(18,2)) - CAST(l.l_tax AS DECIMAL(18,2))) AS DECIMAL(18,6)) END AS line_item_net_unblended_cost,
  CASE WHEN l.l_linenumber % 3 = 0 THEN NULL
       ELSE CAST(CAST(l.l_extendedprice AS DECIMAL(18,2)) * CAST(0.9 AS DECIMAL(18,2)) AS DECIMAL(18,6)) END AS line_item_amortized_cost,
  CASE WHEN l.l_partkey % 3 = 0 THEN '' ELSE 'team-' || CAST(l.l_partkey % 4 AS STRING) END AS resource_tags_user_team,
  CASE l.l_suppkey % 3 WHEN 0 THEN 'prod' WHEN 1 THEN ' ' ELSE 'dev' END AS resource_tags_user_env
FROM {{{{lineitem}}}} l
JOIN {{{{orders}}}} o ON l.l_orderkey = o.o_orderkey
{REGION_JOIN.replace("{", "{{").replace("}", "}}")}
{SERVICE_GROUP_JOIN.replace("{", "{{").replace("}", "}}")}
"""
RAW_CUR_REGION_SQL = RAW_CUR_SQL.format(
    region_column="CASE WHEN l.l_suppkey % 11 = 0 THEN '' ELSE g.region END AS product_region,"
)
RAW_CUR_AZ_SQL = RAW_CUR_SQL.format(region_column="")

# Long metric series: one point per event.
METRICS_SQL = """
SELECT 'tenant-' || CAST(e.user_id % 3 AS STRING) AS tenant_id,
       CAST(100000000000 + e.user_id % 7 AS STRING) AS account_id,
       'r-' || CAST(e.user_id AS STRING) AS resource_id,
       e.event_type AS metric,
       CAST(e.ts AS TIMESTAMP) AS ts,
       e.value AS value
FROM {events} e
"""

# Runs: one per (tenant, workspace, year of order); years divisible by 7 failed.
RUNS_SQL = f"""
SELECT DISTINCT
  'tenant-' || CAST(o.o_custkey % 3 AS STRING) AS tenant_id,
  'prod' AS workspace_id,
  'run-' || {_YEAR_TEXT.format(c='o.o_orderdate')} AS run_id,
  CAST(date_trunc('year', o.o_orderdate) AS TIMESTAMP) AS run_ts,
  CASE WHEN year(o.o_orderdate) % 7 = 0 THEN 'failed' ELSE 'ready' END AS status
FROM {{orders}} o
"""

# State events: one per line item on its finding's fingerprint; state from the
# line's flags, event time = ship date + line number hours.
STATE_EVENTS_SQL = f"""
SELECT
  'tenant-' || CAST(o.o_custkey % 3 AS STRING) AS tenant_id,
  'prod' AS workspace_id,
  CASE WHEN l.l_partkey % 10 = 3 THEN 'ticket' ELSE 'finding' END AS subject_type,
  'tenant-' || CAST(o.o_custkey % 3 AS STRING) || ':' || CAST(100000000000 + l.l_partkey % 7 AS STRING) || ':'
    || c.check_id || ':r-' || CAST(l.l_partkey AS STRING) AS subject_id,
  CASE WHEN l.l_quantity < 10 THEN 'resolved'
       WHEN l.l_quantity < 18 THEN 'snoozed'
       WHEN l.l_quantity < 22 THEN 'ignored'
       WHEN l.l_quantity < 30 THEN 'acknowledged'
       ELSE 'open' END AS state,
  CASE WHEN l.l_quantity >= 10 AND l.l_quantity < 18
       THEN CAST(l.l_shipdate AS TIMESTAMP) + INTERVAL 20 DAY END AS snooze_until,
  CAST(l.l_shipdate AS TIMESTAMP) + INTERVAL 1 HOUR * l.l_linenumber AS event_ts
FROM {{lineitem}} l
JOIN {{orders}} o ON l.l_orderkey = o.o_orderkey
{CATALOG_JOIN}
"""

# Remediation actions: one per order, on the finding of its first line item;
# order status F -> completed, O -> failed, P -> approved (not finalized).
_FINGERPRINT = """'tenant-' || CAST(o.o_custkey % 3 AS STRING) || ':' || CAST(100000000000 + l.l_partkey % 7 AS STRING) || ':'
    || c.check_id || ':r-' || CAST(l.l_partkey AS STRING)"""

# SLA extensions and assignments of findings, one per line item of large or middling quantity.
EXTENSIONS_SQL = f"""
SELECT 'tenant-' || CAST(o.o_custkey % 3 AS STRING) AS tenant_id, 'prod' AS workspace, {_FINGERPRINT} AS fingerprint,
       CAST(l.l_linenumber * 9 AS INT) AS days, CAST(l.l_shipdate AS TIMESTAMP) + INTERVAL 12 DAY AS event_ts
FROM {{lineitem}} l JOIN {{orders}} o ON l.l_orderkey = o.o_orderkey
{CATALOG_JOIN}
WHERE l.l_quantity >= 44
"""
ASSIGNMENTS_SQL = f"""
SELECT 'tenant-' || CAST(o.o_custkey % 3 AS STRING) AS tenant_id, 'prod' AS workspace, {_FINGERPRINT} AS fingerprint,
       CASE WHEN l.l_linenumber < 6 THEN 'user-' || CAST(l.l_suppkey % 20 AS STRING) END AS owner_id, 'team-' || CAST(l.l_suppkey % 5 AS STRING) AS team_id,
       CAST(l.l_shipdate AS TIMESTAMP) + INTERVAL 1 HOUR * l.l_linenumber AS event_ts
FROM {{lineitem}} l JOIN {{orders}} o ON l.l_orderkey = o.o_orderkey
{CATALOG_JOIN}
WHERE l.l_quantity >= 36 AND l.l_quantity < 44
"""

ACTIONS_SQL = f"""
SELECT
  'tenant-' || CAST(o.o_custkey % 3 AS STRING) AS tenant_id,
  'prod' AS workspace_id,
  'act-' || CAST(l.l_orderkey AS STRING) || '.' || CAST(l.l_linenumber AS STRING) AS action_id,
  'tenant-' || CAST(o.o_custkey % 3 AS STRING) || ':' || CAST(100000000000 + l.l_partkey % 7 AS STRING) || ':'
    || c.check_id || ':r-' || CAST(l.l_partkey AS STRING) AS fingerprint,
  c.check_id AS check_id,
  CASE WHEN l.l_partkey % 2 = 0 THEN 'stop' ELSE 'delete' END AS action_type,
  CASE o.o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'failed' ELSE 'approved' END AS status,
  CAST(o.o_orderdate AS TIMESTAMP) - INTERVAL 2 DAY AS requested_at,
  CAST(o.o_orderdate AS TIMESTAMP) AS updated_at
FROM {{orders}} o
JOIN {{lineitem}} l ON l.l_orderkey = o.o_orderkey
{CATALOG_JOIN}
"""

# ---------------------------------------------------------------------------
# Inventories for detectors (one resource per part / per event user / per order)
# ---------------------------------------------------------------------------

# EBS volumes and EC2 instances: one of each per part.
VOLUMES_SQL = """
SELECT
  'tenant-' || CAST(p.p_partkey % 3 AS STRING) AS tenant_id,
  CAST(100000000000 + p.p_partkey % 7 AS STRING) AS account_id,
  g.region AS region,
  'vol-' || CAST(p.p_partkey AS STRING) AS volume_id,
  'i-' || CAST(p.p_partkey AS STRING) AS instance_id,
  CASE WHEN p.p_size % 4 = 0 THEN 'in-use' WHEN p.p_size % 4 = 1 THEN '' ELSE 'available' END AS state,
  CASE WHEN p.p_size % 4 = 0 THEN 1 ELSE 0 END AS attachment_count,
  CASE p.p_size % 3 WHEN 0 THEN 'gp2' WHEN 1 THEN 'gp3' ELSE 'io1' END AS volume_type,
  p.p_size * 10 AS size_gb,
  CASE WHEN p.p_partkey % 3 = 0 THEN NULL WHEN p.p_partkey % 3 = 1 THEN true ELSE false END AS encrypted,
  TIMESTAMP '2024-02-01 00:00:00' - INTERVAL 7 HOUR * (p.p_partkey % 500) AS create_time,
  CASE WHEN p.p_brand = 'Brand#1' THEN 'true' END AS tag_keep,
  CASE WHEN p.p_brand = 'Brand#2' THEN 'Retain-forever' END AS tag_lifecycle,
  CASE p.p_partkey % 4 WHEN 0 THEN 'prod' WHEN 1 THEN 'dev' WHEN 2 THEN ' Staging ' END AS tag_environment,
  CASE WHEN p.p_partkey % 5 = 0 THEN NULL ELSE p.p_name END AS tag_application,
  CASE WHEN p.p_partkey % 6 = 0 THEN '' ELSE 'app-' || CAST(p.p_partkey % 9 AS STRING) END AS tag_applicationid
FROM {part} p
JOIN (VALUES (0, 'us-east-1'), (1, 'us-west-2'), (2, 'eu-west-1'), (3, 'eu-central-1'), (4, 'ap-southeast-2')) AS g(idx, region)
  ON g.idx = p.p_partkey % 5
"""

# NAT gateways and Lambda functions: one per event user (metrics come from that user's events).
NATS_SQL = """
SELECT DISTINCT
  'tenant-' || CAST(e.user_id % 3 AS STRING) AS tenant_id,
  CAST(100000000000 + e.user_id % 7 AS STRING) AS account_id,
  'us-east-1' AS region,
  'r-' || CAST(e.user_id AS STRING) AS resource_id,
  'subnet-' || CAST(e.user_id % 12 AS STRING) AS subnet_id,
  'us-east-1' || CASE e.user_id % 3 WHEN 0 THEN 'a' WHEN 1 THEN 'b' ELSE 'c' END AS az,
  CASE WHEN e.user_id % 29 = 0 THEN 'deleting' ELSE 'available' END AS state,
  CASE WHEN e.user_id % 31 = 0 THEN NULL ELSE TIMESTAMP '2023-12-01 00:00:00' + INTERVAL 1 DAY * (e.user_id % 90) END AS create_time,
  128 * (1 + e.user_id % 16) AS memory_mb,
  3 + e.user_id % 30 AS timeout_s,
  CASE WHEN e.user_id % 11 = 0 THEN 'true' END AS tag_keep
FROM {events} e
"""

# Route tables: one NAT route + one subnet association per order; those of every
# fifth customer also have an internet-gateway default route.
ROUTES_SQL = """
SELECT DISTINCT
  'rtb-' || CAST(o.o_orderkey AS STRING) AS route_table_id,
  'r-' || CAST(o.o_custkey + 50 AS STRING) AS nat_gateway_id,
  'subnet-' || CAST(o.o_custkey AS STRING) AS subnet_id,
  o.o_custkey % 5 = 0 AS has_igw_default
FROM {orders} o
"""

# Subnet -> availability zone (a subnet per customer).
SUBNETS_SQL = """
SELECT 'subnet-' || CAST(c.c_custkey AS STRING) AS subnet_id,
       'us-east-1' || CASE c.c_custkey % 7 % 3 WHEN 0 THEN 'a' WHEN 1 THEN 'b' ELSE 'c' END AS az
FROM {customer} c
"""

# CloudWatch alarms: one per event; error events crowd into seven accounts, the others spread.
ALARMS_SQL = """
SELECT 'tenant-' || CAST(e.user_id % 3 AS STRING) AS tenant_id,
       CAST(100000000000 + CASE WHEN e.event_type = 'error' THEN e.user_id % 7 ELSE 7 + e.user_id % 990 END AS STRING) AS account_id,
       'us-east-1' AS region,
       'alarm-' || CAST(e.event_id AS STRING) AS alarm_name
FROM {events} e
"""

# Running instances (one per 'N' line item) and reservations (one per finished order).
INSTANCES_SQL = """
SELECT 'tenant-' || CAST(l.l_orderkey % 3 AS STRING) AS tenant_id,
       CAST(100000000000 + l.l_suppkey % 7 AS STRING) AS account_id,
       'us-east-1' AS region,
       CASE l.l_partkey % 4 WHEN 0 THEN 'm5.large' WHEN 1 THEN 'M5.xlarge' WHEN 2 THEN 'c5.large' ELSE 't3.micro' END AS instance_type,
       CASE l.l_suppkey % 5 WHEN 0 THEN 'Linux/UNIX' WHEN 1 THEN 'Windows' WHEN 2 THEN 'Red Hat Enterprise Linux' WHEN 3 THEN 'SUSE Linux' ELSE '' END AS platform,
       CASE WHEN l.l_orderkey % 7 = 0 THEN 'Dedicated' ELSE 'default' END AS tenancy,
       CASE l.l_linenumber % 4 WHEN 0 THEN 'us-east-1a' WHEN 1 THEN 'us-east-1b' WHEN 2 THEN 'US-EAST-1c' ELSE '' END AS az,
       CASE WHEN l.l_returnflag = 'N' THEN 'running' ELSE 'stopped' END AS state
FROM {lineitem} l
"""

RESERVATIONS_SQL = """
SELECT 'tenant-' || CAST(o.o_orderkey % 3 AS STRING) AS tenant_id,
       CAST(100000000000 + o.o_custkey % 7 AS STRING) AS account_id,
       'us-east-1' AS region,
       CASE o.o_custkey % 4 WHEN 0 THEN 'm5.large' WHEN 1 THEN 'm5.xlarge' WHEN 2 THEN 'c5.large' ELSE 't3.micro' END AS instance_type,
       CASE o.o_custkey % 5 WHEN 0 THEN 'Linux/UNIX' WHEN 1 THEN 'Windows' WHEN 2 THEN 'Red Hat Enterprise Linux' WHEN 3 THEN 'SUSE Linux' ELSE 'Linux/UNIX (Amazon VPC)' END AS product_description,
       CASE WHEN o.o_orderkey % 7 = 0 THEN 'dedicated' ELSE 'default' END AS instance_tenancy,
       CASE WHEN o.o_orderkey % 2 = 0 THEN 'Availability Zone' ELSE 'Region' END AS scope,
       CASE WHEN o.o_orderkey % 2 = 0 THEN 'us-east-1' || CASE o.o_custkey % 3 WHEN 0 THEN 'a' WHEN 1 THEN 'b' ELSE 'c' END END AS az,
       o.o_orderkey % 5 + 1 AS instance_count,
       CASE WHEN o.o_orderstatus = 'F' THEN 'active' ELSE 'retired' END AS state
FROM {orders} o
"""

# RDS instances (one per customer), S3 buckets (one per part), EKS clusters (one per supplier).
DBS_SQL = """
SELECT 'tenant-' || CAST(c.c_custkey % 3 AS STRING) AS tenant_id,
       CAST(100000000000 + c.c_custkey % 7 AS STRING) AS account_id,
       'eu-west-1' AS region,
       'db-' || CAST(c.c_custkey AS STRING) AS db_instance_id,
       CASE c.c_custkey % 4 WHEN 0 THEN 'mysql' WHEN 1 THEN 'postgres' WHEN 2 THEN 'MariaDB' ELSE 'aurora-mysql' END AS engine,
       CASE c.c_nationkey % 7 WHEN 0 THEN '5.7.44' WHEN 1 THEN '11.22' WHEN 2 THEN '10.5.8' WHEN 3 THEN ' 12.4'
            WHEN 4 THEN '10.6' WHEN 5 THEN '8.0.35' ELSE 'x.1' END AS engine_version,
       CASE c.c_custkey % 5 WHEN 0 THEN 'db.m3.large' WHEN 1 THEN 'db.m5.large' WHEN 2 THEN 'db.t2.micro'
            WHEN 3 THEN 'm4.large' ELSE 'db.r4' END AS instance_class,
       CASE WHEN c.c_mktsegment = 'BUILDING' THEN 'stopped' ELSE 'available' END AS status,
       CASE WHEN c.c_acctbal > 0 THEN CAST(floor(c.c_acctbal / 100) AS BIGINT) ELSE 0 END AS allocated_gb,
       c.c_custkey % 3 = 0 AS multi_az,
       CASE WHEN c.c_custkey % 2 = 0 THEN 'db-' || CAST(c.c_custkey + 1 AS STRING) END AS replica_of,
       CASE c.c_custkey % 6 WHEN 0 THEN 'Dev' WHEN 1 THEN 'prod' WHEN 2 THEN 'qa' WHEN 3 THEN 'UAT' END AS tag_env,
       CASE c.c_custkey % 10 WHEN 4 THEN 'Disaster_Recovery' WHEN 6 THEN 'reporting' END AS tag_role
FROM {customer} c
"""

BUCKETS_SQL = """
SELECT 'tenant-' || CAST(p.p_partkey % 3 AS STRING) AS tenant_id,
       CAST(100000000000 + p.p_partkey % 7 AS STRING) AS account_id,
       'us-east-1' AS region,
       's3-' || CAST(p.p_partkey AS STRING) AS bucket_name,
       CASE p.p_size % 3 WHEN 0 THEN 'missing' WHEN 1 THEN 'present' ELSE 'unknown' END AS lifecycle_state,
       CASE p.p_partkey % 4 WHEN 0 THEN 'missing' WHEN 3 THEN 'unknown' ELSE 'present' END AS encryption_state,
       p.p_size % 2 = 0 AS block_public_acls,
       true AS ignore_public_acls,
       p.p_partkey % 5 <> 0 AS block_public_policy,
       true AS restrict_public_buckets,
       p.p_partkey % 7 <> 0 AS pab_configured,
       p.p_partkey % 11 = 0 AS pab_error
FROM {part} p
"""

EKS_NODEGROUPS_SQL = """
SELECT 'tenant-' || CAST(o.o_custkey % 3 AS STRING) AS tenant_id,
       CAST(100000000000 + o.o_custkey % 7 AS STRING) AS account_id,
       'us-west-2' AS region,
       'ng-' || CAST(o.o_orderkey AS STRING) AS nodegroup_name,
       'eks-' || CAST(o.o_custkey AS STRING) AS cluster_name,
       CAST(o.o_orderkey % 3 AS INT) AS desired_size,
       CASE o.o_orderkey % 5 WHEN 0 THEN 'SPOT' WHEN 1 THEN NULL ELSE 'on_demand' END AS capacity_type,
       CASE o.o_orderkey % 4 WHEN 0 THEN 'prod' WHEN 1 THEN 'Sandbox' END AS tag_stage
FROM {orders} o
"""

EFS_SQL = """
SELECT 'tenant-' || CAST(c.c_custkey % 3 AS STRING) AS tenant_id,
       CAST(100000000000 + c.c_custkey % 7 AS STRING) AS account_id,
       'eu-west-1' AS region,
       'fs-' || CAST(c.c_custkey AS STRING) AS file_system_id,
       CASE c.c_custkey % 4 WHEN 0 THEN 'AFTER_30_DAYS' WHEN 1 THEN ' ' END AS to_ia,
       CASE WHEN c.c_custkey % 6 = 1 THEN 'AFTER_90_DAYS' END AS to_archive,
       CASE c.c_custkey % 5 WHEN 0 THEN 'disabled' WHEN 1 THEN NULL ELSE 'ENABLED' END AS backup_status,
       CASE c.c_custkey % 3 WHEN 0 THEN false WHEN 1 THEN true END AS encrypted,
       CASE WHEN c.c_custkey % 2 = 0 THEN 'provisioned' ELSE 'bursting' END AS throughput_mode
FROM {customer} c
"""


def _json(text: str) -> str:
    """A JSON literal inside a binding: braces doubled for ``format``; ``@name@`` is a column of the row."""
    text = text.replace("{", "{{").replace("}", "}}")
    return "'" + re.sub(r"@(\w+)@", r"' || b.\1 || '", text) + "'"


# Vault access policies by customer key, one for every shape the policy check tells apart.
VAULT_POLICIES = [
    "NULL",
    "'  '",
    _json('{oops'),
    _json('{"Version":"2012-10-17","Id":null}'),
    _json('{"Statement":{"Sid":"np","Effect":"Allow","NotPrincipal":{"AWS":"x"},"Action":"backup:CopyIntoBackupVault"}}'),
    _json('{"Statement":[{"Sid":"any","Effect":"Allow","Principal":"*","Action":["backup:DeleteRecoveryPoint","Backup:StartCopyJob"],"Resource":"*"}]}'),
    _json('{"Statement":[{"Sid":"org","Effect":" allow ","Principal":{"AWS":["*"]},"Action":"backup:*","Condition":{"StringEquals":{"aws:PrincipalOrgID":["o-2","o-1","o-2"]}}}]}'),
    _json('{"Statement":[{"Sid":"far","Effect":"Allow","Principal":"*","Action":"*","Resource":["arn:aws:s3:::logs","arn:aws:s3:::more"]}]}'),
    _json('{"Statement":[{"Sid":"farorg","Effect":"Allow","Principal":{"AWS":"*"},"Action":"*","Resource":"arn:aws:s3:::logs","Condition":{"ForAnyValue:StringLike":{"aws:PrincipalOrgID":"o-9"}}}]}'),
    _json('{"Statement":[{"Sid":"cross","Effect":"Allow","Principal":{"AWS":["arn:aws:iam::210000000002:root","@account_id@","210000000001","210000000007",null]},"Action":"backup:StartRestoreJob"}]}'),
    _json('{"Statement":[{"Effect":"Allow","Principal":{"AWS":"210000000001"}}]}'),
    _json('{"Statement":[{"Sid":"own","Effect":"Allow","Principal":{"AWS":"arn:aws:iam::@account_id@:role/Ops"},"Action":["backup:DeleteBackupVault"]}]}'),
    _json('{"Statement":[{"Sid":"no","Effect":"Deny","Principal":"*","Action":"*"},"text",{"Effect":"Allow","Principal":{"Service":"x"},"Action":"a"}]}'),
    _json('{"Statement":[{"Sid":"a","Effect":"Allow","Principal":["210000000001"],"Action":"backup:Get"},{"Sid":"b","Effect":"Allow","Principal":"*","Resource":"@vault_arn@/part"}]}'),
    _json('{"Statement":[{"Sid":"own","Effect":"Allow","Principal":"@account_id@","Action":"x"},{"Sid":"w1","Effect":"Allow","Principal":"*","Action":"x","Resource":"r"},{"Sid":"w2","Effect":"Allow","Principal":"*","Action":"x","Resource":""}]}'),
    _json('{"Statement":"all of it"}'),
    _json('[{"Effect":"Allow","Principal":"*"}]'),
]

VAULTS_SQL = f"""
SELECT b.*, CASE b.k % {len(VAULT_POLICIES)} {" ".join(f"WHEN {i} THEN {p}" for i, p in enumerate(VAULT_POLICIES))} END AS policy
FROM (
  SELECT a.*, 'arn:aws:backup:' || a.region || ':' || a.account_id || ':backup-vault:' || a.vault_name AS vault_arn
  FROM (
    SELECT 'tenant-' || CAST(c.c_custkey % 3 AS STRING) AS tenant_id,
           CAST(100000000000 + c.c_custkey % 7 AS STRING) AS account_id,
           'eu-west-1' AS region,
           'vault-' || CAST(c.c_custkey AS STRING) AS vault_name,
           CASE c.c_custkey % 4 WHEN 0 THEN true WHEN 1 THEN false END AS locked,
           CASE c.c_custkey % 5 WHEN 0 THEN 0 WHEN 1 THEN 3 WHEN 2 THEN 30 END AS min_days,
           CASE c.c_custkey % 6 WHEN 0 THEN 0 WHEN 1 THEN 365 WHEN 2 THEN 3650 WHEN 3 THEN 400 END AS max_days,
           c.c_custkey AS k
    FROM {{customer}} c) a) b
"""

# Daily storage gauges of buckets (one bucket per part, one wide point per line item): some
# storage types have no point, a zero or an older one only.
BUCKET_GAUGES_SQL = f"""
SELECT 'tenant-' || CAST(l.l_partkey % 3 AS STRING) AS tenant_id,
       CAST(100000000000 + l.l_partkey % 7 AS STRING) AS account_id,
       {_region_case("l.l_partkey")} AS region,
       's3-' || CAST(l.l_partkey AS STRING) AS bucket_name,
       CAST(TIMESTAMP '2024-01-26 00:00:00' + INTERVAL 1 DAY * (l.l_orderkey % 8) AS TIMESTAMP) AS ts,
       CASE WHEN l.l_linenumber % 3 <> 0 THEN l.l_quantity * 1073741824.0 END AS StandardStorage,
       CASE WHEN l.l_partkey % 2 = 0 THEN l.l_quantity * 268435456.0 END AS StandardIAStorage,
       CASE WHEN l.l_partkey % 5 = 0 THEN l.l_quantity * 134217728.0 END AS OneZoneIAStorage,
       CASE WHEN l.l_partkey % 3 = 0 THEN (l.l_quantity - 25) * 536870912.0 END AS IntelligentTieringFAStorage,
       CASE WHEN l.l_partkey % 7 = 0 THEN l.l_quantity * 67108864.0 END AS IntelligentTieringIAStorage,
       CASE WHEN l.l_partkey % 11 = 0 THEN 0.0 END AS IntelligentTieringAAStorage,
       CASE WHEN l.l_partkey % 4 = 1 THEN l.l_quantity * 2147483648.0 END AS GlacierStorage,
       CASE WHEN l.l_partkey % 13 = 0 THEN l.l_quantity * 1073741824.0 END AS GlacierIRStorage,
       CASE WHEN l.l_partkey % 6 = 5 THEN l.l_quantity * 4294967296.0 END AS DeepArchiveStorage
FROM {{lineitem}} l
"""

FSX_SQL = """
SELECT 'tenant-' || CAST(c.c_custkey % 3 AS STRING) AS tenant_id,
       CAST(100000000000 + c.c_custkey % 7 AS STRING) AS account_id,
       'eu-west-1' AS region,
       'fsx-' || CAST(c.c_custkey AS STRING) AS file_system_id,
       CASE c.c_custkey % 4 WHEN 0 THEN 'LUSTRE' WHEN 1 THEN 'ONTAP' ELSE 'WINDOWS' END AS fs_type,
       CASE WHEN c.c_custkey % 3 = 0 THEN 'MULTI_AZ_1' WHEN c.c_custkey % 3 = 1 THEN 'SINGLE_AZ_2' END AS deployment,
       CAST(1024 * (c.c_custkey % 9) AS INT) AS storage_gib,
       CAST(c.c_custkey % 5 * 16 AS INT) AS throughput,
       CASE WHEN c.c_custkey % 5 < 3 THEN 'SSD' ELSE 'HDD' END AS storage_type,
       CASE WHEN c.c_custkey % 11 = 0 THEN NULL ELSE CAST(c.c_custkey % 10 AS INT) END AS backup_days,
       CASE c.c_custkey % 4 WHEN 2 THEN false WHEN 3 THEN true END AS copy_tags,
       CASE c.c_custkey % 7 WHEN 0 THEN '1:08:00' WHEN 1 THEN '3:18:30' WHEN 2 THEN '7:19:00' WHEN 3 THEN 'daily' WHEN 4 THEN ' ' END AS maintenance,
       CASE c.c_custkey % 6 WHEN 0 THEN 'my-DEV-box' WHEN 1 THEN 'prod' WHEN 2 THEN 'sbx' END AS tag_environment,
       CASE WHEN c.c_custkey % 2 = 0 THEN 'app' END AS tag_application,
       CASE WHEN c.c_custkey % 5 = 4 THEN 'qa share' WHEN c.c_custkey % 5 = 3 THEN 'files' END AS tag_name
FROM {customer} c
"""

RDS_SNAPSHOTS_SQL = """
SELECT 'tenant-' || CAST(o.o_custkey % 3 AS STRING) AS tenant_id,
       CAST(100000000000 + o.o_custkey % 7 AS STRING) AS account_id,
       'eu-west-1' AS region,
       'rsnap-' || CAST(o.o_orderkey AS STRING) AS snapshot_id,
       CASE WHEN o.o_orderkey % 3 = 0 THEN 'automated' WHEN o.o_orderkey % 3 = 1 THEN 'Manual' ELSE 'manual-copy' END AS snapshot_type,
       CASE WHEN o.o_orderkey % 4 = 0 THEN 'cluster' ELSE 'db' END AS kind,
       CASE o.o_orderkey % 5 WHEN 0 THEN 'gone-' || CAST(o.o_custkey AS STRING) WHEN 1 THEN '' ELSE 'db-' || CAST(o.o_custkey AS STRING) END AS source_id,
       CASE WHEN o.o_orderkey % 7 = 0 THEN 'us-east-1' END AS source_region,
       CAST(o.o_orderdate AS TIMESTAMP) AS created,
       CAST(CAST(o.o_totalprice AS DECIMAL(18,2)) * CAST(0.001 AS DECIMAL(4,3)) AS DECIMAL(18,2)) AS size_gb
FROM {orders} o
"""

EKS_SQL = """
SELECT 'tenant-' || CAST(s.s_suppkey % 3 AS STRING) AS tenant_id,
       CAST(100000000000 + s.s_suppkey % 7 AS STRING) AS account_id,
       'us-west-2' AS region,
       'eks-' || CAST(s.s_suppkey AS STRING) AS cluster_name,
       CASE WHEN s.s_suppkey % 9 = 0 THEN ' 1.' ELSE '1.' END || CAST(24 + s.s_suppkey % 8 AS STRING) AS version,
       s.s_suppkey % 2 = 0 AS endpoint_public,
       s.s_suppkey % 3 = 0 AS endpoint_private,
       CASE s.s_suppkey % 4 WHEN 0 THEN '' WHEN 1 THEN 'api,audit' WHEN 2 THEN ' ' ELSE 'scheduler' END AS log_types
FROM {supplier} s
"""

# Security groups (one per supplier, two ingress permissions each, some SG-to-SG
# references) and network interfaces attaching them (from line items).
SGS_SQL = """
SELECT 'tenant-' || CAST(s.s_suppkey % 3 AS STRING) AS tenant_id,
       CAST(100000000000 + s.s_suppkey % 7 AS STRING) AS account_id,
       'us-east-1' AS region,
       'sg-' || CAST(s.s_suppkey AS STRING) AS group_id,
       CASE WHEN s.s_suppkey % 10 = 0 THEN 'default' ELSE 'app-' || CAST(s.s_suppkey AS STRING) END AS group_name,
       CASE s.s_suppkey % 4 WHEN 0 THEN '-1' WHEN 3 THEN 'udp' ELSE 'tcp' END AS p1_proto,
       CASE s.s_suppkey % 4 WHEN 1 THEN 22 WHEN 2 THEN 3000 ELSE 0 END AS p1_from,
       CASE s.s_suppkey % 4 WHEN 1 THEN 22 WHEN 2 THEN 4000 ELSE 65535 END AS p1_to,
       CASE WHEN s.s_suppkey % 3 = 0 THEN '0.0.0.0/0' ELSE '10.0.0.0/8' END AS p1_cidr,
       CASE WHEN s.s_suppkey % 5 = 0 THEN '::/0' END AS p1_cidr6,
       'tcp' AS p2_proto, 3389 AS p2_from, 3389 AS p2_to,
       CASE WHEN s.s_suppkey % 6 = 1 THEN '0.0.0.0/0' ELSE '192.168.0.0/16' END AS p2_cidr,
       CAST(NULL AS STRING) AS p2_cidr6,
       CASE WHEN s.s_suppkey % 13 = 0 THEN 'sg-' || CAST(s.s_suppkey + 4 AS STRING) END AS egress_ref_group
FROM {supplier} s
"""

ENIS_SQL = """
SELECT DISTINCT 'eni-' || CAST(l.l_orderkey AS STRING) AS eni_id,
       'i-' || CAST(l.l_orderkey AS STRING) AS instance_id,
       CASE WHEN l.l_suppkey % 4 <> 0 AND l.l_linenumber = 1 THEN 'sg-' ELSE 'other-sg-' END || CAST(l.l_suppkey AS STRING) AS group_id
FROM {lineitem} l
"""

# EBS snapshots (one per order) and the snapshots images refer to (from line items).
SNAPSHOTS_SQL = """
SELECT 'tenant-' || CAST(o.o_custkey % 3 AS STRING) AS tenant_id,
       CAST(100000000000 + o.o_custkey % 7 AS STRING) AS account_id,
       'us-east-1' AS region,
       'snap-' || CAST(o.o_orderkey AS STRING) AS snapshot_id,
       (o.o_orderkey % 50 + 1) * 8 AS size_gb,
       CAST(o.o_orderdate AS TIMESTAMP) AS start_time,
       CASE WHEN o.o_orderkey % 9 = 0 THEN NULL ELSE o.o_orderkey % 4 <> 0 END AS encrypted,
       CASE WHEN o.o_orderpriority = '1-URGENT' THEN 'Created by AWS Backup' ELSE 'manual' END AS description,
       CASE WHEN o.o_custkey % 13 = 0 THEN 'vol-1' END AS tag_backup_source,
       CASE WHEN o.o_custkey % 17 = 0 THEN 'yes' END AS tag_keep
FROM {orders} o
"""

IMAGES_SQL = """
SELECT DISTINCT 'ami-' || CAST(l.l_partkey AS STRING) AS image_id,
       CASE WHEN l.l_linenumber = 3 AND l.l_returnflag = 'R' THEN 'snap-' ELSE 'other-snap-' END || CAST(l.l_orderkey AS STRING) AS snapshot_id
FROM {lineitem} l
"""

# Log groups (one per part) and metric filters on them (one per early line item).
LOG_GROUPS_SQL = """
SELECT 'tenant-' || CAST(p.p_partkey % 3 AS STRING) AS tenant_id,
       CAST(100000000000 + p.p_partkey % 7 AS STRING) AS account_id,
       'us-east-1' AS region,
       CASE WHEN p.p_partkey % 2 = 0 THEN '/aws/lambda/' ELSE '/app/' END || replace(p.p_name, ' ', '-') || '-' || CAST(p.p_partkey AS STRING) AS log_group,
       CASE WHEN p.p_size % 3 = 0 THEN NULL ELSE 30 END AS retention_days,
       CASE WHEN p.p_brand = 'Brand#3' THEN 'true' END AS tag_keep,
       CASE WHEN p.p_partkey % 7 = 0 THEN 'audit' END AS tag_purpose,
       CASE WHEN p.p_partkey % 37 = 0 THEN 'Permanent' END AS tag_owner
FROM {part} p
"""

METRIC_FILTERS_SQL = """
SELECT 'tenant-' || CAST(l.l_partkey % 3 AS STRING) AS tenant_id,
       CAST(100000000000 + l.l_partkey % 7 AS STRING) AS account_id,
       'us-east-1' AS region,
       CAST(l.l_orderkey AS STRING) || '.' || CAST(l.l_linenumber AS STRING) AS filter_name,
       'lg-' || CAST(l.l_partkey AS STRING) AS log_group,
       'Custom/' || CAST(l.l_suppkey % 5 AS STRING) AS namespace,
       'm' || CAST(l.l_orderkey % 40 AS STRING) AS metric_name
FROM {lineitem} l
"""

# ECS clusters (one per supplier) and services (one per order).
ECS_CLUSTERS_SQL = """
SELECT 'tenant-' || CAST(s.s_suppkey % 3 AS STRING) AS tenant_id,
       CAST(100000000000 + s.s_suppkey % 7 AS STRING) AS account_id,
       'eu-central-1' AS region,
       'ecs-' || CAST(s.s_suppkey AS STRING) AS cluster_name,
       s.s_suppkey % 4 AS active_services, s.s_suppkey % 3 AS running_tasks,
       CASE WHEN s.s_suppkey % 5 = 0 THEN 1 ELSE 0 END AS pending_tasks,
       CASE WHEN s.s_suppkey % 2 = 0 THEN 0 ELSE 2 END AS container_instances
FROM {supplier} s
"""

ECS_SERVICES_SQL = """
SELECT 'tenant-' || CAST(o.o_custkey % 3 AS STRING) AS tenant_id,
       CAST(100000000000 + o.o_custkey % 7 AS STRING) AS account_id,
       'eu-central-1' AS region,
       'ecs-' || CAST(o.o_custkey AS STRING) AS cluster_name,
       'svc-' || CAST(o.o_orderkey % 50 AS STRING) AS service_name,
       CASE WHEN o.o_orderkey % 10 = 0 THEN 'DRAINING' ELSE 'ACTIVE' END AS status,
       o.o_orderkey % 4 AS desired_count,
       CASE WHEN o.o_custkey % 3 = 0 THEN 0 ELSE o.o_orderkey % 4 END AS running_count,
       CASE o.o_orderpriority WHEN '1-URGENT' THEN 'EC2' WHEN '2-HIGH' THEN '' ELSE 'fargate' END AS launch_type,
       CASE o.o_custkey % 4 WHEN 0 THEN 'FARGATE_SPOT,FARGATE' WHEN 1 THEN 'FARGATE' WHEN 2 THEN '' ELSE 'ec2-cp' END AS capacity_providers,
       CASE o.o_orderkey % 3 WHEN 0 THEN 'Environment' WHEN 1 THEN 'stage' ELSE 'owner' END AS env_key,
       CASE o.o_orderkey % 5 WHEN 0 THEN 'dev' WHEN 1 THEN 'prod' WHEN 2 THEN ' Staging ' WHEN 3 THEN 'qa' END AS env_value
FROM {orders} o
"""

# Savings plans: one commitment per pending order (USD per hour).
SAVINGS_PLANS_SQL = """
SELECT 'tenant-' || CAST(o.o_orderkey % 3 AS STRING) AS tenant_id,
       CAST(100000000000 + o.o_custkey % 7 AS STRING) AS account_id,
       'us-east-1' AS region,
       'sp-' || CAST(o.o_orderkey AS STRING) AS plan_id,
       CAST(o.o_orderkey % 7 AS DECIMAL(18,4)) * CAST(0.35 AS DECIMAL(18,4)) AS commitment,
       CASE WHEN o.o_orderstatus = 'P' THEN 'active' ELSE 'retired' END AS state
FROM {orders} o
"""

# Backup plans (one per supplier, two rules each), selections (from line items),
# recovery points (one per order).
BACKUP_PLANS_SQL = """
SELECT 'tenant-' || CAST(s.s_suppkey % 3 AS STRING) AS tenant_id,
       CAST(100000000000 + s.s_suppkey % 7 AS STRING) AS account_id,
       'eu-west-1' AS region,
       'plan-' || CAST(s.s_suppkey AS STRING) AS plan_id,
       CASE WHEN s.s_suppkey % 3 = 0 THEN NULL ELSE 30 END AS r1_move_days,
       CASE WHEN s.s_suppkey % 4 = 0 THEN 0 WHEN s.s_suppkey % 4 = 1 THEN NULL ELSE 365 END AS r1_delete_days,
       CASE WHEN s.s_suppkey % 5 = 0 THEN 0 END AS r2_move_days,
       CASE WHEN s.s_suppkey % 2 = 0 THEN 35 END AS r2_delete_days
FROM {supplier} s
"""

BACKUP_SELECTIONS_SQL = """
SELECT DISTINCT CASE WHEN l.l_partkey % 5 = 0 AND l.l_suppkey % 3 <> 1 THEN 'plan-' ELSE 'other-plan-' END || CAST(l.l_suppkey AS STRING) AS plan_id
FROM {lineitem} l
"""

RECOVERY_POINTS_SQL = """
SELECT 'tenant-' || CAST(o.o_custkey % 3 AS STRING) AS tenant_id,
       CAST(100000000000 + o.o_custkey % 7 AS STRING) AS account_id,
       'eu-west-1' AS region,
       'rp-' || CAST(o.o_orderkey AS STRING) AS recovery_point_arn,
       'vault-' || CAST(o.o_custkey AS STRING) AS vault_name,
       CAST(o.o_orderdate AS TIMESTAMP) AS created,
       CASE o.o_orderkey % 10 WHEN 0 THEN 'DELETED' WHEN 1 THEN 'expired' ELSE 'COMPLETED' END AS status,
       CASE WHEN o.o_orderkey % 3 = 0 THEN NULL ELSE CAST(o.o_orderdate AS TIMESTAMP) + INTERVAL 1 DAY * (o.o_orderkey % 2000) END AS delete_at,
       CAST(CAST(o.o_totalprice AS DECIMAL(18,2)) * CAST(0.001 AS DECIMAL(4,3)) AS DECIMAL(18,2)) AS size_gb,
       CASE WHEN o.o_orderkey % 4 = 0 THEN 'COLD' ELSE 'WARM' END AS storage_class,
       CASE WHEN o.o_custkey % 19 = 0 THEN 'true' END AS tag_retain,
       CASE WHEN o.o_custkey % 17 = 0 THEN 'case-7' END AS tag_legal_hold,
       CASE WHEN o.o_custkey % 13 = 0 THEN 'x' END AS tag_lifecycle
FROM {orders} o
"""

# EC2 instances (one per part) with one attached volume (the part's volume).
EC2_SQL = """
SELECT 'tenant-' || CAST(p.p_partkey % 3 AS STRING) AS tenant_id,
       CAST(100000000000 + p.p_partkey % 7 AS STRING) AS account_id,
       g.region AS region,
       'i-' || CAST(p.p_partkey AS STRING) AS instance_id,
       CASE p.p_size % 6 WHEN 0 THEN 't2.micro' WHEN 1 THEN 'm5.large' WHEN 2 THEN 'm3.medium' WHEN 3 THEN 'c3.large'
            WHEN 4 THEN 'x1e.xlarge' ELSE 'c5.large' END AS instance_type,
       CASE WHEN p.p_partkey % 3 = 0 THEN 'stopped' ELSE 'running' END AS state,
       CASE p.p_partkey % 4 WHEN 0 THEN ''
            WHEN 1 THEN 'User initiated (' || CAST(CAST(TIMESTAMP '2023-01-01 00:00:00' + INTERVAL 1 DAY * (p.p_partkey % 360) AS DATE) AS STRING) || ')'
            WHEN 2 THEN 'User initiated (' || CAST(CAST(TIMESTAMP '2023-01-01 00:00:00' + INTERVAL 1 DAY * (p.p_partkey % 360) AS DATE) AS STRING) || ' 10:30:00)'
            ELSE 'Server.SpotInstanceTermination' END AS state_reason,
       TIMESTAMP '2023-06-01 00:00:00' + INTERVAL 1 DAY * (p.p_partkey % 200) AS launch_time,
       CASE p.p_partkey % 5 WHEN 0 THEN 'optional' WHEN 1 THEN NULL ELSE 'required' END AS http_tokens,
       'vol-' || CAST(p.p_partkey AS STRING) AS volume_id
FROM {part} p
JOIN (VALUES (0, 'us-east-1'), (1, 'us-west-2'), (2, 'eu-west-1'), (3, 'eu-central-1'), (4, 'ap-southeast-2')) AS g(idx, region)
  ON g.idx = p.p_partkey % 5
"""

# Load balancers (one per supplier), listeners (one per order), target groups (per part
# residue) and registered targets (from line items).
LBS_SQL = """
SELECT 'tenant-' || CAST(s.s_suppkey % 3 AS STRING) AS tenant_id,
       CAST(100000000000 + s.s_suppkey % 7 AS STRING) AS account_id,
       'us-east-1' AS region,
       'lb-' || CAST(s.s_suppkey AS STRING) AS lb_name,
       CASE WHEN s.s_suppkey % 3 = 0 THEN 'network' ELSE 'application' END AS lb_type,
       CASE WHEN s.s_suppkey % 13 = 0 THEN NULL ELSE TIMESTAMP '2023-12-01 00:00:00' + INTERVAL 1 DAY * (s.s_suppkey % 62) END AS created,
       CASE WHEN s.s_suppkey % 23 = 0 THEN 'true' END AS tag_keep
FROM {supplier} s
"""

LISTENERS_SQL = """
SELECT DISTINCT 'tenant-' || CAST(o.o_custkey % 3 AS STRING) AS tenant_id,
       CAST(100000000000 + o.o_custkey % 7 AS STRING) AS account_id,
       'us-east-1' AS region,
       CASE WHEN o.o_custkey % 9 = 4 THEN 'retired-lb-' ELSE 'lb-' END || CAST(o.o_custkey AS STRING) AS lb_name,
       CASE WHEN o.o_orderkey % 4 = 0 THEN 'fixed-response' ELSE 'forward' END AS action_type,
       'tg-' || CAST(o.o_custkey AS STRING) AS target_group
FROM {orders} o
"""

TARGET_GROUPS_SQL = """
SELECT 'tenant-' || CAST(p.p_partkey % 3 AS STRING) AS tenant_id,
       CAST(100000000000 + p.p_partkey % 7 AS STRING) AS account_id,
       'us-east-1' AS region,
       'tg-' || CAST(p.p_partkey AS STRING) AS target_group,
       CASE WHEN p.p_partkey % 10 = 0 THEN 'lambda' ELSE 'instance' END AS target_type
FROM {part} p
"""

TARGETS_SQL = """
SELECT DISTINCT 'tenant-' || CAST(l.l_partkey % 3 AS STRING) AS tenant_id,
       CAST(100000000000 + l.l_partkey % 7 AS STRING) AS account_id,
       'us-east-1' AS region,
       CASE WHEN l.l_partkey % 3 <> 0 THEN 'tg-' ELSE 'other-tg-' END || CAST(l.l_partkey AS STRING) AS target_group,
       'i-' || CAST(l.l_orderkey AS STRING) AS target_id,
       CASE WHEN l.l_partkey % 5 = 0 THEN 'unhealthy' WHEN l.l_returnflag = 'A' THEN 'healthy' WHEN l.l_returnflag = 'N' THEN 'unhealthy' ELSE 'draining' END AS health
FROM {lineitem} l
"""

# CloudFront distributions (one per customer); requests come from the user's view events.
DISTRIBUTIONS_SQL = """
SELECT 'tenant-' || CAST(c.c_custkey % 3 AS STRING) AS tenant_id,
       CAST(100000000000 + c.c_custkey % 7 AS STRING) AS account_id,
       'global' AS region,
       'dist-' || CAST(c.c_custkey AS STRING) AS distribution_id,
       c.c_custkey % 9 <> 0 AS enabled,
       TIMESTAMP '2023-12-01 00:00:00' + INTERVAL 1 DAY * (c.c_custkey % 60) AS created,
       CASE c.c_custkey % 5 WHEN 0 THEN '413f160f-4f18-4c0b-95c7-bf7f44e8f58b' WHEN 1 THEN 'custom-policy' ELSE '' END AS cache_policy_id,
       CASE WHEN c.c_custkey % 4 = 0 THEN 0 WHEN c.c_custkey % 4 = 1 THEN 0 END AS min_ttl,
       CASE WHEN c.c_custkey % 4 = 0 THEN 0 WHEN c.c_custkey % 4 = 1 THEN 86400 END AS default_ttl,
       CASE WHEN c.c_custkey % 4 = 0 THEN 0 WHEN c.c_custkey % 4 = 1 THEN 31536000 END AS max_ttl
FROM {customer} c
"""

# Run state events (start + outcome per run; the newest year is still running) and live
# run locks (held by one tenant).
RUN_EVENTS_SQL = """
SELECT DISTINCT 'tenant-' || CAST(o.o_custkey % 3 AS STRING) AS tenant_id,
       'prod' AS workspace,
       'run-' || CAST(year(o.o_orderdate) AS STRING) AS run_id,
       CASE WHEN o.o_orderkey % 2 = 0 THEN 'running'
            WHEN year(o.o_orderdate) % 7 = 0 THEN 'failed'
            WHEN year(o.o_orderdate) = 2001 THEN 'running' ELSE 'ready' END AS status,
       CAST(date_trunc('year', o.o_orderdate) AS TIMESTAMP) + INTERVAL 1 HOUR * (o.o_orderkey % 2) AS event_ts
FROM {orders} o
"""

RUN_LOCKS_SQL = """
SELECT DISTINCT 'tenant-' || CAST(o.o_custkey % 3 AS STRING) AS tenant_id, 'prod' AS workspace,
       CASE WHEN o.o_custkey % 3 = 0 THEN 'run-' ELSE 'ended-run-' END || CAST(year(o.o_orderdate) AS STRING) AS run_id
FROM {orders} o
"""

# Teams (per tenant and supplier nation) and members (customers by nation).
TEAMS_SQL = """
SELECT DISTINCT 'tenant-' || CAST(s.s_suppkey % 3 AS STRING) AS tenant_id, 'team-' || CAST(s.s_nationkey AS STRING) AS team_id
FROM {supplier} s
"""

TEAM_MEMBERS_SQL = """
SELECT 'tenant-' || CAST(c.c_custkey % 3 AS STRING) AS tenant_id, 'team-' || CAST(c.c_nationkey % 20 AS STRING) AS team_id,
       'user-' || CAST(c.c_custkey AS STRING) AS user_id
FROM {customer} c
"""

BINDINGS = {
    "findings_flat": (FINDINGS_SQL, ("lineitem", "orders", "part")),
    "cost_facts": (COST_FACTS_SQL, ("lineitem", "orders")),
    "raw_cur": (RAW_CUR_REGION_SQL, ("lineitem", "orders")),
    "raw_cur_az": (RAW_CUR_AZ_SQL, ("lineitem", "orders")),
    "metrics": (METRICS_SQL, ("events",)),
    "runs": (RUNS_SQL, ("orders",)),
    "state_events": (STATE_EVENTS_SQL, ("lineitem", "orders")),
    "extensions": (EXTENSIONS_SQL, ("lineitem", "orders")),
    "assignments": (ASSIGNMENTS_SQL, ("lineitem", "orders")),
    "actions": (ACTIONS_SQL, ("orders", "lineitem")),
    "volumes": (VOLUMES_SQL, ("part",)),
    "nats": (NATS_SQL, ("events",)),
    "routes": (ROUTES_SQL, ("orders",)),
    "subnets": (SUBNETS_SQL, ("customer",)),
    "alarms": (ALARMS_SQL, ("events",)),
    "instances": (INSTANCES_SQL, ("lineitem",)),
    "reservations": (RESERVATIONS_SQL, ("orders",)),
    "dbs": (DBS_SQL, ("customer",)),
    "eks_nodegroups": (EKS_NODEGROUPS_SQL, ("orders",)),
    "efs": (EFS_SQL, ("customer",)),
    "fsx": (FSX_SQL, ("customer",)),
    "vaults": (VAULTS_SQL, ("customer",)),
    "bucket_gauges": (BUCKET_GAUGES_SQL, ("lineitem",)),
    "rds_snapshots": (RDS_SNAPSHOTS_SQL, ("orders",)),
    "buckets": (BUCKETS_SQL, ("part",)),
    "eks": (EKS_SQL, ("supplier",)),
    "sgs": (SGS_SQL, ("supplier",)),
    "enis": (ENIS_SQL, ("lineitem",)),
    "snapshots": (SNAPSHOTS_SQL, ("orders",)),
    "images": (IMAGES_SQL, ("lineitem",)),
    "log_groups": (LOG_GROUPS_SQL, ("part",)),
    "metric_filters": (METRIC_FILTERS_SQL, ("lineitem",)),
    "ecs_clusters": (ECS_CLUSTERS_SQL, ("supplier",)),
    "ecs_services": (ECS_SERVICES_SQL, ("orders",)),
    "savings_plans": (SAVINGS_PLANS_SQL, ("orders",)),
    "backup_plans": (BACKUP_PLANS_SQL, ("supplier",)),
    "backup_selections": (BACKUP_SELECTIONS_SQL, ("lineitem",)),
    "recovery_points": (RECOVERY_POINTS_SQL, ("orders",)),
    "ec2": (EC2_SQL, ("part",)),
    "lbs": (LBS_SQL, ("supplier",)),
    "listeners": (LISTENERS_SQL, ("orders",)),
    "target_groups": (TARGET_GROUPS_SQL, ("part",)),
    "targets": (TARGETS_SQL, ("lineitem",)),
    "distributions": (DISTRIBUTIONS_SQL, ("customer",)),
    "run_events": (RUN_EVENTS_SQL, ("orders",)),
    "run_locks": (RUN_LOCKS_SQL, ("orders",)),
    "teams": (TEAMS_SQL, ("supplier",)),
    "team_members": (TEAM_MEMBERS_SQL, ("customer",)),
}


#: the tenant that owns resources of the same names as another one's
TWIN = "tenant-twin"


def twins(df: DataFrame, where: str = "true", **changed: Column) -> DataFrame:
    """``df`` and a copy of (some of) it in another tenant, with some columns changed."""
    return df.unionByName(df.where(where).withColumns({"tenant_id": F.lit(TWIN), **changed}).select(df.columns))


def twins_cte(name: str, replace: str = "", where: str = "true") -> str:
    """The same for DuckDB: a CTE ``<name>_all`` over ``name``."""
    more = f", {replace}" if replace else ""
    return f"{name}_all AS (SELECT * FROM {name} UNION ALL SELECT * REPLACE ('{TWIN}' AS tenant_id{more}) FROM {name} WHERE {where})"


def bound(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Run a binding in Spark with the source tables passed as DataFrames."""
    text, sources = BINDINGS[name]
    return spark.sql(text, **{s: table(spark, sf_dir, s) for s in sources})


def gathered_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of ``findings_flat`` dealt by tenant and run time, as the findings writer deals
    findings. They move before they get the names made of their other columns, and are narrow."""
    base = spark.sql(_FINDINGS_BASE_SQL, **{s: table(spark, sf_dir, s) for s in BINDINGS["findings_flat"][1]})
    return spark.sql(_FINDINGS_NAMES_SQL + "{base} b", base=base.hint("rebalance", "tenant_id", "run_ts"))


def binding_cte(*names: str) -> str:
    """``WITH`` clause text for DuckDB (views carry the table names)."""
    parts = []
    for n in names:
        text, sources = BINDINGS[n]
        parts.append(f"{n} AS ({text.format(**{s: s for s in sources})})")
    return "WITH " + ",\n".join(parts)
