"""Registered detector queries (D7, D9/D10, D18-D20, D52-D55, D64, A15-A18) with DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.stats import percentile_floor, percentile_linear, percentile_nearest
from ..operators import detect as D
from ..sources.bind import bound, binding_cte, twins, twins_cte
from .inputs import metrics
from .registry import query

AS_OF_VOL = "2024-02-01 00:00:00"
AS_OF_METRICS = "2024-01-31 00:00:00"

# EBS storage price per region and volume type (USD per GB-month).
EBS_PRICES = [
    ("us-east-1", "gp2", "0.100000"), ("us-east-1", "gp3", "0.080000"), ("us-east-1", "io1", "0.125000"),
    ("us-west-2", "gp2", "0.100000"), ("us-west-2", "gp3", "0.080000"), ("us-west-2", "io1", "0.125000"),
    ("eu-west-1", "gp2", "0.110000"), ("eu-west-1", "gp3", "0.088000"), ("eu-west-1", "io1", "0.138000"),
    ("eu-central-1", "gp2", "0.119000"), ("eu-central-1", "gp3", "0.095200"), ("eu-central-1", "io1", "0.149000"),
    ("ap-southeast-2", "gp2", "0.120000"), ("ap-southeast-2", "gp3", "0.120000"), ("ap-southeast-2", "io1", "0.138000"),
]
PRICES_VALUES = "(VALUES " + ", ".join(f"('{r}', '{t}', CAST({p} AS DECIMAL(12,6)))" for r, t, p in EBS_PRICES) + ") AS pr(region, volume_type, price)"


# Prices of network, function and backup detectors: a region and key of their own, any key of the
# region, any region, one that has ended and one yet to come; other kinds have none.
LADDER_PRICES = [
    ("us-east-1", "nat", "hour", 0.048, None), ("global", "nat", "gb", 0.052, None), ("us-east-1", "nat", "gb", 0.0, None),
    ("us-east-1", "lambda", "default", 0.00001, "2020-01-01 00:00:00"), ("us-east-1", "lambda", "default", 0.000015, "2023-06-01 00:00:00"), ("us-east-1", "lambda", "default", 9.0, "2025-01-01 00:00:00"),
    ("us-east-1", "lb_hour", "network", 0.0252, None), ("global", "lb_hour", "default", 0.03, None),
    ("eu-west-1", "backup_gb_month", "cold", 0.012, None),
]


def _ladder_prices(spark) -> DataFrame:
    rows = [(r, k, key, p, since) for r, k, key, p, since in LADDER_PRICES]
    return spark.createDataFrame(rows, "region string, kind string, key string, unit_price double, effective_from string")


LADDER_VALUES = "(VALUES " + ", ".join(f"('{r}', '{k}', '{key}', CAST({p} AS DOUBLE), " + (f"TIMESTAMP '{s}'" if s else "CAST(NULL AS TIMESTAMP)") + ")" for r, k, key, p, s in LADDER_PRICES) + ") AS lp(region, kind, key, price, since)"


def _tag_map(*pairs: tuple[str, str]):
    entries = F.array(*[F.struct(F.lit(k).alias("key"), F.col(c).alias("value")) for k, c in pairs])
    return F.map_from_entries(F.filter(entries, lambda e: e["value"].isNotNull()))


def _volumes(spark, sf) -> DataFrame:
    v = bound(spark, sf, "volumes")
    return v.withColumn(
        "tags",
        _tag_map(
            ("keep", "tag_keep"),
            ("lifecycle", "tag_lifecycle"),
            ("Environment", "tag_environment"),
            ("Application", "tag_application"),
            ("ApplicationId", "tag_applicationid"),
        ),
    )


def _prices(spark):
    return spark.createDataFrame([(r, t, p) for r, t, p in EBS_PRICES], "region string, volume_type string, usd_per_gb_month string").withColumn(
        "usd_per_gb_month", F.col("usd_per_gb_month").cast("decimal(12,6)")
    )


_DRAFT_SELECT = """tenant_id, account_id, region, '{service}' AS service, '{rtype}' AS resource_type, {rid} AS resource_id,
       '{check}' AS check_id, {status} AS status, {lvl} AS severity_level, {score} AS severity_score,
       CAST({cost} AS DECIMAL(18,6)) AS monthly_cost, CAST({savings} AS DECIMAL(18,6)) AS monthly_savings,
       CAST({conf} AS INTEGER) AS confidence, {detail} AS detail"""


def _sel(**kw):
    kw.setdefault("status", "'fail'")
    kw.setdefault("cost", "NULL")
    kw.setdefault("savings", "NULL")
    kw.setdefault("conf", "NULL")
    return _DRAFT_SELECT.format(**kw)


EBS_CTE = (
    binding_cte("volumes")
    + f""",
pr AS (SELECT * FROM {PRICES_VALUES}),
g AS (SELECT region, max(CASE WHEN volume_type = 'gp2' THEN price END) AS p_gp2, max(CASE WHEN volume_type = 'gp3' THEN price END) AS p_gp3
      FROM pr GROUP BY region),
v AS (
  SELECT vol.*, pr.price, g.p_gp2, g.p_gp3, CAST(vol.size_gb AS DECIMAL(18,2)) AS size,
         CAST(floor((epoch_us(TIMESTAMP '{AS_OF_VOL}') - epoch_us(create_time)) / 86400e6) AS INTEGER) AS age
  FROM volumes vol LEFT JOIN pr USING (region, volume_type) LEFT JOIN g USING (region)
  WHERE tag_keep IS NULL AND tag_lifecycle IS NULL)
"""
)


@query(
    "d18_d20_ebs_volumes",
    oracle=EBS_CTE
    + "SELECT "
    + _sel(
        service="AmazonEC2",
        rtype="ebs_volume",
        rid="volume_id",
        check="aws.ec2.ebs.unattached.volume",
        lvl="CASE WHEN size * price < 50 THEN 'medium' ELSE 'high' END",
        score="CASE WHEN size * price < 50 THEN 700 ELSE 850 END",
        cost="size * price",
        savings="size * price",
        detail="volume_type || '|' || CAST(size_gb AS VARCHAR) || '|' || CAST(age AS VARCHAR)",
    )
    + f""" FROM v WHERE attachment_count = 0 AND lower(COALESCE(state, '')) IN ('available', '')
        AND epoch_us(TIMESTAMP '{AS_OF_VOL}') - epoch_us(create_time) >= 24 * 3600e6 AND age >= 7
UNION ALL SELECT """
    + _sel(
        service="AmazonEC2",
        rtype="ebs_volume",
        rid="volume_id",
        check="aws.ec2.ebs.gp2.to.gp3",
        lvl="'medium'",
        score="650",
        cost="size * p_gp2",
        savings="size * (p_gp2 - p_gp3)",
        detail="CAST(size_gb AS VARCHAR)",
    )
    + """ FROM v WHERE lower(volume_type) = 'gp2' AND p_gp2 > p_gp3
UNION ALL SELECT """
    + _sel(
        service="AmazonEC2",
        rtype="ebs_volume",
        rid="volume_id",
        check="aws.ec2.ebs.volume.unencrypted",
        lvl="'high'",
        score="900",
        detail="CASE WHEN encrypted IS NULL THEN 'unknown' ELSE 'false' END",
    )
    + " FROM v WHERE encrypted IS NOT TRUE",
)
def d18_d20(spark, sf):
    return D.ebs_volume_findings(_volumes(spark, sf), _prices(spark), AS_OF_VOL)


@query(
    "d7_instance_tags_missing",
    oracle=binding_cte("volumes")
    + """,
t AS (
  SELECT *, concat_ws(',',
           CASE WHEN COALESCE(trim(tag_applicationid), '') = '' THEN 'applicationid' END,
           CASE WHEN COALESCE(trim(tag_environment), '') = '' THEN 'environment' END,
           CASE WHEN COALESCE(trim(tag_application), '') = '' THEN 'application' END) AS miss
  FROM volumes)
SELECT """
    + _sel(service="AmazonEC2", rtype="instance", rid="instance_id", check="aws.ec2.instances.tags.missing", lvl="'low'", score="300", detail="miss")
    + " FROM t WHERE miss <> ''",
)
def d7(spark, sf):
    return D.instance_tag_findings(_volumes(spark, sf))


def _nats(spark, sf):
    return bound(spark, sf, "nats").withColumn("tags", _tag_map(("keep", "tag_keep")))


def _nat_metrics(spark, sf):
    m = metrics(spark, sf).withColumns({"region": F.lit("us-east-1"), "metric": F.lit("BytesOutToDestination")})
    busy = F.regexp_extract("resource_id", r"(\d+)$", 1).cast("long") % 5 == 0
    return m.withColumn("value", F.when(busy, F.col("value") * 1e6).otherwise(F.col("value")))


NAT_CTE = (
    binding_cte("nats", "routes", "subnets")
    + f""",
n AS (SELECT *, resource_id AS nat_id,
             CAST(floor((epoch_us(TIMESTAMP '{AS_OF_METRICS}') - epoch_us(create_time)) / 86400e6) AS INTEGER) AS age
      FROM nats WHERE tag_keep IS NULL),
ref AS (SELECT DISTINCT nat_gateway_id AS nat_id FROM routes),
live AS (SELECT * FROM n WHERE nat_id IN (SELECT nat_id FROM ref) OR state = 'deleting'),
cross_az AS (
  SELECT l.nat_id, count(DISTINCT r.subnet_id) AS cross_subnets
  FROM live l JOIN (SELECT DISTINCT nat_gateway_id, subnet_id FROM routes WHERE NOT has_igw_default) r ON r.nat_gateway_id = l.nat_id
  JOIN subnets s ON s.subnet_id = r.subnet_id
  WHERE s.az <> l.az GROUP BY l.nat_id),
daily AS (
  SELECT 'r-' || CAST(user_id AS VARCHAR) AS nat_id, CAST(ts AS DATE) AS day, sum(value * CASE WHEN user_id % 5 = 0 THEN 1e6 ELSE 1 END) * 5000.0 AS value
  FROM events WHERE ts >= TIMESTAMP '{AS_OF_METRICS}' - INTERVAL 14 DAY AND ts < TIMESTAMP '{AS_OF_METRICS}'
  GROUP BY ALL),
st AS (
  SELECT nat_id, count(*) AS points, sum(value) AS total,
         list_sort(list(value))[CAST(floor((count(*) - 1) * 0.95) AS BIGINT) + 1] AS p95
  FROM daily GROUP BY nat_id),
s AS (SELECT live.*, st.points, st.total, st.p95, st.total * (30.0 / st.points) / (1024.0 * 1024.0 * 1024.0) AS gib FROM live JOIN st USING (nat_id))
"""
)


@query(
    "d52_d55_nat_gateways",
    oracle=NAT_CTE
    + "SELECT "
    + _sel(service="AmazonVPC", rtype="nat_gateway", rid="nat_id", check="aws.ec2.nat.gateways.orphaned", lvl="'medium'", score="600",
           cost="35.04", savings="35.04", conf="90", detail="COALESCE(CAST(age AS VARCHAR), 'unknown')")
    + " FROM n WHERE nat_id NOT IN (SELECT nat_id FROM ref) AND state <> 'deleting' AND (create_time IS NULL OR age >= 1) UNION ALL SELECT "
    + _sel(service="AmazonVPC", rtype="nat_gateway", rid="nat_id", check="aws.ec2.nat.gateways.cross.az", lvl="'low'", score="350",
           detail="CAST(cross_subnets AS VARCHAR)")
    + " FROM live JOIN cross_az USING (nat_id) UNION ALL SELECT "
    + _sel(service="AmazonVPC", rtype="nat_gateway", rid="nat_id", check="aws.ec2.nat.gateways.idle", lvl="'medium'", score="500",
           cost="35.04", savings="35.04", conf="90", detail="printf('%.6f', p95)")
    + " FROM s WHERE points >= 7 AND p95 < 1048576.0 UNION ALL SELECT "
    + _sel(service="AmazonVPC", rtype="nat_gateway", rid="nat_id", check="aws.ec2.nat.gateways.high.data.processing", lvl="'medium'",
           score="550", cost="CAST(gib * 0.052 AS DECIMAL(18,6)) + 35.04", conf="60", detail="printf('%.6f', gib)")
    + " FROM s WHERE gib >= 100.0",
)
def d52_d55(spark, sf):
    return D.nat_findings(
        _nats(spark, sf), bound(spark, sf, "routes"), bound(spark, sf, "subnets"), _nat_metrics(spark, sf), AS_OF_METRICS, bytes_scale=5000.0, prices=_ladder_prices(spark)
    )


def _lambda_metrics(spark, sf):
    # the twin tenant's functions are never invoked
    m = twins(metrics(spark, sf).withColumn("region", F.lit("us-east-1")), value=F.lit(0.0))
    inv = m.where(F.col("metric").isin("click", "view", "signup")).withColumn("metric", F.lit("Invocations"))
    dur = m.where(F.col("metric").isin("purchase", "error")).withColumn("metric", F.lit("Duration"))
    return inv.unionByName(dur)


LAMBDA_CTE = (
    binding_cte("nats")
    + f""",
{twins_cte("nats")},
ev AS (SELECT 'tenant-' || CAST(user_id % 3 AS VARCHAR) AS tenant_id, 'r-' || CAST(user_id AS VARCHAR) AS resource_id, event_type, ts, value FROM events
       WHERE ts >= TIMESTAMP '{AS_OF_METRICS}' - INTERVAL 14 DAY AND ts < TIMESTAMP '{AS_OF_METRICS}'),
{twins_cte("ev", "0.0::DOUBLE AS value")},
inv_d AS (SELECT tenant_id, resource_id, CAST(ts AS DATE) AS day, sum(value) AS value FROM ev_all WHERE event_type IN ('click', 'view', 'signup') GROUP BY ALL),
dur_d AS (SELECT tenant_id, resource_id, CAST(ts AS DATE) AS day, avg(value) AS value FROM ev_all WHERE event_type IN ('purchase', 'error') GROUP BY ALL),
inv AS (SELECT tenant_id, resource_id, count(*) AS inv_points, sum(value) AS inv_total,
               list_sort(list(value))[CAST(floor((count(*) - 1) * 0.95) AS BIGINT) + 1] AS inv_p95 FROM inv_d GROUP BY ALL),
dur AS (SELECT tenant_id, resource_id, count(*) AS dur_points,
               list_sort(list(value))[CAST(floor((count(*) - 1) * 0.95) AS BIGINT) + 1] AS dur_p95 FROM dur_d GROUP BY ALL),
f AS (
  SELECT n.*, inv.inv_points, inv.inv_total, inv.inv_p95, dur.dur_points, dur.dur_p95,
         COALESCE(inv.inv_points, 0) >= 7 AND inv.inv_p95 <= 1.0 AS unused
  FROM nats_all n LEFT JOIN inv USING (tenant_id, resource_id) LEFT JOIN dur USING (tenant_id, resource_id)),
o AS (
  SELECT *, inv_total / greatest(inv_points, 1) * 30.0 AS monthly_inv, memory_mb / 1024.0 AS gb FROM f
  WHERE NOT COALESCE(unused, false) AND COALESCE(inv_points, 0) >= 7 AND COALESCE(dur_points, 0) >= 7 AND memory_mb >= 1024
    AND dur_p95 > 0 AND dur_p95 <= 250.0 AND (timeout_s <= 0 OR (dur_p95 / 1000.0) / timeout_s <= 0.2) AND inv_total >= 100)
"""
)


@query(
    "d9_d10_lambda",
    oracle=LAMBDA_CTE
    + "SELECT "
    + _sel(service="AWSLambda", rtype="function", rid="resource_id", check="aws.lambda.functions.unused", lvl="'low'", score="320",
           conf="20", detail="printf('%.6f', inv_p95)")
    + " FROM f WHERE unused UNION ALL SELECT "
    + _sel(
        service="AWSLambda",
        rtype="function",
        rid="resource_id",
        check="aws.lambda.functions.memory.overprovisioned",
        lvl="'medium'",
        score="560",
        cost="round(monthly_inv * (dur_p95 / 1000.0) * gb * 0.000015::DOUBLE, 6)",
        savings="round(greatest(monthly_inv * (dur_p95 / 1000.0) * gb * 0.000015::DOUBLE - monthly_inv * (dur_p95 * 1.2 / 1000.0) * (gb * 0.5) * 0.000015::DOUBLE, 0.0), 6)",
        conf="55",
        detail="printf('%.6f', dur_p95)",
    )
    + " FROM o",
)
def d9_d10(spark, sf):
    return D.lambda_findings(twins(_nats(spark, sf).drop("tags")), _lambda_metrics(spark, sf), AS_OF_METRICS, prices=_ladder_prices(spark))


@query(
    "d64_alarms_high_count",
    oracle=binding_cte("alarms")
    + "SELECT "
    + _sel(service="AmazonCloudWatch", rtype="account", rid="account_id", check="aws.cloudwatch.alarms.high.count", status="'info'",
           lvl="'low'", score="200", cost="count(*) * 0.10", savings="count(*) * 0.10", detail="CAST(count(*) AS VARCHAR)")
    + " FROM alarms GROUP BY tenant_id, account_id, region HAVING count(*) >= 100",
)
def d64(spark, sf):
    return D.alarms_high_count(bound(spark, sf, "alarms"))


@query(
    "a15_a18_metric_reductions",
    oracle="""
WITH d AS (SELECT 'r-' || CAST(user_id AS VARCHAR) AS resource_id, event_type AS metric, CAST(ts AS DATE) AS day, sum(value) AS value
           FROM events GROUP BY ALL)
SELECT resource_id, metric, count(*) AS points, round(avg(value), 6) AS avg_value, round(sum(value), 6) AS sum_value,
       min(value) AS min_value, max(value) AS max_value,
       list_sort(list(value))[CAST(floor((count(*) - 1) * 0.95) AS BIGINT) + 1] AS p95_floor,
       list_sort(list(value))[CAST(round_even((count(*) - 1) * 0.95, 0) AS BIGINT) + 1] AS p95_nearest,
       round(quantile_cont(value, 0.95), 6) AS p95_linear
FROM d GROUP BY ALL
""",
)
def a15_a18(spark, sf):
    m = metrics(spark, sf)
    d = m.groupBy("resource_id", "metric", F.to_date("ts").alias("day")).agg(F.sum("value").alias("value"))
    return d.groupBy("resource_id", "metric").agg(
        F.count(F.lit(1)).alias("points"),
        F.round(F.avg("value"), 6).alias("avg_value"),
        F.round(F.sum("value"), 6).alias("sum_value"),
        F.min("value").alias("min_value"),
        F.max("value").alias("max_value"),
        percentile_floor(F.col("value"), 0.95).alias("p95_floor"),
        percentile_nearest(F.col("value"), 0.95).alias("p95_nearest"),
        F.round(percentile_linear(F.col("value"), 0.95), 6).alias("p95_linear"),
    )


# On-demand monthly price per instance type (USD).
ON_DEMAND = [("m5.large", "70.0800"), ("m5.xlarge", "140.1600"), ("c5.large", "62.0500"), ("t3.micro", "7.5920")]

_RI_BASE = "tenant_id, account_id, region, instance_type, platform, tenancy"
_PLATFORM = (
    "CASE WHEN lower(trim(COALESCE({c}, ''))) = '' THEN 'linux' WHEN contains(lower({c}), 'windows') THEN 'windows' "
    "WHEN contains(lower({c}), 'red hat') OR contains(lower({c}), 'rhel') THEN 'rhel' WHEN contains(lower({c}), 'suse') THEN 'suse' ELSE 'linux' END"
)
_TENANCY = "CASE WHEN lower(trim(COALESCE({c}, ''))) IN ('dedicated', 'host') THEN lower(trim({c})) ELSE 'default' END"

RI_CTE = (
    binding_cte("instances", "reservations")
    + f""",
od AS (SELECT instance_type, CAST(monthly_usd AS DECIMAL(18,4)) AS od FROM (VALUES {", ".join(f"('{t}', '{p}')" for t, p in ON_DEMAND)}) t(instance_type, monthly_usd)),
inst AS (
  SELECT tenant_id, account_id, region, lower(trim(instance_type)) AS instance_type, {_PLATFORM.format(c='platform')} AS platform,
         {_TENANCY.format(c='tenancy')} AS tenancy, COALESCE(NULLIF(lower(trim(az)), ''), 'unknown') AS az
  FROM instances WHERE state = 'running' AND lower(trim(instance_type)) <> ''),
run_az AS (SELECT {_RI_BASE}, az, count(*) AS running FROM inst GROUP BY ALL),
res AS (
  SELECT tenant_id, account_id, region, lower(trim(instance_type)) AS instance_type, {_PLATFORM.format(c='product_description')} AS platform,
         {_TENANCY.format(c='instance_tenancy')} AS tenancy, lower(trim(COALESCE(scope, ''))) AS scope, lower(trim(COALESCE(az, ''))) AS az,
         CAST(instance_count AS BIGINT) AS cnt
  FROM reservations WHERE state = 'active' AND lower(trim(instance_type)) <> '' AND instance_count > 0),
res_az AS (SELECT {_RI_BASE}, az, sum(cnt) AS reserved FROM res WHERE contains(scope, 'availability') AND az <> '' GROUP BY ALL),
res_reg AS (SELECT {_RI_BASE}, sum(cnt) AS regional FROM res WHERE NOT (contains(scope, 'availability') AND az <> '') GROUP BY ALL),
azj AS (SELECT {_RI_BASE}, az, COALESCE(running, 0) AS running, COALESCE(reserved, 0) AS reserved
        FROM run_az FULL JOIN res_az USING ({_RI_BASE}, az)),
base AS (SELECT {_RI_BASE}, sum(running) AS running_count, sum(reserved) AS reserved_az, sum(least(running, reserved)) AS used_az,
                sum(running - least(running, reserved)) AS remaining FROM azj GROUP BY ALL),
b0 AS (SELECT {_RI_BASE}, COALESCE(running_count, 0) AS running_count, COALESCE(reserved_az, 0) AS reserved_az, COALESCE(used_az, 0) AS used_az,
              COALESCE(remaining, 0) AS remaining, COALESCE(regional, 0) AS regional
       FROM base FULL JOIN res_reg USING ({_RI_BASE})),
b1 AS (SELECT *, used_az + least(remaining, regional) AS used, reserved_az + regional AS reserved_count FROM b0),
b AS (SELECT b1.*, greatest(0, running_count - used) AS uncovered, greatest(0, reserved_count - used) AS unused,
             CASE WHEN reserved_count > 0 THEN used * 100.0 / reserved_count ELSE 100.0 END AS utilization, od.od,
             concat_ws('|', instance_type, platform, tenancy, CAST(running_count AS VARCHAR), CAST(reserved_count AS VARCHAR), CAST(used AS VARCHAR)) AS rid
      FROM b1 LEFT JOIN od USING (instance_type))
"""
)


@query(
    "d_ri1_ri2_reserved_instances",
    oracle=RI_CTE
    + "SELECT "
    + _sel(service="AmazonEC2", rtype="reserved_instance_pool", rid="rid", check="aws.ec2.ri.coverage.gap",
           lvl="CASE WHEN uncovered >= 5 THEN 'high' ELSE 'medium' END", score="CASE WHEN uncovered >= 5 THEN 700 ELSE 560 END",
           cost="CASE WHEN od > 0 THEN uncovered * od END", savings="CASE WHEN od > 0 THEN round(uncovered * od * 0.30, 2) END",
           detail="CAST(uncovered AS VARCHAR)")
    + " FROM b WHERE uncovered >= 1 UNION ALL SELECT "
    + _sel(service="AmazonEC2", rtype="reserved_instance_pool", rid="rid", check="aws.ec2.ri.utilization.low",
           lvl="CASE WHEN utilization < 50.0 THEN 'high' ELSE 'medium' END", score="CASE WHEN utilization < 50.0 THEN 680 ELSE 540 END",
           cost="CASE WHEN od > 0 THEN round(unused * od * 0.70, 2) END", detail="CAST(unused AS VARCHAR)")
    + " FROM b WHERE reserved_count > 0 AND unused > 0 AND utilization < 80.0",
)
def d_ri(spark, sf):
    od = spark.createDataFrame(ON_DEMAND, "instance_type string, monthly_usd string")
    return D.reserved_instance_findings(bound(spark, sf, "instances"), bound(spark, sf, "reservations"), od)


RDS_CTE = (
    binding_cte("dbs")
    + r""",
d AS (
  SELECT *, CASE WHEN starts_with(COALESCE(instance_class, ''), 'db.') AND len(string_split(instance_class, '.')) >= 3
                 THEN string_split(instance_class, '.')[2] ELSE '' END AS family,
         lower(trim(COALESCE(engine, ''))) AS eng, trim(COALESCE(engine_version, '')) AS ver
  FROM dbs),
v AS (
  SELECT *, TRY_CAST(NULLIF(regexp_extract(trim(string_split(ver, '.')[1]), '^(\d+)', 1), '') AS INTEGER) AS ma0,
            TRY_CAST(NULLIF(regexp_extract(trim(COALESCE(string_split(ver, '.')[2], '0')), '^(\d+)', 1), '') AS INTEGER) AS mi0
  FROM d),
w AS (SELECT *, CASE WHEN ma0 IS NOT NULL AND mi0 IS NOT NULL THEN ma0 END AS ma, CASE WHEN ma0 IS NOT NULL AND mi0 IS NOT NULL THEN mi0 END AS mi FROM v)
"""
)


@query(
    "d39_d42_d43_rds_config",
    oracle=RDS_CTE
    + "SELECT "
    + _sel(service="AmazonRDS", rtype="db_instance", rid="db_instance_id", check="aws.rds.instances.stopped.storage", lvl="'medium'",
           score="500", cost="CAST(allocated_gb AS DECIMAL(18,2)) * CAST(0.115 AS DECIMAL(12,6))",
           savings="CAST(allocated_gb AS DECIMAL(18,2)) * CAST(0.115 AS DECIMAL(12,6))", detail="CAST(allocated_gb AS VARCHAR)")
    + " FROM w WHERE lower(status) = 'stopped' AND allocated_gb > 0 UNION ALL SELECT "
    + _sel(service="AmazonRDS", rtype="db_instance", rid="db_instance_id", check="aws.rds.instance.family.old.generation", lvl="'low'",
           score="320", detail="family")
    + " FROM w WHERE family IN ('m1', 'm2', 'm3', 'm4', 'r3', 'r4', 't1', 't2', 'x1') UNION ALL SELECT "
    + _sel(service="AmazonRDS", rtype="db_instance", rid="db_instance_id", check="aws.rds.engine.needs.upgrade", lvl="'high'",
           score="750", detail="concat_ws(' ', eng, ver)")
    + """ FROM w WHERE CASE WHEN contains(eng, 'mysql') THEN ver <> '' AND (starts_with(ver, '5.6') OR starts_with(ver, '5.7'))
                       WHEN contains(eng, 'postgres') THEN COALESCE(ma < 12 OR (ma = 12 AND mi < 0), false)
                       WHEN contains(eng, 'mariadb') THEN COALESCE(ma < 10 OR (ma = 10 AND mi < 6), false) ELSE false END""",
)
def d39_d43(spark, sf):
    return D.rds_config_findings(bound(spark, sf, "dbs"))


_S3_PAB = (
    "CASE WHEN pab_error THEN 'unknown' WHEN NOT pab_configured THEN 'missing' "
    "WHEN COALESCE(block_public_acls, false) AND COALESCE(ignore_public_acls, false) AND COALESCE(block_public_policy, false) "
    "AND COALESCE(restrict_public_buckets, false) THEN 'present' ELSE 'missing' END"
)


def _s3_part(check, state, lvl, score):
    return (
        "SELECT "
        + _sel(service="AmazonS3", rtype="bucket", rid="bucket_name", check=check,
               status=f"CASE WHEN lower({state}) = 'missing' THEN 'fail' ELSE 'info' END",
               lvl=f"CASE WHEN lower({state}) = 'missing' THEN '{lvl}' ELSE 'low' END",
               score=f"CASE WHEN lower({state}) = 'missing' THEN {score} ELSE 10 END", detail=f"lower({state})")
        + f" FROM b WHERE lower({state}) IN ('missing', 'unknown')"
    )


@query(
    "d35_d37_s3_governance",
    oracle=binding_cte("buckets")
    + f", b AS (SELECT *, {_S3_PAB} AS pab_state FROM buckets) "
    + " UNION ALL ".join(
        [
            _s3_part("aws.s3.governance.lifecycle.missing", "lifecycle_state", "medium", 50),
            _s3_part("aws.s3.governance.encryption.missing", "encryption_state", "high", 80),
            _s3_part("aws.s3.governance.public.access.block.missing", "pab_state", "high", 85),
        ]
    ),
)
def d35_d37(spark, sf):
    return D.s3_governance_findings(bound(spark, sf, "buckets"))


@query(
    "d14_d16_eks_clusters",
    oracle=binding_cte("eks")
    + r""",
e AS (
  SELECT *, len(list_filter(string_split(log_types, ','), lambda x: trim(x) <> '')) AS n_logs,
         TRY_CAST(NULLIF(regexp_extract(trim(string_split(trim(version), '.')[1]), '^(\d+)', 1), '') AS INTEGER) AS ma,
         TRY_CAST(NULLIF(regexp_extract(trim(COALESCE(string_split(trim(version), '.')[2], '0')), '^(\d+)', 1), '') AS INTEGER) AS mi
  FROM eks)
SELECT """
    + _sel(service="AmazonEKS", rtype="eks_cluster", rid="cluster_name", check="aws.eks.cluster.endpoint.public.only", lvl="'high'",
           score="820", detail="''")
    + " FROM e WHERE COALESCE(endpoint_public, false) AND NOT COALESCE(endpoint_private, false) UNION ALL SELECT "
    + _sel(service="AmazonEKS", rtype="eks_cluster", rid="cluster_name", check="aws.eks.cluster.controlplane.logging.disabled",
           lvl="'medium'", score="520", detail="''")
    + " FROM e WHERE n_logs = 0 UNION ALL SELECT "
    + _sel(service="AmazonEKS", rtype="eks_cluster", rid="cluster_name", check="aws.eks.cluster.version.outdated", lvl="'medium'",
           score="610", detail="trim(version)")
    + " FROM e WHERE ma IS NOT NULL AND mi IS NOT NULL AND (ma < 1 OR (ma = 1 AND mi < 28))",
)
def d14_d16(spark, sf):
    c = bound(spark, sf, "eks").withColumn("enabled_log_types", F.split("log_types", ","))
    return D.eks_findings(c)


def _sg_frames(spark, sf):
    sgs = bound(spark, sf, "sgs")
    perm = F.struct
    perms = F.array(
        perm(F.col("p1_proto").alias("proto"), F.col("p1_from").alias("from_port"), F.col("p1_to").alias("to_port"),
             F.array(F.col("p1_cidr")).alias("cidrs"), F.array_compact(F.array(F.col("p1_cidr6"))).alias("cidrs6")),
        perm(F.col("p2_proto").alias("proto"), F.col("p2_from").alias("from_port"), F.col("p2_to").alias("to_port"),
             F.array(F.col("p2_cidr")).alias("cidrs"), F.array_compact(F.array(F.col("p2_cidr6"))).alias("cidrs6")),
    )
    permissions = sgs.select("group_id", perms.alias("perms"))
    pairs = sgs.where(F.col("egress_ref_group").isNotNull()).select("group_id", F.col("egress_ref_group").alias("ref_group_id"))
    return sgs, permissions, pairs


SG_CTE = binding_cte("sgs", "enis") + """,
used AS (SELECT group_id FROM enis UNION SELECT group_id FROM sgs WHERE egress_ref_group IS NOT NULL
         UNION SELECT egress_ref_group FROM sgs WHERE egress_ref_group IS NOT NULL),
perm AS (SELECT group_id, p1_proto AS proto, p1_from AS from_port, p1_to AS to_port, p1_cidr AS cidr, p1_cidr6 AS cidr6 FROM sgs
         UNION ALL SELECT group_id, p2_proto, p2_from, p2_to, p2_cidr, p2_cidr6 FROM sgs),
exposed AS (SELECT DISTINCT group_id, port FROM perm, (VALUES (22), (3389)) AS ap(port)
            WHERE (cidr = '0.0.0.0/0' OR cidr6 = '::/0') AND (proto = '-1' OR (from_port <= port AND port <= to_port))),
inst AS (SELECT e.instance_id, list_sort(list(DISTINCT x.port)) AS ports FROM (SELECT DISTINCT instance_id, group_id FROM enis) e
         JOIN exposed x USING (group_id) GROUP BY e.instance_id),
tenants AS (SELECT DISTINCT instance_id FROM enis)
"""


@query(
    "d5_d8_security_groups",
    oracle=SG_CTE
    + "SELECT "
    + _sel(service="AmazonEC2", rtype="security_group", rid="group_id", check="aws.ec2.security.groups.unused", lvl="'low'", score="250",
           detail="group_name")
    + " FROM sgs WHERE COALESCE(group_name, '') <> 'default' AND group_id NOT IN (SELECT group_id FROM used) UNION ALL "
    + "SELECT 'all' AS tenant_id, 'all' AS account_id, 'us-east-1' AS region, 'AmazonEC2' AS service, 'instance' AS resource_type, "
    + "instance_id AS resource_id, 'aws.ec2.instances.security.admin.ports.open.world' AS check_id, 'fail' AS status, 'high' AS severity_level, "
    + "850 AS severity_score, CAST(NULL AS DECIMAL(18,6)) AS monthly_cost, CAST(NULL AS DECIMAL(18,6)) AS monthly_savings, "
    + "CAST(NULL AS INTEGER) AS confidence, array_to_string(ports, ',') AS detail FROM inst",
)
def d5_d8(spark, sf):
    sgs, permissions, pairs = _sg_frames(spark, sf)
    enis = bound(spark, sf, "enis")
    instances = enis.select("instance_id").distinct().select(
        F.lit("all").alias("tenant_id"), F.lit("all").alias("account_id"), F.lit("us-east-1").alias("region"), "instance_id"
    )
    return D.unused_security_groups(sgs, enis, pairs).unionByName(D.admin_ports_open(permissions, enis, instances))


AS_OF_SNAP = "2002-01-01 00:00:00"


@query(
    "d21_d22_ebs_snapshots",
    oracle=binding_cte("snapshots", "images")
    + f""",
s AS (SELECT * FROM snapshots
      WHERE tag_keep IS NULL AND tag_backup_source IS NULL AND NOT contains(lower(description), 'aws backup')),
o AS (SELECT *, CAST(CAST(size_gb AS DECIMAL(18,2)) * CAST(0.05 AS DECIMAL(12,6)) AS DECIMAL(18,6)) AS c,
             CAST(floor((epoch_us(TIMESTAMP '{AS_OF_SNAP}') - epoch_us(start_time)) / 86400e6) AS INTEGER) AS age
      FROM s WHERE start_time <= TIMESTAMP '{AS_OF_SNAP}' - INTERVAL 45 DAY
        AND snapshot_id NOT IN (SELECT snapshot_id FROM images))
SELECT """
    + _sel(service="AmazonEC2", rtype="ebs_snapshot", rid="snapshot_id", check="aws.ec2.ebs.old.snapshot",
           lvl="CASE WHEN c < 20 THEN 'low' ELSE 'medium' END", score="CASE WHEN c < 20 THEN 420 ELSE 620 END", cost="c", savings="c",
           detail="CAST(age AS VARCHAR)")
    + " FROM o UNION ALL SELECT "
    + _sel(service="AmazonEC2", rtype="ebs_snapshot", rid="snapshot_id", check="aws.ec2.ebs.snapshot.unencrypted", lvl="'medium'",
           score="750", detail="CAST(size_gb AS VARCHAR)")
    + " FROM s WHERE encrypted IS NOT TRUE",
)
def d21_d22(spark, sf):
    snaps = bound(spark, sf, "snapshots").withColumn(
        "tags", _tag_map(("aws:backup:source-resource", "tag_backup_source"), ("keep", "tag_keep"))
    )
    return D.ebs_snapshot_findings(snaps, bound(spark, sf, "images"), AS_OF_SNAP)


@query(
    "d62_d63_logs_and_custom_metrics",
    oracle=binding_cte("log_groups", "metric_filters")
    + ", pm AS (SELECT tenant_id, account_id, region, namespace, metric_name, count(*) AS filters, count(DISTINCT log_group) AS log_groups "
    + "FROM metric_filters WHERE namespace IS NOT NULL AND metric_name IS NOT NULL GROUP BY ALL) SELECT "
    + _sel(service="AmazonCloudWatch", rtype="log_group", rid="log_group", check="aws.logs.log.groups.retention.missing", lvl="'medium'",
           score="450", detail="''")
    + " FROM log_groups WHERE retention_days IS NULL AND tag_keep IS NULL AND tag_owner IS NULL UNION ALL SELECT "
    + _sel(service="AmazonCloudWatch", rtype="custom_metric", rid="namespace || ':' || metric_name",
           check="aws.cloudwatch.custom.metrics.from.log.filters", status="'info'", lvl="'low'", score="150", cost="0.30", savings="0.30",
           detail="CAST(filters AS VARCHAR) || '|' || CAST(log_groups AS VARCHAR)")
    + " FROM pm",
)
def d62_d63(spark, sf):
    lg = bound(spark, sf, "log_groups").withColumn("tags", _tag_map(("keep", "tag_keep"), ("purpose", "tag_purpose"), ("owner", "tag_owner")))
    return D.log_retention_findings(lg).unionByName(D.custom_metric_findings(bound(spark, sf, "metric_filters")))


@query(
    "d11_d13_ecs",
    oracle=binding_cte("ecs_clusters", "ecs_services")
    + """,
a AS (SELECT *, list_filter(list_transform(string_split(capacity_providers, ','), lambda x: upper(trim(x))), lambda x: x <> '') AS prov
      FROM ecs_services WHERE upper(trim(status)) = 'ACTIVE' AND desired_count > 0)
SELECT """
    + _sel(service="AmazonECS", rtype="ecs_cluster", rid="cluster_name", check="aws.ecs.cluster.possibly.unused", lvl="'low'", score="240",
           detail="''")
    + " FROM ecs_clusters WHERE active_services = 0 AND running_tasks = 0 AND pending_tasks = 0 AND container_instances = 0 UNION ALL SELECT "
    + _sel(service="AmazonECS", rtype="ecs_service", rid="cluster_name || '/' || service_name", check="aws.ecs.service.zero.running", lvl="'medium'", score="620",
           detail="CAST(desired_count AS VARCHAR)")
    + " FROM a WHERE running_count = 0 UNION ALL SELECT "
    + _sel(service="AmazonECS", rtype="ecs_service", rid="cluster_name || '/' || service_name", check="aws.ecs.service.nonprod.on_demand", lvl="'low'", score="260",
           detail="''")
    + """ FROM a WHERE lower(trim(env_key)) IN ('env', 'environment', 'stage', 'tier')
          AND lower(trim(COALESCE(env_value, ''))) IN ('dev', 'test', 'qa', 'uat', 'staging', 'sandbox', 'nonprod', 'non-prod')
          AND (upper(trim(COALESCE(launch_type, ''))) = 'FARGATE' OR list_contains(prov, 'FARGATE'))
          AND NOT list_bool_or(list_transform(prov, lambda x: ends_with(x, 'SPOT'))) IS TRUE""",
)
def d11_d13(spark, sf):
    svc = bound(spark, sf, "ecs_services")
    svc = svc.withColumns(
        {
            "providers": F.split("capacity_providers", ","),
            "tags": F.map_from_entries(
                F.filter(F.array(F.struct(F.col("env_key").alias("key"), F.col("env_value").alias("value"))), lambda e: e["value"].isNotNull())
            ),
        }
    )
    return D.ecs_findings(bound(spark, sf, "ecs_clusters"), svc)


@query(
    "d_sp1_sp2_savings_plans",
    oracle=binding_cte("instances", "savings_plans")
    + f""",
od AS (SELECT instance_type, CAST(monthly_usd AS DECIMAL(18,4)) AS od FROM (VALUES {", ".join(f"('{t}', '{p}')" for t, p in ON_DEMAND)}) t(instance_type, monthly_usd)),
inst AS (SELECT tenant_id, account_id, region, lower(trim(instance_type)) AS instance_type FROM instances WHERE state = 'running' AND lower(trim(instance_type)) <> ''),
dem AS (SELECT tenant_id, account_id, region, CAST(round(sum(CASE WHEN od.od > 0 THEN od.od END) / 730, 4) AS DECIMAL(18,4)) AS demand
        FROM inst LEFT JOIN od USING (instance_type) GROUP BY ALL),
ty AS (SELECT tenant_id, account_id, region, instance_type, count(*) AS n FROM inst GROUP BY ALL),
top AS (SELECT tenant_id, account_id, region, string_agg(instance_type || ':' || CAST(n AS VARCHAR), ',' ORDER BY r) AS top_types FROM (
          SELECT *, row_number() OVER (PARTITION BY tenant_id, account_id, region ORDER BY n DESC, instance_type) AS r FROM ty) WHERE r <= 5 GROUP BY ALL),
com AS (SELECT tenant_id, account_id, region, CAST(round(sum(commitment), 4) AS DECIMAL(18,4)) AS commitment FROM savings_plans WHERE state = 'active' AND commitment > 0 GROUP BY ALL),
b0 AS (SELECT tenant_id, account_id, region, COALESCE(demand, 0) AS demand, COALESCE(commitment, 0) AS commitment
       FROM dem FULL JOIN com USING (tenant_id, account_id, region)),
b AS (SELECT b0.*, COALESCE(top.top_types, '') AS top_types, greatest(0, demand - commitment) AS uncovered, greatest(0, commitment - demand) AS unused,
             CASE WHEN commitment > 0 THEN least(demand, commitment) * 100.0 / commitment ELSE 100.0 END AS utilization
      FROM b0 LEFT JOIN top USING (tenant_id, account_id, region) WHERE demand > 0 OR commitment > 0)
SELECT """
    + _sel(service="AmazonEC2", rtype="account", rid="account_id", check="aws.ec2.savings.plans.coverage.gap",
           lvl="CASE WHEN uncovered >= 1 THEN 'high' ELSE 'medium' END", score="CASE WHEN uncovered >= 1 THEN 700 ELSE 560 END",
           cost="round(uncovered * 730, 2)", savings="round(round(uncovered * 730, 2) * 0.25, 2)",
           detail="concat_ws('|', CAST(demand AS VARCHAR), CAST(commitment AS VARCHAR), top_types)")
    + " FROM b WHERE uncovered >= 0.05 UNION ALL SELECT "
    + _sel(service="AmazonEC2", rtype="account", rid="account_id", check="aws.ec2.savings.plans.utilization.low",
           lvl="CASE WHEN utilization < 50.0 THEN 'high' ELSE 'medium' END", score="CASE WHEN utilization < 50.0 THEN 680 ELSE 540 END",
           cost="round(unused * 730 * 1.00, 2)", detail="concat_ws('|', CAST(demand AS VARCHAR), CAST(commitment AS VARCHAR), top_types)")
    + " FROM b WHERE commitment > 0 AND utilization < 80.0 AND unused > 0",
)
def d_sp(spark, sf):
    od = spark.createDataFrame(ON_DEMAND, "instance_type string, monthly_usd string")
    return D.savings_plan_findings(bound(spark, sf, "instances"), bound(spark, sf, "savings_plans"), od)


AS_OF_BACKUP = "2000-01-01 00:00:00"


@query(
    "d47_d49_backup",
    oracle=binding_cte("backup_plans", "backup_selections", "recovery_points")
    + f""",
r AS (SELECT tenant_id, account_id, region, plan_id, 1 AS pos, r1_move_days AS mv, r1_delete_days AS dl FROM backup_plans
      UNION ALL SELECT tenant_id, account_id, region, plan_id, 2, r2_move_days, r2_delete_days FROM backup_plans),
rp AS (SELECT *, CASE WHEN CAST(size_gb AS DECIMAL(18,2)) * CASE WHEN upper(storage_class) = 'COLD' THEN CAST(0.012 AS DECIMAL(12,6))
                  ELSE CAST(0.05 AS DECIMAL(12,6)) END > 0
                  THEN round(CAST(size_gb AS DECIMAL(18,2)) * CASE WHEN upper(storage_class) = 'COLD' THEN CAST(0.012 AS DECIMAL(12,6))
                  ELSE CAST(0.05 AS DECIMAL(12,6)) END, 2) END AS c
       FROM recovery_points
       WHERE created IS NOT NULL AND upper(COALESCE(status, '')) NOT IN ('DELETED', 'EXPIRED')
         AND created < TIMESTAMP '{AS_OF_BACKUP}' - INTERVAL 90 DAY
         AND (delete_at IS NULL OR delete_at > TIMESTAMP '{AS_OF_BACKUP}' + INTERVAL 14 DAY) AND tag_retain IS NULL AND tag_legal_hold IS NULL)
SELECT """
    + _sel(service="AWSBackup", rtype="backup_plan", rid="plan_id", check="aws.backup.plans.no.selections", lvl="'low'", score="45", detail="''")
    + " FROM backup_plans WHERE plan_id NOT IN (SELECT plan_id FROM backup_selections) UNION ALL SELECT "
    + _sel(service="AWSBackup", rtype="backup_rule", rid="plan_id || '#' || CAST(pos AS VARCHAR)", check="aws.backup.rules.no.lifecycle",
           lvl="'medium'", score="70", detail="''")
    + " FROM r WHERE COALESCE(mv, 0) = 0 AND COALESCE(dl, 0) = 0 UNION ALL SELECT "
    + _sel(service="AWSBackup", rtype="recovery_point", rid="recovery_point_arn", check="aws.backup.recovery.points.stale", lvl="'medium'",
           score="65", cost="c", savings="c", conf="CASE WHEN c IS NULL THEN 10 WHEN upper(storage_class) = 'COLD' THEN 90 ELSE 40 END", detail="vault_name")
    + " FROM rp",
)
def d47_d49(spark, sf):
    plans = bound(spark, sf, "backup_plans").withColumn(
        "rules",
        F.array(
            F.struct(F.col("r1_move_days").alias("move_days"), F.col("r1_delete_days").alias("delete_days")),
            F.struct(F.col("r2_move_days").alias("move_days"), F.col("r2_delete_days").alias("delete_days")),
        ),
    )
    rps = bound(spark, sf, "recovery_points").withColumn("tags", _tag_map(("retain", "tag_retain"), ("Legal-Hold", "tag_legal_hold"), ("lifecycle", "tag_lifecycle")))
    prices = _ladder_prices(spark).where("kind = 'backup_gb_month'")
    return D.backup_findings(plans, bound(spark, sf, "backup_selections"), rps, AS_OF_BACKUP, prices=prices)


AS_OF_EC2 = "2024-01-01 00:00:00"


@query(
    "d2_d4_ec2_instances",
    oracle=binding_cte("ec2", "volumes")
    + rf""",
pr AS (SELECT * FROM {PRICES_VALUES}),
st AS (
  SELECT *, COALESCE(TRY_CAST(NULLIF(regexp_extract(COALESCE(state_reason, ''), '\((\d{{4}}-\d{{2}}-\d{{2}}(?: \d{{2}}:\d{{2}}:\d{{2}})?)\)', 1), '') AS TIMESTAMP),
                     launch_time) AS stop_ts
  FROM ec2 WHERE lower(state) = 'stopped'),
sa AS (SELECT *, CAST(trunc((epoch_us(TIMESTAMP '{AS_OF_EC2}') - epoch_us(stop_ts)) / 86400e6) AS INTEGER) AS age_days FROM st),
so AS (SELECT * FROM sa WHERE age_days >= 30),
stor AS (SELECT so.instance_id, sum(v.size_gb) AS size_gib, sum(CAST(v.size_gb AS DECIMAL(18,2)) * COALESCE(pr.price, 0)) AS storage_cost
         FROM so JOIN volumes v ON v.volume_id = so.volume_id
         LEFT JOIN pr ON pr.region = v.region AND pr.volume_type = lower(COALESCE(v.volume_type, 'gp2')) GROUP BY so.instance_id),
s AS (SELECT so.*, stor.size_gib, stor.storage_cost FROM so LEFT JOIN stor USING (instance_id))
SELECT """
    + _sel(service="AmazonEC2", rtype="instance", rid="instance_id", check="aws.ec2.instances.stopped.long", lvl="'low'", score="350",
           cost="round(COALESCE(storage_cost, 0), 2)", savings="round(COALESCE(storage_cost, 0), 2)",
           detail="CAST(age_days AS VARCHAR) || '|' || CAST(COALESCE(size_gib, 0) AS VARCHAR)")
    + " FROM s UNION ALL SELECT "
    + _sel(service="AmazonEC2", rtype="instance", rid="instance_id", check="aws.ec2.instances.old.generation", lvl="'low'", score="250",
           detail="string_split(lower(COALESCE(instance_type, '')), '.')[1]")
    + " FROM ec2 WHERE string_split(lower(COALESCE(instance_type, '')), '.')[1] IN "
    + "('t1', 't2', 'm1', 'm2', 'm3', 'c1', 'c3', 'r3', 'i2', 'd2', 'g2', 'p2', 'x1', 'x1e') UNION ALL SELECT "
    + _sel(service="AmazonEC2", rtype="instance", rid="instance_id", check="aws.ec2.instances.security.imdsv1.allowed", lvl="'high'",
           score="800", detail="COALESCE(http_tokens, 'missing')")
    + " FROM ec2 WHERE COALESCE(lower(trim(http_tokens)), '') <> 'required'",
)
def d2_d4(spark, sf):
    inst = bound(spark, sf, "ec2").withColumn("volume_ids", F.array("volume_id"))
    return D.ec2_instance_findings(inst, bound(spark, sf, "volumes"), _prices(spark), AS_OF_EC2)


_LB_COST = "CASE lower(lb_type) WHEN 'network' THEN 18.14 ELSE 21.60 END"
_LB_CONF = "CASE lower(lb_type) WHEN 'network' THEN 90 ELSE 50 END"
# the twin tenant's load balancers have the same names, but other listeners and targets
_TWIN_LISTENERS = "lb_name LIKE '%2' OR lb_name LIKE '%7'"
_TWIN_TARGETS = "health = 'healthy' AND target_group LIKE '%7'"


def _lb_metrics(spark, sf):
    k = F.regexp_extract("resource_id", r"(\d+)$", 1).cast("long") % 100
    m = metrics(spark, sf).withColumns({"value": F.lit(1.0), "region": F.lit("us-east-1"), "_k": k})
    text = lambda c: c.cast("string")
    m = m.withColumns({"resource_id": F.concat(F.lit("lb-"), text(F.col("_k"))), "tenant_id": F.concat(F.lit("tenant-"), text(F.col("_k") % 3)), "account_id": text(F.lit(100000000000) + F.col("_k") % 7)}).drop("_k")
    named = lambda name: m.withColumn("metric", F.when(F.col("metric") == "error", name).otherwise(F.col("metric")))
    return named("RequestCount").unionByName(named("NewFlowCount"))


@query(
    "d56_d58_load_balancers",
    oracle=binding_cte("lbs", "listeners", "target_groups", "targets")
    + f""",
{twins_cte("lbs", "'application' AS lb_type")},
{twins_cte("listeners", where=_TWIN_LISTENERS)},
{twins_cte("target_groups")},
{twins_cte("targets", where=_TWIN_TARGETS)},
lb AS (SELECT * FROM lbs_all WHERE tag_keep IS NULL AND (created IS NULL OR TIMESTAMP '{AS_OF_METRICS}' - created >= INTERVAL 2 DAY)),
wl AS (SELECT DISTINCT tenant_id, account_id, region, lb_name FROM listeners_all),
live AS (SELECT lb.* FROM lb JOIN wl USING (tenant_id, account_id, region, lb_name)),
d AS (SELECT 'tenant-' || CAST(user_id % 100 % 3 AS VARCHAR) AS tenant_id, 'lb-' || CAST(user_id % 100 AS VARCHAR) AS lb_name, CAST(ts AS DATE) AS day, sum(1.0) AS value FROM events
      WHERE event_type = 'error' AND ts >= TIMESTAMP '{AS_OF_METRICS}' - INTERVAL 14 DAY AND ts < TIMESTAMP '{AS_OF_METRICS}' GROUP BY ALL),
st AS (SELECT tenant_id, lb_name, count(*) AS points, list_sort(list(value))[CAST(floor((count(*) - 1) * 0.95) AS BIGINT) + 1] AS p95 FROM d GROUP BY ALL),
s AS (SELECT live.*, st.points, st.p95 FROM live LEFT JOIN st USING (tenant_id, lb_name)),
fwd AS (SELECT DISTINCT l.tenant_id, l.account_id, l.region, l.lb_name, l.target_group FROM listeners_all l JOIN target_groups_all g USING (tenant_id, account_id, region, target_group)
        WHERE lower(l.action_type) = 'forward' AND lower(g.target_type) <> 'lambda'),
per AS (SELECT tenant_id, account_id, region, lb_name, count(*) AS groups,
               max(CASE WHEN EXISTS (SELECT 1 FROM targets_all t WHERE t.tenant_id = fwd.tenant_id AND t.account_id = fwd.account_id AND t.target_group = fwd.target_group) THEN 1 ELSE 0 END) AS any_t,
               max(CASE WHEN EXISTS (SELECT 1 FROM targets_all t WHERE t.tenant_id = fwd.tenant_id AND t.account_id = fwd.account_id AND t.target_group = fwd.target_group AND health = 'healthy') THEN 1 ELSE 0 END) AS any_h
        FROM fwd GROUP BY ALL)
SELECT """
    + _sel(service="ElasticLoadBalancing", rtype="load_balancer", rid="lb_name", check="aws.elbv2.load.balancers.no.listeners",
           lvl="'high'", score="75", cost=_LB_COST, conf=_LB_CONF, detail="''")
    + " FROM lb ANTI JOIN wl USING (tenant_id, account_id, region, lb_name) UNION ALL SELECT "
    + _sel(service="ElasticLoadBalancing", rtype="load_balancer", rid="lb_name", check="aws.elbv2.load.balancers.idle", lvl="'medium'",
           score="60", savings=_LB_COST, conf=_LB_CONF, detail="printf('%.6f', COALESCE(p95, 0.0))")
    + " FROM s WHERE lower(lb_type) IN ('application', 'network') AND COALESCE(points, 0) >= 7 AND COALESCE(p95, 0.0) <= 1.0"
    + " UNION ALL SELECT "
    + _sel(service="ElasticLoadBalancing", rtype="load_balancer", rid="lb_name", check="aws.elbv2.load.balancers.no.registered.targets",
           lvl="'high'", score="75", savings=_LB_COST, conf=_LB_CONF, detail="CAST(groups AS VARCHAR)")
    + " FROM live JOIN per USING (tenant_id, account_id, region, lb_name) WHERE any_t = 0 UNION ALL SELECT "
    + _sel(service="ElasticLoadBalancing", rtype="load_balancer", rid="lb_name", check="aws.elbv2.load.balancers.no.healthy.targets",
           lvl="'high'", score="75", detail="CAST(groups AS VARCHAR)")
    + " FROM live JOIN per USING (tenant_id, account_id, region, lb_name) WHERE any_t = 1 AND any_h = 0",
)
def d56_d58(spark, sf):
    lbs = twins(bound(spark, sf, "lbs").withColumn("tags", _tag_map(("keep", "tag_keep"))), lb_type=F.lit("application"))
    return D.elbv2_findings(
        lbs, twins(bound(spark, sf, "listeners"), _TWIN_LISTENERS), twins(bound(spark, sf, "target_groups")), twins(bound(spark, sf, "targets"), _TWIN_TARGETS),
        _lb_metrics(spark, sf), AS_OF_METRICS, prices=_ladder_prices(spark),
    )


def _cf_metrics(spark, sf):
    m = metrics(spark, sf).withColumns({"value": F.lit(1.0), "region": F.lit("global")}).withColumn("metric", F.when(F.col("metric") == "view", "Requests").otherwise(F.col("metric")))
    return m.withColumn("resource_id", F.regexp_replace("resource_id", "^r-", "dist-"))


@query(
    "d60_d61_cloudfront",
    oracle=binding_cte("distributions")
    + f""",
d AS (SELECT *, trim(COALESCE(cache_policy_id, '')) AS pol FROM distributions WHERE COALESCE(enabled, false)),
r AS (SELECT *, CASE WHEN pol = '413f160f-4f18-4c0b-95c7-bf7f44e8f58b' THEN 'managed_policy_caching_disabled' WHEN pol <> '' THEN ''
                     WHEN min_ttl IS NOT NULL AND default_ttl IS NOT NULL AND max_ttl IS NOT NULL AND min_ttl <= 0 AND default_ttl <= 0 AND max_ttl <= 0
                     THEN 'legacy_ttl_zero' ELSE '' END AS reason FROM d),
dd AS (SELECT 'dist-' || CAST(user_id AS VARCHAR) AS distribution_id, CAST(ts AS DATE) AS day, sum(1.0) AS value FROM events
       WHERE event_type = 'view' AND ts >= TIMESTAMP '{AS_OF_METRICS}' - INTERVAL 14 DAY AND ts < TIMESTAMP '{AS_OF_METRICS}' GROUP BY ALL),
st AS (SELECT distribution_id, count(*) AS points, list_sort(list(value))[CAST(floor((count(*) - 1) * 0.95) AS BIGINT) + 1] AS p95 FROM dd GROUP BY ALL),
c AS (SELECT d.*, st.points, st.p95 FROM d JOIN st USING (distribution_id)
      WHERE d.created IS NULL OR CAST(floor((epoch_us(TIMESTAMP '{AS_OF_METRICS}') - epoch_us(d.created)) / 86400e6) AS INTEGER) >= 7)
SELECT """
    + _sel(service="AmazonCloudFront", rtype="distribution", rid="distribution_id", check="aws.cloudfront.distributions.caching.disabled",
           lvl="'medium'", score="520", detail="reason")
    + " FROM r WHERE reason <> '' UNION ALL SELECT "
    + _sel(service="AmazonCloudFront", rtype="distribution", rid="distribution_id", check="aws.cloudfront.distributions.unused",
           lvl="'medium'", score="560", detail="printf('%.6f', p95)")
    + " FROM c WHERE points >= 7 AND p95 <= 1.0",
)
def d60_d61(spark, sf):
    return D.cloudfront_findings(bound(spark, sf, "distributions"), _cf_metrics(spark, sf), AS_OF_METRICS)
