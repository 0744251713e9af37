"""Registered rightsizing, RDS, EFS and node group detectors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import rightsize as R
from ..sources.bind import REGIONS, bound, binding_cte, twins, twins_cte
from .inputs import metrics
from .q_detect import AS_OF_METRICS, _sel, _tag_map
from .registry import query

#: prices of the queries: one type has none, one only a fallback
HOURLY = [("us-east-1", "m5.large", 0.096), ("us-east-1", "t2.micro", 0.0116), ("us-west-2", "m5.large", 0.096), ("eu-west-1", "m5.large", 0.107), ("eu-west-1", "m5.medium", 0.0535), ("eu-west-1", "c5.large", 0.096), ("ap-southeast-2", "t2.micro", 0.0146), ("ap-southeast-2", "t2.nano", 0.0073)]
FALLBACK = {"m3.medium": 0.067, "c5.large": 0.085}
RDS_HOURLY = [("db.m5.large:single", 0.178), ("db.m5.large:multi", 0.356), ("db.m3.large:single", 0.19), ("db.t2.micro:single", 0.018), ("db.t2.micro:multi", 0.036)]
#: event types stand for the metrics of an instance or database
EC2_METRICS = {"view": "CPUUtilization", "click": "NetworkIn", "purchase": "NetworkOut", "signup": "CPUCreditBalance", "error": "CPUSurplusCreditsCharged"}


def _metrics(spark, sf, prefix: str, names: dict[str, str], scale: float, region: str | None = None) -> DataFrame:
    m = metrics(spark, sf)
    name = F.element_at(F.create_map(*[F.lit(x) for kv in names.items() for x in kv]), F.col("metric"))
    own = F.get(F.array(*map(F.lit, REGIONS)), (F.regexp_extract("resource_id", r"(\d+)$", 1).cast("long") % len(REGIONS)).cast("int"))
    where = (F.lit(region) if region else own).alias("region")
    return m.select("tenant_id", "account_id", where, F.regexp_replace("resource_id", "^r-", prefix).alias("resource_id"), F.coalesce(name, "metric").alias("metric"), "ts", (F.col("value") * scale).alias("value"))


def _prices(spark) -> DataFrame:
    rows = [(r, "ec2_hour", k, p, "pricing_api") for r, k, p in HOURLY] + [("eu-west-1", "rds_hour", k, p, "price_file") for k, p in RDS_HOURLY]
    return spark.createDataFrame(rows, "region string, kind string, key string, unit_price double, source string")


_SIZES = "[" + ", ".join(f"'{s}'" for s in R.SIZES) + "]"
_PRICES = "(VALUES " + ", ".join(f"('{r}', '{k}', CAST({p} AS DOUBLE))" for r, k, p in HOURLY) + ") AS t(region, k, p)"
_FALLBACKS = "(VALUES " + ", ".join(f"('{k}', CAST({p} AS DOUBLE))" for k, p in FALLBACK.items()) + ") AS t(k, p)"


@query(
    "d1_underutilized_instances",
    oracle=binding_cte("ec2")
    + f""",
m AS (SELECT 'i-' || CAST(user_id AS VARCHAR) AS instance_id, event_type, value FROM events
      WHERE ts >= TIMESTAMP '{AS_OF_METRICS}' - INTERVAL 14 DAY AND ts < TIMESTAMP '{AS_OF_METRICS}' AND event_type IN ('view', 'click', 'purchase')),
u AS (SELECT instance_id, COALESCE(avg(value) FILTER (event_type = 'view'), 0) AS cpu,
             COALESCE(sum(value) FILTER (event_type <> 'view'), 0) / 1024.0
             / greatest(count(*) FILTER (event_type = 'click'), count(*) FILTER (event_type = 'purchase'), 1) AS net FROM m GROUP BY 1),
i AS (SELECT ec2.*, cpu, net, string_split(instance_type, '.')[1] AS fam, list_position({_SIZES}, string_split(instance_type, '.')[2]) AS idx
      FROM ec2 JOIN u USING (instance_id) WHERE state = 'running' AND cpu <= 60 AND net <= 512),
s AS (SELECT *, CASE WHEN idx > 1 THEN fam || '.' || ({_SIZES})[idx - 1] END AS smaller FROM i),
p AS (SELECT * FROM {_PRICES}), fb AS (SELECT * FROM {_FALLBACKS}),
q AS (SELECT s.*, COALESCE(a.p, fa.p) AS price, COALESCE(b.p, fbb.p) AS less,
             CASE WHEN a.p IS NOT NULL THEN 90 WHEN fa.p IS NOT NULL THEN 60 ELSE 0 END AS c1, CASE WHEN b.p IS NOT NULL THEN 90 WHEN fbb.p IS NOT NULL THEN 60 ELSE 0 END AS c2
      FROM s LEFT JOIN p a ON a.region = s.region AND a.k = s.instance_type LEFT JOIN fb fa ON fa.k = s.instance_type
      LEFT JOIN p b ON b.region = s.region AND b.k = s.smaller LEFT JOIN fb fbb ON fbb.k = s.smaller),
r AS (SELECT *, round(price * 730, 2) AS cost, round(less * 730, 2) AS cost2 FROM q)
SELECT """
    + _sel(service="AmazonEC2", rtype="instance", rid="instance_id", check="aws.ec2.instances.underutilized", lvl="'medium'", score="550",
           cost="cost", savings="CASE WHEN smaller IS NOT NULL AND cost2 < cost THEN round(cost - cost2, 2) ELSE cost END",
           detail="concat_ws('|', instance_type, COALESCE(smaller, ''), printf('%.6f', cpu), printf('%.6f', net))").replace(
        "CAST(NULL AS INTEGER) AS confidence", "CASE WHEN smaller IS NOT NULL THEN least(c1, c2) ELSE c1 END AS confidence")
    + " FROM r",
)
def d1(spark, sf):
    return R.underutilized_instances(bound(spark, sf, "ec2"), _metrics(spark, sf, "i-", EC2_METRICS, 1.0), _prices(spark), AS_OF_METRICS, cpu_max=60.0, fallback=FALLBACK)


@query(
    "d6_credit_issues",
    oracle=binding_cte("ec2")
    + f""",
u AS (SELECT 'i-' || CAST(user_id AS VARCHAR) AS instance_id, min(value) FILTER (event_type = 'signup') AS b, sum(value) FILTER (event_type = 'error') AS x
      FROM events WHERE ts >= TIMESTAMP '{AS_OF_METRICS}' - INTERVAL 7 DAY AND ts < TIMESTAMP '{AS_OF_METRICS}' GROUP BY 1),
t AS (SELECT ec2.*, COALESCE(b, 0) AS b, COALESCE(x, 0) AS x FROM ec2 LEFT JOIN u USING (instance_id) WHERE lower(instance_type) LIKE 't%')
SELECT """
    + _sel(service="AmazonEC2", rtype="instance", rid="instance_id", check="aws.ec2.instances.t.credit.issues", lvl="'medium'", score="650",
           detail="concat_ws('|', instance_type, printf('%.2f', b), printf('%.2f', x))")
    + " FROM t WHERE b < 20 OR x > 0",
)
def d6(spark, sf):
    return R.credit_issues(bound(spark, sf, "ec2"), _metrics(spark, sf, "i-", EC2_METRICS, 1.0), AS_OF_METRICS)


@query(
    "d17_eks_nodegroups",
    oracle=binding_cte("eks", "eks_nodegroups")
    + f""",
{twins_cte("eks", "NOT endpoint_public AS endpoint_public")},
{twins_cte("eks_nodegroups", where="desired_size = 2")},
n AS (SELECT g.*, lower(COALESCE(g.tag_stage, CASE WHEN c.endpoint_public THEN 'dev' END)) AS stage
      FROM eks_nodegroups_all g JOIN eks_all c USING (tenant_id, account_id, region, cluster_name))
SELECT """
    + _sel(service="AmazonEKS", rtype="nodegroup", rid="nodegroup_name", check="aws.eks.nodegroup.nonprod.on_demand", status="'info'", lvl="'low'", score="270",
           detail="cluster_name || '|' || CAST(desired_size AS VARCHAR)")
    + " FROM n WHERE desired_size > 0 AND upper(COALESCE(capacity_type, 'ON_DEMAND')) = 'ON_DEMAND' AND stage IN ('dev', 'test', 'qa', 'uat', 'staging', 'sandbox', 'nonprod', 'non-prod')",
)
def d17(spark, sf):
    clusters = twins(bound(spark, sf, "eks"), endpoint_public=~F.col("endpoint_public")).withColumn("tag_stage", F.when(F.col("endpoint_public"), F.lit("dev"))).withColumn("tags", _tag_map(("Stage", "tag_stage")))
    return R.nodegroups_on_demand(clusters, twins(bound(spark, sf, "eks_nodegroups"), "desired_size = 2").withColumn("tags", _tag_map(("stage", "tag_stage"))))


@query(
    "d25_d27_efs_configuration",
    oracle=binding_cte("efs")
    + " SELECT "
    + _sel(service="AmazonEFS", rtype="file_system", rid="file_system_id", check="aws.efs.filesystems.lifecycle.missing", lvl="'low'", score="400", detail="''")
    + " FROM efs WHERE trim(COALESCE(to_ia, '')) = '' AND trim(COALESCE(to_archive, '')) = '' UNION ALL SELECT "
    + _sel(service="AmazonEFS", rtype="file_system", rid="file_system_id", check="aws.efs.filesystems.backup.disabled", lvl="'medium'", score="700", detail="''")
    + " FROM efs WHERE upper(backup_status) = 'DISABLED' UNION ALL SELECT "
    + _sel(service="AmazonEFS", rtype="file_system", rid="file_system_id", check="aws.efs.filesystems.unencrypted", lvl="'high'", score="900", detail="''")
    + " FROM efs WHERE encrypted = false",
)
def d25_d27(spark, sf):
    policies = F.array(F.struct(F.col("to_ia"), F.lit(None).cast("string").alias("to_archive")), F.struct(F.lit(None).cast("string").alias("to_ia"), F.col("to_archive")))
    return R.efs_configuration(bound(spark, sf, "efs").withColumn("policies", policies))


DB_METRICS = {"view": "FreeStorageSpace", "click": "ReadIOPS"}
_GIB = 1024.0**3


def _db_metrics(spark, sf) -> DataFrame:
    # nothing is free or read in the twin tenant's databases
    m = twins(_metrics(spark, sf, "db-", DB_METRICS, 1.0, "eu-west-1"), value=F.lit(0.0))
    return m.withColumn("value", F.when(F.col("metric") == "FreeStorageSpace", F.col("value") * _GIB).otherwise(F.col("value") / 1000.0))


@query(
    "d40_d41_d44_rds_rightsizing",
    oracle=binding_cte("dbs")
    + f""",
{twins_cte("dbs")},
ev AS (SELECT 'tenant-' || CAST(user_id % 3 AS VARCHAR) AS tenant_id, user_id, event_type, ts, value FROM events),
{twins_cte("ev", "0.0::DOUBLE AS value")},
day AS (SELECT tenant_id, 'db-' || CAST(user_id AS VARCHAR) AS db_instance_id, event_type, CAST(ts AS DATE) AS day, avg(CASE event_type WHEN 'view' THEN value * {_GIB} ELSE value / 1000.0 END) AS v
        FROM ev_all WHERE event_type IN ('view', 'click') AND ts >= TIMESTAMP '{AS_OF_METRICS}' - INTERVAL 14 DAY AND ts < TIMESTAMP '{AS_OF_METRICS}' GROUP BY ALL),
st AS (SELECT tenant_id, db_instance_id, event_type, count(*) AS points, quantile_cont(v, 0.95) AS p95 FROM day GROUP BY ALL HAVING count(*) >= 8),
f0 AS (SELECT dbs_all.*, points, greatest(0, allocated_gb - greatest(0, p95 / {_GIB})) AS used FROM dbs_all JOIN st USING (tenant_id, db_instance_id) WHERE event_type = 'view' AND allocated_gb > 0),
f AS (SELECT *, greatest(0, allocated_gb - greatest(used, allocated_gb * 0.4)) AS excess FROM f0 WHERE used / allocated_gb < 0.4),
pr AS (SELECT * FROM (VALUES {", ".join(f"('{k}', CAST({p} AS DOUBLE))" for k, p in RDS_HOURLY)}) AS t(k, p)),
z AS (SELECT dbs_all.*, a.p AS two, b.p AS one, a.p IS NOT NULL AND b.p IS NOT NULL AS known FROM dbs_all
      LEFT JOIN pr a ON a.k = lower(instance_class) || ':multi' LEFT JOIN pr b ON b.k = lower(instance_class) || ':single'),
rep AS (SELECT z.*, points, p95, round(CASE WHEN multi_az THEN two ELSE one END * 730, 2) AS c FROM z JOIN st USING (tenant_id, db_instance_id)
        WHERE event_type = 'click' AND p95 < 0.1 AND replica_of IS NOT NULL AND engine NOT LIKE 'aurora%' AND status = 'available'
          AND COALESCE(lower(replace(tag_role, '_', '-')), '') <> 'disaster-recovery')
SELECT """
    + _sel(service="AmazonRDS", rtype="db_instance", rid="db_instance_id", check="aws.rds.storage.overprovisioned", lvl="'low'", score="350", cost="0",
           savings="round(excess * 0.115, 2)", detail="concat_ws('|', CAST(allocated_gb AS VARCHAR), printf('%.1f', used), CAST(points AS VARCHAR))").replace("CAST(NULL AS INTEGER) AS confidence", "70 AS confidence")
    + " FROM f WHERE excess >= 20 UNION ALL SELECT "
    + _sel(service="AmazonRDS", rtype="db_instance", rid="db_instance_id", check="aws.rds.multi.az.non.prod", lvl="'medium'", score="520",
           cost="CASE WHEN known THEN round(two * 730, 2) ELSE 0 END", savings="CASE WHEN known THEN round(greatest(0, two - one) * 730, 2) ELSE 0 END",
           detail="instance_class").replace("CAST(NULL AS INTEGER) AS confidence", "CASE WHEN known THEN 80 ELSE 30 END AS confidence")
    + " FROM z WHERE multi_az AND lower(tag_env) IN ('dev', 'test', 'nprd', 'staging', 'nonprod', 'non-prod', 'sandbox', 'qa', 'uat') UNION ALL SELECT "
    + _sel(service="AmazonRDS", rtype="db_instance", rid="db_instance_id", check="aws.rds.read.replica.unused", lvl="'medium'", score="560", cost="COALESCE(c, 0)",
           savings="COALESCE(c, 0)", detail="CAST(points AS VARCHAR) || '|' || printf('%.6f', p95)").replace("CAST(NULL AS INTEGER) AS confidence", "CASE WHEN c IS NOT NULL THEN 80 ELSE 70 END AS confidence")
    + " FROM rep",
)
def d40_d44(spark, sf):
    dbs = twins(bound(spark, sf, "dbs")).withColumn("tags", _tag_map(("Env", "tag_env"), ("Role", "tag_role")))
    return R.rds_rightsizing(dbs, _db_metrics(spark, sf), _prices(spark), AS_OF_METRICS)


AS_OF_SNAPSHOTS = "2000-01-01 00:00:00"


@query(
    "d45_d46_rds_snapshots",
    oracle=binding_cte("rds_snapshots", "dbs")
    + f""",
{twins_cte("rds_snapshots", where="kind = 'db'")},
s AS (SELECT *, COALESCE(source_region, region) = region AND source_id <> '' AND (kind <> 'db' OR (tenant_id, source_id) NOT IN (SELECT (tenant_id, db_instance_id) FROM dbs)) AS orphan FROM rds_snapshots_all)
SELECT """
    + _sel(service="AmazonRDS", rtype="' || 'rds_' || kind || '_snapshot", rid="snapshot_id", check="aws.rds.snapshots.orphaned", lvl="'medium'", score="70",
           cost="size_gb * 0.095", savings="size_gb * 0.095", detail="source_id")
    + " FROM s WHERE orphan UNION ALL SELECT "
    + _sel(service="AmazonRDS", rtype="' || 'rds_' || kind || '_snapshot", rid="snapshot_id", check="aws.rds.snapshots.manual.old", lvl="'low'", score="60",
           cost="size_gb * 0.095", savings="size_gb * 0.095", detail="CAST(CAST(created AS DATE) AS VARCHAR)")
    + f" FROM s WHERE NOT orphan AND lower(snapshot_type) LIKE 'manual%' AND created <= TIMESTAMP '{AS_OF_SNAPSHOTS}' - INTERVAL 30 DAY",
)
def d45_d46(spark, sf):
    sources = bound(spark, sf, "dbs").select("tenant_id", "account_id", "region", F.lit("db").alias("kind"), F.col("db_instance_id").alias("source_id"))
    return R.rds_snapshots(twins(bound(spark, sf, "rds_snapshots"), "kind = 'db'"), sources, AS_OF_SNAPSHOTS)
