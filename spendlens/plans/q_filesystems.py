"""Registered file system detectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import filesystems as R
from ..sources.bind import bound, binding_cte
from .inputs import metrics
from .q_detect import AS_OF_METRICS, _sel, _tag_map
from .registry import query

_WINDOW = f"ts >= TIMESTAMP '{AS_OF_METRICS}' - INTERVAL 14 DAY AND ts < TIMESTAMP '{AS_OF_METRICS}'"
_P95 = "list_sort(list({v}))[CAST(floor((count(*) - 1) * 0.95) AS BIGINT) + 1]"
FSX_PRICES = [("ssd", 0.13), ("hdd", 0.013)]


def _as(spark, sf, prefix: str, names: dict[str, str], busy: int):
    """Metric points named after event types; errors of every ``busy``-th user are another metric."""
    m = metrics(spark, sf)
    name = F.element_at(F.create_map(*[F.lit(x) for kv in names.items() for x in kv]), F.col("metric"))
    user = F.regexp_extract("resource_id", r"(\d+)$", 1).cast("long")
    odd = (F.col("metric") == "error") & (user % busy == 0)
    return m.select("tenant_id", "account_id", F.lit("eu-west-1").alias("region"), F.regexp_replace("resource_id", "^r-", prefix).alias("resource_id"), F.when(odd, "Other").otherwise(F.coalesce(name, "metric")).alias("metric"), "ts", "value")


@query(
    "d23_d24_efs_use",
    oracle=binding_cte("efs")
    + f""",
ev AS (SELECT 'fs-' || CAST(user_id AS VARCHAR) AS file_system_id, user_id, event_type, CAST(ts AS DATE) AS day, value FROM events WHERE {_WINDOW}),
rd AS (SELECT file_system_id, day, sum(value) AS r FROM ev WHERE event_type = 'click' GROUP BY ALL),
wr AS (SELECT file_system_id, day, sum(value) AS w FROM ev WHERE event_type = 'purchase' GROUP BY ALL),
io AS (SELECT file_system_id, count(*) AS points, {_P95.format(v='r + w')} AS p95 FROM rd JOIN wr USING (file_system_id, day) GROUP BY 1),
mx AS (SELECT file_system_id, max(value) FILTER (event_type = 'error' AND user_id % 3 <> 0) AS conn, max(value) FILTER (event_type = 'view') AS lim FROM ev GROUP BY 1),
f AS (SELECT * FROM efs LEFT JOIN io USING (file_system_id) LEFT JOIN mx USING (file_system_id))
SELECT """
    + _sel(service="AmazonEFS", rtype="file_system", rid="file_system_id", check="aws.efs.filesystems.unused", lvl="'medium'", score="700",
           detail="CAST(points AS VARCHAR) || '|' || printf('%.0f', p95)")
    + " FROM f WHERE points >= 2 AND p95 <= 5242880 AND COALESCE(conn, 0) <= 0 UNION ALL SELECT "
    + _sel(service="AmazonEFS", rtype="file_system", rid="file_system_id", check="aws.efs.filesystems.provisioned.throughput.underutilized", lvl="'medium'", score="650",
           detail="printf('%.6f', lim)")
    + " FROM f WHERE throughput_mode = 'provisioned' AND lim <= 60",
)
def d23_d24(spark, sf):
    m = _as(spark, sf, "fs-", {"click": "DataReadIOBytes", "purchase": "DataWriteIOBytes", "view": "PercentIOLimit", "error": "ClientConnections"}, 3)
    return R.efs_use(bound(spark, sf, "efs"), m, AS_OF_METRICS, min_points=2, io_limit_p95=60.0)


def _fsx(check: str, lvl: str, score: int, conf: str, where: str, detail: str = "''", **money: str) -> str:
    text = _sel(service="AmazonFSx", rtype="file_system", rid="file_system_id", check=check, lvl=f"'{lvl}'", score=str(score), detail=detail, **money)
    return f"SELECT {text.replace('CAST(NULL AS INTEGER) AS confidence', conf + ' AS confidence')} FROM f WHERE {where}"


@query(
    "d28_d34_fsx",
    oracle=binding_cte("fsx")
    + f""",
ev AS (SELECT 'fsx-' || CAST(user_id AS VARCHAR) AS file_system_id, event_type, date_trunc('hour', ts) AS hour, value FROM events
       WHERE {_WINDOW} AND event_type IN ('view', 'click', 'purchase')),
act AS (SELECT file_system_id, max(value) > 0 AS active FROM ev GROUP BY 1),
h AS (SELECT file_system_id, event_type, hour, CASE WHEN event_type = 'view' THEN avg(value) ELSE sum(value) END AS v FROM ev GROUP BY file_system_id, event_type, hour),
p AS (SELECT file_system_id, event_type, {_P95.format(v='v')} AS p95 FROM h GROUP BY file_system_id, event_type),
s AS (SELECT file_system_id, max(p95) FILTER (event_type = 'view') AS util, max(p95) FILTER (event_type = 'click') AS r, max(p95) FILTER (event_type = 'purchase') AS w FROM p GROUP BY 1),
f AS (SELECT fsx.*, act.active IS NOT NULL AS seen, COALESCE(act.active, false) AS active, util,
             CASE WHEN r IS NOT NULL OR w IS NOT NULL THEN (COALESCE(r, 0) + COALESCE(w, 0)) / 3600.0 / 1048576.0 END AS mib_s,
             COALESCE(regexp_matches(lower(tag_environment), 'dev|test|staging|sbx|nprod|qa|nonprod'), false)
             OR COALESCE(regexp_matches(lower(tag_name), 'dev|test|staging|sbx|nprod|qa|nonprod'), false) AS nonprod,
             concat_ws(',', CASE WHEN tag_application IS NULL THEN 'application' END, 'applicationid', CASE WHEN tag_environment IS NULL THEN 'environment' END) AS miss,
             TRY_CAST(string_split(trim(COALESCE(maintenance, '')), ':')[2] AS INTEGER) AS mh
      FROM fsx LEFT JOIN act USING (file_system_id) LEFT JOIN s USING (file_system_id))
"""
    + " UNION ALL ".join(
        [
            _fsx("aws.fsx.filesystems.missing.required.tags", "low", 300, "NULL", "miss <> ''", "miss"),
            _fsx("aws.fsx.filesystems.possible.unused", "medium", 650, "CASE WHEN seen THEN 60 ELSE 35 END", "NOT active", "fs_type"),
            _fsx("aws.fsx.filesystems.underutilized.throughput", "medium", 700, "65", "throughput > 0 AND util < 120", "printf('%.6f', util)"),
            _fsx("aws.fsx.filesystems.large.and.inactive", "low", 350, "40", "storage_gib >= 4096 AND NOT active", "CAST(storage_gib AS VARCHAR)"),
            _fsx("aws.fsx.filesystems.multi.az.in.nonprod", "medium", 650, "70", "COALESCE(deployment, '') LIKE '%MULTI_AZ%' AND nonprod AND fs_type IN ('WINDOWS', 'ONTAP')", "deployment"),
            _fsx("aws.fsx.windows.backups.disabled", "high", 850, "90", "fs_type = 'WINDOWS' AND backup_days = 0"),
            _fsx("aws.fsx.windows.backup.retention.low", "medium", 650, "80", "fs_type = 'WINDOWS' AND backup_days BETWEEN 1 AND 6", "CAST(backup_days AS VARCHAR)"),
            _fsx("aws.fsx.windows.copy.tags.to.backups.disabled", "low", 300, "90", "fs_type = 'WINDOWS' AND copy_tags = false"),
            _fsx("aws.fsx.windows.maintenance.window.missing", "low", 250, "70", "fs_type = 'WINDOWS' AND trim(COALESCE(maintenance, '')) = ''"),
            _fsx("aws.fsx.windows.maintenance.window.business.hours", "low", 250, "55", "fs_type = 'WINDOWS' AND mh BETWEEN 8 AND 18 AND NOT nonprod", "trim(maintenance)"),
            _fsx("aws.fsx.windows.storage.type.mismatch", "low", 350, "40", "fs_type = 'WINDOWS' AND storage_type = 'SSD' AND (NOT active OR util < 10 OR mib_s < 1)", "CAST(storage_gib AS VARCHAR)",
                 cost="CASE WHEN storage_gib > 0 THEN round(storage_gib * 0.13::DOUBLE, 2) END", savings="CASE WHEN storage_gib > 0 THEN round(storage_gib * (0.13::DOUBLE - 0.013::DOUBLE), 2) END"),
        ]
    ),
)
def d28_d34(spark, sf):
    f = bound(spark, sf, "fsx").withColumn("tags", _tag_map(("Environment", "tag_environment"), ("Application", "tag_application"), ("Name", "tag_name")))
    m = _as(spark, sf, "fsx-", {"view": "ThroughputUtilization", "click": "DataReadBytes", "purchase": "DataWriteBytes"}, 1)
    prices = spark.createDataFrame([("eu-west-1", "fsx_gb_month", k, p, "pricing_api") for k, p in FSX_PRICES], "region string, kind string, key string, unit_price double, source string")
    return R.fsx_findings(f, m, prices, AS_OF_METRICS, util_p95=120.0)
