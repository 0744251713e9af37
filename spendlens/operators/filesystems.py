"""Shared file systems: EFS use (D23, D24) and FSx.

Series are reduced to one point a day (or an hour) inside the lookback window
before any list is collected, so a file system's list is bounded by the window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.coerce import MONEY
from ..functions.stats import percentile_floor
from ..functions.tags import missing_required, non_production
from ..sources.prices import price_lookup
from .detect import SCOPE, _draft, daily_series

#: fixed values: tags every FSx file system needs, and words of test environments
FSX_REQUIRED_TAGS = ("application", "applicationId", "environment")
FSX_ENVIRONMENT_KEYS = ("env", "environment", "stage", "tier")
FSX_NONPROD_WORDS = ("dev", "test", "staging", "sbx", "nprod", "qa", "nonprod")
#: fixed values: metrics that show activity; utilization metrics in order of preference
FSX_ACTIVITY = ("DataReadBytes", "DataWriteBytes", "ThroughputUtilization", "NetworkThroughputUtilization", "DiskIopsUtilization")
FSX_UTILIZATION = ("ThroughputUtilization", "NetworkThroughputUtilization")


def _in_window(metrics: DataFrame, as_of, days: int) -> DataFrame:
    now = F.lit(as_of).cast("timestamp")
    return metrics.where((F.col("ts") >= now - F.make_interval(days=F.lit(days))) & (F.col("ts") < now))


def _hourly_p95(metrics: DataFrame, metric: str, name: str, agg) -> DataFrame:
    """p95 of the hourly points of a metric, by file system."""
    hours = metrics.where(F.col("metric") == metric).groupBy(*SCOPE, "resource_id", F.date_trunc("hour", "ts").alias("hour")).agg(agg("value").alias("value"))
    return hours.groupBy(*SCOPE, F.col("resource_id").alias("file_system_id")).agg(percentile_floor(F.col("value"), 0.95).alias(name))


def efs_use(
    filesystems: DataFrame, metrics: DataFrame, as_of, *, lookback_days: int = 14, min_points: int = 7, idle_p95_bytes: float = 5 * 1024.0**2,
    max_connections: float = 0.0, io_limit_p95: float = 20.0,
) -> DataFrame:
    """D23 unused: enough days with reads and writes, p95 of their daily sum and the most client
    connections at or below the limits. D24 provisioned throughput whose hourly IO-limit
    percentage never exceeds the limit (needs points)."""
    name = [*SCOPE, "resource_id"]
    days = lambda m, n: daily_series(metrics, m, as_of, lookback_days).select(*name, "day", F.col("value").alias(n))
    io = days("DataReadIOBytes", "r").join(days("DataWriteIOBytes", "w"), [*name, "day"]).groupBy(*name).agg(
        F.count(F.lit(1)).alias("points"), percentile_floor(F.col("r") + F.col("w"), 0.95).alias("io_p95")
    )
    seen = _in_window(metrics, as_of, lookback_days).groupBy(*name).agg(
        F.max(F.when(F.col("metric") == "ClientConnections", F.col("value"))).alias("connections"),
        F.max(F.when(F.col("metric") == "PercentIOLimit", F.col("value"))).alias("io_limit"),
    )
    f = filesystems.withColumn("resource_id", F.col("file_system_id")).join(io, name, "left").join(seen, name, "left")
    base = dict(service=F.lit("AmazonEFS"), resource_type=F.lit("file_system"), resource_id=F.col("file_system_id"))
    unused = (F.col("points") >= min_points) & (F.col("io_p95") <= idle_p95_bytes) & (F.coalesce("connections", F.lit(0.0)) <= max_connections)
    d23 = _draft(
        f.where(unused), check_id=F.lit("aws.efs.filesystems.unused"), severity_level=F.lit("medium"), severity_score=F.lit(700),
        detail=F.concat_ws("|", F.col("points").cast("string"), F.format_string("%.0f", "io_p95")), **base,
    )
    d24 = _draft(
        f.where((F.lower("throughput_mode") == "provisioned") & (F.col("io_limit") <= io_limit_p95)),
        check_id=F.lit("aws.efs.filesystems.provisioned.throughput.underutilized"), severity_level=F.lit("medium"), severity_score=F.lit(650),
        detail=F.format_string("%.6f", "io_limit"), **base,
    )
    return d23.unionByName(d24)


def fsx_findings(
    filesystems: DataFrame, metrics: DataFrame, prices: DataFrame, as_of, *, lookback_days: int = 14, util_p95: float = 20.0, large_gib: int = 4096,
    low_retention_days: int = 7, ssd_util_p95: float = 10.0, ssd_mib_s: float = 1.0,
) -> DataFrame:
    """D28 required tags, D29 no activity, D30 throughput underused, D31 large and inactive,
    D32 Multi-AZ outside production, D33 five Windows settings, D34 SSD storage under little
    load (savings: the price step to HDD).

    ``filesystems``: file_system_id, fs_type, deployment, storage_gib, throughput, storage_type,
    backup_days, copy_tags, maintenance (``d:HH:MM``), tags.
    """
    m = _in_window(metrics, as_of, lookback_days)
    name = [*SCOPE, "file_system_id"]
    act = m.where(F.col("metric").isin(*FSX_ACTIVITY)).groupBy(*SCOPE, F.col("resource_id").alias("file_system_id")).agg(F.max((F.col("value") > 0).cast("int")).alias("active"))
    f = filesystems.join(act, name, "left").withColumn("seen", F.col("active").isNotNull()).withColumn("active", F.coalesce("active", F.lit(0)) == 1)
    for i, metric in enumerate(FSX_UTILIZATION):
        f = f.join(_hourly_p95(m, metric, f"u{i}", F.avg), name, "left")
    f = f.join(_hourly_p95(m, "DataReadBytes", "read95", F.sum), name, "left").join(_hourly_p95(m, "DataWriteBytes", "write95", F.sum), name, "left")
    f = f.withColumn("util", F.coalesce(*[F.col(f"u{i}") for i in range(len(FSX_UTILIZATION))]))
    rw = (F.coalesce("read95", F.lit(0.0)) + F.coalesce("write95", F.lit(0.0))) / 3600.0 / 1024.0**2
    f = f.withColumn("mib_s", F.when(F.col("read95").isNotNull() | F.col("write95").isNotNull(), rw))
    nonprod = non_production(F.col("tags"), FSX_ENVIRONMENT_KEYS, FSX_NONPROD_WORDS, mode="contains", name_key="name")
    base = dict(service=F.lit("AmazonFSx"), resource_type=F.lit("file_system"), resource_id=F.col("file_system_id"))

    def rule(rows: DataFrame, check: str, level: str, score: int, confidence: Column | int | None = None, **more: Column) -> DataFrame:
        conf = F.lit(confidence) if not isinstance(confidence, Column) else confidence
        return _draft(rows, check_id=F.lit(check), severity_level=F.lit(level), severity_score=F.lit(score), confidence=conf.cast("int"), **base, **more)

    missing = missing_required(F.col("tags"), FSX_REQUIRED_TAGS)
    out = [
        rule(f.withColumn("_m", missing).where(F.size("_m") > 0), "aws.fsx.filesystems.missing.required.tags", "low", 300, detail=F.array_join("_m", ",")),
        rule(f.where(~F.col("active")), "aws.fsx.filesystems.possible.unused", "medium", 650, F.when(F.col("seen"), 60).otherwise(35), detail=F.col("fs_type")),
        rule(f.where((F.col("throughput") > 0) & (F.col("util") < util_p95)), "aws.fsx.filesystems.underutilized.throughput", "medium", 700, 65, detail=F.format_string("%.6f", "util")),
        rule(f.where((F.col("storage_gib") >= large_gib) & ~F.col("active")), "aws.fsx.filesystems.large.and.inactive", "low", 350, 40, detail=F.col("storage_gib").cast("string")),
        rule(
            f.where(F.upper(F.coalesce("deployment", F.lit(""))).contains("MULTI_AZ") & nonprod & F.col("fs_type").isin("WINDOWS", "ONTAP")),
            "aws.fsx.filesystems.multi.az.in.nonprod", "medium", 650, 70, detail=F.col("deployment"),
        ),
    ]
    w = f.where(F.col("fs_type") == "WINDOWS")
    maintenance = F.trim(F.coalesce("maintenance", F.lit("")))
    hour = F.get(F.split(maintenance, ":"), F.lit(1)).try_cast("int")
    out += [
        rule(w.where(F.col("backup_days") == 0), "aws.fsx.windows.backups.disabled", "high", 850, 90),
        rule(w.where((F.col("backup_days") > 0) & (F.col("backup_days") < low_retention_days)), "aws.fsx.windows.backup.retention.low", "medium", 650, 80, detail=F.col("backup_days").cast("string")),
        rule(w.where(~F.col("copy_tags")), "aws.fsx.windows.copy.tags.to.backups.disabled", "low", 300, 90),
        rule(w.where(maintenance == ""), "aws.fsx.windows.maintenance.window.missing", "low", 250, 70),
        rule(w.where(hour.between(8, 18) & ~nonprod), "aws.fsx.windows.maintenance.window.business.hours", "low", 250, 55, detail=maintenance),
    ]
    idle = w.where((F.col("storage_type") == "SSD") & (~F.col("active") | (F.col("util") < ssd_util_p95) | (F.col("mib_s") < ssd_mib_s)))
    idle = price_lookup(idle, prices, region=F.col("region"), kind="fsx_gb_month", key=F.lit("ssd")).withColumnsRenamed({"unit_price": "ssd", "price_confidence": "ssd_conf"})
    idle = price_lookup(idle, prices, region=F.col("region"), kind="fsx_gb_month", key=F.lit("hdd"))
    gib = F.when(F.col("storage_gib") > 0, F.col("storage_gib"))
    step = F.round(gib * F.greatest(F.lit(0.0), F.col("ssd") - F.col("unit_price")), 2)
    out.append(
        rule(
            idle, "aws.fsx.windows.storage.type.mismatch", "low", 350, F.least(F.lit(40), F.least("ssd_conf", "price_confidence")),
            monthly_cost=F.round(gib * F.col("ssd"), 2).cast(MONEY), monthly_savings=F.when(step > 0, step).cast(MONEY), detail=F.coalesce(F.col("storage_gib").cast("string"), F.lit("")),
        )
    )
    drafts = out[0]
    for d in out[1:]:
        drafts = drafts.unionByName(d)
    return drafts
