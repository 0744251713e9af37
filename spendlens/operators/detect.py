"""Detectors: inventory / metric / price tables -> finding drafts (D-series).

Each detector is a DataFrame job whose output is the flat draft shape that
``contract.to_findings`` turns into storage findings (``DRAFT_COLUMNS``).
Metric series are reduced to daily points inside a lookback window first, so
every per-resource list that is collected (for an exact floor percentile) is
bounded by the window length, independent of table size. Inventory joins are
equi-joins (or anti-joins) on resource keys; price tables are dimensions.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.coerce import MONEY
from ..functions.stats import percentile_floor
from ..functions.tags import missing_required, suppressed
from ..sources.prices import price_ladder

DRAFT_COLUMNS = [
    "tenant_id",
    "account_id",
    "region",
    "service",
    "resource_type",
    "resource_id",
    "check_id",
    "status",
    "severity_level",
    "severity_score",
    "monthly_cost",
    "monthly_savings",
    "confidence",
    "detail",
]

#: where a name is unique; inventories, metrics and references all carry these columns and join on them
SCOPE = ["tenant_id", "account_id", "region"]

# Prices (USD) that stand in where no table has one.
NAT_USD = {"hour": 0.045, "gb": 0.045}
LAMBDA_GB_SECOND_USD = 0.0000166667
LB_HOUR_USD = {"application": 0.0225, "network": 0.0225}
BACKUP_GB_MONTH_USD = {"warm": 0.05, "cold": 0.01}

# Suppression tag keys / values / prefixes by resource family.
EBS_SUPPRESS_KEYS = ("retain", "retention", "keep", "do_not_delete", "donotdelete", "backup", "purpose", "lifecycle")
EBS_SUPPRESS_VALUES = ("retain", "retained", "keep", "true", "yes", "1", "permanent", "legal-hold")
EBS_SUPPRESS_PREFIXES = ("keep", "retain", "do-not-delete", "do_not_delete", "donotdelete")
LOGS_SUPPRESS_KEYS = ("retain", "retention", "keep", "do_not_delete", "donotdelete", "lifecycle")
BACKUP_SUPPRESS_KEYS = ("retain", "legal-hold", "legal_hold", "backup-policy", "backup_policy", "suppress", "keep")
NAT_SUPPRESS_KEYS = ("finops:ignore", "do-not-delete", "keep")
REQUIRED_INSTANCE_TAGS = ("ApplicationId", "Environment", "Application")


@dataclass(frozen=True)
class DetectorParams:
    """Fixed default thresholds (detector configuration)."""

    ebs_unattached_min_age_days: int = 7
    ebs_recent_grace_hours: int = 24
    nat_lookback_days: int = 14
    nat_min_daily_points: int = 7
    nat_idle_p95_daily_bytes: float = 1_048_576.0
    nat_high_data_gib_month: float = 100.0
    nat_orphan_min_age_days: int = 1
    lambda_lookback_days: int = 14
    lambda_min_daily_points: int = 7
    lambda_idle_p95_daily_invocations: float = 1.0
    lambda_min_memory_mb: int = 1024
    lambda_max_p95_duration_ms: float = 250.0
    lambda_max_duration_to_timeout: float = 0.20
    lambda_min_invocations: int = 100
    alarms_high_count: int = 100
    alarm_usd_per_month: float = 0.10


def _draft(df: DataFrame, **cols: Column) -> DataFrame:
    defaults = {
        "status": F.lit("fail"),
        "monthly_cost": F.lit(None).cast(MONEY),
        "monthly_savings": F.lit(None).cast(MONEY),
        "confidence": F.lit(None).cast("int"),
        "detail": F.lit(""),
    }
    return df.select(*[(cols[c] if c in cols else defaults.get(c, F.col(c))).alias(c) for c in DRAFT_COLUMNS])


def _age_days(ts: Column, as_of: Column) -> Column:
    return F.floor((F.unix_micros(as_of) - F.unix_micros(ts)) / F.lit(86400e6)).cast("int")


# ---------------------------------------------------------------------------
# Storage: EBS volumes
# ---------------------------------------------------------------------------


def ebs_volume_findings(volumes: DataFrame, prices: DataFrame, as_of, params: DetectorParams = DetectorParams()) -> DataFrame:
    """D18 unattached, D19 gp2->gp3, D20 unencrypted for non-suppressed volumes.

    ``volumes``: tenant_id, account_id, region, volume_id, state, attachment_count,
    volume_type, size_gb, encrypted, create_time, tags. ``prices``: region,
    volume_type, usd_per_gb_month (dimension, joined on equality keys).
    """
    now = F.lit(as_of).cast("timestamp")
    v = volumes.where(~suppressed(F.col("tags"), EBS_SUPPRESS_KEYS, EBS_SUPPRESS_VALUES, EBS_SUPPRESS_PREFIXES))
    p = prices.select("region", "volume_type", F.col("usd_per_gb_month").cast("decimal(12,6)").alias("price"))
    gp = prices.groupBy("region").agg(
        F.max(F.when(F.col("volume_type") == "gp2", F.col("usd_per_gb_month"))).cast("decimal(12,6)").alias("p_gp2"),
        F.max(F.when(F.col("volume_type") == "gp3", F.col("usd_per_gb_month"))).cast("decimal(12,6)").alias("p_gp3"),
    )
    v = v.join(p, ["region", "volume_type"], "left").join(gp, ["region"], "left")
    size = F.col("size_gb").cast("decimal(18,2)")
    age = _age_days(F.col("create_time"), now)
    cost = (size * F.col("price")).cast(MONEY)
    unattached = v.where(
        (F.col("attachment_count") == 0)
        & F.lower(F.coalesce(F.col("state"), F.lit(""))).isin("available", "")
        & (F.unix_micros(now) - F.unix_micros("create_time") >= F.lit(params.ebs_recent_grace_hours * 3600e6))
        & (age >= params.ebs_unattached_min_age_days)
    )
    d18 = _draft(
        unattached,
        service=F.lit("AmazonEC2"),
        resource_type=F.lit("ebs_volume"),
        resource_id=F.col("volume_id"),
        check_id=F.lit("aws.ec2.ebs.unattached.volume"),
        severity_level=F.when(cost < 50, "medium").otherwise("high"),
        severity_score=F.when(cost < 50, 700).otherwise(850),
        monthly_cost=cost,
        monthly_savings=cost,
        detail=F.concat_ws("|", F.col("volume_type"), F.col("size_gb").cast("string"), age.cast("string")),
    )
    gp2 = v.where((F.lower("volume_type") == "gp2") & (F.col("p_gp2") > F.col("p_gp3")))
    d19 = _draft(
        gp2,
        service=F.lit("AmazonEC2"),
        resource_type=F.lit("ebs_volume"),
        resource_id=F.col("volume_id"),
        check_id=F.lit("aws.ec2.ebs.gp2.to.gp3"),
        severity_level=F.lit("medium"),
        severity_score=F.lit(650),
        monthly_cost=(size * F.col("p_gp2")).cast(MONEY),
        monthly_savings=(size * (F.col("p_gp2") - F.col("p_gp3"))).cast(MONEY),
        detail=F.col("size_gb").cast("string"),
    )
    unenc = v.where(~F.coalesce(F.col("encrypted"), F.lit(False)))
    d20 = _draft(
        unenc,
        service=F.lit("AmazonEC2"),
        resource_type=F.lit("ebs_volume"),
        resource_id=F.col("volume_id"),
        check_id=F.lit("aws.ec2.ebs.volume.unencrypted"),
        severity_level=F.lit("high"),
        severity_score=F.lit(900),
        detail=F.when(F.col("encrypted").isNull(), "unknown").otherwise("false"),
    )
    return d18.unionByName(d19).unionByName(d20)


def instance_tag_findings(instances: DataFrame, required=REQUIRED_INSTANCE_TAGS, params: DetectorParams = DetectorParams()) -> DataFrame:
    """Instances with any required tag missing or blank (keys compared case-insensitively)."""
    miss = missing_required(F.col("tags"), required)
    i = instances.withColumn("_miss", miss).where(F.size("_miss") > 0)
    d = _draft(
        i,
        service=F.lit("AmazonEC2"),
        resource_type=F.lit("instance"),
        resource_id=F.col("instance_id"),
        check_id=F.lit("aws.ec2.instances.tags.missing"),
        severity_level=F.lit("low"),
        severity_score=F.lit(300),
        detail=F.array_join("_miss", ","),
    )
    return d


# ---------------------------------------------------------------------------
# Metric series
# ---------------------------------------------------------------------------


def daily_series(metrics: DataFrame, metric: str, as_of, lookback_days: int, *, agg: str = "sum", scale: float = 1.0) -> DataFrame:
    """Daily points (scope, resource_id, day, value) of one metric over [as_of - lookback, as_of).

    Pre-aggregates raw points to one row per resource and day (map-side
    partial aggregation), which bounds every later per-resource list.
    """
    now = F.lit(as_of).cast("timestamp")
    m = metrics.where((F.col("metric") == metric) & (F.col("ts") >= now - F.make_interval(days=F.lit(lookback_days))) & (F.col("ts") < now))
    fn = {"sum": F.sum, "avg": F.avg, "max": F.max}[agg]
    return m.groupBy(*SCOPE, "resource_id", F.to_date("ts").alias("day")).agg((fn("value") * F.lit(scale)).alias("value"))


def series_stats(daily: DataFrame, p: float = 0.95) -> DataFrame:
    """Per resource: points, sum, max and floor percentile of the daily values."""
    return daily.groupBy(*SCOPE, "resource_id").agg(
        F.count(F.lit(1)).alias("points"),
        F.sum("value").alias("total"),
        F.max("value").alias("max_value"),
        percentile_floor(F.col("value"), p).alias("p95"),
    )


# ---------------------------------------------------------------------------
# Network: NAT gateways
# ---------------------------------------------------------------------------


def nat_findings(
    nats: DataFrame,
    routes: DataFrame,
    subnets: DataFrame,
    metrics: DataFrame,
    as_of,
    *,
    bytes_metric: str = "BytesOutToDestination",
    bytes_scale: float = 1.0,
    prices: DataFrame | None = None,
    params: DetectorParams = DetectorParams(),
) -> DataFrame:
    """D52 orphaned (in no route, not being deleted, age >= 1 d or unknown), D53 cross-AZ (associated subnet in
    another AZ; route tables with an internet-gateway default route ignored),
    D54 idle (>= N daily points, p95 daily bytes below threshold), D55 high data
    processing (bytes scaled to 30 days). Unreferenced gateways that are not
    being deleted skip D53-D55. ``prices``: kind ``nat``, keys ``hour`` and ``gb``.
    """
    now = F.lit(as_of).cast("timestamp")
    n = nats.where(~suppressed(F.col("tags"), NAT_SUPPRESS_KEYS)).withColumnRenamed("resource_id", "nat_id")
    for k in ("hour", "gb"):
        n = price_ladder(n, prices, kind="nat", region=F.col("region"), key=F.lit(k), as_of=as_of, fallback=NAT_USD, name=f"{k}_usd")
    referenced = routes.select(F.col("nat_gateway_id").alias("nat_id")).distinct()
    age = _age_days(F.col("create_time"), now)
    hourly_cost = F.round(F.col("hour_usd") * 730.0, 6).cast(MONEY)
    hour_conf = F.col("hour_usd_confidence").cast("int")
    unreferenced = n.join(referenced, "nat_id", "left_anti")
    deleting = F.coalesce(F.lower("state"), F.lit("")) == "deleting"
    orphan = unreferenced.where(~deleting & (F.col("create_time").isNull() | (age >= params.nat_orphan_min_age_days)))
    d52 = _draft(
        orphan,
        service=F.lit("AmazonVPC"),
        resource_type=F.lit("nat_gateway"),
        resource_id=F.col("nat_id"),
        check_id=F.lit("aws.ec2.nat.gateways.orphaned"),
        severity_level=F.lit("medium"),
        severity_score=F.lit(600),
        monthly_cost=hourly_cost,
        monthly_savings=hourly_cost,
        confidence=hour_conf,
        detail=F.coalesce(age.cast("string"), F.lit("unknown")),
    )
    live = n.join(referenced, "nat_id", "left_semi").unionByName(unreferenced.where(deleting))
    # Routes x associations (equi joins), then the inequality filter on AZ
    private = routes.where(~F.col("has_igw_default")).select(F.col("nat_gateway_id").alias("nat_id"), "subnet_id").distinct()
    assoc = private.join(subnets.select("subnet_id", F.col("az").alias("subnet_az")), "subnet_id")
    cross = (
        live.select("nat_id", F.col("az").alias("nat_az"))
        .join(assoc, "nat_id")
        .where(F.col("subnet_az") != F.col("nat_az"))
        .groupBy("nat_id")
        .agg(F.count_distinct("subnet_id").alias("cross_subnets"))
    )
    d53 = _draft(
        live.join(cross, "nat_id"),
        service=F.lit("AmazonVPC"),
        resource_type=F.lit("nat_gateway"),
        resource_id=F.col("nat_id"),
        check_id=F.lit("aws.ec2.nat.gateways.cross.az"),
        severity_level=F.lit("low"),
        severity_score=F.lit(350),
        detail=F.col("cross_subnets").cast("string"),
    )
    stats = series_stats(daily_series(metrics, bytes_metric, as_of, params.nat_lookback_days, scale=bytes_scale)).withColumnRenamed(
        "resource_id", "nat_id"
    )
    s = live.join(stats, [*SCOPE, "nat_id"])
    idle = s.where((F.col("points") >= params.nat_min_daily_points) & (F.col("p95") < params.nat_idle_p95_daily_bytes))
    d54 = _draft(
        idle,
        service=F.lit("AmazonVPC"),
        resource_type=F.lit("nat_gateway"),
        resource_id=F.col("nat_id"),
        check_id=F.lit("aws.ec2.nat.gateways.idle"),
        severity_level=F.lit("medium"),
        severity_score=F.lit(500),
        monthly_cost=hourly_cost,
        monthly_savings=hourly_cost,
        confidence=hour_conf,
        detail=F.format_string("%.6f", F.col("p95")),
    )
    monthly_gib = F.col("total") * (30.0 / F.col("points")) / F.lit(1024.0**3)
    high = s.withColumn("gib", monthly_gib).where(F.col("gib") >= params.nat_high_data_gib_month)
    data_cost = (F.col("gib") * F.col("gb_usd")).cast(MONEY)
    d55 = _draft(
        high,
        service=F.lit("AmazonVPC"),
        resource_type=F.lit("nat_gateway"),
        resource_id=F.col("nat_id"),
        check_id=F.lit("aws.ec2.nat.gateways.high.data.processing"),
        severity_level=F.lit("medium"),
        severity_score=F.lit(550),
        monthly_cost=(data_cost + hourly_cost).cast(MONEY),
        confidence=F.least(hour_conf, F.col("gb_usd_confidence")).cast("int"),
        detail=F.format_string("%.6f", F.col("gib")),
    )
    return d52.unionByName(d53).unionByName(d54).unionByName(d55)


# ---------------------------------------------------------------------------
# Compute: Lambda
# ---------------------------------------------------------------------------


def lambda_findings(
    functions: DataFrame,
    metrics: DataFrame,
    as_of,
    *,
    invocations_metric: str = "Invocations",
    duration_metric: str = "Duration",
    prices: DataFrame | None = None,
    params: DetectorParams = DetectorParams(),
) -> DataFrame:
    """D9 unused (>= N daily points, p95 daily invocations <= 1); D10 memory
    over-provisioned (>= 1024 MB, 0 < p95 duration <= 250 ms, duration/timeout
    <= 0.2, >= 100 invocations) for functions not flagged unused. ``prices``: kind ``lambda``,
    key ``gb_second``."""
    inv = series_stats(daily_series(metrics, invocations_metric, as_of, params.lambda_lookback_days)).select(
        *SCOPE, "resource_id", F.col("points").alias("inv_points"), F.col("total").alias("inv_total"), F.col("p95").alias("inv_p95")
    )
    dur = series_stats(daily_series(metrics, duration_metric, as_of, params.lambda_lookback_days, agg="avg")).select(
        *SCOPE, "resource_id", F.col("points").alias("dur_points"), F.col("p95").alias("dur_p95")
    )
    name = [*SCOPE, "resource_id"]
    f = functions.join(inv, name, "left").join(dur, name, "left")
    f = price_ladder(f, prices, kind="lambda", region=F.col("region"), key=F.lit("gb_second"), as_of=as_of, fallback=LAMBDA_GB_SECOND_USD, name="usd")
    unused = (F.coalesce("inv_points", F.lit(0)) >= params.lambda_min_daily_points) & (
        F.col("inv_p95") <= params.lambda_idle_p95_daily_invocations
    )
    d9 = _draft(
        f.where(unused),
        service=F.lit("AWSLambda"),
        resource_type=F.lit("function"),
        check_id=F.lit("aws.lambda.functions.unused"),
        severity_level=F.lit("low"),
        severity_score=F.lit(320),
        confidence=F.lit(20),
        detail=F.format_string("%.6f", F.col("inv_p95")),
    )
    over = (
        ~F.coalesce(unused, F.lit(False))
        & (F.coalesce("inv_points", F.lit(0)) >= params.lambda_min_daily_points)
        & (F.coalesce("dur_points", F.lit(0)) >= params.lambda_min_daily_points)
        & (F.col("memory_mb") >= params.lambda_min_memory_mb)
        & (F.col("dur_p95") > 0)
        & (F.col("dur_p95") <= params.lambda_max_p95_duration_ms)
        & ((F.col("timeout_s") <= 0) | ((F.col("dur_p95") / 1000.0) / F.col("timeout_s") <= params.lambda_max_duration_to_timeout))
        & (F.col("inv_total") >= params.lambda_min_invocations)
    )
    monthly_inv = F.col("inv_total") / F.greatest(F.col("inv_points"), F.lit(1)) * 30.0
    gb = F.col("memory_mb") / 1024.0
    cur_cost = monthly_inv * (F.col("dur_p95") / 1000.0) * gb * F.col("usd")
    new_cost = monthly_inv * (F.col("dur_p95") * 1.2 / 1000.0) * (gb * 0.5) * F.col("usd")
    d10 = _draft(
        f.where(over),
        service=F.lit("AWSLambda"),
        resource_type=F.lit("function"),
        check_id=F.lit("aws.lambda.functions.memory.overprovisioned"),
        severity_level=F.lit("medium"),
        severity_score=F.lit(560),
        monthly_cost=F.round(cur_cost, 6).cast(MONEY),
        monthly_savings=F.round(F.greatest(cur_cost - new_cost, F.lit(0.0)), 6).cast(MONEY),
        confidence=F.greatest(F.lit(20), F.least(F.col("usd_confidence"), F.lit(55))).cast("int"),
        detail=F.format_string("%.6f", F.col("dur_p95")),
    )
    return d9.unionByName(d10)


# ---------------------------------------------------------------------------
# Observability: alarm count
# ---------------------------------------------------------------------------


def alarms_high_count(alarms: DataFrame, params: DetectorParams = DetectorParams()) -> DataFrame:
    """Accounts (per region) with >= threshold alarms; cost = count x monthly alarm price."""
    g = alarms.groupBy("tenant_id", "account_id", "region").agg(F.count(F.lit(1)).alias("alarm_count"))
    hit = g.where(F.col("alarm_count") >= params.alarms_high_count)
    cost = (F.col("alarm_count") * F.lit(params.alarm_usd_per_month)).cast(MONEY)
    return _draft(
        hit,
        service=F.lit("AmazonCloudWatch"),
        resource_type=F.lit("account"),
        resource_id=F.col("account_id"),
        check_id=F.lit("aws.cloudwatch.alarms.high.count"),
        status=F.lit("info"),
        severity_level=F.lit("low"),
        severity_score=F.lit(200),
        monthly_cost=cost,
        monthly_savings=cost,
        detail=F.col("alarm_count").cast("string"),
    )


# ---------------------------------------------------------------------------
# Commitments: reserved instance coverage / utilization (D-RI1, D-RI2, J18, W9)
# ---------------------------------------------------------------------------

RI_BASE = ["tenant_id", "account_id", "region", "instance_type", "platform", "tenancy"]


def normalize_platform(c: Column) -> Column:
    t = F.lower(F.trim(F.coalesce(c, F.lit(""))))
    return (
        F.when(t == "", "linux")
        .when(F.instr(t, "windows") > 0, "windows")
        .when((F.instr(t, "red hat") > 0) | (F.instr(t, "rhel") > 0), "rhel")
        .when(F.instr(t, "suse") > 0, "suse")
        .otherwise("linux")
    )


def normalize_tenancy(c: Column) -> Column:
    t = F.lower(F.trim(F.coalesce(c, F.lit(""))))
    return F.when(t.isin("dedicated", "host"), t).otherwise("default")


def reserved_instance_findings(
    instances: DataFrame, reservations: DataFrame, on_demand: DataFrame, *, params: DetectorParams = DetectorParams(),
    min_gap: int = 1, low_utilization_pct: float = 80.0, savings_factor: float = 0.30, unused_factor: float = 0.70,
) -> DataFrame:
    """Two-stage reservation matching, set-based.

    Stage 1: zonal reservations cover running instances of the same
    (type, platform, tenancy, AZ): least(running, reserved) per zone. Stage 2:
    regional reservations cover what is left in the base, least(sum remaining,
    regional). Coverage gap (D-RI1) and low utilization (D-RI2) per base.
    Everything is grouped counts and equi-joins on the base key; no per-instance
    state. ``on_demand(instance_type, monthly_usd)`` is a price dimension.
    """
    inst = instances.where(F.lower("state") == "running").select(
        "tenant_id", "account_id", "region",
        F.lower(F.trim("instance_type")).alias("instance_type"),
        normalize_platform(F.col("platform")).alias("platform"),
        normalize_tenancy(F.col("tenancy")).alias("tenancy"),
        F.coalesce(F.nullif(F.lower(F.trim("az")), F.lit("")), F.lit("unknown")).alias("az"),
    ).where(F.col("instance_type") != "")
    run_az = inst.groupBy(*RI_BASE, "az").agg(F.count(F.lit(1)).alias("running"))
    res = reservations.where(F.lower("state") == "active").select(
        "tenant_id", "account_id", "region",
        F.lower(F.trim("instance_type")).alias("instance_type"),
        normalize_platform(F.col("product_description")).alias("platform"),
        normalize_tenancy(F.col("instance_tenancy")).alias("tenancy"),
        F.lower(F.trim(F.coalesce("scope", F.lit("")))).alias("scope"),
        F.lower(F.trim(F.coalesce("az", F.lit("")))).alias("az"),
        F.col("instance_count").cast("long").alias("cnt"),
    ).where((F.col("instance_type") != "") & (F.col("cnt") > 0))
    zonal = F.instr(F.col("scope"), "availability") > 0
    res_az = res.where(zonal & (F.col("az") != "")).groupBy(*RI_BASE, "az").agg(F.sum("cnt").alias("reserved"))
    res_reg = res.where(~(zonal & (F.col("az") != ""))).groupBy(*RI_BASE).agg(F.sum("cnt").alias("regional"))
    az = run_az.join(res_az, RI_BASE + ["az"], "full").fillna(0, ["running", "reserved"])
    az = az.withColumn("covered_az", F.least("running", "reserved"))
    base = az.groupBy(*RI_BASE).agg(
        F.sum("running").alias("running_count"),
        F.sum("reserved").alias("reserved_az"),
        F.sum("covered_az").alias("used_az"),
        F.sum(F.col("running") - F.col("covered_az")).alias("remaining"),
    )
    b = base.join(res_reg, RI_BASE, "full").fillna(0, ["running_count", "reserved_az", "used_az", "remaining", "regional"])
    b = b.withColumn("used", F.col("used_az") + F.least("remaining", "regional"))
    b = b.withColumns(
        {
            "reserved_count": F.col("reserved_az") + F.col("regional"),
            "uncovered": F.greatest(F.lit(0), F.col("running_count") - F.col("used")),
        }
    ).withColumns(
        {
            "unused": F.greatest(F.lit(0), F.col("reserved_count") - F.col("used")),
            "utilization": F.when(F.col("reserved_count") > 0, F.col("used") * 100.0 / F.col("reserved_count")).otherwise(100.0),
        }
    )
    b = b.join(
        on_demand.select(F.lower("instance_type").alias("instance_type"), F.col("monthly_usd").cast("decimal(18,4)").alias("od")),
        "instance_type",
        "left",
    )
    has_price = F.col("od").isNotNull() & (F.col("od") > 0)
    gap_cost = F.when(has_price, F.col("uncovered") * F.col("od"))
    detail = F.concat_ws("|", *[F.col(c).cast("string") for c in ("instance_type", "platform", "tenancy", "running_count", "reserved_count", "used")])
    ri1 = _draft(
        b.where(F.col("uncovered") >= max(1, min_gap)),
        service=F.lit("AmazonEC2"),
        resource_type=F.lit("reserved_instance_pool"),
        resource_id=detail,
        check_id=F.lit("aws.ec2.ri.coverage.gap"),
        severity_level=F.when(F.col("uncovered") >= 5, "high").otherwise("medium"),
        severity_score=F.when(F.col("uncovered") >= 5, 700).otherwise(560),
        monthly_cost=gap_cost.cast(MONEY),
        monthly_savings=F.round(gap_cost * F.lit(savings_factor).cast("decimal(4,2)"), 2).cast(MONEY),
        detail=F.col("uncovered").cast("string"),
    )
    ri2 = _draft(
        b.where((F.col("reserved_count") > 0) & (F.col("unused") > 0) & (F.col("utilization") < low_utilization_pct)),
        service=F.lit("AmazonEC2"),
        resource_type=F.lit("reserved_instance_pool"),
        resource_id=detail,
        check_id=F.lit("aws.ec2.ri.utilization.low"),
        severity_level=F.when(F.col("utilization") < 50.0, "high").otherwise("medium"),
        severity_score=F.when(F.col("utilization") < 50.0, 680).otherwise(540),
        monthly_cost=F.when(has_price, F.round(F.col("unused") * F.col("od") * F.lit(unused_factor).cast("decimal(4,2)"), 2)).cast(MONEY),
        detail=F.col("unused").cast("string"),
    )
    return ri1.unionByName(ri2)


# ---------------------------------------------------------------------------
# Configuration checks: RDS (D39, D42, D43), S3 governance (D35-D37), EKS
# ---------------------------------------------------------------------------

# Old-generation RDS families; engine version policy; EKS minimum version.
RDS_OLD_FAMILIES = ("m1", "m2", "m3", "m4", "r3", "r4", "t1", "t2", "x1")
RDS_MYSQL_BLOCKED_PREFIXES = ("5.6", "5.7")
RDS_POSTGRES_MIN_VERSION = (12, 0)
RDS_MARIADB_MIN_VERSION = (10, 6)
RDS_STORAGE_GB_MONTH_USD = "0.115"
EKS_MIN_SUPPORTED_VERSION = (1, 28)


def major_minor(version: Column) -> tuple[Column, Column]:
    """(major, minor) from leading digits of the first two dot parts; NULL when unparsable.
    A missing minor part counts as 0."""
    parts = F.split(F.trim(F.coalesce(version, F.lit(""))), r"\.", 3)
    major = F.nullif(F.regexp_extract(F.trim(F.try_element_at(parts, F.lit(1))), r"^(\d+)", 1), F.lit("")).cast("int")
    minor_txt = F.coalesce(F.try_element_at(parts, F.lit(2)), F.lit("0"))
    minor = F.nullif(F.regexp_extract(F.trim(minor_txt), r"^(\d+)", 1), F.lit("")).cast("int")
    ok = major.isNotNull() & minor.isNotNull()
    return F.when(ok, major), F.when(ok, minor)


def version_below(version: Column, minimum: tuple[int, int]) -> Column:
    """(major, minor) < minimum, False when the version cannot be parsed."""
    ma, mi = major_minor(version)
    below = (ma < minimum[0]) | ((ma == minimum[0]) & (mi < minimum[1]))
    return F.coalesce(below, F.lit(False))


def engine_needs_upgrade(engine: Column, version: Column) -> Column:
    eng = F.lower(F.trim(F.coalesce(engine, F.lit(""))))
    ver = F.trim(F.coalesce(version, F.lit("")))
    mysql = F.instr(eng, "mysql") > 0
    blocked = F.lit(False)
    for pfx in RDS_MYSQL_BLOCKED_PREFIXES:
        blocked = blocked | ver.startswith(pfx)
    return (
        F.when(mysql, (ver != "") & blocked)
        .when(F.instr(eng, "postgres") > 0, version_below(ver, RDS_POSTGRES_MIN_VERSION))
        .when(F.instr(eng, "mariadb") > 0, version_below(ver, RDS_MARIADB_MIN_VERSION))
        .otherwise(F.lit(False))
    )


def rds_config_findings(dbs: DataFrame, params: DetectorParams = DetectorParams()) -> DataFrame:
    """D39 stopped instance still billed for storage, D42 old-generation family, D43 engine upgrade."""
    cls = F.coalesce(F.col("instance_class"), F.lit(""))
    parts = F.split(cls, r"\.")
    family = F.when(cls.startswith("db.") & (F.size(parts) >= 3), F.try_element_at(parts, F.lit(2))).otherwise(F.lit(""))
    d = dbs.withColumn("family", family)
    price = F.lit(RDS_STORAGE_GB_MONTH_USD).cast("decimal(12,6)")
    stopped = d.where((F.lower(F.col("status")) == "stopped") & (F.col("allocated_gb") > 0))
    d39 = _draft(
        stopped,
        service=F.lit("AmazonRDS"),
        resource_type=F.lit("db_instance"),
        resource_id=F.col("db_instance_id"),
        check_id=F.lit("aws.rds.instances.stopped.storage"),
        severity_level=F.lit("medium"),
        severity_score=F.lit(500),
        monthly_cost=(F.col("allocated_gb").cast("decimal(18,2)") * price).cast(MONEY),
        monthly_savings=(F.col("allocated_gb").cast("decimal(18,2)") * price).cast(MONEY),
        detail=F.col("allocated_gb").cast("string"),
    )
    old = d.where(F.col("family").isin(*RDS_OLD_FAMILIES))
    d42 = _draft(
        old,
        service=F.lit("AmazonRDS"),
        resource_type=F.lit("db_instance"),
        resource_id=F.col("db_instance_id"),
        check_id=F.lit("aws.rds.instance.family.old.generation"),
        severity_level=F.lit("low"),
        severity_score=F.lit(320),
        detail=F.col("family"),
    )
    up = d.where(engine_needs_upgrade(F.col("engine"), F.col("engine_version")))
    d43 = _draft(
        up,
        service=F.lit("AmazonRDS"),
        resource_type=F.lit("db_instance"),
        resource_id=F.col("db_instance_id"),
        check_id=F.lit("aws.rds.engine.needs.upgrade"),
        severity_level=F.lit("high"),
        severity_score=F.lit(750),
        detail=F.concat_ws(" ", F.lower(F.trim("engine")), F.trim("engine_version")),
    )
    return d39.unionByName(d42).unionByName(d43)


def s3_governance_findings(buckets: DataFrame) -> DataFrame:
    """D35 lifecycle, D36 default encryption, D37 public access block: state 'missing' fails,
    'unknown' (could not be read) is informational, 'present' passes."""
    pab_flags = ["block_public_acls", "ignore_public_acls", "block_public_policy", "restrict_public_buckets"]
    all_on = F.lit(True)
    for c in pab_flags:
        all_on = all_on & F.coalesce(F.col(c), F.lit(False))
    pab_state = (
        F.when(F.col("pab_error"), "unknown").when(~F.col("pab_configured"), "missing").when(all_on, "present").otherwise("missing")
    )
    b = buckets.withColumn("pab_state", pab_state)
    outs = []
    for check, state_col, fail_sev in (
        ("aws.s3.governance.lifecycle.missing", "lifecycle_state", ("medium", 50)),
        ("aws.s3.governance.encryption.missing", "encryption_state", ("high", 80)),
        ("aws.s3.governance.public.access.block.missing", "pab_state", ("high", 85)),
    ):
        st = F.lower(F.col(state_col))
        hit = b.where(st.isin("missing", "unknown"))
        missing = st == "missing"
        outs.append(
            _draft(
                hit,
                service=F.lit("AmazonS3"),
                resource_type=F.lit("bucket"),
                resource_id=F.col("bucket_name"),
                check_id=F.lit(check),
                status=F.when(missing, "fail").otherwise("info"),
                severity_level=F.when(missing, fail_sev[0]).otherwise("low"),
                severity_score=F.when(missing, fail_sev[1]).otherwise(10),
                detail=st,
            )
        )
    return outs[0].unionByName(outs[1]).unionByName(outs[2])


def eks_findings(clusters: DataFrame) -> DataFrame:
    """D14 public-only endpoint, D15 control-plane logging disabled, D16 version below the minimum."""
    enabled = F.filter(F.coalesce(F.col("enabled_log_types"), F.array().cast("array<string>")), lambda x: F.trim(x) != "")
    base = dict(service=F.lit("AmazonEKS"), resource_type=F.lit("eks_cluster"), resource_id=F.col("cluster_name"))
    d14 = _draft(
        clusters.where(F.coalesce("endpoint_public", F.lit(False)) & ~F.coalesce("endpoint_private", F.lit(False))),
        check_id=F.lit("aws.eks.cluster.endpoint.public.only"), severity_level=F.lit("high"), severity_score=F.lit(820), **base,
    )
    d15 = _draft(
        clusters.where(F.size(enabled) == 0),
        check_id=F.lit("aws.eks.cluster.controlplane.logging.disabled"), severity_level=F.lit("medium"), severity_score=F.lit(520), **base,
    )
    d16 = _draft(
        clusters.where(version_below(F.col("version"), EKS_MIN_SUPPORTED_VERSION)),
        check_id=F.lit("aws.eks.cluster.version.outdated"), severity_level=F.lit("medium"), severity_score=F.lit(610),
        detail=F.trim("version"), **base,
    )
    return d14.unionByName(d15).unionByName(d16)


# ---------------------------------------------------------------------------
# Network security: unused security groups (D5), admin ports open to the world
# ---------------------------------------------------------------------------

# Administrative ports and "anywhere" ranges.
ADMIN_PORTS = (22, 3389)
WORLD_V4, WORLD_V6 = "0.0.0.0/0", "::/0"


def unused_security_groups(sgs: DataFrame, enis: DataFrame, sg_pairs: DataFrame) -> DataFrame:
    """Not 'default', attached to no network interface and in no SG-to-SG rule
    (as referrer or referenced). ``sg_pairs(group_id, ref_group_id)``; the used set
    is a distinct union and the test an anti-join (J14/U7)."""
    used = (
        enis.select("group_id")
        .unionByName(sg_pairs.select("group_id"))
        .unionByName(sg_pairs.select(F.col("ref_group_id").alias("group_id")))
        .where(F.col("group_id").isNotNull() & (F.col("group_id") != ""))
        .distinct()
    )
    cand = sgs.where(F.coalesce(F.col("group_name"), F.lit("")) != "default").join(used, "group_id", "left_anti")
    return _draft(
        cand,
        service=F.lit("AmazonEC2"),
        resource_type=F.lit("security_group"),
        resource_id=F.col("group_id"),
        check_id=F.lit("aws.ec2.security.groups.unused"),
        severity_level=F.lit("low"),
        severity_score=F.lit(250),
        detail=F.col("group_name"),
    )


def admin_ports_open(permissions: DataFrame, enis: DataFrame, instances: DataFrame) -> DataFrame:
    """Instances whose security groups expose 22 / 3389 to 0.0.0.0/0 or ::/0.

    ``permissions``: group_id + ``perms`` array<struct<proto, from_port, to_port,
    cidrs array<string>, cidrs6 array<string>>> (nested, as inventories carry it).
    Permissions are exploded per group, matched against the admin ports, and the
    exposed ports gathered per instance through its interfaces.
    """
    p = permissions.select("group_id", F.explode("perms").alias("p"))
    ports = F.array(*[F.lit(x) for x in ADMIN_PORTS])
    world = F.array_contains(F.coalesce(F.col("p.cidrs"), F.array().cast("array<string>")), WORLD_V4) | F.array_contains(
        F.coalesce(F.col("p.cidrs6"), F.array().cast("array<string>")), WORLD_V6
    )
    exposed = (
        p.where(world)
        .select("group_id", F.explode(ports).alias("port"), "p")
        .where((F.col("p.proto") == "-1") | ((F.col("p.from_port") <= F.col("port")) & (F.col("port") <= F.col("p.to_port"))))
        .select("group_id", "port")
        .distinct()
    )
    by_inst = enis.select("instance_id", "group_id").distinct().join(exposed, "group_id").groupBy("instance_id").agg(
        F.array_sort(F.collect_set("port")).alias("ports")
    )
    i = instances.join(by_inst, "instance_id")
    return _draft(
        i,
        service=F.lit("AmazonEC2"),
        resource_type=F.lit("instance"),
        resource_id=F.col("instance_id"),
        check_id=F.lit("aws.ec2.instances.security.admin.ports.open.world"),
        severity_level=F.lit("high"),
        severity_score=F.lit(850),
        detail=F.array_join(F.transform("ports", lambda x: x.cast("string")), ","),
    )


# ---------------------------------------------------------------------------
# Storage: EBS snapshots
# ---------------------------------------------------------------------------


def backup_managed(tags: Column, description: Column) -> Column:
    """Snapshot created by the backup service: an 'aws:backup:*' tag key, or 'aws backup'
    in a tag value or the description."""
    keys = F.map_keys(F.coalesce(tags, F.create_map().cast("map<string,string>")))
    vals = F.map_values(F.coalesce(tags, F.create_map().cast("map<string,string>")))
    return (
        F.exists(keys, lambda k: F.lower(F.trim(k)).startswith("aws:backup:"))
        | F.exists(vals, lambda v: F.instr(F.lower(v), "aws backup") > 0)
        | F.coalesce(F.instr(F.lower(description), "aws backup") > 0, F.lit(False))
    )


def ebs_snapshot_findings(
    snapshots: DataFrame, images: DataFrame, as_of, *, old_age_days: int = 45, usd_per_gb_month: str = "0.05",
    params: DetectorParams = DetectorParams(),
) -> DataFrame:
    """D21 old snapshot (>= N days, not referenced by an image), D22 unencrypted snapshot.

    Suppressed and backup-managed snapshots are skipped by both. The image
    reference test is an anti-join; the two checks are independent (K10: an
    image-referenced old snapshot is still checked for encryption).
    """
    now = F.lit(as_of).cast("timestamp")
    s = snapshots.where(
        ~suppressed(F.col("tags"), EBS_SUPPRESS_KEYS, EBS_SUPPRESS_VALUES, EBS_SUPPRESS_PREFIXES)
        & ~backup_managed(F.col("tags"), F.col("description"))
    )
    refs = images.select("snapshot_id").distinct()
    old = s.where(F.col("start_time") <= now - F.make_interval(days=F.lit(old_age_days))).join(refs, "snapshot_id", "left_anti")
    cost = (F.col("size_gb").cast("decimal(18,2)") * F.lit(usd_per_gb_month).cast("decimal(12,6)")).cast(MONEY)
    d21 = _draft(
        old,
        service=F.lit("AmazonEC2"),
        resource_type=F.lit("ebs_snapshot"),
        resource_id=F.col("snapshot_id"),
        check_id=F.lit("aws.ec2.ebs.old.snapshot"),
        severity_level=F.when(cost < 20, "low").otherwise("medium"),
        severity_score=F.when(cost < 20, 420).otherwise(620),
        monthly_cost=cost,
        monthly_savings=cost,
        detail=_age_days(F.col("start_time"), now).cast("string"),
    )
    unenc = s.where(~F.coalesce(F.col("encrypted"), F.lit(False)))
    d22 = _draft(
        unenc,
        service=F.lit("AmazonEC2"),
        resource_type=F.lit("ebs_snapshot"),
        resource_id=F.col("snapshot_id"),
        check_id=F.lit("aws.ec2.ebs.snapshot.unencrypted"),
        severity_level=F.lit("medium"),
        severity_score=F.lit(750),
        detail=F.col("size_gb").cast("string"),
    )
    return d21.unionByName(d22)


# ---------------------------------------------------------------------------
# Observability: log retention (D62), custom metrics from log filters
# ---------------------------------------------------------------------------

def log_retention_findings(log_groups: DataFrame) -> DataFrame:
    """Log groups without a retention policy (never expire), unless suppressed."""
    g = log_groups.where(F.col("retention_days").isNull() & ~suppressed(F.col("tags"), LOGS_SUPPRESS_KEYS, EBS_SUPPRESS_VALUES, EBS_SUPPRESS_PREFIXES))
    return _draft(
        g,
        service=F.lit("AmazonCloudWatch"),
        resource_type=F.lit("log_group"),
        resource_id=F.col("log_group"),
        check_id=F.lit("aws.logs.log.groups.retention.missing"),
        severity_level=F.lit("medium"),
        severity_score=F.lit(450),
    )


def custom_metric_findings(filters: DataFrame, *, usd_per_metric_month: str = "0.30", min_metrics: int = 1) -> DataFrame:
    """One informational finding per custom metric (namespace:metric) created by
    log metric filters, with the number of filters and of distinct log groups feeding it;
    emitted only where an account/region has at least ``min_metrics`` such metrics."""
    keys = ["tenant_id", "account_id", "region"]
    per_metric = filters.where(F.col("namespace").isNotNull() & F.col("metric_name").isNotNull()).groupBy(
        *keys, "namespace", "metric_name"
    ).agg(F.count(F.lit(1)).alias("filters"), F.count_distinct("log_group").alias("log_groups"))
    per_scope = per_metric.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_metrics")).where(F.col("n_metrics") >= min_metrics)
    m = per_metric.join(per_scope, keys, "left_semi")
    cost = F.lit(usd_per_metric_month).cast(MONEY)
    return _draft(
        m,
        service=F.lit("AmazonCloudWatch"),
        resource_type=F.lit("custom_metric"),
        resource_id=F.concat_ws(":", "namespace", "metric_name"),
        check_id=F.lit("aws.cloudwatch.custom.metrics.from.log.filters"),
        status=F.lit("info"),
        severity_level=F.lit("low"),
        severity_score=F.lit(150),
        monthly_cost=cost,
        monthly_savings=cost,
        detail=F.concat_ws("|", F.col("filters").cast("string"), F.col("log_groups").cast("string")),
    )


# ---------------------------------------------------------------------------
# Containers: ECS
# ---------------------------------------------------------------------------

# Environment tag keys and non-production values for containers.
CONTAINERS_NONPROD_TAG_KEYS = ("env", "environment", "stage", "tier")
CONTAINERS_NONPROD_TAG_VALUES = ("dev", "test", "qa", "uat", "staging", "sandbox", "nonprod", "non-prod")


def ecs_findings(clusters: DataFrame, services: DataFrame) -> DataFrame:
    """D11 cluster with no services, tasks or instances; D12 active service with desired > 0 and
    nothing running; D13 non-production Fargate service without a Spot capacity provider."""
    from ..functions.tags import non_production

    idle = clusters.where(
        (F.col("active_services") == 0) & (F.col("running_tasks") == 0) & (F.col("pending_tasks") == 0) & (F.col("container_instances") == 0)
    )
    d11 = _draft(
        idle, service=F.lit("AmazonECS"), resource_type=F.lit("ecs_cluster"), resource_id=F.col("cluster_name"),
        check_id=F.lit("aws.ecs.cluster.possibly.unused"), severity_level=F.lit("low"), severity_score=F.lit(240),
    )
    # a service name is unique in its cluster
    service = F.concat_ws("/", "cluster_name", "service_name")
    active = services.where((F.upper(F.trim("status")) == "ACTIVE") & (F.col("desired_count") > 0))
    d12 = _draft(
        active.where(F.col("running_count") == 0), service=F.lit("AmazonECS"), resource_type=F.lit("ecs_service"),
        resource_id=service, check_id=F.lit("aws.ecs.service.zero.running"), severity_level=F.lit("medium"),
        severity_score=F.lit(620), detail=F.col("desired_count").cast("string"),
    )
    providers = F.filter(F.transform(F.col("providers"), lambda x: F.upper(F.trim(x))), lambda x: x != "")
    fargate = (F.upper(F.trim(F.coalesce("launch_type", F.lit("")))) == "FARGATE") | F.array_contains(providers, "FARGATE")
    spot = F.exists(providers, lambda x: x.endswith("SPOT"))
    nonprod = non_production(F.col("tags"), CONTAINERS_NONPROD_TAG_KEYS, CONTAINERS_NONPROD_TAG_VALUES)
    d13 = _draft(
        active.where(nonprod & fargate & ~spot), service=F.lit("AmazonECS"), resource_type=F.lit("ecs_service"),
        resource_id=service, check_id=F.lit("aws.ecs.service.nonprod.on_demand"), severity_level=F.lit("low"),
        severity_score=F.lit(260),
    )
    return d11.unionByName(d12).unionByName(d13)


# ---------------------------------------------------------------------------
# Commitments: savings plans (D-SP1, D-SP2, A20)
# ---------------------------------------------------------------------------


def savings_plan_findings(
    instances: DataFrame, plans: DataFrame, on_demand: DataFrame, *, min_gap_per_hour: str = "0.05",
    low_utilization_pct: float = 80.0, savings_factor: str = "0.25", unused_factor: str = "1.00",
) -> DataFrame:
    """Per account and region: on-demand demand ($/h, from running instances and the price
    dimension) against active commitment ($/h). Coverage gap (D-SP1) and low utilization
    (D-SP2); the five most common instance types ride along (A20, ranked within the scope)."""
    keys = ["tenant_id", "account_id", "region"]
    od = on_demand.select(F.lower("instance_type").alias("instance_type"), F.col("monthly_usd").cast("decimal(18,4)").alias("od"))
    inst = instances.where(F.lower("state") == "running").select(*keys, F.lower(F.trim("instance_type")).alias("instance_type")).where(F.col("instance_type") != "")
    demand = inst.join(od, "instance_type", "left").groupBy(*keys).agg(
        F.round(F.sum(F.when(F.col("od") > 0, F.col("od"))) / F.lit(730), 4).cast("decimal(18,4)").alias("demand")
    )
    types = inst.groupBy(*keys, "instance_type").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(*keys).orderBy(F.col("n").desc(), F.col("instance_type"))
    top = (
        types.withColumn("_r", F.row_number().over(w))
        .where("_r <= 5")
        .groupBy(*keys)
        .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_r", "instance_type", "n"))), lambda x: F.concat(x["instance_type"], F.lit(":"), x["n"].cast("string"))), ",").alias("top_types"))
    )
    commit = plans.where((F.lower("state") == "active") & (F.col("commitment") > 0)).groupBy(*keys).agg(F.round(F.sum("commitment"), 4).cast("decimal(18,4)").alias("commitment"))
    zero = F.lit(0).cast("decimal(18,4)")
    b = demand.join(commit, keys, "full").join(top, keys, "left").fillna({"top_types": ""})
    b = b.withColumns({"demand": F.coalesce("demand", zero), "commitment": F.coalesce("commitment", zero)})
    b = b.where((F.col("demand") > 0) | (F.col("commitment") > 0))
    covered = F.least("demand", "commitment")
    b = b.withColumns(
        {
            "uncovered": F.greatest(zero, F.col("demand") - F.col("commitment")),
            "unused": F.greatest(zero, F.col("commitment") - F.col("demand")),
            "utilization": F.when(F.col("commitment") > 0, covered * 100.0 / F.col("commitment")).otherwise(100.0),
        }
    )
    gap_cost = F.round(F.col("uncovered") * 730, 2)
    sp1 = _draft(
        b.where(F.col("uncovered") >= F.lit(min_gap_per_hour).cast("decimal(18,4)")),
        service=F.lit("AmazonEC2"),
        resource_type=F.lit("account"),
        resource_id=F.col("account_id"),
        check_id=F.lit("aws.ec2.savings.plans.coverage.gap"),
        severity_level=F.when(F.col("uncovered") >= 1, "high").otherwise("medium"),
        severity_score=F.when(F.col("uncovered") >= 1, 700).otherwise(560),
        monthly_cost=gap_cost.cast(MONEY),
        monthly_savings=F.round(gap_cost * F.lit(savings_factor).cast("decimal(4,2)"), 2).cast(MONEY),
        detail=F.concat_ws("|", F.col("demand").cast("string"), F.col("commitment").cast("string"), F.col("top_types")),
    )
    sp2 = _draft(
        b.where((F.col("commitment") > 0) & (F.col("utilization") < low_utilization_pct) & (F.col("unused") > 0)),
        service=F.lit("AmazonEC2"),
        resource_type=F.lit("account"),
        resource_id=F.col("account_id"),
        check_id=F.lit("aws.ec2.savings.plans.utilization.low"),
        severity_level=F.when(F.col("utilization") < 50.0, "high").otherwise("medium"),
        severity_score=F.when(F.col("utilization") < 50.0, 680).otherwise(540),
        monthly_cost=F.round(F.col("unused") * 730 * F.lit(unused_factor).cast("decimal(4,2)"), 2).cast(MONEY),
        detail=F.concat_ws("|", F.col("demand").cast("string"), F.col("commitment").cast("string"), F.col("top_types")),
    )
    return sp1.unionByName(sp2)


# ---------------------------------------------------------------------------
# Backup: plans without selections (D47), rules without lifecycle (D48), stale recovery points
# ---------------------------------------------------------------------------


def backup_findings(
    plans: DataFrame, selections: DataFrame, recovery_points: DataFrame, as_of, *, stale_days: int = 90,
    skip_if_deleting_within_days: int = 14, prices: DataFrame | None = None,
) -> DataFrame:
    """D47 plan with no selection (anti-join), D48 rule whose lifecycle moves and deletes
    nothing (rules exploded with their position), D49 recovery point older than N days,
    not deleted/expired, not expiring within M days, not suppressed; cost = size x class price
    (``prices``: kind ``backup_gb_month``, keys ``warm`` and ``cold``)."""
    now = F.lit(as_of).cast("timestamp")
    d47 = _draft(
        plans.join(selections.select("plan_id").distinct(), "plan_id", "left_anti"),
        service=F.lit("AWSBackup"), resource_type=F.lit("backup_plan"), resource_id=F.col("plan_id"),
        check_id=F.lit("aws.backup.plans.no.selections"), severity_level=F.lit("low"), severity_score=F.lit(45),
    )
    rules = plans.select("tenant_id", "account_id", "region", "plan_id", F.posexplode("rules").alias("pos", "rule"))
    no_lc = rules.where(F.coalesce(F.col("rule.move_days"), F.lit(0)) == 0).where(F.coalesce(F.col("rule.delete_days"), F.lit(0)) == 0)
    d48 = _draft(
        no_lc, service=F.lit("AWSBackup"), resource_type=F.lit("backup_rule"),
        resource_id=F.concat(F.col("plan_id"), F.lit("#"), (F.col("pos") + 1).cast("string")),
        check_id=F.lit("aws.backup.rules.no.lifecycle"), severity_level=F.lit("medium"), severity_score=F.lit(70),
    )
    rp = recovery_points.where(
        F.col("created").isNotNull()
        & ~F.upper(F.coalesce("status", F.lit(""))).isin("DELETED", "EXPIRED")
        & (F.col("created") < now - F.make_interval(days=F.lit(stale_days)))
        & (F.col("delete_at").isNull() | (F.col("delete_at") > now + F.make_interval(days=F.lit(skip_if_deleting_within_days))))
        & ~suppressed(F.col("tags"), BACKUP_SUPPRESS_KEYS, BACKUP_SUPPRESS_KEYS)
    )
    stored_as = F.when(F.upper("storage_class") == "COLD", "cold").otherwise("warm")
    rp = price_ladder(rp, prices, kind="backup_gb_month", region=F.col("region"), key=stored_as, as_of=as_of, fallback=BACKUP_GB_MONTH_USD, name="usd")
    raw = F.col("size_gb").cast("decimal(18,2)") * F.col("usd").cast("decimal(12,6)")
    cost = F.when(raw > 0, F.round(raw, 2)).cast(MONEY)
    d49 = _draft(
        rp, service=F.lit("AWSBackup"), resource_type=F.lit("recovery_point"), resource_id=F.col("recovery_point_arn"),
        check_id=F.lit("aws.backup.recovery.points.stale"), severity_level=F.lit("medium"), severity_score=F.lit(65),
        monthly_cost=cost, monthly_savings=cost, detail=F.col("vault_name"),
        confidence=F.when(raw > 0, F.least(F.lit(90), F.greatest(F.lit(20), F.col("usd_confidence") + 10))).otherwise(10).cast("int"),
    )
    return d47.unionByName(d48).unionByName(d49)


# ---------------------------------------------------------------------------
# Compute: EC2 stopped long (D2), old generation (D3), IMDSv1 allowed
# ---------------------------------------------------------------------------

# Old-generation EC2 instance families.
EC2_OLD_FAMILIES = ("t1", "t2", "m1", "m2", "m3", "c1", "c3", "r3", "i2", "d2", "g2", "p2", "x1", "x1e")
# Fixed value: stop time inside the state-transition reason, "(YYYY-MM-DD[ HH:MM:SS])".
STOP_REASON_PATTERN = r"\((\d{4}-\d{2}-\d{2}(?: \d{2}:\d{2}:\d{2})?)\)"


def ec2_instance_findings(
    instances: DataFrame, volumes: DataFrame, prices: DataFrame, as_of, *, stopped_min_days: int = 30,
) -> DataFrame:
    """D2 stopped for >= N days (stop time from the transition reason, else launch time), with the
    attached volumes' size and storage cost (exploded device list joined to volumes and prices);
    D3 old-generation family; D4 IMDSv1 allowed (http tokens not 'required', missing counts)."""
    now = F.lit(as_of).cast("timestamp")
    raw = F.regexp_extract(F.coalesce("state_reason", F.lit("")), STOP_REASON_PATTERN, 1)
    stop_ts = F.coalesce(
        F.try_to_timestamp(F.nullif(raw, F.lit("")), F.lit("yyyy-MM-dd HH:mm:ss")),
        F.try_to_timestamp(F.nullif(raw, F.lit("")), F.lit("yyyy-MM-dd")),
        F.col("launch_time"),
    )
    age = ((F.unix_micros(now) - F.unix_micros(stop_ts)) / F.lit(86400e6)).cast("int")
    stopped = instances.where(F.lower("state") == "stopped").withColumn("age_days", age).where(
        F.col("age_days").isNotNull() & (F.col("age_days") >= stopped_min_days)
    )
    devices = stopped.select("instance_id", F.explode("volume_ids").alias("volume_id"))
    p = prices.select("region", "volume_type", F.col("usd_per_gb_month").cast("decimal(12,6)").alias("price"))
    vols = volumes.select("volume_id", "region", F.lower(F.coalesce("volume_type", F.lit("gp2"))).alias("volume_type"), "size_gb").join(
        p, ["region", "volume_type"], "left"
    )
    storage = devices.join(vols, "volume_id").groupBy("instance_id").agg(
        F.sum("size_gb").alias("size_gib"), F.sum(F.col("size_gb").cast("decimal(18,2)") * F.coalesce("price", F.lit(0))).alias("storage_cost")
    )
    s = stopped.join(storage, "instance_id", "left")
    d2 = _draft(
        s, service=F.lit("AmazonEC2"), resource_type=F.lit("instance"), resource_id=F.col("instance_id"),
        check_id=F.lit("aws.ec2.instances.stopped.long"), severity_level=F.lit("low"), severity_score=F.lit(350),
        monthly_cost=F.round(F.coalesce("storage_cost", F.lit(0)), 2).cast(MONEY),
        monthly_savings=F.round(F.coalesce("storage_cost", F.lit(0)), 2).cast(MONEY),
        detail=F.concat_ws("|", F.col("age_days").cast("string"), F.coalesce(F.col("size_gib"), F.lit(0)).cast("string")),
    )
    family = F.split(F.lower(F.coalesce("instance_type", F.lit(""))), r"\.").getItem(0)
    d3 = _draft(
        instances.withColumn("family", family).where(F.col("family").isin(*EC2_OLD_FAMILIES)), service=F.lit("AmazonEC2"),
        resource_type=F.lit("instance"), resource_id=F.col("instance_id"), check_id=F.lit("aws.ec2.instances.old.generation"),
        severity_level=F.lit("low"), severity_score=F.lit(250), detail=F.col("family"),
    )
    d4 = _draft(
        instances.where(F.coalesce(F.lower(F.trim("http_tokens")), F.lit("")) != "required"), service=F.lit("AmazonEC2"),
        resource_type=F.lit("instance"), resource_id=F.col("instance_id"), check_id=F.lit("aws.ec2.instances.security.imdsv1.allowed"),
        severity_level=F.lit("high"), severity_score=F.lit(800), detail=F.coalesce(F.col("http_tokens"), F.lit("missing")),
    )
    return d2.unionByName(d3).unionByName(d4)


# ---------------------------------------------------------------------------
# Load balancers: no listeners (D56), idle (D57), no registered (D58) or healthy (D59) targets
# ---------------------------------------------------------------------------

ELB_SUPPRESS_KEYS = ("finops:ignore", "do-not-delete", "keep")


def elbv2_findings(
    lbs: DataFrame, listeners: DataFrame, target_groups: DataFrame, targets: DataFrame, metrics: DataFrame, as_of, *,
    lookback_days: int = 14, min_points: int = 7, idle_p95: float = 1.0, min_age_days: int = 2, require_min_points: bool = True,
    prices: DataFrame | None = None,
) -> DataFrame:
    """Load balancers at least N days old (or of unknown age): D56 without listeners (no further
    checks for it); D57 idle: p95 of daily RequestCount (application) / NewFlowCount (network)
    <= threshold (K11: a minimum number of daily points is required unless
    ``require_min_points`` is off, in which case a missing series counts as 0); D58 forward
    target groups referenced (lambda groups excluded) and none of them has a registered
    target; D59 targets registered, none healthy. Cost: the hourly price over 30 days. Names
    of load balancers and target groups are unique in their account and region only.
    ``prices``: kind ``lb_hour``, key the type."""
    name, group = [*SCOPE, "lb_name"], [*SCOPE, "target_group"]
    now = F.lit(as_of).cast("timestamp")
    old_enough = F.col("created").isNull() | (F.unix_micros(now) - F.unix_micros("created") >= F.lit(min_age_days * 86400e6))
    lb = lbs.where(~suppressed(F.col("tags"), ELB_SUPPRESS_KEYS) & old_enough)
    lb = price_ladder(lb, prices, kind="lb_hour", region=F.col("region"), key=F.lower("lb_type"), as_of=as_of, fallback=LB_HOUR_USD, name="usd")
    monthly = F.round(F.col("usd").cast("decimal(18,6)") * 24 * 30, 2).cast(MONEY)
    conf = F.col("usd_confidence").cast("int")
    with_listener = listeners.select(*name).distinct()
    base = dict(service=F.lit("ElasticLoadBalancing"), resource_type=F.lit("load_balancer"), resource_id=F.col("lb_name"))
    d56 = _draft(
        lb.join(with_listener, name, "left_anti"), check_id=F.lit("aws.elbv2.load.balancers.no.listeners"),
        severity_level=F.lit("high"), severity_score=F.lit(75), monthly_cost=monthly, confidence=conf, **base,
    )
    live = lb.join(with_listener, name, "left_semi")
    req = series_stats(daily_series(metrics, "RequestCount", as_of, lookback_days)).select(
        *SCOPE, F.col("resource_id").alias("lb_name"), F.col("points").alias("req_points"), F.col("p95").alias("req_p95")
    )
    flows = series_stats(daily_series(metrics, "NewFlowCount", as_of, lookback_days)).select(
        *SCOPE, F.col("resource_id").alias("lb_name"), F.col("points").alias("flow_points"), F.col("p95").alias("flow_p95")
    )
    s = live.join(req, name, "left").join(flows, name, "left")
    is_app = F.lower("lb_type") == "application"
    points = F.when(is_app, F.col("req_points")).otherwise(F.col("flow_points"))
    p95 = F.when(is_app, F.col("req_p95")).otherwise(F.col("flow_p95"))
    enough = (F.coalesce(points, F.lit(0)) >= min_points) if require_min_points else F.lit(True)
    idle = F.lower("lb_type").isin("application", "network") & enough & (F.coalesce(p95, F.lit(0.0)) <= idle_p95)
    d57 = _draft(
        s.where(idle), check_id=F.lit("aws.elbv2.load.balancers.idle"), severity_level=F.lit("medium"),
        severity_score=F.lit(60), monthly_savings=monthly, confidence=conf, detail=F.format_string("%.6f", F.coalesce(p95, F.lit(0.0))), **base,
    )
    fwd = (
        listeners.where(F.lower("action_type") == "forward")
        .join(target_groups.where(F.lower("target_type") != "lambda").select(*group), group)
        .select(*name, "target_group")
        .distinct()
    )
    registered = targets.groupBy(*group).agg(F.lit(1).alias("_t"), F.max((F.col("health") == "healthy").cast("int")).alias("_h"))
    per_lb = fwd.join(registered, group, "left").groupBy(*name).agg(
        F.count(F.lit(1)).alias("groups"), F.max(F.coalesce("_t", F.lit(0))).alias("any_targets"), F.max(F.coalesce("_h", F.lit(0))).alias("any_healthy")
    )
    checked = live.join(per_lb, name)
    d58 = _draft(
        checked.where(F.col("any_targets") == 0), check_id=F.lit("aws.elbv2.load.balancers.no.registered.targets"),
        severity_level=F.lit("high"), severity_score=F.lit(75), monthly_savings=monthly, confidence=conf, detail=F.col("groups").cast("string"), **base,
    )
    d59 = _draft(
        checked.where((F.col("any_targets") == 1) & (F.col("any_healthy") == 0)), check_id=F.lit("aws.elbv2.load.balancers.no.healthy.targets"),
        severity_level=F.lit("high"), severity_score=F.lit(75), detail=F.col("groups").cast("string"), **base,
    )
    return d56.unionByName(d57).unionByName(d58).unionByName(d59)


# ---------------------------------------------------------------------------
# Edge: CloudFront caching disabled (D60), unused distribution
# ---------------------------------------------------------------------------

# Fixed value: id of the managed "caching disabled" cache policy.
MANAGED_CACHING_DISABLED_POLICY_ID = "413f160f-4f18-4c0b-95c7-bf7f44e8f58b"


def cloudfront_findings(
    distributions: DataFrame, metrics: DataFrame, as_of, *, lookback_days: int = 14, min_points: int = 7,
    idle_p95: float = 1.0, min_age_days: int = 7,
) -> DataFrame:
    """Enabled distribution whose default behavior uses the managed caching-disabled
    policy, or (without a policy) has min / default / max TTL all <= 0. D61: enabled, at least
    N days old, >= M daily request points and p95 daily requests <= threshold."""
    now = F.lit(as_of).cast("timestamp")
    d = distributions.where(F.coalesce("enabled", F.lit(False)))
    pol = F.trim(F.coalesce("cache_policy_id", F.lit("")))
    ttls_present = F.col("min_ttl").isNotNull() & F.col("default_ttl").isNotNull() & F.col("max_ttl").isNotNull()
    reason = (
        F.when(pol == MANAGED_CACHING_DISABLED_POLICY_ID, "managed_policy_caching_disabled")
        .when(pol != "", "")
        .when(ttls_present & (F.col("min_ttl") <= 0) & (F.col("default_ttl") <= 0) & (F.col("max_ttl") <= 0), "legacy_ttl_zero")
        .otherwise("")
    )
    base = dict(service=F.lit("AmazonCloudFront"), resource_type=F.lit("distribution"), resource_id=F.col("distribution_id"))
    d60 = _draft(
        d.withColumn("reason", reason).where(F.col("reason") != ""), check_id=F.lit("aws.cloudfront.distributions.caching.disabled"),
        severity_level=F.lit("medium"), severity_score=F.lit(520), detail=F.col("reason"), **base,
    )
    req = series_stats(daily_series(metrics, "Requests", as_of, lookback_days)).withColumnRenamed("resource_id", "distribution_id")
    age = _age_days(F.col("created"), now)
    cand = d.where(F.col("created").isNull() | (age >= min_age_days)).join(req, [*SCOPE, "distribution_id"])
    d61 = _draft(
        cand.where((F.col("points") >= min_points) & (F.col("p95") <= idle_p95)), check_id=F.lit("aws.cloudfront.distributions.unused"),
        severity_level=F.lit("medium"), severity_score=F.lit(560), detail=F.format_string("%.6f", F.col("p95")), **base,
    )
    return d60.unionByName(d61)
