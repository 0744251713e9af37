"""Detectors that need prices or long series: rightsizing, storage and replica use.

Prices come from a price table through ``price_lookup`` (exact price, else a
fixed fallback, else none), and its confidence becomes the finding's. Series
are reduced to daily points first, so a resource's list is never longer than
the lookback window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.coerce import MONEY
from ..functions.stats import percentile_linear
from ..functions.tags import non_production, normalize_tags
from ..sources.prices import price_lookup
from .detect import CONTAINERS_NONPROD_TAG_KEYS, CONTAINERS_NONPROD_TAG_VALUES, SCOPE, _draft, daily_series

HOURS_PER_MONTH = 730
#: fixed values: instance sizes in rising order
SIZES = [
    "nano", "micro", "small", "medium", "large", "xlarge", "2xlarge", "3xlarge", "4xlarge", "6xlarge", "8xlarge", "9xlarge", "10xlarge",
    "12xlarge", "16xlarge", "18xlarge", "24xlarge", "32xlarge", "48xlarge", "56xlarge",
]
#: fixed values: tags of replicas that are meant to be idle, and environment tags
REPLICA_KEEP_KEYS = ("retain", "do_not_delete", "donotdelete", "keep")
REPLICA_KEEP_VALUES = ("1", "true", "yes", "y")
REPLICA_PURPOSE_KEYS = ("purpose", "role", "usage", "workload", "service", "component")
REPLICA_PURPOSE_VALUES = ("failover", "disaster-recovery", "disasterrecovery", "migration")
ENVIRONMENT_KEYS = ("env", "environment")
NONPROD_VALUES = ("dev", "test", "nprd", "staging", "nonprod", "non-prod", "sandbox", "qa", "uat")


def smaller_type(instance_type: Column) -> Column:
    """the next smaller size of the family (``m5.xlarge`` -> ``m5.large``), NULL at the end of the ladder."""
    t = F.lower(F.trim(F.coalesce(instance_type, F.lit(""))))
    family, size = F.substring_index(t, ".", 1), F.when(F.instr(t, ".") > 0, F.substring_index(t, ".", -1))
    at = F.array_position(F.array(*map(F.lit, SIZES)), size).cast("int")
    return F.when((family != "") & (at > 1), F.concat(family, F.lit("."), F.get(F.array(*map(F.lit, SIZES)), at - 2)))


def _monthly(price: Column) -> Column:
    return F.round(price * HOURS_PER_MONTH, 2)


def underutilized_instances(
    instances: DataFrame, metrics: DataFrame, prices: DataFrame, as_of, *, lookback_days: int = 14, cpu_max: float = 10.0,
    net_max_kib_h: float = 512.0, fallback: dict[str, float] | None = None,
) -> DataFrame:
    """Running instances with metrics, average CPU and network at or below the limits.

    Savings: the price step to the next smaller type when that is cheaper, else
    the whole cost. ``metrics``: resource_id, metric (CPUUtilization, NetworkIn,
    NetworkOut), ts, value; network points are bytes an hour.
    """
    now = F.lit(as_of).cast("timestamp")
    m = metrics.where((F.col("ts") >= now - F.make_interval(days=F.lit(lookback_days))) & (F.col("ts") < now))

    def of(name: str, fn) -> Column:
        return fn(F.when(F.col("metric") == name, F.col("value")))

    use = m.where(F.col("metric").isin("CPUUtilization", "NetworkIn", "NetworkOut")).groupBy(*SCOPE, F.col("resource_id").alias("instance_id")).agg(
        F.coalesce(of("CPUUtilization", F.avg), F.lit(0.0)).alias("cpu"),
        ((F.coalesce(of("NetworkIn", F.sum), F.lit(0.0)) + F.coalesce(of("NetworkOut", F.sum), F.lit(0.0))) / 1024.0
         / F.greatest(of("NetworkIn", F.count), of("NetworkOut", F.count), F.lit(1))).alias("net"),
    )
    i = instances.where(F.lower("state") == "running").join(use, [*SCOPE, "instance_id"]).where((F.col("cpu") <= cpu_max) & (F.col("net") <= net_max_kib_h))
    i = i.withColumn("smaller", smaller_type(F.col("instance_type")))
    i = price_lookup(i, prices, region=F.col("region"), kind="ec2_hour", key=F.lower(F.trim("instance_type")), fallback=fallback)
    i = i.withColumnsRenamed({"unit_price": "price", "price_confidence": "confidence"})
    i = price_lookup(i, prices, region=F.col("region"), kind="ec2_hour", key=F.coalesce("smaller", F.lit("")), fallback=fallback)
    cost, less = _monthly(F.col("price")), _monthly(F.col("unit_price"))
    step = F.when(F.col("smaller").isNotNull() & (less < cost), F.round(cost - less, 2))
    conf = F.when(F.col("smaller").isNotNull(), F.least("confidence", "price_confidence")).otherwise(F.col("confidence"))
    return _draft(
        i, service=F.lit("AmazonEC2"), resource_type=F.lit("instance"), resource_id=F.col("instance_id"), check_id=F.lit("aws.ec2.instances.underutilized"),
        severity_level=F.lit("medium"), severity_score=F.lit(550), monthly_cost=cost.cast(MONEY), monthly_savings=F.coalesce(step, cost).cast(MONEY),
        confidence=conf.cast("int"),
        detail=F.concat_ws("|", F.col("instance_type"), F.coalesce("smaller", F.lit("")), F.format_string("%.6f", "cpu"), F.format_string("%.6f", "net")),
    )


def credit_issues(instances: DataFrame, metrics: DataFrame, as_of, *, lookback_days: int = 7, balance_min: float = 20.0) -> DataFrame:
    """T instances whose lowest credit balance is under the limit or that paid for surplus
    credits in the window; an instance without points counts as 0."""
    now = F.lit(as_of).cast("timestamp")
    m = metrics.where((F.col("ts") >= now - F.make_interval(days=F.lit(lookback_days))) & (F.col("ts") < now))
    use = m.groupBy(*SCOPE, F.col("resource_id").alias("instance_id")).agg(
        F.min(F.when(F.col("metric") == "CPUCreditBalance", F.col("value"))).alias("balance"),
        F.sum(F.when(F.col("metric") == "CPUSurplusCreditsCharged", F.col("value"))).alias("surplus"),
    )
    t = instances.where(F.lower(F.coalesce("instance_type", F.lit(""))).startswith("t")).join(use, [*SCOPE, "instance_id"], "left")
    t = t.withColumns({"balance": F.coalesce("balance", F.lit(0.0)), "surplus": F.coalesce("surplus", F.lit(0.0))})
    return _draft(
        t.where((F.col("balance") < balance_min) | (F.col("surplus") > 0)), service=F.lit("AmazonEC2"), resource_type=F.lit("instance"),
        resource_id=F.col("instance_id"), check_id=F.lit("aws.ec2.instances.t.credit.issues"), severity_level=F.lit("medium"), severity_score=F.lit(650),
        detail=F.concat_ws("|", F.col("instance_type"), F.format_string("%.2f", "balance"), F.format_string("%.2f", "surplus")),
    )


def nodegroups_on_demand(clusters: DataFrame, nodegroups: DataFrame) -> DataFrame:
    """Node groups of desired size > 0 on on-demand capacity (also when none is named),
    non-production by the cluster's tags overlaid with their own."""
    c = clusters.select(*SCOPE, "cluster_name", normalize_tags(F.col("tags")).alias("_cluster"))
    n = nodegroups.join(c, [*SCOPE, "cluster_name"]).withColumn("_own", normalize_tags(F.col("tags")))
    kept = F.map_filter("_cluster", lambda k, v: ~F.array_contains(F.map_keys("_own"), k))
    n = n.withColumn("tags", F.map_concat(kept, "_own")).where(
        (F.col("desired_size") > 0)
        & (F.upper(F.coalesce("capacity_type", F.lit("ON_DEMAND"))) == "ON_DEMAND")
        & non_production(F.col("tags"), CONTAINERS_NONPROD_TAG_KEYS, CONTAINERS_NONPROD_TAG_VALUES)
    )
    return _draft(
        n, service=F.lit("AmazonEKS"), resource_type=F.lit("nodegroup"), resource_id=F.col("nodegroup_name"), check_id=F.lit("aws.eks.nodegroup.nonprod.on_demand"),
        status=F.lit("info"), severity_level=F.lit("low"), severity_score=F.lit(270), detail=F.concat_ws("|", "cluster_name", F.col("desired_size").cast("string")),
    )


def efs_configuration(filesystems: DataFrame) -> DataFrame:
    """D25 no lifecycle policy moves data to a colder class; D26 backups disabled; D27 not
    encrypted (unknown does not count). ``policies``: array of (to_ia, to_archive)."""
    set_ = lambda c: F.trim(F.coalesce(c, F.lit(""))) != ""
    moves = F.exists(F.coalesce("policies", F.array().cast("array<struct<to_ia:string,to_archive:string>>")), lambda p: set_(p["to_ia"]) | set_(p["to_archive"]))
    base = dict(service=F.lit("AmazonEFS"), resource_type=F.lit("file_system"), resource_id=F.col("file_system_id"))
    d25 = _draft(filesystems.where(~moves), check_id=F.lit("aws.efs.filesystems.lifecycle.missing"), severity_level=F.lit("low"), severity_score=F.lit(400), **base)
    d26 = _draft(
        filesystems.where(F.upper(F.trim("backup_status")) == "DISABLED"), check_id=F.lit("aws.efs.filesystems.backup.disabled"),
        severity_level=F.lit("medium"), severity_score=F.lit(700), **base,
    )
    d27 = _draft(filesystems.where(~F.col("encrypted")), check_id=F.lit("aws.efs.filesystems.unencrypted"), severity_level=F.lit("high"), severity_score=F.lit(900), **base)
    return d25.unionByName(d26).unionByName(d27)


def _enough(window_days: int, absolute: int = 7, ratio: float = 0.6) -> int:
    return max(absolute, int(window_days * ratio))


def rds_rightsizing(
    dbs: DataFrame, metrics: DataFrame, prices: DataFrame, as_of, *, window_days: int = 14, used_ratio: float = 0.40, min_excess_gb: float = 20.0,
    usd_per_gb: float = 0.115, read_iops_max: float = 0.1,
) -> DataFrame:
    """D40 storage overprovisioned: enough daily points of FreeStorageSpace, allocation less its
    p95 below the used ratio, and at least N GB to give back. D41 Multi-AZ outside production:
    the price step to one zone. D44 read replica (not Aurora, available, not tagged for a
    purpose) with enough points and p95 ReadIOPS below the limit: its whole price."""
    base = dict(service=F.lit("AmazonRDS"), resource_type=F.lit("db_instance"), resource_id=F.col("db_instance_id"))

    def stats(metric: str, name: str) -> DataFrame:
        daily = daily_series(metrics, metric, as_of, window_days, agg="avg")
        return daily.groupBy(*SCOPE, F.col("resource_id").alias("db_instance_id")).agg(F.count(F.lit(1)).alias("points"), percentile_linear(F.col("value"), 0.95).alias(name))

    name = [*SCOPE, "db_instance_id"]
    free = dbs.where(F.col("allocated_gb") > 0).join(stats("FreeStorageSpace", "p95"), name).where(F.col("points") >= _enough(window_days))
    alloc = F.col("allocated_gb").cast("double")
    free = free.withColumn("used", F.greatest(F.lit(0.0), alloc - F.greatest(F.lit(0.0), F.col("p95") / 1024.0**3)))
    free = free.withColumn("excess", F.greatest(F.lit(0.0), alloc - F.greatest(F.col("used"), alloc * used_ratio)))
    free = free.where((F.col("used") / alloc < used_ratio) & (F.col("excess") >= min_excess_gb))
    d40 = _draft(
        free, check_id=F.lit("aws.rds.storage.overprovisioned"), severity_level=F.lit("low"), severity_score=F.lit(350), monthly_cost=F.lit(0).cast(MONEY),
        monthly_savings=F.round(F.col("excess") * usd_per_gb, 2).cast(MONEY), confidence=F.lit(70),
        detail=F.concat_ws("|", F.format_string("%.0f", alloc), F.format_string("%.1f", "used"), F.col("points").cast("string")), **base,
    )
    tags = normalize_tags(F.col("tags"))
    production = F.exists(F.map_entries(tags), lambda e: e["key"].isin(*ENVIRONMENT_KEYS) & e["value"].isin("prod", "production"))
    zone_key = lambda option: F.concat(F.lower("instance_class"), F.lit(f":{option}"))
    multi = dbs.where(F.col("multi_az") & ~production & non_production(F.col("tags"), ENVIRONMENT_KEYS, NONPROD_VALUES))
    multi = price_lookup(multi, prices, region=F.col("region"), kind="rds_hour", key=zone_key("multi")).withColumnsRenamed({"unit_price": "two", "price_confidence": "two_conf"})
    multi = price_lookup(multi, prices, region=F.col("region"), kind="rds_hour", key=zone_key("single"))
    known = F.col("two").isNotNull() & F.col("unit_price").isNotNull()
    d41 = _draft(
        multi, check_id=F.lit("aws.rds.multi.az.non.prod"), severity_level=F.lit("medium"), severity_score=F.lit(520),
        monthly_cost=F.when(known, _monthly(F.col("two"))).otherwise(0).cast(MONEY),
        monthly_savings=F.when(known, _monthly(F.greatest(F.lit(0.0), F.col("two") - F.col("unit_price")))).otherwise(0).cast(MONEY),
        confidence=F.when(known, F.least(F.lit(80), F.greatest("two_conf", "price_confidence"))).otherwise(30).cast("int"), detail=F.col("instance_class"), **base,
    )
    purpose = F.exists(
        F.map_entries(tags),
        lambda e: (e["key"].isin(*REPLICA_KEEP_KEYS) & e["value"].isin(*REPLICA_KEEP_VALUES))
        | (e["key"].isin(*REPLICA_PURPOSE_KEYS) & F.replace(e["value"], F.lit("_"), F.lit("-")).isin(*REPLICA_PURPOSE_VALUES)),
    )
    replica = dbs.where(
        F.col("replica_of").isNotNull() & (F.col("replica_of") != "") & ~F.lower(F.coalesce("engine", F.lit(""))).startswith("aurora")
        & (F.lower("status") == "available") & ~F.coalesce(purpose, F.lit(False))
    ).join(stats("ReadIOPS", "p95"), name).where((F.col("points") >= _enough(window_days)) & (F.col("p95") < read_iops_max))
    option = F.when(F.col("multi_az"), F.lit("multi")).otherwise("single")
    replica = price_lookup(replica, prices, region=F.col("region"), kind="rds_hour", key=F.concat(F.lower("instance_class"), F.lit(":"), option))
    cost = F.coalesce(_monthly(F.col("unit_price")), F.lit(0)).cast(MONEY)
    d44 = _draft(
        replica, check_id=F.lit("aws.rds.read.replica.unused"), severity_level=F.lit("medium"), severity_score=F.lit(560), monthly_cost=cost, monthly_savings=cost,
        confidence=F.when(F.col("unit_price").isNotNull(), F.least(F.lit(90), F.greatest(F.lit(70), F.col("price_confidence")))).otherwise(70).cast("int"),
        detail=F.concat_ws("|", F.col("points").cast("string"), F.format_string("%.6f", "p95")), **base,
    )
    return d40.unionByName(d41).unionByName(d44)


def rds_snapshots(snapshots: DataFrame, sources: DataFrame, as_of, *, stale_days: int = 30, usd_per_gb: str = "0.095") -> DataFrame:
    """D45 snapshot of this region whose source database is gone (anti-join); D46 manual
    snapshot at least N days old whose source still exists or lies elsewhere.

    ``snapshots``: region, snapshot_id, snapshot_type, kind (db, cluster), source_id,
    source_region, created, size_gb. ``sources``: scope, kind, source_id of existing databases;
    a name of another account or region is another database.
    """
    now = F.lit(as_of).cast("timestamp")
    here = F.coalesce("source_region", "region") == F.col("region")
    named = F.coalesce("source_id", F.lit("")) != ""
    key = [*SCOPE, "kind", "source_id"]
    there = sources.select(*key).distinct().withColumn("_there", F.lit(True))
    s = snapshots.join(there, key, "left").withColumn("orphan", here & named & F.col("_there").isNull())
    cost = (F.col("size_gb").cast("decimal(18,2)") * F.lit(usd_per_gb).cast("decimal(12,6)")).cast(MONEY)
    base = dict(service=F.lit("AmazonRDS"), resource_type=F.concat(F.lit("rds_"), "kind", F.lit("_snapshot")), resource_id=F.col("snapshot_id"), monthly_cost=cost, monthly_savings=cost)
    d45 = _draft(s.where("orphan"), check_id=F.lit("aws.rds.snapshots.orphaned"), severity_level=F.lit("medium"), severity_score=F.lit(70), detail=F.col("source_id"), **base)
    old = s.where(~F.col("orphan") & F.lower(F.coalesce("snapshot_type", F.lit(""))).startswith("manual") & (F.col("created") <= now - F.make_interval(days=F.lit(stale_days))))
    d46 = _draft(old, check_id=F.lit("aws.rds.snapshots.manual.old"), severity_level=F.lit("low"), severity_score=F.lit(60), detail=F.to_date("created").cast("string"), **base)
    return d45.unionByName(d46)
