"""Correlation: findings -> meta-findings.

A rule is ``fn(rule_input: DataFrame) -> DataFrame`` returning one row per
meta-finding in the *rule output shape* (see ``RULE_COLUMNS``); ``finalize``
adds run metadata, identity and the storage shape. Built-in rules aggregate
each signal side to the rule grain first and join aggregates afterwards, so a
hot account/region never multiplies rows (no raw 1:n:m fan-out, K2).
User rules are SQL text over the view ``rule_input`` or Python callables.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.coerce import MONEY, confidence_0_100, money_or_zero
from .contract import to_findings

RUN_KEYS = ["tenant_id", "workspace_id", "run_id"]
ACCT_KEYS = RUN_KEYS + ["account_id", "region"]

#: what the built-in rules, ``run_meta`` and ``evidence`` read of a finding
RULE_READS = [*RUN_KEYS, "run_ts", "engine_name", "engine_version", "rulepack_version", "check_id", "status", "severity", "scope", "estimated", "dimensions", "fingerprint"]

RULE_COLUMNS = [
    "tenant_id",
    "workspace_id",
    "run_id",
    "account_id",
    "region",
    "service",
    "resource_type",
    "resource_id",
    "resource_arn",
    "check_id",
    "check_name",
    "category",
    "sub_category",
    "frameworks",
    "status",
    "severity_level",
    "severity_score",
    "title",
    "message",
    "recommendation",
    "monthly_savings",
    "monthly_cost",
    "confidence",
    "notes",
    "dimensions",
    "metadata_json",
    "source_fingerprints",
    "sources",
]


@dataclass(frozen=True)
class Rule:
    rule_id: str
    name: str
    required_check_ids: tuple[str, ...]
    fn: Callable[[DataFrame], DataFrame] | None = None
    sql: str | None = None
    enabled: bool = True
    params: dict = field(default_factory=dict)
    #: predicate of the findings whose fingerprints the rule's digest counts, and the grain it
    #: counts them at (resource, vault or account); ``evidence`` lists them by both
    sources: Callable[..., Column] | None = None
    grain: str = "account"


# ---------------------------------------------------------------------------
# Inputs (P6, P7/J1, J8)
# ---------------------------------------------------------------------------


def base_findings(findings: DataFrame, tenant_id: str = "", workspace_id: str = "", run_id: str = "") -> DataFrame:
    """Tenant / workspace / run filter; empty string = no filter (pushes to the scan)."""
    for c, v in (("tenant_id", tenant_id), ("workspace_id", workspace_id), ("run_id", run_id)):
        if v:
            findings = findings.where(F.col(c) == v)
    return findings


def rule_input(base: DataFrame, required_check_ids: Sequence[str]) -> DataFrame:
    """Keep only the rule's source checks (``IN`` list pushes into Parquet)."""
    ids = [i for i in required_check_ids if i]
    if not ids:
        raise ValueError("rule has no required_check_ids")
    return base.where(F.col("check_id").isin(*ids))


def run_meta(base: DataFrame) -> DataFrame:
    """Per-run metadata, one aggregate instead of correlated subqueries per row.

    One row per run: tiny (runs x columns) and joined on the run key.
    """
    return base.groupBy(*RUN_KEYS).agg(
        F.max("run_ts").alias("run_ts"),
        F.min("engine_name").alias("engine_name"),
        F.min("engine_version").alias("engine_version"),
        F.min("rulepack_version").alias("rulepack_version"),
        F.min("scope.cloud").alias("cloud"),
        F.min("scope.provider_partition").alias("provider_partition"),
        F.min("scope.billing_account_id").alias("billing_account_id"),
    )


def _sig(ri: DataFrame) -> DataFrame:
    """Flat signal view of rule_input."""
    return ri.select(
        *RUN_KEYS,
        F.col("scope.account_id").alias("account_id"),
        F.col("scope.region").alias("region"),
        F.col("scope.resource_type").alias("resource_type"),
        F.col("scope.resource_id").alias("resource_id"),
        F.col("scope.resource_arn").alias("resource_arn"),
        "check_id",
        "status",
        F.coalesce(F.col("severity.score"), F.lit(0)).alias("sev"),
        F.coalesce(F.col("estimated.monthly_cost"), F.lit(0).cast(MONEY)).alias("cost"),
        "dimensions",
        "fingerprint",
    )


def _source_hash(c: Column) -> Column:
    """96 bits of a fingerprint's MD5 as a number."""
    m = F.md5(c.cast("binary"))
    half = lambda at: F.conv(F.substring(m, at, 12), 16, 10).cast("decimal(15,0)")
    return (half(1) * F.lit(1 << 48).cast("decimal(15,0)") + half(13)).cast("decimal(29,0)")


def _fps(c: str = "fingerprint") -> Column:
    """Digest of a group's distinct source fingerprints: their number and the sum of their
    hashes. Its size does not grow with the group, and digests of disjoint sets add up."""
    h = _source_hash(F.col(c))
    return F.struct(F.count_distinct(h).alias("n"), F.sum_distinct(h).cast("decimal(38,0)").alias("h"))


def _concat_fps(*cols: str) -> Column:
    """Digest of several sides' sources (checks differ from side to side, so no source is in two)."""
    zero = F.lit(0).cast("decimal(38,0)")
    n, h = F.lit(0).cast("long"), zero
    for c in cols:
        n = n + F.coalesce(F.col(c)["n"], F.lit(0))
        h = (h + F.coalesce(F.col(c)["h"], zero)).cast("decimal(38,0)")
    return F.struct(n.alias("n"), h.alias("h"))


def _listed_sources(c: Column) -> Column:
    """The same digest of fingerprints a user rule lists."""
    each = F.array_distinct(F.filter(F.coalesce(c, F.array().cast("array<string>")), lambda x: F.trim(x) != ""))
    total = F.aggregate(each, F.lit(0).cast("decimal(38,0)"), lambda s, x: (s + _source_hash(x)).cast("decimal(38,0)"))
    return F.struct(F.size(each).cast("long").alias("n"), total.alias("h"))


def _per_month(cost: Column) -> Column:
    """``about $x a month`` for a cost above 0, else NULL."""
    return F.when(cost > 0, F.concat(F.lit("about $"), _text2(cost), F.lit(" a month")))


def _sev(*tiers: tuple[Column, str, int], default: tuple[str, int]) -> tuple[Column, Column]:
    lvl, score = None, None
    for cond, l_, s_ in tiers:
        lvl = F.when(cond, l_) if lvl is None else lvl.when(cond, l_)
        score = F.when(cond, s_) if score is None else score.when(cond, s_)
    return lvl.otherwise(default[0]), score.otherwise(default[1])


def _money(c: Column) -> Column:
    return c.cast(MONEY)


def _text2(c: Column) -> Column:
    """Money as text with two decimals (message fragments)."""
    return F.format_string("%.2f", c.cast("double"))


def _shape(df: DataFrame, **cols: Column) -> DataFrame:
    """Project to RULE_COLUMNS; missing ones get neutral defaults."""
    defaults = {
        "service": F.lit(""),
        "resource_type": F.lit("account"),
        "resource_id": F.col("account_id"),
        "resource_arn": F.lit(""),
        "sub_category": F.lit(""),
        "frameworks": F.array(F.lit("FinOps")),
        "message": F.lit(""),
        "recommendation": F.lit(""),
        "monthly_savings": F.lit(None).cast(MONEY),
        "monthly_cost": F.lit(None).cast(MONEY),
        "confidence": F.lit(0),
        "notes": F.lit(""),
        "dimensions": F.create_map().cast("map<string,string>"),
        "metadata_json": F.lit(""),
        "check_id": F.lit(""),
        "check_name": F.lit(""),
        "category": F.lit(""),
        "status": F.lit("fail"),
        "severity_level": F.lit(None).cast("string"),
        "severity_score": F.lit(None).cast("int"),
        "title": F.lit(""),
        "source_fingerprints": F.array().cast("array<string>"),
        "sources": F.lit(None).cast("struct<n:bigint,h:decimal(38,0)>"),
    }
    out = []
    for c in RULE_COLUMNS:
        if c in cols:
            out.append(cols[c].alias(c))
        elif c in defaults:
            out.append(defaults[c].alias(c))
        else:
            out.append(F.col(c))
    return df.select(*out)


# ---------------------------------------------------------------------------
# What the built-in rules count as sources (shared with ``evidence``)
# ---------------------------------------------------------------------------

#: K1: a problem may be reported with any of these statuses (detectors differ)
SIGNAL_STATUSES = ("fail", "warn", "info")

VAULT_OWN = ("aws.backup.vaults.no.lifecycle", "aws.backup.vaults.access.policy.misconfig")
STALE_POINTS, ENDLESS_RULES = "aws.backup.recovery.points.stale", "aws.backup.rules.no.lifecycle"
NAT_CHECKS = ("aws.ec2.nat.gateways.idle", "aws.ec2.nat.gateways.high.data.processing", "aws.ec2.nat.gateways.cross.az")


def _signal(checks: Sequence[str], resource_type: str, statuses: Sequence[str] = ("fail",)) -> Column:
    return F.col("status").isin(*statuses) & F.col("check_id").isin(*checks) & (F.col("resource_type") == resource_type)


def vault_of() -> Column:
    """The vault a finding speaks of: itself, or the one its dimensions name."""
    dims = F.col("dimensions")
    return (
        F.when(F.col("check_id") == ENDLESS_RULES, F.coalesce(dims["target_vault_name"], dims["target_vault"], dims["backup_vault"], F.lit("")))
        .when(F.col("resource_type") == "backup_vault", F.col("resource_id"))
        .otherwise(F.coalesce(dims["vault_name"], F.lit("")))
    )


def vault_signals() -> Column:
    own = F.col("check_id").isin(*VAULT_OWN) & (F.col("resource_type") == "backup_vault")
    return (F.col("status") == "fail") & (own | F.col("check_id").isin(STALE_POINTS, ENDLESS_RULES))


def volume_signals() -> Column:
    return _signal(("aws.ec2.ebs.unattached.volume", "aws.ec2.ebs.volume.unencrypted"), "ebs_volume")


def metric_signals() -> Column:
    return _signal(("aws.cloudwatch.custom.metrics.from.log.filters",), "custom_metric", ("info",))


def alarm_signals(statuses: Sequence[str] = SIGNAL_STATUSES) -> Column:
    return _signal(("aws.cloudwatch.alarms.high.count",), "account", statuses)


def observability_signals() -> Column:
    return alarm_signals(("info",)) | metric_signals()


def log_signals(statuses: Sequence[str] = ("fail",)) -> Column:
    return _signal(("aws.logs.log.groups.retention.missing",), "log_group", statuses)


def idle_instance_signals(statuses: Sequence[str] = SIGNAL_STATUSES) -> Column:
    return _signal(("aws.ec2.instances.underutilized", "aws.ec2.instances.stopped.long"), "instance", ("fail", "warn"))


def lambda_log_signals(statuses: Sequence[str] = SIGNAL_STATUSES) -> Column:
    return log_signals(statuses) & F.coalesce(F.col("dimensions")["log_group"], F.col("resource_id")).startswith("/aws/lambda/")


def nat_signals() -> Column:
    gateway = F.regexp_replace(F.col("resource_type"), "-", "_") == "nat_gateway"
    return F.col("status").isin("fail", "warn") & F.col("check_id").isin(*NAT_CHECKS) & gateway


def underutilized_signals() -> Column:
    return _signal(("aws.ec2.instances.underutilized",), "instance")


def traffic_signals() -> Column:
    return nat_signals() | underutilized_signals()


def database_signals() -> Column:
    return _signal(("aws.rds.instances.stopped.storage", "aws.rds.storage.overprovisioned"), "db_instance", ("fail", "warn"))


def kept_vault_signals() -> Column:
    return _signal(("aws.backup.vaults.no.lifecycle", "aws.backup.recovery.points.stale"), "backup_vault")


def kept_bucket_signals() -> Column:
    return _signal(("aws.s3.bucket.lifecycle.missing", "aws.s3.governance.lifecycle.missing"), "bucket")


def backup_signals() -> Column:
    return database_signals() | kept_vault_signals() | kept_bucket_signals()


# ---------------------------------------------------------------------------
# Built-in rules (ids, check names, titles and thresholds are fixed values: group keys and
# users' filters hang on them; messages are our own)
# ---------------------------------------------------------------------------


def rule_vault_risk(ri: DataFrame) -> DataFrame:
    """>= 2 of {no lifecycle, policy misconfig, stale recovery points, rules w/o lifecycle} per vault."""
    # one long list of (vault, signal) rows; a vault itself carries the first two signals
    own, stale, no_rules = VAULT_OWN, STALE_POINTS, ENDLESS_RULES
    failed = _sig(ri).where(F.col("status") == "fail")
    rows = failed.where(vault_signals()).withColumn("vault_name", vault_of())
    anchors = rows.where(F.col("check_id").isin(*own)).select(*ACCT_KEYS, "vault_name", F.col("resource_arn").alias("vault_arn")).distinct()
    plans = failed.where(F.col("check_id") == "aws.backup.plans.no.selections").groupBy(*RUN_KEYS).agg(F.count(F.lit(1)).alias("plans_n"))

    def times(*checks: str) -> Column:
        return F.count_if(F.col("check_id").isin(*checks))

    c = (
        anchors.join(rows, ACCT_KEYS + ["vault_name"])
        .where(~F.col("check_id").isin(*own) | F.col("resource_arn").eqNullSafe(F.col("vault_arn")))
        .groupBy(*ACCT_KEYS, "vault_name", "vault_arn")
        .agg(
            F.count_distinct("check_id").alias("signals"),
            times(own[0]).alias("guard_n"),
            times(own[1]).alias("policy_n"),
            times(stale).alias("stale_n"),
            times(no_rules).alias("rules_n"),
            F.coalesce(F.sum(F.when(F.col("check_id") == stale, F.col("cost"))), F.lit(0)).cast("decimal(28,6)").alias("stale_cost"),
            _fps().alias("fps"),
        )
        .where(F.col("signals") >= 2)
        .join(plans, RUN_KEYS, "left")
    )
    lvl, score = _sev(
        (F.col("signals") >= 3, "high", 900),
        ((F.col("signals") == 2) & (F.col("stale_n") > 0), "high", 850),
        default=("medium", 750),
    )
    def part(n: Column, text: str) -> Column:
        return F.when(n > 0, F.format_string(text, n))

    msg = F.concat_ws(
        "; ",
        F.format_string("Vault %s combines %d risk signals", "vault_name", "signals"),
        F.when(F.col("guard_n") > 0, F.lit("no retention lock")),
        F.when(F.col("policy_n") > 0, F.lit("weak access policy")),
        part(F.col("stale_n"), "%d stale recovery point(s)"),
        part(F.col("rules_n"), "%d rule(s) without lifecycle"),
        part(F.coalesce("plans_n", F.lit(0)), "the run also has %d plan(s) without selections"),
    )
    has_cost = F.col("stale_cost") > 0
    return _shape(
        c,
        service=F.lit("AWSBackup"),
        resource_type=F.lit("backup_vault"),
        resource_id=F.col("vault_name"),
        resource_arn=F.col("vault_arn"),
        check_id=F.lit("aws.backup.correlation.vault.risk"),
        check_name=F.lit("AWS Backup vault risk (correlated)"),
        category=F.lit("governance"),
        sub_category=F.lit("backup"),
        frameworks=F.array(F.lit("FinOps"), F.lit("Governance")),
        status=F.lit("fail"),
        severity_level=lvl,
        severity_score=score,
        title=F.lit("Backup vault has correlated retention / governance risks"),
        message=msg,
        recommendation=F.lit("Lock the vault, give every rule a lifecycle, narrow who may enter, and let old points expire."),
        monthly_cost=F.when(has_cost, F.col("stale_cost")),
        confidence=F.when(has_cost, 50).otherwise(10),
        dimensions=F.create_map(
            F.lit("vault_name"), F.col("vault_name"),
            F.lit("vault_arn"), F.coalesce(F.col("vault_arn"), F.lit("")),
            F.lit("signal_count"), F.col("signals").cast("string"),
            F.lit("stale_rp_count"), F.col("stale_n").cast("string"),
            F.lit("rules_no_lifecycle_count"), F.col("rules_n").cast("string"),
        ),
        metadata_json=F.concat(F.lit('{"correlation_rule":"vault_risk","signal_count":'), F.col("signals").cast("string"), F.lit("}")),
        sources=F.col("fps"),
    )


def rule_ebs_unattached_unencrypted(ri: DataFrame) -> DataFrame:
    """R2: the same volume is both unattached and unencrypted."""
    s = _sig(ri).where(volume_signals())
    un = F.col("check_id") == "aws.ec2.ebs.unattached.volume"

    def dim(k: str) -> Column:
        return F.max(F.when(un, F.coalesce(F.col("dimensions")[k], F.lit(""))).otherwise(F.lit("")))

    v = (
        s.groupBy(*ACCT_KEYS, "resource_id", "resource_arn")
        .agg(
            F.max(F.when(un, 1).otherwise(0)).alias("sig_un"),
            F.max(F.when(~un, 1).otherwise(0)).alias("sig_enc"),
            F.max(F.when(un, F.col("cost")).otherwise(F.lit(0).cast(MONEY))).alias("cost"),
            _fps().alias("fps"),
            dim("volume_type").alias("volume_type"),
            dim("size_gb").alias("size_gb"),
            dim("age_days").alias("age_days"),
        )
        .where((F.col("sig_un") == 1) & (F.col("sig_enc") == 1))
    )
    has_cost = F.col("cost") > 0
    said = lambda c, text: F.when(F.col(c) != "", F.format_string(text, c))
    msg = F.concat_ws(
        "; ",
        F.format_string("%s holds plain data and serves no instance", "resource_id"),
        said("volume_type", "type %s"),
        said("size_gb", "%s GB"),
        said("age_days", "%s days old"),
        _per_month(F.col("cost")),
    )
    lvl, score = _sev((F.col("cost") >= 50, "high", 900), default=("high", 850))
    return _shape(
        v,
        service=F.lit("AmazonEC2"),
        resource_type=F.lit("ebs_volume"),
        resource_id=F.col("resource_id"),
        resource_arn=F.col("resource_arn"),
        check_id=F.lit("aws.ec2.correlation.ebs.unattached.unencrypted"),
        check_name=F.lit("EBS unattached + unencrypted volume (correlated)"),
        category=F.lit("governance"),
        sub_category=F.lit("storage"),
        frameworks=F.array(F.lit("FinOps"), F.lit("Security")),
        status=F.lit("fail"),
        severity_level=lvl,
        severity_score=score,
        title=F.lit("Unattached and unencrypted EBS volume"),
        message=msg,
        recommendation=F.lit("Keep an encrypted snapshot if the data matters, then remove the volume."),
        monthly_savings=F.when(has_cost, F.col("cost")),
        monthly_cost=F.when(has_cost, F.col("cost")),
        confidence=F.when(has_cost, 55).otherwise(30),
        dimensions=F.create_map(
            F.lit("volume_id"), F.col("resource_id"),
            F.lit("volume_arn"), F.coalesce(F.col("resource_arn"), F.lit("")),
            F.lit("volume_type"), F.col("volume_type"),
            F.lit("size_gb"), F.col("size_gb"),
            F.lit("age_days"), F.col("age_days"),
            F.lit("signals"), F.lit("unattached,unencrypted"),
        ),
        metadata_json=F.lit('{"correlation_rule":"ebs_unattached_unencrypted"}'),
        sources=F.col("fps"),
    )


def rule_custom_metrics_sprawl(ri: DataFrame, min_count: int = 5) -> DataFrame:
    """>= ``min_count`` custom metrics from log filters per account x region."""
    s = _sig(ri).where(metric_signals())
    g = (
        s.groupBy(*ACCT_KEYS)
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.sum("cost").alias("cost"),
            F.min(F.col("dimensions")["namespace"]).alias("first_ns"),
            F.max(F.col("dimensions")["namespace"]).alias("last_ns"),
            _fps().alias("fps"),
        )
        .where(F.col("n") >= min_count)
    )
    has_cost = F.col("cost") > 0
    lvl, score = _sev(
        ((F.col("n") >= 200) | (F.col("cost") >= 200), "high", 900),
        ((F.col("n") >= 50) | (F.col("cost") >= 50), "medium", 760),
        default=("medium", 650),
    )
    msg = F.concat_ws(
        "; ",
        F.format_string("Region %s: %d metrics fed by log filters", "region", "n"),
        _per_month(F.col("cost")),
        F.concat(F.lit("namespaces from "), F.col("first_ns"), F.lit(" to "), F.col("last_ns")),
    )
    return _shape(
        g,
        service=F.lit("AmazonCloudWatch"),
        check_id=F.lit("aws.cloudwatch.correlation.custom.metrics.sprawl"),
        check_name=F.lit("CloudWatch custom metrics sprawl (correlated)"),
        category=F.lit("waste"),
        sub_category=F.lit("observability"),
        status=F.lit("fail"),
        severity_level=lvl,
        severity_score=score,
        title=F.lit("Custom CloudWatch metrics created by log filters may be stale or excessive"),
        message=msg,
        monthly_savings=F.when(has_cost, F.col("cost")),
        monthly_cost=F.when(has_cost, F.col("cost")),
        confidence=F.when(has_cost, 55).otherwise(20),
        dimensions=F.create_map(F.lit("metric_count"), F.col("n").cast("string"), F.lit("region"), F.col("region")),
        metadata_json=F.concat(
            F.lit('{"correlation_rule":"custom_metrics_sprawl","metric_count":'), F.col("n").cast("string"),
            F.lit(',"monthly_cost_sum":'), _text2(F.col("cost")), F.lit("}"),
        ),
        sources=F.col("fps"),
    )


def _alarms(s: DataFrame, statuses: Sequence[str]) -> DataFrame:
    return (
        s.where(alarm_signals(statuses))
        .groupBy(*ACCT_KEYS)
        .agg(
            F.max(F.col("dimensions")["alarm_count"].try_cast("int")).alias("alarm_count"),
            F.sum("cost").alias("alarms_cost"),
            _fps().alias("alarm_fps"),
        )
    )


def rule_observability_sprawl(ri: DataFrame, min_metrics: int = 20) -> DataFrame:
    """Alarms-high-count and >= ``min_metrics`` custom metrics in the same account x region."""
    s = _sig(ri)
    alarms = _alarms(s, ("info",))
    metrics = (
        s.where(metric_signals())
        .groupBy(*ACCT_KEYS)
        .agg(F.count(F.lit(1)).alias("n"), F.sum("cost").alias("cost"), _fps().alias("metric_fps"))
    )
    c = alarms.join(metrics, ACCT_KEYS, "inner").where(F.col("n") >= min_metrics)
    ac = F.coalesce(F.col("alarm_count"), F.lit(0))
    has_cost = F.col("cost") > 0
    lvl, score = _sev(
        ((ac >= 500) | (F.col("n") >= 500) | (F.col("cost") >= 500), "high", 920),
        ((ac >= 200) | (F.col("n") >= 200) | (F.col("cost") >= 200), "high", 880),
        default=("medium", 760),
    )
    return _shape(
        c,
        service=F.lit("AmazonCloudWatch"),
        check_id=F.lit("aws.cloudwatch.correlation.observability.sprawl"),
        check_name=F.lit("CloudWatch observability sprawl (correlated)"),
        category=F.lit("waste"),
        sub_category=F.lit("observability"),
        status=F.lit("fail"),
        severity_level=lvl,
        severity_score=score,
        title=F.lit("CloudWatch alarms and custom metrics indicate observability sprawl"),
        message=F.concat_ws("; ", F.format_string("%d alarms beside %d custom metrics", ac, "n"), _per_month(F.col("cost"))),
        monthly_savings=F.when(has_cost, F.col("cost")),
        monthly_cost=F.when(has_cost, F.col("cost")),
        confidence=F.when(has_cost, 55).otherwise(20),
        dimensions=F.create_map(
            F.lit("alarm_count"), ac.cast("string"), F.lit("custom_metric_count"), F.col("n").cast("string")
        ),
        sources=_concat_fps("alarm_fps", "metric_fps"),
    )


def first_names(s: DataFrame, n: int = 5) -> DataFrame:
    """T5: the first ``n`` resource names of each account and region, sorted, as ``names``.

    Every partition passes on at most the rows of its ``n`` least names (the rank is a group
    limit), so neither the names of a large account nor their list reach one task.
    """
    w = Window.partitionBy(*ACCT_KEYS).orderBy("resource_id")
    few = s.select(*ACCT_KEYS, "resource_id").withColumn("_k", F.dense_rank().over(w)).where(F.col("_k") <= n)
    return few.groupBy(*ACCT_KEYS).agg(F.array_sort(F.collect_set("resource_id")).alias("names"))


def rule_retention_missing_sprawl(ri: DataFrame, min_count: int = 1) -> DataFrame:
    """Log groups without retention per account x region; tiers 50 / 10."""
    s = _sig(ri).where(log_signals())
    g = (
        s.groupBy(*ACCT_KEYS)
        .agg(F.count(F.lit(1)).alias("n"), _fps().alias("fps"))
        .where(F.col("n") >= min_count)
    )
    g = g.join(first_names(s), ACCT_KEYS, "left")
    listed = F.concat(F.array_join("names", ", "), F.when(F.col("n") > F.size("names"), ", ...").otherwise(""))
    lvl, score = _sev((F.col("n") >= 50, "high", 900), (F.col("n") >= 10, "medium", 750), default=("medium", 650))
    return _shape(
        g,
        service=F.lit("CloudWatchLogs"),
        check_id=F.lit("aws.logs.correlation.retention.missing.sprawl"),
        check_name=F.lit("CloudWatch Logs retention missing (correlated)"),
        category=F.lit("waste"),
        sub_category=F.lit("observability"),
        frameworks=F.array(F.lit("FinOps"), F.lit("Governance")),
        status=F.lit("fail"),
        severity_level=lvl,
        severity_score=score,
        title=F.lit("Many CloudWatch Log Groups have no retention policy"),
        message=F.format_string("Region %s keeps %d log groups forever: %s", F.col("region"), F.col("n"), listed),
        confidence=F.lit(10),
        notes=F.lit("Risk of growing cost; no amount is known."),
        dimensions=F.create_map(F.lit("log_groups_missing_retention"), F.col("n").cast("string"), F.lit("region"), F.col("region")),
        sources=F.col("fps"),
    )


def rule_ec2_monitoring_cost(ri: DataFrame, statuses: Sequence[str] = SIGNAL_STATUSES) -> DataFrame:
    """idle/stopped instances with log groups lacking retention and alarm cost (side aggregates joined)."""
    s = _sig(ri)
    ec2 = (
        s.where(idle_instance_signals(statuses))
        .groupBy(*ACCT_KEYS)
        .agg(
            F.count_distinct("resource_id").alias("ec2_n"),
            F.sum("cost").alias("ec2_cost"),
            _fps().alias("ec2_fps"),
            F.max("sev").alias("max_sev"),
        )
    )
    logs = (
        s.where(log_signals(statuses))
        .groupBy(*ACCT_KEYS)
        .agg(F.count_distinct("resource_id").alias("logs_n"), F.sum("cost").alias("logs_cost"))
    )
    alarms = _alarms(s, statuses)
    c = ec2.join(logs, ACCT_KEYS, "left").join(alarms, ACCT_KEYS, "left").where(F.col("ec2_n") >= 1)
    zero = F.lit(0).cast(MONEY)
    logs_n = F.coalesce("logs_n", F.lit(0))
    lc = F.coalesce("logs_cost", zero)
    ac = F.coalesce("alarms_cost", zero)
    n = F.col("ec2_n")
    status = (
        F.when((n >= 10) & ((lc > 50) | (ac > 50)), "fail").when((n >= 5) | (logs_n >= 10), "warn").otherwise("info")
    )
    lvl, score = _sev(
        ((n >= 20) | ((lc + ac) >= 200), "high", 850), ((n >= 10) | (logs_n >= 20), "medium", 700), default=("low", 500)
    )
    return _shape(
        c,
        service=F.lit("AmazonEC2"),
        check_id=F.lit("aws.ec2.correlation.cloudwatch.monitoring.cost"),
        check_name=F.lit("EC2 + CloudWatch monitoring cost correlation"),
        category=F.lit("waste"),
        sub_category=F.lit("cost_optimization"),
        status=status,
        severity_level=lvl,
        severity_score=score,
        title=F.lit("EC2 instances with unused CloudWatch monitoring cost"),
        message=F.concat_ws("; ", F.format_string("%d instances do no work while %d log groups keep their data", n, logs_n), _per_month(lc + ac)),
        monthly_savings=_money(F.greatest(lc, ac) * F.lit(0.3).cast("decimal(2,1)")),
        monthly_cost=_money(lc + ac),
        confidence=F.lit(40),
        dimensions=F.create_map(
            F.lit("ec2_instance_count"), n.cast("string"),
            F.lit("cw_log_groups_no_retention"), logs_n.cast("string"),
            F.lit("cw_alarm_count"), F.coalesce("alarm_count", F.lit(0)).cast("string"),
        ),
        sources=F.col("ec2_fps"),
    )


def rule_lambda_logs_cost(ri: DataFrame, statuses: Sequence[str] = SIGNAL_STATUSES) -> DataFrame:
    """R7: '/aws/lambda/' log groups without retention, with lambda signals and alarms."""
    s = _sig(ri)
    logs = (
        s.where(lambda_log_signals(statuses))
        .groupBy(*ACCT_KEYS)
        .agg(
            F.count_distinct("resource_id").alias("logs_n"),
            F.sum("cost").alias("logs_cost"),
            _fps().alias("log_fps"),
            F.max("sev").alias("max_sev"),
        )
    )
    fns = (
        s.where(F.col("status").isin("fail", "warn") & F.col("check_id").startswith("aws.lambda.") & (F.col("resource_type") == "function"))
        .groupBy(*ACCT_KEYS)
        .agg(F.count_distinct("resource_id").alias("fn_n"), F.sum("cost").alias("fn_cost"))
    )
    alarms = _alarms(s, statuses)
    c = logs.join(fns, ACCT_KEYS, "left").join(alarms, ACCT_KEYS, "left").where(F.col("logs_n") >= 1)
    zero = F.lit(0).cast(MONEY)
    ac = F.coalesce("alarms_cost", zero)
    total = F.col("logs_cost") + ac
    n = F.col("logs_n")
    alarm_n = F.coalesce("alarm_count", F.lit(0))
    status = F.when((n >= 20) & (total >= 100), "fail").when((n >= 10) | (alarm_n >= 50), "warn").otherwise("info")
    lvl, score = _sev(((n >= 50) | (total >= 200), "high", 850), ((n >= 20) | (alarm_n >= 100), "medium", 700), default=("low", 500))
    fn_n = F.coalesce("fn_n", F.lit(0))
    return _shape(
        c,
        service=F.lit("AWSLambda"),
        check_id=F.lit("aws.lambda.correlation.cloudwatch.logs.cost"),
        check_name=F.lit("Lambda + CloudWatch Logs cost correlation"),
        category=F.lit("waste"),
        sub_category=F.lit("cost_optimization"),
        status=status,
        severity_level=lvl,
        severity_score=score,
        title=F.lit("Lambda functions paying for unused CloudWatch Logs"),
        message=F.concat_ws("; ", F.format_string("%d function log groups never expire, %d functions have findings of their own", n, fn_n), _per_month(total)),
        monthly_savings=_money(total * F.lit(0.5).cast("decimal(2,1)")),
        monthly_cost=_money(total),
        confidence=F.lit(35),
        dimensions=F.create_map(
            F.lit("lambda_log_groups_count"), n.cast("string"), F.lit("lambda_functions_count"), fn_n.cast("string"),
            F.lit("alarm_count"), alarm_n.cast("string"),
        ),
        sources=F.col("log_fps"),
    )


def rule_nat_ec2_traffic(ri: DataFrame) -> DataFrame:
    """NAT gateway signals (idle / high data / cross-AZ) with underutilized EC2."""
    s = _sig(ri)
    nat = (
        s.where(nat_signals())
        .groupBy(*ACCT_KEYS)
        .agg(
            F.count_distinct("resource_id").alias("nat_n"),
            *[
                F.count_distinct(F.when(F.col("check_id") == cid, F.col("resource_id"))).alias(a)
                for cid, a in zip(NAT_CHECKS, ("idle_n", "high_n", "xaz_n"))
            ],
            F.sum("cost").alias("nat_cost"),
            _fps().alias("nat_fps"),
            F.max("sev").alias("max_sev"),
        )
    )
    ec2 = (
        s.where(underutilized_signals())
        .groupBy(*ACCT_KEYS)
        .agg(F.count_distinct("resource_id").alias("ec2_n"), F.sum("cost").alias("ec2_cost"), _fps().alias("ec2_fps"))
    )
    c = nat.join(ec2, ACCT_KEYS, "left").where(F.col("nat_n") >= 1)
    ec2_n = F.coalesce("ec2_n", F.lit(0))
    total = F.col("nat_cost") + F.coalesce("ec2_cost", F.lit(0).cast(MONEY))
    status = (
        F.when((F.col("idle_n") >= 2) & (ec2_n >= 5), "fail")
        .when((F.col("high_n") >= 1) | (F.col("xaz_n") >= 1), "warn")
        .otherwise("info")
    )
    lvl, score = _sev(
        ((F.col("nat_n") >= 5) | (total >= 500), "high", 850),
        ((F.col("nat_n") >= 3) | (F.col("idle_n") >= 2), "medium", 700),
        default=("low", 500),
    )
    return _shape(
        c,
        service=F.lit("AmazonEC2"),
        check_id=F.lit("aws.nat.correlation.ec2.traffic"),
        check_name=F.lit("NAT Gateway + EC2 traffic correlation"),
        category=F.lit("waste"),
        sub_category=F.lit("networking"),
        status=status,
        severity_level=lvl,
        severity_score=score,
        title=F.lit("Traffic flowing through expensive NAT Gateways unnecessarily"),
        message=F.concat_ws(
            "; ",
            F.format_string("Gateways: %d (idle %d, busy %d, other zones %d)", "nat_n", "idle_n", "high_n", "xaz_n"),
            F.format_string("instances with little load: %d", ec2_n),
            _per_month(total),
        ),
        monthly_savings=_money(total * F.lit(0.35).cast("decimal(3,2)")),
        monthly_cost=_money(total),
        confidence=F.lit(40),
        dimensions=F.create_map(
            F.lit("nat_gateway_count"), F.col("nat_n").cast("string"), F.lit("idle_nat_count"), F.col("idle_n").cast("string"),
            F.lit("underutilized_ec2_count"), ec2_n.cast("string"),
        ),
        sources=_concat_fps("nat_fps", "ec2_fps"),
    )


def rule_rds_s3_backup(ri: DataFrame) -> DataFrame:
    """RDS signals with backup vaults and buckets lacking lifecycle (side aggregates joined)."""
    s = _sig(ri)
    rds = (
        s.where(database_signals())
        .groupBy(*ACCT_KEYS)
        .agg(F.count_distinct("resource_id").alias("rds_n"), F.sum("cost").alias("rds_cost"), _fps().alias("rds_fps"), F.max("sev").alias("rds_sev"))
    )
    vault = (
        s.where(kept_vault_signals())
        .groupBy(*ACCT_KEYS)
        .agg(
            F.count_distinct("resource_id").alias("vault_n"),
            F.count_distinct(F.when(F.col("check_id") == "aws.backup.recovery.points.stale", F.col("resource_id"))).alias("stale_n"),
            F.sum("cost").alias("vault_cost"),
            _fps().alias("vault_fps"),
        )
    )
    s3 = (
        s.where(kept_bucket_signals())
        .groupBy(*ACCT_KEYS)
        .agg(F.count_distinct("resource_id").alias("s3_n"), F.sum("cost").alias("s3_cost"), _fps().alias("s3_fps"))
    )
    c = rds.join(vault, ACCT_KEYS, "left").join(s3, ACCT_KEYS, "left").where(F.col("rds_n") >= 1)
    zero = F.lit(0).cast(MONEY)
    s3_n = F.coalesce("s3_n", F.lit(0))
    vault_n = F.coalesce("vault_n", F.lit(0))
    stale_n = F.coalesce("stale_n", F.lit(0))
    total = F.col("rds_cost") + F.coalesce("vault_cost", zero) + F.coalesce("s3_cost", zero)
    status = F.when((s3_n >= 3) & (vault_n >= 2), "fail").when((s3_n >= 1) | (vault_n >= 1), "warn").otherwise("info")
    lvl, score = _sev(((s3_n >= 5) | (stale_n >= 3), "high", 850), ((s3_n >= 2) | (vault_n >= 2), "medium", 700), default=("low", 500))
    return _shape(
        c,
        service=F.lit("AmazonRDS"),
        check_id=F.lit("aws.rds.correlation.s3.backup.lifecycle"),
        check_name=F.lit("RDS + S3 backup lifecycle correlation"),
        category=F.lit("waste"),
        sub_category=F.lit("backup"),
        status=status,
        severity_level=lvl,
        severity_score=score,
        title=F.lit("RDS backups stored in S3 without lifecycle management"),
        message=F.concat_ws("; ", F.format_string("Databases: %d, vaults: %d, buckets that keep everything: %d", "rds_n", vault_n, s3_n), _per_month(total)),
        monthly_savings=_money(total * F.lit(0.4).cast("decimal(2,1)")),
        monthly_cost=_money(total),
        confidence=F.lit(45),
        dimensions=F.create_map(
            F.lit("rds_instance_count"), F.col("rds_n").cast("string"), F.lit("backup_vaults_no_lifecycle"), vault_n.cast("string"),
            F.lit("s3_buckets_no_lifecycle"), s3_n.cast("string"),
        ),
        sources=_concat_fps("rds_fps", "vault_fps", "s3_fps"),
    )


def rule_cooccurrence(
    ri: DataFrame,
    *,
    rule_id: str,
    signals: dict[str, str],
    k: int,
    grain: Sequence[str] = ("resource_id",),
    statuses: Sequence[str] = ("fail",),
    title: str = "Correlated signals",
) -> DataFrame:
    """K-of-n co-occurrence of named signals (check ids) per key (R1/R2/R4 generalised)."""
    s = _sig(ri).where(F.col("status").isin(*statuses) & F.col("check_id").isin(*signals.values()))
    keys = ACCT_KEYS + list(grain)
    g = s.groupBy(*keys).agg(
        *[F.max(F.when(F.col("check_id") == cid, 1).otherwise(0)).alias(f"sig_{name}") for name, cid in signals.items()],
        F.sum("cost").alias("cost"),
        _fps().alias("fps"),
    )
    n = sum((F.col(f"sig_{name}") for name in signals), F.lit(0))
    names = F.array_compact(F.array(*[F.when(F.col(f"sig_{name}") == 1, F.lit(name)) for name in signals]))
    g = g.withColumn("n_signals", n).where(F.col("n_signals") >= k)
    res = F.col(grain[0]) if grain else F.col("account_id")
    return _shape(
        g,
        resource_type=F.lit(grain[0] if grain else "account"),
        resource_id=res,
        check_id=F.lit(rule_id),
        check_name=F.lit(title),
        category=F.lit("governance"),
        status=F.lit("fail"),
        severity_level=F.when(n == len(signals), "high").otherwise("medium"),
        severity_score=F.when(n == len(signals), 850).otherwise(700),
        title=F.lit(title),
        message=F.concat(F.lit("signals: "), F.array_join(names, ",")),
        monthly_cost=F.when(F.col("cost") > 0, F.col("cost")),
        dimensions=F.create_map(F.lit("signals"), F.array_join(names, ","), F.lit("signal_count"), n.cast("string")),
        sources=F.col("fps"),
    )


# Built-in rule ids, names and required source checks.
BUILTIN_RULES = [
    Rule(
        "aws.backup.correlation.vault.risk",
        "AWS Backup vault risk (correlated)",
        (
            "aws.backup.vaults.no.lifecycle",
            "aws.backup.vaults.access.policy.misconfig",
            "aws.backup.recovery.points.stale",
            "aws.backup.rules.no.lifecycle",
            "aws.backup.plans.no.selections",
        ),
        rule_vault_risk,
        sources=vault_signals,
        grain="vault",
    ),
    Rule(
        "aws.cloudwatch.correlation.custom.metrics.sprawl",
        "CloudWatch custom metrics sprawl (correlated)",
        ("aws.cloudwatch.custom.metrics.from.log.filters",),
        rule_custom_metrics_sprawl,
        sources=metric_signals,
    ),
    Rule(
        "aws.cloudwatch.correlation.observability.sprawl",
        "CloudWatch observability sprawl (correlated)",
        ("aws.cloudwatch.alarms.high.count", "aws.cloudwatch.custom.metrics.from.log.filters"),
        rule_observability_sprawl,
        sources=observability_signals,
    ),
    Rule(
        "aws.ec2.correlation.cloudwatch.monitoring.cost",
        "EC2 + CloudWatch monitoring cost correlation",
        (
            "aws.ec2.instances.underutilized",
            "aws.ec2.instances.stopped.long",
            "aws.logs.log.groups.retention.missing",
            "aws.cloudwatch.alarms.high.count",
        ),
        rule_ec2_monitoring_cost,
        sources=idle_instance_signals,
    ),
    Rule(
        "aws.ec2.correlation.ebs.unattached.unencrypted",
        "EBS unattached + unencrypted volume (correlated)",
        ("aws.ec2.ebs.unattached.volume", "aws.ec2.ebs.volume.unencrypted"),
        rule_ebs_unattached_unencrypted,
        sources=volume_signals,
        grain="resource",
    ),
    Rule(
        "aws.lambda.correlation.cloudwatch.logs.cost",
        "Lambda + CloudWatch Logs cost correlation",
        (
            "aws.logs.log.groups.retention.missing",
            "aws.lambda.functions.unused",
            "aws.lambda.functions.memory.overprovisioned",
            "aws.cloudwatch.alarms.high.count",
        ),
        rule_lambda_logs_cost,
        sources=lambda_log_signals,
    ),
    Rule(
        "aws.logs.correlation.retention.missing.sprawl",
        "CloudWatch Logs retention missing (correlated)",
        ("aws.logs.log.groups.retention.missing",),
        rule_retention_missing_sprawl,
        sources=log_signals,
    ),
    Rule(
        "aws.nat.correlation.ec2.traffic",
        "NAT Gateway + EC2 traffic correlation",
        (
            "aws.ec2.nat.gateways.idle",
            "aws.ec2.nat.gateways.high.data.processing",
            "aws.ec2.nat.gateways.cross.az",
            "aws.ec2.instances.underutilized",
        ),
        rule_nat_ec2_traffic,
        sources=traffic_signals,
    ),
    Rule(
        "aws.rds.correlation.s3.backup.lifecycle",
        "RDS + S3 backup lifecycle correlation",
        (
            "aws.rds.instances.stopped.storage",
            "aws.rds.storage.overprovisioned",
            "aws.backup.vaults.no.lifecycle",
            "aws.backup.recovery.points.stale",
            "aws.s3.bucket.lifecycle.missing",
            "aws.s3.governance.lifecycle.missing",
        ),
        rule_rds_s3_backup,
        sources=backup_signals,
    ),
]


# ---------------------------------------------------------------------------
# Finalize, run, user rules
# ---------------------------------------------------------------------------


#: dimension of a meta-finding that holds the digest of its sources
SOURCES_KEY = "source_digest"


def finalize(raw: DataFrame, rule: Rule, meta: DataFrame, *, id_salt: str = "stable") -> DataFrame:
    """Rule output -> storage findings with deterministic identity.

    issue key = {rule_id, sources = digest of the distinct source fingerprints
    (number and hash sum, defined at any size)}; fingerprint/finding_id via the contract hashes. Run metadata
    comes from the per-run aggregate (J8).
    """
    missing = [c for c in ("tenant_id", "workspace_id", "run_id", "account_id", "status") if c not in raw.columns]
    if missing:
        raise ValueError(f"rule {rule.rule_id} output lacks {missing}")
    j = raw.join(meta, RUN_KEYS, "left")
    digest = F.coalesce("sources", _listed_sources(F.col("source_fingerprints")))
    sources = F.concat_ws(":", digest["n"].cast("string"), F.coalesce(digest["h"], F.lit(0)).cast("string"))
    drafts = j.select(
        "tenant_id",
        "workspace_id",
        "run_id",
        "run_ts",
        F.coalesce("cloud", F.lit("")).alias("cloud"),
        F.coalesce("provider_partition", F.lit("")).alias("provider_partition"),
        F.coalesce("billing_account_id", F.lit("")).alias("billing_account_id"),
        "account_id",
        "region",
        "service",
        "resource_type",
        "resource_id",
        "resource_arn",
        F.coalesce(F.nullif(F.col("check_id"), F.lit("")), F.lit(f"correlation.{rule.rule_id}")).alias("check_id"),
        F.coalesce(F.nullif(F.col("check_name"), F.lit("")), F.lit(rule.name)).alias("check_name"),
        F.coalesce(F.nullif(F.col("category"), F.lit("")), F.lit("governance")).alias("category"),
        "sub_category",
        "frameworks",
        F.coalesce(F.nullif(F.col("status"), F.lit("")), F.lit("fail")).alias("status"),
        F.coalesce("severity_level", F.lit("medium")).alias("severity_level"),
        F.coalesce("severity_score", F.lit(700)).alias("severity_score"),
        F.coalesce(F.nullif(F.col("title"), F.lit("")), F.lit(f"Correlated signal: {rule.name}")).alias("title"),
        "message",
        "recommendation",
        money_or_zero(F.col("monthly_savings")).alias("monthly_savings"),
        money_or_zero(F.col("monthly_cost")).alias("monthly_cost"),
        confidence_0_100(F.col("confidence")).alias("confidence"),
        F.coalesce(F.nullif(F.col("notes"), F.lit("")), F.lit("Correlated meta-finding.")).alias("notes"),
        F.map_concat(F.map_filter(F.coalesce("dimensions", F.create_map().cast("map<string,string>")), lambda k, v: k != SOURCES_KEY), F.create_map(F.lit(SOURCES_KEY), sources)).alias("dimensions"),
        "metadata_json",
        F.create_map(F.lit("rule_id"), F.lit(rule.rule_id), F.lit("sources"), sources).alias("issue_key"),
        F.lit(f"correlation:{rule.rule_id}").alias("source_ref"),
        sources.alias("source_fingerprints_text"),
    )
    out = to_findings(
        drafts.drop("source_fingerprints_text"),
        engine_name="spendlens",
        source_type="scanner",
        id_salt=id_salt,
    )
    return out


def sql_rule(rule_id: str, name: str, required: Sequence[str], sql: str) -> Rule:
    """A user rule as SQL over ``rule_input`` (Spark parses and analyzes it)."""
    return Rule(rule_id, name, tuple(required), sql=sql)


def _run_one(spark_base: DataFrame, rule: Rule) -> DataFrame:
    ri = rule_input(spark_base, rule.required_check_ids)
    if rule.fn is not None:
        return rule.fn(ri, **rule.params) if rule.params else rule.fn(ri)
    out = _sql_over(ri, rule.sql or "")
    missing = [c for c in ("tenant_id", "workspace_id", "run_id", "account_id", "status") if c not in out.columns]
    if missing:
        raise ValueError(f"rule {rule.rule_id} output lacks required columns {missing}")
    return _conform(out)


def _sql_over(ri: DataFrame, text: str) -> DataFrame:
    """The rule's SQL with ``rule_input`` bound to the frame (no name is left in the session)."""
    if "{rule_input}" not in text:
        text = re.sub(r"\brule_input\b", "{rule_input}", text.replace("{", "{{").replace("}", "}}"))
    return ri.sparkSession.sql(text, rule_input=ri)


def _conform(df: DataFrame) -> DataFrame:
    """Project a user rule's output onto RULE_COLUMNS (missing -> defaults)."""
    given = {"region": F.lit("")} | {c: F.col(c) for c in RULE_COLUMNS if c in df.columns}
    return _shape(df, **given)


def correlate(
    findings: DataFrame,
    rules: Sequence[Rule] = tuple(BUILTIN_RULES),
    *,
    tenant_id: str = "",
    workspace_id: str = "",
    run_id: str = "",
    id_salt: str = "stable",
    fail_fast: bool = True,
) -> tuple[DataFrame, DataFrame]:
    """Run every enabled rule and union the meta-findings.

    Returns (meta_findings, report); the report has one row per enabled rule with the number
    emitted, 0 included (one aggregate over the union, not one job per rule), and the error of
    a rule that has none. Without ``fail_fast`` a rule that Spark cannot analyze, or whose
    output lacks columns, is such a row and the others run.
    """
    base = base_findings(findings, tenant_id, workspace_id, run_id)
    outs, errors = _planned(base, rules, id_salt, fail_fast)
    if not outs:
        return _typed_empty(findings), _report(findings.sparkSession, rules, errors, None)
    allm = reduce(DataFrame.unionByName, outs)
    return allm, _report(findings.sparkSession, rules, errors, allm)


def _planned(base: DataFrame, rules: Sequence[Rule], id_salt: str, fail_fast: bool) -> tuple[list[DataFrame], dict[str, str]]:
    """The analyzed plan of each enabled rule, and the error of those without one."""
    meta = run_meta(base)
    outs, errors = [], {}
    for r in rules:
        if not r.enabled:
            continue
        try:
            outs.append(finalize(_run_one(base, r), r, meta, id_salt=id_salt))
        except (PySparkException, ValueError) as e:
            if fail_fast:
                raise
            errors[r.rule_id] = (e.getCondition() or type(e).__name__) if isinstance(e, PySparkException) else str(e)
    return outs, errors


def _typed_empty(findings: DataFrame) -> DataFrame:
    return findings.where(F.lit(False))


def _report(spark, rules: Sequence[Rule], errors: dict[str, str], allm: DataFrame | None) -> DataFrame:
    ran = spark.createDataFrame([(r.rule_id, errors.get(r.rule_id)) for r in rules if r.enabled], "rule_id string, error string")
    if allm is None:
        return ran.select("rule_id", F.lit(0).cast("long").alias("emitted"), "error")
    counts = allm.groupBy(F.regexp_replace(F.col("source.source_ref"), "^correlation:", "").alias("rule_id")).agg(F.count(F.lit(1)).alias("emitted"))
    return ran.join(counts, "rule_id", "left").select("rule_id", F.coalesce("emitted", F.lit(0)).alias("emitted"), "error")


def store_correlated(findings: DataFrame, rules: Sequence[Rule], path: str, *, id_salt: str = "stable", fail_fast: bool = False) -> DataFrame:
    """R10 as a job: write the meta-findings to ``path`` and return the report, counted from what
    was written, so no rule runs twice."""
    outs, errors = _planned(findings, rules, id_salt, fail_fast)
    spark = findings.sparkSession
    if not outs:
        return _report(spark, rules, errors, None)
    reduce(DataFrame.unionByName, outs).write.mode("overwrite").parquet(path)
    return _report(spark, rules, errors, spark.read.parquet(path))


def evidence(findings: DataFrame, meta: DataFrame, rules: Sequence[Rule], *, salts: int = 32) -> DataFrame:
    """The source findings behind meta-findings, one row each.

    A meta-finding's identity holds only a digest of its sources; here they are listed by the
    very predicates the rules count with. One pass over the findings notes for each which
    rules count it and at which grain; the notes meet their meta-findings by an equi-join on
    run, account, region, rule and subject (the resource, the vault, or the account). At the
    account grain the notes are dealt over ``salts`` keys and the few meta-findings copied to
    each, so a hot account is no single task. Rules of users list their sources themselves.

    Columns: tenant_id, workspace_id, run_id, meta_fingerprint, rule_id, subject, check_id,
    fingerprint. Count and hash sum equal each meta-finding's digest (``evidence_digests``).
    """
    told = [r for r in rules if r.sources is not None]
    checks = sorted({c for r in told for c in r.required_check_ids})
    arn = F.coalesce("resource_arn", F.lit(""))
    any_arn = F.lit(None).cast("string")
    spread = F.pmod(F.xxhash64("fingerprint"), F.lit(salts)).cast("int")
    subject = {
        "resource": (F.col("resource_id"), arn, F.lit(0)),
        # points and rules name the vault only; a vault's own findings must be of the same vault
        "vault": (vault_of(), F.when(F.col("check_id").isin(*VAULT_OWN), arn).otherwise(any_arn), F.lit(0)),
        "account": (F.col("account_id"), any_arn, spread),
    }

    def note(r: Rule) -> Column:
        who, named, salt = subject[r.grain]
        counted = r.sources(**{k: v for k, v in r.params.items() if k == "statuses"})
        return F.when(counted, F.struct(F.lit(r.rule_id).alias("rule_id"), who.alias("subject"), named.alias("arn"), salt.alias("salt")))

    s = _sig(findings.where(F.col("check_id").isin(*checks)))
    notes = s.select(*ACCT_KEYS, "check_id", "fingerprint", F.explode(F.array_compact(F.array(*map(note, told)))).alias("note"))
    notes = notes.select(*ACCT_KEYS, "check_id", "fingerprint", "note.*").distinct()
    by_account = [r.rule_id for r in told if r.grain == "account"]
    m = meta.select(
        *RUN_KEYS,
        F.col("scope.account_id").alias("account_id"),
        F.col("scope.region").alias("region"),
        F.regexp_replace(F.col("source.source_ref"), "^correlation:", "").alias("rule_id"),
        F.col("scope.resource_id").alias("subject"),
        F.coalesce("scope.resource_arn", F.lit("")).alias("meta_arn"),
        F.col("fingerprint").alias("meta_fingerprint"),
    )
    copies = F.when(F.col("rule_id").isin(*by_account), salts).otherwise(1)
    m = m.withColumn("salt", F.explode(F.sequence(F.lit(0), copies - 1)))
    same = F.col("arn").isNull() | (F.col("arn") == F.col("meta_arn"))
    for k in (*ACCT_KEYS, "rule_id", "subject", "salt"):
        same &= notes[k].eqNullSafe(m[k])
    keep = [notes[k] for k in (*RUN_KEYS, "rule_id", "subject", "check_id", "fingerprint")]
    return notes.join(m, same).select(*keep[: len(RUN_KEYS)], "meta_fingerprint", *keep[len(RUN_KEYS) :])


def evidence_digests(listed: DataFrame, meta: DataFrame) -> DataFrame:
    """Per meta-finding the digest it carries, the one of its listed sources, and whether they agree."""
    h = F.sum(_source_hash(F.col("fingerprint"))).cast("decimal(38,0)")
    found = listed.groupBy(*RUN_KEYS, "rule_id", "meta_fingerprint").agg(F.count(F.lit(1)).alias("sources"), F.concat_ws(":", F.count(F.lit(1)).cast("string"), h.cast("string")).alias("listed_digest"))
    m = meta.select(
        *RUN_KEYS, F.regexp_replace(F.col("source.source_ref"), "^correlation:", "").alias("rule_id"), F.col("fingerprint").alias("meta_fingerprint"), F.col("dimensions")[SOURCES_KEY].alias("digest")
    )
    out = m.join(found, [*RUN_KEYS, "rule_id", "meta_fingerprint"], "left")
    return out.withColumns({"sources": F.coalesce("sources", F.lit(0)), "agree": F.col("digest") == F.coalesce("listed_digest", F.lit("0:0"))})


def meta_flat(meta: DataFrame) -> DataFrame:
    """Flat projection of meta-findings used by the registered queries."""
    return meta.select(
        "tenant_id",
        "workspace_id",
        "run_id",
        "check_id",
        F.col("scope.account_id").alias("account_id"),
        F.col("scope.region").alias("region"),
        F.col("scope.resource_id").alias("resource_id"),
        "status",
        F.col("severity.level").alias("severity_level"),
        F.col("severity.score").alias("severity_score"),
        F.col("estimated.monthly_savings").alias("monthly_savings"),
        F.col("estimated.monthly_cost").alias("monthly_cost"),
        F.col("estimated.confidence").cast("int").alias("confidence"),
        "fingerprint",
    )
