"""Correlation rules on hand fixtures (both signals / one signal / repeat), identity stability."""

from decimal import Decimal

import pytest

from pyspark.sql import functions as F

from spendlens.operators import correlate as C
from spendlens.operators.contract import to_findings

import datetime as dt


def _drafts(spark, rows):
    schema = (
        "tenant_id string, workspace_id string, run_id string, run_ts timestamp, cloud string, account_id string, region string, "
        "service string, resource_type string, resource_id string, resource_arn string, check_id string, status string, "
        "severity_level string, severity_score int, title string, monthly_cost decimal(18,6), dimensions map<string,string>"
    )
    return to_findings(spark.createDataFrame(rows, schema))


def row(check, rtype, rid, cost=Decimal("0"), dims=None, status="fail"):
    return ("acme", "prod", "run-1", dt.datetime(2024, 1, 1), "aws", "123456789012", "eu-west-1", "AmazonEC2", rtype, rid,
            "", check, status, "high", 800, "t", cost, dims or {})


def test_ebs_rule_needs_both_signals(spark):
    both = [
        row("aws.ec2.ebs.unattached.volume", "ebs_volume", "vol-1", Decimal("9.5"), {"volume_type": "gp2", "size_gb": "100", "age_days": "10"}),
        row("aws.ec2.ebs.volume.unencrypted", "ebs_volume", "vol-1"),
        row("aws.ec2.ebs.unattached.volume", "ebs_volume", "vol-2", Decimal("60")),
    ]
    rule = [r for r in C.BUILTIN_RULES if r.rule_id == "aws.ec2.correlation.ebs.unattached.unencrypted"]
    meta, _ = C.correlate(_drafts(spark, both), rule)
    got = meta.collect()
    assert len(got) == 1
    m = got[0]
    assert m.scope.resource_id == "vol-1"
    assert (m.severity.level, m.severity.score) == ("high", 850)
    assert m.estimated.monthly_cost == Decimal("9.5")
    assert m.estimated.confidence == 55
    assert m.source.source_ref == "correlation:aws.ec2.correlation.ebs.unattached.unencrypted"
    assert "100 GB" in m.message and "about $9.50 a month" in m.message  # the size and cost dimensions reach the text
    again, _ = C.correlate(_drafts(spark, list(reversed(both))), rule)
    assert again.collect()[0].fingerprint == m.fingerprint  # deterministic identity


def test_vault_risk_two_signals_with_stale(spark):
    rows = [
        row("aws.backup.vaults.no.lifecycle", "backup_vault", "vault-001"),
        row("aws.backup.recovery.points.stale", "recovery_point", "rp-1", Decimal("12.345678"), {"vault_name": "vault-001"}),
        row("aws.backup.vaults.no.lifecycle", "backup_vault", "vault-002"),
    ]
    rule = [r for r in C.BUILTIN_RULES if r.rule_id == "aws.backup.correlation.vault.risk"]
    got = C.correlate(_drafts(spark, rows), rule)[0].collect()
    assert len(got) == 1
    assert got[0].scope.resource_id == "vault-001"
    assert (got[0].severity.level, got[0].severity.score) == ("high", 850)
    assert got[0].estimated.monthly_cost == Decimal("12.345678")


def test_sprawl_thresholds(spark):
    def metrics(n):
        return [row("aws.cloudwatch.custom.metrics.from.log.filters", "custom_metric", f"m{i}", status="info",
                    dims={"namespace": f"ns{i % 2}"}) for i in range(n)]

    rule = [r for r in C.BUILTIN_RULES if r.rule_id == "aws.cloudwatch.correlation.custom.metrics.sprawl"]
    for n, expect in ((4, 0), (5, 1), (6, 1)):
        got = C.correlate(_drafts(spark, metrics(n)), rule)[0].collect()
        assert len(got) == expect, n
        if expect:
            assert got[0].severity.score == 650


def test_user_sql_rule_and_report(spark):
    rows = [row("aws.ec2.ebs.gp2.to.gp3", "ebs_volume", f"v{i}") for i in range(3)]
    sql = (
        "SELECT tenant_id, workspace_id, run_id, scope.account_id AS account_id, scope.region AS region, "
        "'user.rule' AS check_id, 'fail' AS status, collect_set(fingerprint) AS source_fingerprints "
        "FROM rule_input GROUP BY tenant_id, workspace_id, run_id, scope.account_id, scope.region"
    )
    r = C.sql_rule("user.rule", "User rule", ["aws.ec2.ebs.gp2.to.gp3"], sql)
    meta, report = C.correlate(_drafts(spark, rows), [r])
    assert meta.count() == 1
    assert report.collect()[0].emitted == 1


def _all_signals():
    """Findings that make every built-in rule emit, and some it must not count."""
    rows = [row("aws.ec2.ebs.unattached.volume", "ebs_volume", "vol-1"), row("aws.ec2.ebs.volume.unencrypted", "ebs_volume", "vol-1"), row("aws.ec2.ebs.unattached.volume", "ebs_volume", "vol-2")]
    rows += [row("aws.ec2.ebs.volume.unencrypted", "ebs_volume", "vol-1", status="info")]
    rows += [row("aws.backup.vaults.no.lifecycle", "backup_vault", v) for v in ("v1", "v2")]
    rows += [row("aws.backup.recovery.points.stale", "recovery_point", f"rp-{i}", dims={"vault_name": "v1"}) for i in range(3)]
    rows += [row("aws.backup.rules.no.lifecycle", "backup_rule", "rule", dims={"target_vault_name": "v1"}), row("aws.backup.recovery.points.stale", "recovery_point", "rp-9", dims={"vault_name": "v9"})]
    rows += [row("aws.cloudwatch.custom.metrics.from.log.filters", "custom_metric", f"m{i}", status="info") for i in range(25)]
    rows += [row("aws.cloudwatch.alarms.high.count", "account", "123456789012", status="info", dims={"alarm_count": "300"})]
    rows += [row("aws.logs.log.groups.retention.missing", "log_group", f"/aws/lambda/f{i}") for i in range(4)] + [row("aws.logs.log.groups.retention.missing", "log_group", "other", status="warn")]
    rows += [row("aws.ec2.instances.underutilized", "instance", f"i-{i}") for i in range(3)] + [row("aws.ec2.instances.stopped.long", "instance", "i-9", status="info")]
    rows += [row("aws.ec2.nat.gateways.idle", "nat-gateway", "nat-1"), row("aws.ec2.nat.gateways.cross.az", "nat_gateway", "nat-2", status="info")]
    rows += [row("aws.rds.storage.overprovisioned", "db_instance", "db-1"), row("aws.s3.governance.lifecycle.missing", "bucket", "b-1")]
    return rows + rows[:5]  # repeated findings count once


def test_evidence_equals_every_digest(spark):
    f = _drafts(spark, _all_signals())
    meta, _ = C.correlate(f, C.BUILTIN_RULES)
    meta = meta.cache()
    listed = C.evidence(f, meta, C.BUILTIN_RULES, salts=4).cache()
    digests = C.evidence_digests(listed, meta).collect()
    assert {d.rule_id for d in digests} == {r.rule_id for r in C.BUILTIN_RULES} and all(d.agree for d in digests)
    n = {d.rule_id.split("correlation.")[1]: d.sources for d in digests}
    assert n == {
        "vault.risk": 5, "ebs.unattached.unencrypted": 2, "custom.metrics.sprawl": 25, "observability.sprawl": 26, "cloudwatch.monitoring.cost": 3,
        "cloudwatch.logs.cost": 4, "retention.missing.sprawl": 4, "ec2.traffic": 4, "s3.backup.lifecycle": 4,
    }
    plan = C.evidence(f, meta, C.BUILTIN_RULES)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_evidence_keeps_tenants_apart(spark):
    rows = _all_signals()
    other = [("rival", *r[1:]) for r in rows if r[11] != "aws.ec2.ebs.volume.unencrypted"]
    f = _drafts(spark, rows + other)
    meta, _ = C.correlate(f, C.BUILTIN_RULES)
    listed = C.evidence(f, meta, C.BUILTIN_RULES)
    assert all(d.agree for d in C.evidence_digests(listed, meta).collect())
    assert not listed.where("tenant_id = 'rival' AND rule_id LIKE '%ebs%'").count()


def test_a_broken_rule_is_a_row_of_the_report(spark, tmp_path):
    sound = "SELECT tenant_id, workspace_id, run_id, scope.account_id AS account_id, 'fail' AS status FROM rule_input GROUP BY ALL"
    rules = [
        C.sql_rule("broken", "b", ["aws.ec2.ebs.gp2.to.gp3"], "SELECT nothing FROM rule_input"),
        C.sql_rule("sound", "s", ["aws.ec2.ebs.gp2.to.gp3"], sound),
        C.sql_rule("other", "o", ["aws.ec2.instances.underutilized"], sound),
    ]
    f = _drafts(spark, [row("aws.ec2.ebs.gp2.to.gp3", "ebs_volume", "v")])
    meta, report = C.correlate(f, rules, fail_fast=False)
    want = {"broken": (0, "UNRESOLVED_COLUMN.WITH_SUGGESTION"), "sound": (1, None), "other": (0, None)}
    assert {r.rule_id: (r.emitted, r.error) for r in report.collect()} == want and meta.count() == 1
    stored = C.store_correlated(f, rules, str(tmp_path / "meta"))
    assert {r.rule_id: (r.emitted, r.error) for r in stored.collect()} == want
    assert not spark.catalog.tableExists("rule_input")
    assert C.correlate(f, rules[:1], fail_fast=False)[0].count() == 0
    with pytest.raises(Exception):
        C.correlate(f, rules)
