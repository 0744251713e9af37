"""Detectors: one passing, one failing and one suppressed row each, boundaries of age and status."""

import datetime as dt

import pytest

from spendlens.operators import detect as D

AS_OF = "2024-02-01 00:00:00"
NOW = dt.datetime(2024, 2, 1)
SCOPE = ("t", "111", "eu-west-1")
SC = "tenant_id string, account_id string, region string"


def ids(df, check):
    return sorted(r.resource_id for r in df.where(df.check_id == check).collect())


def test_log_groups(spark):
    rows = [("flag", None, {"purpose": "x"}), ("kept", 30, {}), ("lifecycle", None, {"lifecycle": "x"}), ("value", None, {"any": "Permanent"}), ("backup", None, {"backup": "x"})]
    df = spark.createDataFrame([(*SCOPE, n, r, t) for n, r, t in rows], SC + ", log_group string, retention_days int, tags map<string,string>")
    assert ids(D.log_retention_findings(df), "aws.logs.log.groups.retention.missing") == ["backup", "flag"]


def test_recovery_points(spark):
    old = NOW - dt.timedelta(days=200)
    rows = [("flag", old, {"lifecycle": "x"}), ("new", NOW - dt.timedelta(days=89), {}), ("hold", old, {"Legal-Hold": "case"}), ("value", old, {"policy": "backup-policy"})]
    rp = spark.createDataFrame([(*SCOPE, n, "v", c, "COMPLETED", None, 10.0, "WARM", t) for n, c, t in rows], SC + ", recovery_point_arn string, vault_name string, created timestamp, status string, delete_at timestamp, size_gb double, storage_class string, tags map<string,string>")
    plans = spark.createDataFrame([], SC + ", plan_id string, rules array<struct<move_days:int,delete_days:int>>")
    out = D.backup_findings(plans, spark.createDataFrame([], "plan_id string"), rp, AS_OF)
    assert ids(out, "aws.backup.recovery.points.stale") == ["flag"]


def test_orphaned_nat_gateways(spark):
    day = dt.timedelta(days=1)
    rows = [("old", "available", NOW - 2 * day, {}), ("young", "available", NOW - day / 2, {}), ("unknown", "available", None, {}), ("deleting", "deleting", NOW - 9 * day, {}), ("kept", "available", NOW - 9 * day, {"keep": "x"}), ("routed", "available", NOW - 9 * day, {})]
    nats = spark.createDataFrame([(*SCOPE, n, "eu-west-1a", s, c, t) for n, s, c, t in rows], SC + ", resource_id string, az string, state string, create_time timestamp, tags map<string,string>")
    routes = spark.createDataFrame([("rtb", "routed", "s1", False)], "route_table_id string, nat_gateway_id string, subnet_id string, has_igw_default boolean")
    metrics = spark.createDataFrame([], SC + ", resource_id string, metric string, ts timestamp, value double")
    out = D.nat_findings(nats, routes, spark.createDataFrame([("s1", "eu-west-1b")], "subnet_id string, az string"), metrics, AS_OF)
    assert ids(out, "aws.ec2.nat.gateways.orphaned") == ["old", "unknown"]
    assert ids(out, "aws.ec2.nat.gateways.cross.az") == ["routed"]


def test_load_balancers(spark):
    day = dt.timedelta(days=1)
    made = {"bare": 9 * day, "young": day, "unknown": None, "empty": 9 * day, "sick": 9 * day, "well": 9 * day, "kept": 9 * day}
    lbs = spark.createDataFrame([(*SCOPE, n, "application", NOW - a if a else None, {"keep": "x"} if n == "kept" else {}) for n, a in made.items()], SC + ", lb_name string, lb_type string, created timestamp, tags map<string,string>")
    listeners = spark.createDataFrame([(*SCOPE, n, "forward", f"tg-{n}") for n in ("empty", "sick", "well")], SC + ", lb_name string, action_type string, target_group string")
    groups = spark.createDataFrame([(*SCOPE, f"tg-{n}", "instance") for n in ("empty", "sick", "well")], SC + ", target_group string, target_type string")
    targets = spark.createDataFrame([(*SCOPE, "tg-sick", "i-1", "unhealthy"), (*SCOPE, "tg-well", "i-2", "unhealthy"), (*SCOPE, "tg-well", "i-3", "healthy")], SC + ", target_group string, target_id string, health string")
    metrics = spark.createDataFrame([], SC + ", resource_id string, metric string, ts timestamp, value double")
    out = D.elbv2_findings(lbs, listeners, groups, targets, metrics, AS_OF).cache()
    assert ids(out, "aws.elbv2.load.balancers.no.listeners") == ["bare", "unknown"]
    assert ids(out, "aws.elbv2.load.balancers.no.registered.targets") == ["empty"]
    assert ids(out, "aws.elbv2.load.balancers.no.healthy.targets") == ["sick"]
    assert {str(r.monthly_cost) for r in out.where("resource_id = 'bare'").collect()} == {"16.200000"}


@pytest.mark.parametrize("n,flagged", [(99, False), (100, True)])
def test_alarm_count(spark, n, flagged):
    out = D.alarms_high_count(spark.createDataFrame([(*SCOPE, f"a{i}") for i in range(n)], SC + ", alarm_name string")).collect()
    assert bool(out) == flagged and all(r.monthly_savings == r.monthly_cost for r in out)


def test_size_ladder(spark):
    from pyspark.sql import functions as F

    from spendlens.operators.rightsize import smaller_type

    rows = spark.createDataFrame([("m5.xlarge",), (" M5.Large ",), ("t3.nano",), ("m5.metal",), ("m5",), ("",), (None,)], "t string")
    assert [r[0] for r in rows.select(smaller_type(F.col("t"))).collect()] == ["m5.large", "m5.medium", None, None, None, None, None]


def test_underutilized_price_hit_fallback_and_none(spark):
    from spendlens.operators.rightsize import underutilized_instances

    types = {"hit": "m5.xlarge", "fallback": "m3.large", "none": "z9.large", "busy": "m5.xlarge", "silent": "m5.xlarge", "stopped": "m5.xlarge"}
    inst = spark.createDataFrame([(*SCOPE, n, t, "stopped" if n == "stopped" else "running") for n, t in types.items()], SC + ", instance_id string, instance_type string, state string")
    at = NOW - dt.timedelta(days=1)
    points = [(*SCOPE, n, "CPUUtilization", at, 90.0 if n == "busy" else 10.0) for n in types if n != "silent"] + [(*SCOPE, n, "NetworkIn", at, 512 * 1024.0) for n in types if n != "silent"]
    metrics = spark.createDataFrame(points, SC + ", resource_id string, metric string, ts timestamp, value double")
    prices = spark.createDataFrame([("eu-west-1", "ec2_hour", "m5.xlarge", 0.2, "pricing_api"), ("eu-west-1", "ec2_hour", "m5.large", 0.1, "pricing_api")], "region string, kind string, key string, unit_price double, source string")
    got = {r.resource_id: r for r in underutilized_instances(inst, metrics, prices, AS_OF, fallback={"m3.large": 0.1}).collect()}
    assert set(got) == {"hit", "fallback", "none"}
    assert (float(got["hit"].monthly_cost), float(got["hit"].monthly_savings), got["hit"].confidence) == (146.0, 73.0, 90)
    assert (float(got["fallback"].monthly_cost), float(got["fallback"].monthly_savings), got["fallback"].confidence) == (73.0, 73.0, 0)
    assert got["none"].monthly_cost is None and got["none"].confidence == 0


def test_rds_snapshots(spark):
    from spendlens.operators.rightsize import rds_snapshots

    old, new = NOW - dt.timedelta(days=40), NOW - dt.timedelta(days=3)
    rows = [("gone", "manual", "db", "db-9", None, new), ("elsewhere", "manual", "db", "db-9", "us-east-1", old), ("young", "manual", "db", "db-1", None, new), ("auto", "automated", "db", "db-1", None, old), ("old", "Manual", "db", "db-1", None, old), ("cluster", "manual", "cluster", "db-1", None, old)]
    snaps = spark.createDataFrame([(*SCOPE, *r, 10.0) for r in rows], SC + ", snapshot_id string, snapshot_type string, kind string, source_id string, source_region string, created timestamp, size_gb double")
    out = rds_snapshots(snaps, spark.createDataFrame([(*SCOPE, "db", "db-1")], SC + ", kind string, source_id string"), AS_OF)
    assert ids(out, "aws.rds.snapshots.orphaned") == ["cluster", "gone"] and ids(out, "aws.rds.snapshots.manual.old") == ["elsewhere", "old"]


def test_fsx_windows_settings_and_activity(spark):
    from spendlens.operators.filesystems import fsx_findings

    tags = {"Application": "a", "applicationId": "1", "environment": "prod"}
    rows = [
        ("good", "WINDOWS", "SINGLE_AZ_1", 100, 32, "HDD", 7, True, "1:07:59", tags),
        ("bad", "WINDOWS", "MULTI_AZ_1", 4096, 32, "SSD", 0, False, "", {"Name": "my-dev-share"}),
        ("low", "WINDOWS", None, 4095, 0, "HDD", 6, None, "1:18:00", tags),
    ]
    f = spark.createDataFrame([(*SCOPE, *r) for r in rows], SC + ", file_system_id string, fs_type string, deployment string, storage_gib int, throughput int, storage_type string, backup_days int, copy_tags boolean, maintenance string, tags map<string,string>")
    at = NOW - dt.timedelta(days=1)
    m = spark.createDataFrame([(*SCOPE, "good", "ThroughputUtilization", at, 50.0), (*SCOPE, "low", "DataReadBytes", at, 0.0)], SC + ", resource_id string, metric string, ts timestamp, value double")
    prices = spark.createDataFrame([("eu-west-1", "fsx_gb_month", "ssd", 0.13, "pricing_api"), ("eu-west-1", "fsx_gb_month", "hdd", 0.03, "pricing_api")], "region string, kind string, key string, unit_price double, source string")
    got = {}
    for r in fsx_findings(f, m, prices, AS_OF).collect():
        got.setdefault(r.resource_id, {})[r.check_id.removeprefix("aws.fsx.")] = r
    assert "good" not in got
    assert set(got["bad"]) == {
        "filesystems.missing.required.tags", "filesystems.possible.unused", "filesystems.large.and.inactive", "filesystems.multi.az.in.nonprod",
        "windows.backups.disabled", "windows.copy.tags.to.backups.disabled", "windows.maintenance.window.missing", "windows.storage.type.mismatch",
    }
    assert set(got["low"]) == {"filesystems.possible.unused", "windows.backup.retention.low", "windows.maintenance.window.business.hours"}
    assert got["bad"]["filesystems.possible.unused"].confidence == 35 and got["low"]["filesystems.possible.unused"].confidence == 60
    assert float(got["bad"]["windows.storage.type.mismatch"].monthly_savings) == 409.6


VAULT = SC + ", vault_name string, locked boolean, min_days int, max_days int, vault_arn string, policy string"
PRICE = "region string, kind string, key string, unit_price double, source string"


def test_vault_locks(spark):
    from spendlens.operators.vaults import vault_locks

    rows = [("good", True, 7, 365), ("unset", None, None, None), ("idle", False, 0, 0), ("open-end", True, 30, None), ("short", True, 3, 365), ("long", None, 30, 4000)]
    v = spark.createDataFrame([(*SCOPE, *r, "", None) for r in rows], VAULT)
    held = [(*SCOPE, "open-end", "WARM", 100.0), (*SCOPE, "open-end", None, 1.0), (*SCOPE, "open-end", "cold", 50.0), (*SCOPE, "open-end", "WARM", -5.0), ("t2", "111", "eu-west-1", "open-end", "WARM", 9e6), (*SCOPE, "unset", "WARM", 7.0)]
    points = spark.createDataFrame(held, SC + ", vault_name string, storage_class string, size_gb double")
    prices = spark.createDataFrame([("eu-west-1", "backup_gb_month", "warm", 0.1, "pricing_api"), ("us-east-1", "backup_gb_month", "cold", 9.0, "pricing_api")], PRICE)
    out = vault_locks(v, points, prices, expected_min_days=7, expected_max_days=400).collect()
    assert {r.resource_id: r.detail.split("|")[0] for r in out} == {"unset": "missing", "idle": "missing", "open-end": "no_max", "short": "out_of_standard", "long": "out_of_standard"}
    assert {r.resource_id: (float(r.monthly_cost), r.confidence) for r in out if r.monthly_cost is not None} == {"open-end": (10.6, 70)}
    assert {r.resource_id for r in vault_locks(v, points, prices).collect()} == {"unset", "idle", "open-end"}
    empty = vault_locks(v, points.limit(0), prices).where("resource_id = 'open-end'").first()
    assert (float(empty.monthly_cost), empty.confidence) == (0.0, 20)


def _policy(*statements):
    import json

    return json.dumps({"Statement": list(statements)})


def _allow(principal, **more):
    return {"Effect": "Allow", "Principal": principal, **more}


ARN = "arn:aws:backup:eu-west-1:111122223333:backup-vault:v"
POLICIES = {
    "none": (None, ("no_access_policy", 40)),
    "blank": (" \n", ("empty_access_policy", 40)),
    "invalid": ("{", ("invalid_policy_json", 65)),
    "no statements": ('{"Statement": null}', None),
    "not an object": ("[1]", None),
    "one object": ('{"Statement": {"Effect": "ALLOW", "Principal": "*", "Action": "a"}}', ("wildcard_principal", 95)),
    "deny": (_policy({"Effect": "Deny", "Principal": "*"}), None),
    "not principal": (_policy({"Effect": "Allow", "NotPrincipal": {"AWS": "x"}, "Principal": "*"}), ("uses_notprincipal", 20)),
    "null not principal": (_policy({"Effect": "Allow", "NotPrincipal": None, "Principal": "*"}), ("wildcard_principal", 95)),
    "in list": (_policy(_allow({"AWS": ["x", "*"]}, Resource=ARN + "/x")), ("wildcard_principal", 95)),
    "org": (_policy(_allow("*", Condition={"StringLike": {"aws:PrincipalOrgID": ["o-1"]}})), ("wildcard_principal", 85)),
    "org blank": (_policy(_allow("*", Condition={"StringLike": {"aws:PrincipalOrgID": " "}})), ("wildcard_principal", 95)),
    "org other operator": (_policy(_allow("*", Condition={"StringNotLike": {"aws:PrincipalOrgID": "o-1"}})), ("wildcard_principal", 95)),
    "elsewhere": (_policy(_allow("*", Resource=["arn:other"])), ("wildcard_principal", 65)),
    "elsewhere org": (_policy(_allow("*", Resource="arn:other", Condition={"StringEquals": {"aws:PrincipalOrgID": "o-1"}})), ("wildcard_principal", 45)),
    "cross sensitive": (_policy(_allow({"AWS": "arn:aws:iam::999999999999:root"}, Action=["backup:DeleteRecoveryPoint"])), ("cross_account_access", 80)),
    "cross plain": (_policy(_allow(["999999999999"])), ("cross_account_access", 70)),
    "allowed": (_policy(_allow({"AWS": "888888888888"})), None),
    "own": (_policy(_allow({"AWS": "111122223333"}, Action="x")), ("broad_sensitive_actions", 65)),
    "service": (_policy(_allow({"Service": "backup.amazonaws.com"}, Action="*")), None),
    "worst": (_policy(_allow("111122223333", Action="x", Sid="a"), _allow("*", Sid="b", Resource="r"), _allow("*", Sid="c", Resource="r")), ("wildcard_principal", 65)),
}


def test_vault_policies(spark):
    from spendlens.operators.vaults import vault_policies

    scope = ("t", "111122223333", "eu-west-1")
    rows = [(*scope, n, True, 7, 365, ARN, p) for n, (p, _) in POLICIES.items()] + [(*scope, "lock fails", None, None, None, ARN, None)]
    got = {r.resource_id: r for r in vault_policies(spark.createDataFrame(rows, VAULT), allowed_accounts=["888888888888"]).collect()}
    assert {n: (r.detail.split("|")[0], r.severity_score) for n, r in got.items()} == {n: w for n, (_, w) in POLICIES.items() if w}
    assert got["worst"].detail.split("|")[1] == "b" and got["not principal"].status == "info" and got["org"].severity_level == "medium"
    assert got["cross sensitive"].detail == "cross_account_access||backup:deleterecoverypoint|999999999999|"


def test_sensitive_patterns(spark):
    from spendlens.operators.vaults import vault_policies

    rows = [("t", "111122223333", "eu-west-1", n, True, 7, 365, ARN, _policy(_allow("111122223333", Action=a))) for n, a in [("copy", "backup:CopyIntoVault"), ("get", "backup:Get"), ("exact", ["x", "iam:PassRole"])]]
    out = vault_policies(spark.createDataFrame(rows, VAULT), sensitive=["backup:copy*", "iam:passrole"]).collect()
    assert sorted(r.resource_id for r in out) == ["copy", "exact"]


def test_bucket_storage(spark):
    import json

    from spendlens.operators.buckets import bucket_storage_estimate

    gib, day = 1024.0**3, dt.timedelta(days=1)
    points = [
        ("big", NOW - 2 * day, 900 * gib, None), ("big", NOW - day, 10 * gib, 5 * gib), ("big", NOW, 800 * gib, None), ("big", NOW - 9 * day, 700 * gib, None),
        ("small", NOW - day, 9.99 * gib, None), ("edge", NOW - day, None, 10 * gib), ("emptied", NOW - 2 * day, 50 * gib, 20 * gib), ("emptied", NOW - day, 0.0, None), ("old", NOW - 4 * day, 50 * gib, None),
    ]
    g = spark.createDataFrame([(*SCOPE, *p) for p in points] + [("t2", "111", "us-east-1", "big", NOW - day, 100 * gib, None)], SC + ", bucket_name string, ts timestamp, StandardStorage double, GlacierStorage double")
    prices = spark.createDataFrame([("eu-west-1", "s3_gb_month", "Standard", 0.5, "pricing_api"), ("eu-west-1", "s3_gb_month", "Glacier Flexible Retrieval", 0.0, "pricing_api")], PRICE)
    got = {(r.tenant_id, r.resource_id): r for r in bucket_storage_estimate(g, prices, AS_OF).collect()}
    assert {k: (float(r.monthly_cost), r.confidence) for k, r in got.items()} == {("t", "big"): (5.02, 55), ("t", "edge"): (0.04, 55), ("t", "emptied"): (0.08, 55), ("t2", "big"): (2.3, 55)}
    total, usd, items = got["t", "big"].detail.split("|")
    assert (total, usd) == ("15.0000", "5.0200") and [(i["storage_type"], i["price_source"]) for i in json.loads(items)] == [("StandardStorage", "price_table"), ("GlacierStorage", "fallback")]
    only = spark.createDataFrame([(*SCOPE, "b", NOW - day, 20 * gib)], SC + ", bucket_name string, ts timestamp, StandardStorage double")
    assert bucket_storage_estimate(only, prices, AS_OF).first().confidence == 80


def test_two_tenants_with_equal_names(spark):
    """What lies in one tenant, account or region never answers for another."""
    from spendlens.operators.rightsize import nodegroups_on_demand, rds_rightsizing, rds_snapshots

    here, there = ("t1", "111", "eu-west-1"), ("t2", "222", "eu-west-1")
    at = NOW - dt.timedelta(days=1)
    frame = lambda rows, cols: spark.createDataFrame(rows, f"{SC}, {cols}")
    metric = "resource_id string, metric string, ts timestamp, value double"
    lbs = frame([(*s, "lb-x", "application", NOW - dt.timedelta(days=9), {}) for s in (here, there)], "lb_name string, lb_type string, created timestamp, tags map<string,string>")
    out = D.elbv2_findings(
        lbs, frame([(*here, "lb-x", "forward", "tg")], "lb_name string, action_type string, target_group string"), frame([(*s, "tg", "instance") for s in (here, there)], "target_group string, target_type string"),
        frame([(*there, "tg", "i-1", "healthy")], "target_group string, target_id string, health string"), frame([], metric), AS_OF,
    ).collect()
    assert {(r.tenant_id, r.check_id.rsplit("balancers.")[1]) for r in out} == {("t2", "no.listeners"), ("t1", "no.registered.targets")}
    idle = [(*here, "f", "Invocations", NOW - dt.timedelta(days=d), 0.0) for d in range(1, 9)] + [(*there, "f", "Invocations", NOW - dt.timedelta(days=d), 900.0) for d in range(1, 9)]
    functions = frame([(*s, "f", 128, 3) for s in (here, there)], "resource_id string, memory_mb int, timeout_s int")
    assert [r.tenant_id for r in D.lambda_findings(functions, frame(idle, metric), AS_OF).collect()] == ["t1"]
    clusters = frame([(*here, "c", {"env": "dev"}), (*there, "c", {"env": "dev"})], "cluster_name string, tags map<string,string>")
    groups = frame([(*here, "ng", "c", 1, None, {})], "nodegroup_name string, cluster_name string, desired_size int, capacity_type string, tags map<string,string>")
    assert [r.tenant_id for r in nodegroups_on_demand(clusters, groups).collect()] == ["t1"]
    dbs = frame([(*s, "db", 100, "db.m5.large", False, "src", "mysql", "available", {}) for s in (here, there)], "db_instance_id string, allocated_gb int, instance_class string, multi_az boolean, replica_of string, engine string, status string, tags map<string,string>")
    reads = [(*here, "db", "ReadIOPS", NOW - dt.timedelta(days=d), 0.0) for d in range(1, 13)]
    assert [(r.tenant_id, r.check_id) for r in rds_rightsizing(dbs, frame(reads, metric), spark.createDataFrame([], PRICE), AS_OF).collect()] == [("t1", "aws.rds.read.replica.unused")]
    snaps = frame([(*s, "snap", "automated", "db", "db", None, at, 1.0) for s in (here, there)], "snapshot_id string, snapshot_type string, kind string, source_id string, source_region string, created timestamp, size_gb double")
    assert [r.tenant_id for r in rds_snapshots(snaps, frame([(*there, "db", "db")], "kind string, source_id string"), AS_OF).collect()] == ["t1"]
    services = frame([(*here, c, "svc", "ACTIVE", 1, 0, "EC2", [], {}) for c in ("c1", "c2")], "cluster_name string, service_name string, status string, desired_count int, running_count int, launch_type string, providers array<string>, tags map<string,string>")
    idle_clusters = frame([], "cluster_name string, active_services int, running_tasks int, pending_tasks int, container_instances int")
    assert sorted(r.resource_id for r in D.ecs_findings(idle_clusters, services).collect()) == ["c1/svc", "c2/svc"]


def test_identity_tells_rules_of_a_resource_apart(spark):
    from pyspark.sql import functions as F

    from spendlens.operators.emit import drafts_to_findings

    base = (*SCOPE, "AWSBackup", "backup_vault", "v", "aws.backup.vaults.access.policy.misconfig", "fail", "low", 40, None, None, 0)
    cols = SC + ", service string, resource_type string, resource_id string, check_id string, status string, severity_level string, severity_score int, monthly_cost decimal(18,6), monthly_savings decimal(18,6), confidence int, detail string"
    rows = [(*base, "wildcard_principal|a|x||"), (*base, "wildcard_principal|b|x||"), (*base, "wildcard_principal|b|y||"), (*base, "no_access_policy||||")]
    got = drafts_to_findings(spark.createDataFrame(rows, cols), "r", F.lit(AS_OF)).select("fingerprint", "title", "category").collect()
    assert len({r.fingerprint for r in got}) == 3
    assert {(r.title, r.category) for r in got} == {("Vault access policy lets anyone in", "security"), ("Vault has no access policy", "governance")}
