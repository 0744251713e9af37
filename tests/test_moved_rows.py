"""What the read model, governance, attribution and exports move: plans deal findings by fine keys only, and results hold."""

import datetime as dt
import gzip
import io
import random
import re
from contextlib import redirect_stdout
from decimal import Decimal
from pathlib import Path

from pyspark.sql import functions as F

from spendlens.operators import governance as G
from spendlens.operators import history as H
from spendlens.operators import recommend as R
from spendlens.operators import remediation as M
from spendlens.operators.contract import to_findings
from spendlens.operators.cost import attribute_costs
from spendlens.sources.findings_io import export_json


def dealt_by(df) -> list[list[str]]:
    """Keys of the hash exchanges in the plan."""
    with redirect_stdout(io.StringIO()) as out:
        df.explain()
    return [[re.sub(r"#\d+L?$", "", c.strip()) for c in m.split(",")[:-1]] for m in re.findall(r"hashpartitioning\(([^)]*)\)", out.getvalue())]


def drafts(spark, rows):
    return to_findings(spark.createDataFrame(rows, "tenant_id string, workspace_id string, run_id string, run_ts timestamp, check_id string, status string, severity_level string, severity_score int, title string, account_id string, region string, service string, resource_id string, resource_arn string, finding_id string, fingerprint string"))


def draft(i, run, resource="r-1", region="eu", service="EC2", account="1"):
    return ("t", "prod", f"run-{run:%Y%m%d}", run, "aws.ec2.x", "fail", "high", 1, "Volume", account, region, service, resource, f"arn:{resource}", f"f{i}", f"fp-{resource}")


def test_latest_is_not_dealt_by_run(spark):
    days = [dt.datetime(2024, 1, d) for d in (1, 2, 3)]
    f = drafts(spark, [draft(i, d) for i, d in enumerate(days)])
    runs = spark.createDataFrame([("t", "prod", f"run-{d:%Y%m%d}", d, "failed" if d.day == 3 else "ready") for d in days], "tenant_id string, workspace_id string, run_id string, run_ts timestamp, status string")
    latest, (presence, _) = H.latest_of_runs(f, runs), H.ingest_run(f, runs)
    assert [r.finding_id for r in latest.collect()] == ["f1"] and sorted(r.finding_id for r in presence.collect()) == ["f0", "f1"]
    assert all("fingerprint" in keys for keys in dealt_by(latest) + dealt_by(presence))


def test_governance_is_not_dealt_by_category_or_group(spark):
    t = dt.datetime(2024, 1, 1)
    latest = spark.createDataFrame([("t", "w", f"fp{i}", "c", "cost", t, "g") for i in range(5)], "tenant_id string, workspace string, fingerprint string, check_id string, category string, detected_at timestamp, group_key string")
    ev = spark.createDataFrame([("t", "w", "finding", "fp1", "open", None, t), ("t", "w", "group", "g", "resolved", None, t + dt.timedelta(days=1))], "tenant_id string, workspace string, subject_type string, subject_id string, state string, snooze_until timestamp, event_ts timestamp")
    gov = G.sla_replay(ev, latest, G.default_policies(spark))
    cur = G.finding_current(latest, ev, gov, "2024-02-01")
    assert {r.effective_state for r in cur.collect()} == {"resolved"} and gov.count() == 5
    assert {r.sla_days for r in G.resolve_sla_days(latest, G.default_policies(spark)).collect()} == {14}
    assert all({"fingerprint", "subject_id"} & {*keys} for keys in dealt_by(cur))


def test_actions_and_items_are_not_dealt_by_tenant_or_run(spark):
    t = dt.datetime(2024, 1, 1)
    actions = spark.createDataFrame([("t", "w", f"a{i}", "fp", "c", "stop", "completed", t) for i in range(3)], "tenant_id string, workspace string, action_id string, fingerprint string, check_id string, action_type string, status string, updated_at timestamp")
    runs = spark.createDataFrame([("t", "w", "r1", t, "ready"), ("t", "w", "r2", t + dt.timedelta(days=9), "ready")], "tenant_id string, workspace string, run_id string, run_ts timestamp, status string")
    presence = spark.createDataFrame([("t", "w", "fp", "r1", t, Decimal(7))], "tenant_id string, workspace string, fingerprint string, run_id string, run_ts timestamp, estimated_monthly_savings decimal(18,6)")
    impact = M.remediation_impact(actions, runs, presence)
    assert [(r.verification_status, r.realized_monthly_savings) for r in impact.collect()] == [("verified_resolved", Decimal(7))] * 3
    current = presence.withColumns({"check_id": F.lit(R.RECOMMENDATION_RULES[0][0]), "est_confidence": F.lit(90)})
    items = R.recommendation_items(current, runs)
    assert [r.run_started_at for r in items.collect()] == [t]
    assert all("fingerprint" in keys for keys in dealt_by(impact) + dealt_by(items))


def test_attribution_asks_once_a_key_and_equals_brute_force(spark):
    rng, first = random.Random(5), dt.date(2023, 12, 20)
    day = lambda n: dt.datetime.combine(first + dt.timedelta(days=n), dt.time())
    fnd = [draft(i, day(rng.randrange(110)), f"r-{rng.randrange(4)}", rng.choice(["eu", "US"]), account=rng.choice("12")) for i in range(60)]
    bills = [("t", rng.choice("12"), rng.choice([None, "eu", "us"]), rng.choice([None, "ec2"]), rng.choice([None, "r-0", "r-1", "arn:r-1", "arn:r-2"]), rng.choice([None] + [day(n) for n in range(110)] * 2), Decimal(rng.randrange(1, 99))) for _ in range(400)]
    facts = spark.createDataFrame(bills, "tenant_id string, account_id string, region string, service string, resource_id string, usage_start timestamp, cost_unblended decimal(18,6)").selectExpr("*", "cast(null as timestamp) billing_period_start", "cast(null as decimal(18,6)) cost_net", "cast(null as decimal(18,6)) cost_amortized", "'USD' currency")
    out = attribute_costs(drafts(spark, fnd), facts, cost_model="unblended")
    got = {r.finding_id: (r.actual.attribution.method, r.actual.cost_7d, r.actual.cost_30d, r.actual.cost_mtd, r.actual.cost_prev_month) for r in out.collect()}
    for f in fnd:
        d = f[3].date()
        month = d.replace(day=1)
        prev = (month - dt.timedelta(days=1)).replace(day=1)
        near = [b for b in bills if b[1] == f[9] and b[2] in (None, f[10].lower()) and b[3] in (None, "ec2")]
        exact = [b for b in near if b[4] in (f[12], f[13])]
        hits = [(b[5].date(), b[6]) for b in exact or near if b[5]]
        total = lambda lo, hi: sum((c for x, c in hits if lo <= x < hi), Decimal(0))
        one = dt.timedelta(days=1)
        want = ("exact_resource_id" if exact else "heuristic" if near else "none", total(d - 7 * one, d), total(d - 30 * one, d), total(month, d + one), total(prev, month))
        assert got[f[14]] == want
    with redirect_stdout(io.StringIO()) as plan:
        out.explain()
    assert len(re.findall(r"Generate explode", plan.getvalue().split("== Initial Plan ==")[0])) <= 1  # a key's id and ARN; no row per window or day


def test_export_is_compressed_in_bounded_files(spark, tmp_path):
    df = spark.range(25).select(F.lit("t").alias("tenant_id"), F.col("id").cast("decimal(18,6)").alias("v"), F.lit(None).cast("string").alias("n")).coalesce(1)
    paths = export_json({"findings": df}, str(tmp_path), rows_per_file=10)
    files = sorted(Path(paths["findings"]).glob("part-*"))
    lines = [gzip.decompress(p.read_bytes()).decode().splitlines() for p in files]
    assert all(p.name.endswith(".json.gz") for p in files) and [len(x) for x in lines] == [10, 10, 5]
    assert sorted(Decimal(r.v) for r in spark.read.json(paths["findings"]).collect()) == list(range(25))


def test_written_findings_are_read_and_not_moved_again(spark, tmp_path):
    from spendlens.sources import findings_io as io

    day = dt.datetime(2024, 1, 1)
    f = drafts(spark, [("007", *draft(0, day)[1:]), (None, *draft(1, day)[1:]), draft(2, day)])
    io.write_findings(f, str(tmp_path / "raw"))
    back = io.read_written(spark, str(tmp_path / "raw"), f)
    assert back.schema.simpleString() == f.schema.simpleString() and sorted(map(str, back.collect())) == sorted(map(str, f.collect()))
    io.write_findings(back.where("status = 'fail'"), str(tmp_path / "enriched"), gather=False)
    assert sorted(r.tenant_id for r in io.read_written(spark, str(tmp_path / "enriched"), f).collect()) == ["", "007", "t"]


def test_findings_move_before_they_are_wide(spark):
    from conftest import SF001

    from spendlens.sources.bind import bound, gathered_findings

    moved, plain = gathered_findings(spark, SF001), bound(spark, SF001, "findings_flat")
    assert moved.columns == plain.columns and moved.exceptAll(plain).count() == plain.exceptAll(moved).count() == 0
    node = moved._jdf.queryExecution().optimizedPlan()
    while not node.nodeName().startswith("RebalancePartitions"):
        node = node.children().head()
    dealt = node.output().mkString(",")
    assert "resource_id#" in dealt and not any(f"{c}#" in dealt for c in ("fingerprint", "finding_id", "resource_arn"))


def test_evidence_stores_what_the_rules_read_once(spark, monkeypatch):
    from conftest import SF001

    from spendlens.plans import q_correlate as Q

    stored = []
    keep = Q.materialize
    monkeypatch.setattr(Q, "materialize", lambda df, name: stored.append(name) or keep(df, name))
    evidence, meta = Q._evidence(spark, SF001)
    assert stored == ["signals", "meta-findings"]
    # the tables are not joined again for each rule
    for df in (evidence, meta):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert "l_partkey" not in plan and "o_custkey" not in plan


def test_current_view_deals_the_log_once(spark):
    t = dt.datetime(2024, 1, 1)
    day = lambda n: t + dt.timedelta(days=n)
    cols = "tenant_id string, workspace string, subject_type string, subject_id string, state string, snooze_until timestamp, event_ts timestamp"
    rng = random.Random(3)
    events = [("t", "w", "finding", f"fp{rng.randrange(6)}", s := rng.choice(["open", "resolved", "snoozed", "ignored"]), day(i + 40) if s == "snoozed" else None, day(i)) for i in range(40)]
    ev = spark.createDataFrame([*events, ("t", "w", "group", "g1", "ignored", None, day(3))], cols)
    latest = spark.createDataFrame([("t", "w", f"fp{i}", "c", "cost", t, f"g{i % 3}") for i in range(8)], "tenant_id string, workspace string, fingerprint string, check_id string, category string, detected_at timestamp, group_key string")
    policies = G.default_policies(spark)
    replayed = G.finding_current(latest, ev, G.sla_replay(ev, latest, policies, own_state=True), "2024-02-20")
    looked_up = G.finding_current(latest, ev, G.sla_replay(ev, latest, policies), "2024-02-20")
    assert replayed.columns == looked_up.columns and sorted(map(str, replayed.collect())) == sorted(map(str, looked_up.collect()))
    plan = replayed._jdf.queryExecution().executedPlan().toString()
    # no second sort and aggregate after the replay's windows, and no second pass over the findings' events
    assert "SortAggregate" not in plan and "max_by" not in plan and not any("subject_id" in keys for keys in dealt_by(replayed))


def test_titles_without_ids_skip_the_patterns(spark):
    titles = ["Volume r-17 idle", "x arn:aws:ec2:eu:1:a/b c", "foo-i-12345678.amazonaws.com", "i-0abcdef12 vol-0abcdef12 subnet-0abcdef12", "my.sg-0123456789 vpc-01234567", "A  b\t 12", "", None, "multi-az", "bucket.s3.amazonaws.com 7"]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(titles)], "i int, title string")
    plain = F.lower(F.trim(F.coalesce("title", F.lit(""))))
    for pattern in H.TITLE_ID_PATTERNS:
        plain = F.regexp_replace(plain, pattern, "<id>")
    plain = F.trim(F.regexp_replace(F.regexp_replace(plain, r"\d+", "<n>"), r"\s+", " "))
    assert all(r.a == r.b for r in df.select(H.normalize_title(F.col("title")).alias("a"), plain.alias("b")).collect())
    gated = H.normalize_title(F.col("title"))._jc.toString()
    assert "CASE WHEN" in gated and all(x in gated for x in H.TITLE_ID_TEXTS)


def test_strip_of_bare_text_equals_python(spark):
    from spendlens.functions.identity import PY_WHITESPACE, py_strip

    texts = ["", "a", " a", "a ", "!", "~", "\x7f", "é", "é ", "\x1ca\x85", "a　", *(f"{x}b c{x}" for x in PY_WHITESPACE), "x" * 50, None]
    df = spark.createDataFrame([(x,) for x in texts], "x string").select("x", py_strip(F.col("x")).alias("y"))
    assert all(r.y == (None if r.x is None else r.x.strip()) for r in df.collect())
    assert "CASE WHEN" in py_strip(F.col("x"))._jc.toString()
