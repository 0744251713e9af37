"""Remediation impact reads baseline and latest presence from one join with the fingerprint's history."""

import datetime as dt
import random
from decimal import Decimal

from test_moved_rows import dealt_by

from spendlens.operators import remediation as M

DAY = lambda n: dt.datetime(2024, 1, 1) + dt.timedelta(days=n)


def test_impact_equals_brute_force_and_deals_actions_once(spark):
    rng = random.Random(11)
    runs = [("t", "w", f"r{i}", DAY(10 * i), "failed" if i == 3 else "ready") for i in range(5)]
    ready = [r for r in runs if r[4] == "ready"]
    past = [("t", "w", f"fp{k}", r[2], r[3], rng.choice([None, Decimal(rng.randrange(-5, 50))])) for k in range(8) for r in ready if rng.random() < 0.6]
    acts = [("t", rng.choice("wwwx"), f"a{i}" if i % 9 else None, rng.choice([f" fp{rng.randrange(9)} ", None]), "c", "stop", rng.choice(["completed", " Completed", "failed", "approved"]), rng.choice([None, DAY(rng.randrange(-5, 60))])) for i in range(80)]
    acts += [(*a[:7], DAY(rng.randrange(60))) for a in acts[:20]] + acts[20:30]  # actions that come twice, some at another time
    actions = spark.createDataFrame(acts, "tenant_id string, workspace string, action_id string, fingerprint string, check_id string, action_type string, status string, updated_at timestamp")
    impact = M.remediation_impact(
        actions,
        spark.createDataFrame(runs, "tenant_id string, workspace string, run_id string, run_ts timestamp, status string"),
        spark.createDataFrame(past, "tenant_id string, workspace string, fingerprint string, run_id string, run_ts timestamp, estimated_monthly_savings decimal(18,6)"),
    )
    # actions are dealt once, and their history once, without a broadcast too
    limit = "spark.sql.autoBroadcastJoinThreshold"
    was = spark.conf.get(limit)
    spark.conf.set(limit, "100")
    try:
        assert sorted(dealt_by(impact.select("action_id", "realized_monthly_savings")))[:2] == [["fingerprint"], ["fingerprint"]]
        assert sum("fingerprint" in keys for keys in dealt_by(impact.select("action_id", "realized_monthly_savings"))) == 2
    finally:
        spark.conf.set(limit, was)
    want, zero = [], Decimal(0)
    for t, w, a, fp, _, _, status, at in acts:
        fp, status = fp and fp.strip(), status.strip().lower()
        mine = [p for p in past if (p[0], p[1], p[2]) == (t, w, fp)]
        ats = [b[7] for b in acts if (b[0], b[1], b[2], b[3] and b[3].strip()) == (t, w, a, fp) and b[7]]
        before = [p for p in mine if ats and p[4] <= max(ats)] or mine
        base = max(zero, (max(before, key=lambda p: p[4])[5] or zero) if before and a else zero)
        last = "r4" if w == "w" else None
        now = [p for p in mine if p[3] == last]
        cur = now[0][5] if now else None
        late = last is None or (at is not None and DAY(40) <= at)
        done = status == "completed"
        if not done:
            verdict = "execution_failed" if status == "failed" else "pending_post_run"
        else:
            verdict = "pending_post_run" if late else "verified_persistent" if now else "verified_resolved"
        real = zero if not done or late else max(zero, base - max(zero, cur or zero)) if now else base
        want.append((a, fp, at, bool(now) if last else None, base, None if cur is None else max(zero, cur), verdict, real))
    got = [(r.action_id, r.fingerprint, r.finalized_at, r.present_in_latest, r.baseline_estimated_monthly_savings, r.current_estimated_monthly_savings, r.verification_status, r.realized_monthly_savings) for r in impact.collect()]
    plain = lambda rows: sorted(str([float(x) if isinstance(x, Decimal) else x for x in r]) for r in rows)
    assert plain(got) == plain(want)
