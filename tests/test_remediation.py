"""Remediation impact outcomes (M3): resolved, persistent, pending, failed."""

import datetime as dt
from decimal import Decimal

from spendlens.operators import remediation as M

D = dt.datetime


def test_impact_outcomes(spark):
    runs = spark.createDataFrame(
        [("t", "w", "r1", D(2024, 1, 1), "ready"), ("t", "w", "r2", D(2024, 2, 1), "ready")],
        "tenant_id string, workspace_id string, run_id string, run_ts timestamp, status string",
    )
    presence = spark.createDataFrame(
        [
            ("t", "w", "fpA", "r1", D(2024, 1, 1), Decimal("120")),
            ("t", "w", "fpB", "r1", D(2024, 1, 1), Decimal("200")),
            ("t", "w", "fpB", "r2", D(2024, 2, 1), Decimal("50")),
            ("t", "w", "fpC", "r2", D(2024, 2, 1), Decimal("80")),
        ],
        "tenant_id string, workspace string, fingerprint string, run_id string, run_ts timestamp, estimated_monthly_savings decimal(18,6)",
    )
    actions = spark.createDataFrame(
        [
            ("t", "w", "a1", "fpA", "c", "stop", "completed", D(2024, 1, 15)),
            ("t", "w", "a2", "fpB", "c", "stop", "completed", D(2024, 1, 15)),
            ("t", "w", "a3", "fpC", "c", "stop", "completed", D(2024, 3, 1)),
            ("t", "w", "a4", "fpA", "c", "stop", "failed", D(2024, 1, 15)),
        ],
        "tenant_id string, workspace_id string, action_id string, fingerprint string, check_id string, action_type string, status string, updated_at timestamp",
    )
    out = {r.action_id: r for r in M.remediation_impact(actions, runs, presence).collect()}
    assert out["a1"].verification_status == "verified_resolved"
    assert out["a1"].realized_monthly_savings == Decimal("120")
    assert out["a1"].realization_rate_pct == 100.0
    assert out["a2"].verification_status == "verified_persistent"
    assert out["a2"].realized_monthly_savings == Decimal("150")
    assert out["a2"].realization_rate_pct == 75.0
    assert out["a3"].verification_status == "pending_post_run"
    assert out["a3"].realized_monthly_savings == 0
    assert out["a4"].verification_status == "execution_failed"


def test_newest_snapshot_without_savings_counts_as_zero(spark):
    runs = spark.createDataFrame([("t", "w", "r1", D(2024, 1, 1), "ready"), ("t", "w", "r2", D(2024, 2, 1), "ready")], "tenant_id string, workspace_id string, run_id string, run_ts timestamp, status string")
    presence = spark.createDataFrame(
        [("t", "w", "fp", "r1", D(2024, 1, 1), None), ("t", "w", "fp", "r2", D(2024, 2, 1), Decimal("500"))],
        "tenant_id string, workspace string, fingerprint string, run_id string, run_ts timestamp, estimated_monthly_savings decimal(18,6)",
    )
    actions = spark.createDataFrame([("t", "w", "a", "fp", "c", "stop", "completed", D(2024, 1, 15))], "tenant_id string, workspace_id string, action_id string, fingerprint string, check_id string, action_type string, status string, updated_at timestamp")
    r = M.remediation_impact(actions, runs, presence).first()
    assert r.baseline_estimated_monthly_savings == 0 and r.current_estimated_monthly_savings == Decimal("500")
