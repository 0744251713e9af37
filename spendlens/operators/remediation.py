"""Remediation actions and their measured impact.

Impact is computed set-based for every finalized action at once: the baseline
is an as-of lookup into the presence history (J12: newest ready-run snapshot
at or before the action was finalized, else the newest ever) and presence in
the latest ready run (J13). Both are read from the fingerprint's history, one
row with a list as long as there are runs, which each action meets in one
equi-join on the fingerprint.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.coerce import MONEY
from ..functions.identity import action_id_col
from ..session import materialize
from .recommend import rules_frame

KEY = ["tenant_id", "workspace", "fingerprint"]

# Action and verification statuses.
COMPLETED, FAILED = "completed", "failed"
PENDING_APPROVAL, APPROVED = "pending_approval", "approved"
VERIFY_PENDING = "pending_post_run"
VERIFY_RESOLVED = "verified_resolved"
VERIFY_PERSISTENT = "verified_persistent"
VERIFY_FAILED = "execution_failed"
TERMINAL_STATES = ("resolved", "ignored")


def stable_action_id(tenant_id: Column, workspace: Column, fingerprint: Column, action_type: Column, dry_run: Column) -> Column:
    """M1: 'act_' + sha256('tenant|workspace|fingerprint|action_type|dry_run(0/1)')[:24]."""
    seed = F.concat_ws(
        "|", tenant_id, workspace, fingerprint, action_type, F.coalesce(dry_run.cast("int"), F.lit(0)).cast("string")
    )
    return action_id_col(seed)


def initial_actions(current: DataFrame, *, action_type: str | None = None, dry_run: bool = False, auto_approve: bool = False, requested_at=None) -> DataFrame:
    """M2: one proposed action per actionable finding (eligible check, not in a terminal state).

    Status is pending_approval, or approved when ``auto_approve`` and the rule
    does not require approval (rules that do are never auto-approved).
    """
    rules = rules_frame(current.sparkSession).select("check_id", "action_type", "requires_approval", "recommendation_type")
    f = current.where(~F.col("effective_state").isin(*TERMINAL_STATES)).join(F.broadcast(rules), "check_id")
    at = F.lit(action_type) if action_type else F.col("action_type")
    status = F.when(F.lit(auto_approve) & ~F.col("requires_approval"), APPROVED).otherwise(PENDING_APPROVAL)
    out = f.select(
        "tenant_id",
        "workspace",
        stable_action_id(F.col("tenant_id"), F.col("workspace"), F.col("fingerprint"), at, F.lit(dry_run)).alias("action_id"),
        "fingerprint",
        "check_id",
        at.alias("action_type"),
        "recommendation_type",
        status.alias("status"),
        F.lit(dry_run).alias("dry_run"),
        (F.lit(requested_at).cast("timestamp") if requested_at is not None else F.current_timestamp()).alias("requested_at"),
    )
    return out.dropDuplicates(["tenant_id", "workspace", "action_id"])


def remediation_impact(actions: DataFrame, runs: DataFrame, presence: DataFrame) -> DataFrame:
    """M3/M4: verification status and realized savings for every action.

    A baseline falls back to the newest snapshot ever only when none precedes
    the finalization (that row's savings, even if NULL, counts as found).
    ``actions``: tenant_id, workspace, action_id, fingerprint, check_id,
    action_type, status, updated_at. ``presence`` holds ready runs only.
    """
    a = actions.withColumnRenamed("workspace_id", "workspace") if "workspace_id" in actions.columns else actions
    r = runs.withColumnRenamed("workspace_id", "workspace") if "workspace_id" in runs.columns else runs
    w = Window.partitionBy("tenant_id", "workspace").orderBy(F.col("run_ts").desc(), F.col("run_id").desc())
    latest_run = (
        r.where(F.col("status") == "ready")
        .withColumn("_r", F.row_number().over(w))
        .where("_r = 1")
        .select("tenant_id", "workspace", F.col("run_id").alias("latest_run_id"), F.col("run_ts").alias("latest_run_ts"))
    )
    latest_run = materialize(latest_run, "latest-run")  # a row a workspace, of known size: actions are not dealt by tenant
    a = a.select(
        "tenant_id",
        "workspace",
        "action_id",
        F.trim("fingerprint").alias("fingerprint"),
        "check_id",
        "action_type",
        F.lower(F.trim("status")).alias("action_status"),
        F.col("updated_at").alias("finalized_at"),
    )
    # stored: what the presence shuffled is freed before the actions move
    hist = materialize(presence.select(*KEY, "run_id", "run_ts", F.col("estimated_monthly_savings").cast(MONEY).alias("s")), "savings-history")
    # newest snapshot = max of (run_ts, run_id, savings) structs
    # both sides are dealt once, by fingerprint, for window, list and join alike; tenant and
    # workspace are compared as a range, since as join keys they would have both dealt again
    past = hist.repartition("fingerprint").groupBy(*KEY).agg(F.collect_list(F.struct("run_ts", "run_id", "s")).alias("_past"))
    # rows of one action share the snapshots before the last of them
    one = Window.partitionBy(*KEY, "action_id")
    a = a.repartition("fingerprint").withColumn("_until", F.max("finalized_at").over(one))
    within = [F.col(f"a.{c}").between(F.col(f"p.{c}"), F.col(f"p.{c}")) for c in KEY[:2]]
    a = a.alias("a").join(past.alias("p"), reduce(Column.__and__, within, F.col("a.fingerprint") == F.col("p.fingerprint")), "left").select("a.*", "p._past")
    before = F.array_max(F.filter("_past", lambda x: x["run_ts"] <= F.col("_until")))
    baseline_raw = F.when(F.col("action_id").isNotNull(), F.coalesce(before, F.array_max("_past"))["s"])
    in_latest = F.filter("_past", lambda x: x["run_id"] == F.col("latest_run_id"))
    j = (
        a.join(latest_run, ["tenant_id", "workspace"], "left")
        .withColumns({"baseline_raw": baseline_raw, "_now": F.explode_outer(in_latest)})
        .withColumns({"current_raw": F.col("_now.s"), "_present": F.when(F.col("_now").isNotNull(), True)})
    )
    zero = F.lit(0).cast(MONEY)
    baseline = F.greatest(zero, F.coalesce("baseline_raw", zero))
    current = F.greatest(zero, F.coalesce("current_raw", zero))
    present = F.when(F.col("latest_run_id").isNull(), F.lit(None).cast("boolean")).otherwise(F.coalesce("_present", F.lit(False)))
    not_done = F.col("action_status") != COMPLETED
    no_later_run = F.col("latest_run_ts").isNull() | (F.col("latest_run_ts") <= F.col("finalized_at"))
    status = (
        F.when(not_done, F.when(F.col("action_status") == FAILED, VERIFY_FAILED).otherwise(VERIFY_PENDING))
        .when(no_later_run, VERIFY_PENDING)
        .when(present, VERIFY_PERSISTENT)
        .otherwise(VERIFY_RESOLVED)
    )
    realized = (
        F.when(not_done | no_later_run, zero)
        .when(present, F.greatest(zero, baseline - current))
        .otherwise(baseline)
        .cast(MONEY)
    )
    rate = F.when(baseline > 0, F.round(realized.cast("double") / baseline.cast("double") * 100.0, 6))
    return j.select(
        "tenant_id",
        "workspace",
        "action_id",
        "fingerprint",
        "check_id",
        "action_type",
        "action_status",
        "finalized_at",
        "latest_run_id",
        "latest_run_ts",
        present.alias("present_in_latest"),
        baseline.cast(MONEY).alias("baseline_estimated_monthly_savings"),
        F.when(F.col("current_raw").isNotNull(), current).cast(MONEY).alias("current_estimated_monthly_savings"),
        status.alias("verification_status"),
        realized.alias("realized_monthly_savings"),
        rate.alias("realization_rate_pct"),
    )


def impact_summary(impact: DataFrame, by: tuple[str, ...] = ("tenant_id", "workspace")) -> DataFrame:
    """Counts by verification status, baseline and realized totals, realization %."""
    g = impact.groupBy(*by).agg(
        F.count(F.lit(1)).alias("actions_count"),
        F.count_if(F.col("verification_status") == VERIFY_RESOLVED).alias("resolved_count"),
        F.count_if(F.col("verification_status") == VERIFY_PERSISTENT).alias("persistent_count"),
        F.count_if(F.col("verification_status") == VERIFY_PENDING).alias("pending_count"),
        F.count_if(F.col("verification_status") == VERIFY_FAILED).alias("failed_count"),
        F.coalesce(F.sum("baseline_estimated_monthly_savings"), F.lit(0)).cast("decimal(38,6)").alias("baseline_total_monthly_savings"),
        F.coalesce(F.sum("realized_monthly_savings"), F.lit(0)).cast("decimal(38,6)").alias("realized_total_monthly_savings"),
    )
    rate = F.when(
        F.col("baseline_total_monthly_savings") > 0,
        F.round(F.col("realized_total_monthly_savings").cast("double") / F.col("baseline_total_monthly_savings").cast("double") * 100.0, 6),
    )
    return g.withColumn("realization_rate_pct", rate)


def action_list(actions: DataFrame, *, statuses=None, action_types=None, check_ids=None, fingerprints=None) -> DataFrame:
    """M6: actions filtered by status / type / check / fingerprint, newest request first."""
    df = actions
    for c, vs in (("status", statuses), ("action_type", action_types), ("check_id", check_ids), ("fingerprint", fingerprints)):
        if vs:
            df = df.where(F.col(c).isin(*vs))
    return df.orderBy(F.col("requested_at").desc(), F.col("action_id"))
