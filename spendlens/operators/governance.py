"""Governance: effective state, SLA policy, SLA clock replay, current view.

The reference keeps SLA clocks in a database row updated by a trigger on every
state change. Here the clock is *replayed* from the state-event log as window
expressions per fingerprint (one shuffle on the fingerprint key): pauses are
islands of snoozed events, the paused total is a running sum credited at the
event that ends each pause, and the breach stamp is the first event at which
the running deadline has passed. ``as_of`` is always a parameter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import materialize

KEY = ["tenant_id", "workspace", "fingerprint"]

#: columns of the replay with ``own_state``
OWN_STATE = ("fs_state", "fs_snooze")

# Default SLA policy per category (tenant/workspace 'default').
DEFAULT_SLA_POLICIES = [
    ("security", 7, "Critical security findings require immediate attention"),
    ("governance", 30, "General governance and compliance findings"),
    ("cost", 14, "Cost optimization opportunities should be addressed quickly"),
    ("waste", 21, "Idle/unused resources should be cleaned up"),
    ("inventory", 45, "Asset inventory findings have longer resolution time"),
    ("backup.governance", 14, "Backup compliance findings"),
]


def default_policies(spark: SparkSession) -> DataFrame:
    """The default policy dimension (6 rows)."""
    rows = [("default", "default", c, d, t) for c, d, t in DEFAULT_SLA_POLICIES]
    return spark.createDataFrame(rows, "tenant_id string, workspace string, category string, sla_days int, description string")


def effective_state(state: Column, snooze_until: Column, group_state: Column, group_snooze: Column, as_of: Column) -> Column:
    """G1: group resolved/ignored/active snooze wins, then the finding's, else open."""
    return (
        F.when(group_state == "resolved", "resolved")
        .when(group_state == "ignored", "ignored")
        .when((group_state == "snoozed") & (group_snooze > as_of), "snoozed")
        .when(state == "resolved", "resolved")
        .when(state == "ignored", "ignored")
        .when((state == "snoozed") & (snooze_until > as_of), "snoozed")
        .otherwise("open")
    )


def resolve_sla_days(latest: DataFrame, category_policies: DataFrame, check_overrides: DataFrame | None = None) -> DataFrame:
    """sla_days per finding: check override -> tenant category -> default category.

    Policy tables are dimensions (a few rows per tenant); they are stored, so that their size
    is known when the joins are planned: small ones are broadcast, and findings are not dealt
    by category.
    """
    own = category_policies.where(F.col("tenant_id") != "default").select(
        "tenant_id", "workspace", "category", F.col("sla_days").alias("_cat_days")
    )
    dflt = category_policies.where((F.col("tenant_id") == "default") & (F.col("workspace") == "default")).select(
        "category", F.col("sla_days").alias("_def_days")
    )
    own, dflt = materialize(own, "policies"), materialize(dflt, "default-policies")
    out = latest.join(own, ["tenant_id", "workspace", "category"], "left").join(dflt, ["category"], "left")
    if check_overrides is not None:
        ov = check_overrides.select("tenant_id", "workspace", "check_id", F.col("sla_days").alias("_ov_days"))
        out = out.join(materialize(ov, "check-policies"), ["tenant_id", "workspace", "check_id"], "left")
    else:
        out = out.withColumn("_ov_days", F.lit(None).cast("int"))
    return out.withColumn("sla_days", F.coalesce("_ov_days", "_cat_days", "_def_days")).drop("_ov_days", "_cat_days", "_def_days")


def _finding_events(state_events: DataFrame, latest: DataFrame) -> DataFrame:
    """Finding events plus group events fanned out to the group's members."""
    ev = state_events.withColumnRenamed("workspace_id", "workspace") if "workspace_id" in state_events.columns else state_events
    f = ev.where(F.col("subject_type") == "finding").select(
        "tenant_id",
        "workspace",
        F.col("subject_id").alias("fingerprint"),
        F.lit("finding").alias("source"),
        "state",
        "snooze_until",
        "event_ts",
    )
    members = latest.select("tenant_id", "workspace", "fingerprint", "group_key").where(F.col("group_key").isNotNull())
    # stored, so that their size is known: few are broadcast, and members not dealt by group
    of_groups = ev.where(F.col("subject_type") == "group").select("tenant_id", "workspace", F.col("subject_id").alias("group_key"), "state", "snooze_until", "event_ts")
    g = (
        materialize(of_groups, "group-events")
        .join(members, ["tenant_id", "workspace", "group_key"])
        .select("tenant_id", "workspace", "fingerprint", F.lit("group").alias("source"), "state", "snooze_until", "event_ts")
    )
    return f.unionByName(g)


def _event_log(state_events: DataFrame, latest: DataFrame, extensions: DataFrame | None, assignments: DataFrame | None) -> DataFrame:
    """All events of findings in one shape: state changes (own and of the group, G5), SLA
    extensions (G7) and assignments (G11); ``source`` tells them apart."""
    none = F.lit(None).cast("string")
    ev = _finding_events(state_events, latest).withColumns({"days": F.lit(None).cast("int"), "owner_id": none, "team_id": none})
    more = []
    if extensions is not None:
        more.append(extensions.select(*KEY, F.lit("extension").alias("source"), "event_ts", F.col("days").cast("int").alias("days")))
    if assignments is not None:
        more.append(assignments.select(*KEY, F.lit("assignment").alias("source"), "event_ts", "owner_id", "team_id"))
    for m in more:
        ev = ev.unionByName(m, allowMissingColumns=True)
    return ev


def sla_replay(
    state_events: DataFrame, latest: DataFrame, category_policies: DataFrame, check_overrides: DataFrame | None = None, extensions: DataFrame | None = None, assignments: DataFrame | None = None, own_state: bool = False
) -> DataFrame:
    """G4/W10 with G5, G7 and G11: replay the governance of each finding from all its events.

    Returns one row per finding with events: first_detected_at, first_opened_at, sla_days,
    sla_paused_at (open pause), total paused and extension seconds, deadline, breached_at,
    extension count, state event count, and - with ``assignments`` - the last owner and team.

    Events fold in order of time (then kind), so an extension meets the pauses and the breach
    stamp as they are at its time: it lifts the stamp if it moves the deadline to its time or
    later, else the stamp stays (or is set). State changes stamp a breach once. Extensions
    and assignments neither open nor pause nor resume. ``extensions``: key, days, event_ts;
    ``assignments``: key, owner_id, team_id, event_ts.

    With ``own_state`` also the finding's own last state and its end of snooze (``OWN_STATE``),
    the row ``current_state`` would choose: ``finding_current`` then need not deal the log again.

    One shuffle and one sort on the finding's key: every window has the same partitioning and
    order, and the last event's row has all that is asked.
    """
    days = resolve_sla_days(latest, category_policies, check_overrides).select(*KEY, "sla_days", "detected_at")
    ev = _event_log(state_events, latest, extensions, assignments).join(days, KEY)
    w = Window.partitionBy(*KEY, "sla_days", "detected_at").orderBy("event_ts", "source", "state", "days", "owner_id", "team_id")
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    is_state = F.col("source").isin("finding", "group")
    # state of the finding and of its group as of each event (last non-null so far)
    pair = F.struct(F.col("state").alias("st"), F.col("snooze_until").alias("su"))
    ev = ev.withColumns(
        {
            "_f": F.last(F.when(F.col("source") == "finding", pair), ignorenulls=True).over(upto),
            "_g": F.last(F.when(F.col("source") == "group", pair), ignorenulls=True).over(upto),
        }
    )
    eff = effective_state(F.col("_f.st"), F.col("_f.su"), F.col("_g.st"), F.col("_g.su"), F.col("event_ts"))
    ev = ev.withColumn("eff", F.when(is_state, eff))
    # the clock only notices a snooze, or its end, at a state event
    ev = ev.withColumn("_s", F.coalesce(F.last(F.col("eff") == "snoozed", ignorenulls=True).over(upto), F.lit(False)))
    ev = ev.withColumn("_ps", F.coalesce(F.lag("_s").over(w), F.lit(False)))
    ev = ev.withColumn("_pause_from", F.last(F.when(F.col("_s") & ~F.col("_ps"), F.col("event_ts")), ignorenulls=True).over(upto))
    secs = F.floor(F.unix_micros("event_ts") / 1e6 - F.unix_micros("_pause_from") / 1e6)
    ev = ev.withColumn("_delta", F.when(~F.col("_s") & F.col("_ps"), F.greatest(F.lit(0), secs)).otherwise(F.lit(0)).cast("long"))
    ev = ev.withColumns(
        {
            "_paused": F.sum("_delta").over(upto),
            "_ext": F.sum(F.coalesce(F.col("days"), F.lit(0)).cast("long") * 86400).over(upto),
            "_opened": F.min(F.when(F.col("eff") == "open", F.col("event_ts"))).over(upto),
        }
    )
    deadline = F.when(
        F.col("_opened").isNotNull() & F.col("sla_days").isNotNull(),
        F.col("_opened") + F.make_interval(days=F.col("sla_days")) + F.make_interval(secs=F.col("_paused") + F.col("_ext")),
    )
    ev = ev.withColumn("_deadline", deadline)
    late = F.col("_deadline") < F.col("event_ts")
    lifts = (F.col("source") == "extension") & ~F.coalesce(late, F.lit(False))
    ev = ev.withColumns({"_late": late & (F.col("source") != "assignment"), "_lifted": F.count_if(lifts).over(upto)})
    # what the last event has seen; its row stands for the finding
    ev = ev.withColumns(
        {
            "_first_ts": F.min(F.when(is_state, F.col("event_ts"))).over(upto),
            "_n": F.count_if(is_state).over(upto),
            "_n_ext": F.count_if(F.col("source") == "extension").over(upto),
            # the first late event after the last extension that lifted the stamp
            "_b": F.min(F.when(F.col("_late"), F.struct((-F.col("_lifted")).alias("since"), F.col("event_ts").alias("at")))).over(upto),
            "_a": F.last(F.when(F.col("source") == "assignment", F.struct("owner_id", "team_id", "event_ts")), ignorenulls=True).over(upto),
            "_next": F.lead(F.lit(True)).over(w),
        }
    )
    out = ev.where(F.col("_next").isNull())
    owner = [F.col("_a.owner_id").alias("owner_id"), F.col("_a.team_id").alias("team_id"), F.col("_a.event_ts").alias("assigned_at")]
    return out.select(
        *KEY,
        F.coalesce("detected_at", "_first_ts").alias("first_detected_at"),
        F.col("_opened").alias("first_opened_at"),
        "sla_days",
        F.when(F.col("_s"), F.col("_pause_from")).alias("sla_paused_at"),
        F.col("_paused").alias("sla_total_paused_seconds"),
        F.col("_ext").alias("sla_extension_seconds"),
        F.col("_deadline").alias("sla_deadline"),
        F.when(F.col("_b.since") == -F.col("_lifted"), F.col("_b.at")).alias("sla_breached_at"),
        F.col("_n_ext").cast("int").alias("sla_extended_count"),
        F.col("_n").alias("events"),
        *(owner if assignments is not None else []),
        *([F.col("_f.st").alias(OWN_STATE[0]), F.col("_f.su").alias(OWN_STATE[1])] if own_state else []),
    )


def apply_extensions(governance: DataFrame, extensions: DataFrame) -> DataFrame:
    """Add the days of every extension event (days, event_ts) to a finding's deadline.

    Events apply in time order. One that leaves the deadline behind its own time
    keeps the breach stamp (or stamps its time); one that moves the deadline to
    its time or later clears it. Without a deadline there is no breach.
    """
    so_far = Window.partitionBy(*KEY).orderBy("event_ts", "days").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ev = extensions.select(*KEY, "days", "event_ts").join(governance.select(*KEY, "sla_deadline"), KEY)
    moved = F.col("sla_deadline") + F.make_interval(secs=F.sum(F.col("days") * 86400).over(so_far))
    ev = ev.withColumn("_late", moved < F.col("event_ts"))
    ev = ev.withColumn("_in_time", F.max(F.when(~F.col("_late"), F.col("event_ts"))).over(Window.partitionBy(*KEY)))
    after = F.col("_late") & (F.col("_in_time").isNull() | (F.col("event_ts") > F.col("_in_time")))
    ext = ev.groupBy(*KEY).agg(
        F.sum(F.col("days") * 86400).cast("long").alias("_ext"),
        F.count(F.lit(1)).alias("_cnt"),
        F.max("_in_time").alias("_in_time"),
        F.min(F.when(after, F.col("event_ts"))).alias("_stamp"),
    )
    g = governance.join(ext, KEY, "left")
    ext_s = F.coalesce("_ext", F.lit(0))
    breach = (
        F.when(F.col("_cnt").isNull(), F.col("sla_breached_at"))
        .when(F.col("sla_deadline").isNull() | F.col("_stamp").isNull(), F.lit(None))
        .when(F.col("_in_time").isNull(), F.coalesce("sla_breached_at", "_stamp"))
        .otherwise(F.col("_stamp"))
    )
    return g.withColumns(
        {
            "sla_extension_seconds": F.col("sla_extension_seconds") + ext_s,
            "sla_extended_count": F.col("sla_extended_count") + F.coalesce("_cnt", F.lit(0)),
            "sla_breached_at": breach,
            "sla_deadline": F.when(F.col("sla_deadline").isNotNull(), F.col("sla_deadline") + F.make_interval(secs=ext_s)),
        }
    ).drop("_ext", "_cnt", "_in_time", "_stamp")


def current_state(state_events: DataFrame, subject_type: str) -> DataFrame:
    """Latest state per subject (finding or group): G11/U6 'latest event wins'."""
    ev = state_events.withColumnRenamed("workspace_id", "workspace") if "workspace_id" in state_events.columns else state_events
    w = Window.partitionBy("tenant_id", "workspace", "subject_id").orderBy(F.col("event_ts").desc(), F.col("state").desc())
    return (
        ev.where(F.col("subject_type") == subject_type)
        .withColumn("_r", F.row_number().over(w))
        .where("_r = 1")
        .select("tenant_id", "workspace", "subject_id", "state", "snooze_until", "event_ts")
    )


def _days_between(later: Column, earlier: Column) -> Column:
    """Whole 24h days between two timestamps, truncated toward zero."""
    return F.when(
        later.isNotNull() & earlier.isNotNull(),
        ((F.unix_micros(later) - F.unix_micros(earlier)) / F.lit(86400e6)).cast("int"),
    )


def finding_current(latest: DataFrame, state_events: DataFrame, governance: DataFrame, as_of) -> DataFrame:
    """G2 (+G1, G3): the current read model with effective state, ages and SLA status as of ``as_of``.

    A ``governance`` replayed with ``own_state`` brings each finding's own last state; else it
    is taken from the log (``current_state``).
    """
    now = F.lit(as_of).cast("timestamp") if not isinstance(as_of, Column) else as_of
    gs = current_state(state_events, "group").select(
        "tenant_id", "workspace", F.col("subject_id").alias("group_key"), F.col("state").alias("gs_state"), F.col("snooze_until").alias("gs_snooze")
    )
    gs = materialize(gs, "group-states")  # a row a group, of known size: few are broadcast
    gov = governance.drop("events") if "events" in governance.columns else governance
    columns = latest.columns
    if not {*OWN_STATE} <= {*gov.columns}:
        fs = current_state(state_events, "finding").withColumnsRenamed({"subject_id": "fingerprint", "state": OWN_STATE[0], "snooze_until": OWN_STATE[1]}).drop("event_ts")
        latest = latest.join(fs, KEY, "left")
    sb = latest.join(gs, ["tenant_id", "workspace", "group_key"], "left").join(gov, KEY, "left")
    j = sb.withColumns(
        {
            "state": F.coalesce("gs_state", "fs_state", F.lit("open")),
            "snooze_until": F.coalesce("gs_snooze", "fs_snooze"),
            "effective_state": effective_state(F.col("fs_state"), F.col("fs_snooze"), F.col("gs_state"), F.col("gs_snooze"), now),
        }
    ).drop("gs_state", "gs_snooze", "fs_state", "fs_snooze")
    status = (
        F.when(F.col("sla_deadline").isNull(), "none")
        .when(F.col("sla_breached_at").isNotNull(), "breached")
        .when(F.col("effective_state").isin("resolved", "ignored"), "closed")
        .when((F.col("effective_state") == "snoozed") & (F.col("snooze_until") > now), "paused")
        .when(F.col("sla_deadline") < now, "breached")
        .when(F.col("sla_deadline") < now + F.expr("INTERVAL 3 DAYS"), "breaching_soon")
        .otherwise("active")
    )
    out = j.withColumns(
        {
            "age_days_open": _days_between(now, F.col("first_opened_at")),
            "age_days_detected": _days_between(now, F.col("first_detected_at")),
            "sla_status": status,
            "sla_days_remaining": _days_between(F.col("sla_deadline"), now),
        }
    )
    own = ["state", "snooze_until", "effective_state"]
    first = [*KEY, *(c for c in columns if c not in KEY), *own]
    return out.select(*first, *(c for c in out.columns if c not in first))


def sla_backfill(latest: DataFrame, category_policies: DataFrame, as_of, check_overrides: DataFrame | None = None, state_events: DataFrame | None = None) -> DataFrame:
    """Governance rows for open findings that never had an event: opened at detection, deadline by policy.

    A finding with any event of its own or of its group (``state_events``) has its clock
    from the replay and is left out; one without is open.
    """
    now = F.lit(as_of).cast("timestamp")
    d = resolve_sla_days(latest, category_policies, check_overrides)
    if state_events is not None:
        ev = state_events.withColumnRenamed("workspace_id", "workspace") if "workspace_id" in state_events.columns else state_events
        known = ev.where(F.col("subject_type") == "finding").select("tenant_id", "workspace", F.col("subject_id").alias("fingerprint")).distinct()
        groups = ev.where(F.col("subject_type") == "group").select("tenant_id", "workspace", F.col("subject_id").alias("group_key")).distinct()
        d = d.join(known, KEY, "left_anti").join(groups, ["tenant_id", "workspace", "group_key"], "left_anti")
    opened = F.coalesce(F.col("detected_at"), now)
    return d.select(
        *KEY,
        opened.alias("first_detected_at"),
        opened.alias("first_opened_at"),
        "sla_days",
        F.when(F.col("sla_days").isNotNull(), opened + F.make_interval(days=F.col("sla_days"))).alias("sla_deadline"),
    )


def breached_list(current: DataFrame) -> DataFrame:
    """Breached findings, earliest deadline first (NULLs last), newest detection next."""
    return current.where(F.col("sla_status") == "breached").orderBy(
        F.col("sla_deadline").asc_nulls_last(), F.col("detected_at").desc(), F.col("fingerprint")
    )


def ageing_list(current: DataFrame, min_days: int | None = None, max_days: int | None = None, basis: str = "open") -> DataFrame:
    """Findings whose age (open or detected) is within [min, max], oldest first."""
    age = F.col("age_days_open") if basis == "open" else F.col("age_days_detected")
    df = current.where(age.isNotNull())
    if min_days is not None:
        df = df.where(age >= min_days)
    if max_days is not None:
        df = df.where(age <= max_days)
    return df.orderBy(age.desc(), F.col("fingerprint"))


def team_member_counts(teams: DataFrame, members: DataFrame) -> DataFrame:
    """Teams with their member count (teams without members count 0)."""
    m = members.groupBy("tenant_id", "team_id").agg(F.count(F.lit(1)).alias("member_count"))
    return teams.join(m, ["tenant_id", "team_id"], "left").withColumn("member_count", F.coalesce("member_count", F.lit(0)))


def audit_history(events: DataFrame, subject_type: str | None = None, subject_id: str | None = None) -> DataFrame:
    """Append-only state history filtered by subject, in time order."""
    df = events
    if subject_type:
        df = df.where(F.col("subject_type") == subject_type)
    if subject_id:
        df = df.where(F.col("subject_id") == subject_id)
    return df.orderBy("event_ts", "subject_id")
