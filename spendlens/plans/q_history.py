"""Registered history / read-model queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.coerce import messy_number
from ..operators import governance as G
from ..operators import history as H
from ..operators import read
from ..operators.state_table import read_state, upsert_state
from ..session import materialize, new_folder
from ..sources.bind import bound, binding_cte
from ..sources.tables import table
from .inputs import findings, runs, state_events
from .registry import query

AS_OF = "2002-06-01 00:00:00"

# DuckDB spelling of the title masking used for group keys (same patterns).
_TITLE_NORM = "lower(trim(title))"
for _p in [
    r"\barn:[^\s]+",
    r"\bi-[0-9a-f]{8,}\b",
    r"\bvol-[0-9a-f]{8,}\b",
    r"\bsg-[0-9a-f]{8,}\b",
    r"\bsubnet-[0-9a-f]{8,}\b",
    r"\bvpc-[0-9a-f]{8,}\b",
    r"\b[a-z0-9-]{1,63}\.amazonaws\.com\b",
]:
    _TITLE_NORM = f"regexp_replace({_TITLE_NORM}, '{_p}', '<id>', 'g')"
_TITLE_NORM = f"trim(regexp_replace(regexp_replace({_TITLE_NORM}, '\\d+', '<n>', 'g'), '\\s+', ' ', 'g'))"

HIST_CTE = (
    binding_cte("findings_flat", "runs", "state_events")
    + f""",
pres_all AS (
  SELECT tenant_id, workspace_id AS workspace, run_id, run_ts, finding_id, fingerprint, check_id, service,
         severity_level AS severity, title, CAST(COALESCE(monthly_savings, 0) AS DECIMAL(18,6)) AS estimated_monthly_savings,
         confidence AS est_confidence,
         region, account_id, category,
         sha1(check_id || '|' || category || '|' || {_TITLE_NORM}) AS group_key,
         run_ts AS detected_at,
         row_number() OVER (PARTITION BY tenant_id, workspace_id, run_id, fingerprint ORDER BY finding_id) AS rn
  FROM findings_flat
  WHERE (tenant_id, workspace_id, run_id) IN (SELECT tenant_id, workspace_id, run_id FROM runs WHERE status = 'ready')),
pres AS (SELECT * EXCLUDE (rn) FROM pres_all WHERE rn = 1),
lat AS (
  SELECT * EXCLUDE (r) FROM (
    SELECT *, row_number() OVER (PARTITION BY tenant_id, workspace, fingerprint ORDER BY run_ts DESC, run_id DESC) AS r FROM pres)
  WHERE r = 1)
"""
)


def _presence(spark, sf):
    p, _ = H.ingest_run(findings(spark, sf), runs(spark, sf))
    return p


def _run_diff(spark, sf):
    # presence is ingested run by run: that of runs that are not compared is not needed
    r = runs(spark, sf)
    p, _ = H.ingest_run(findings(spark, sf), H.latest_ready_runs(r, 2))
    return H.run_diff(p, r)


def _latest(spark, sf):
    return H.latest_of_runs(findings(spark, sf), runs(spark, sf))


@query("n1_presence", oracle=HIST_CTE + "SELECT * FROM pres")
def n1(spark, sf):
    return _presence(spark, sf)


@query("w1_latest_per_fingerprint", oracle=HIST_CTE + "SELECT * FROM lat")
def w1(spark, sf):
    return _latest(spark, sf)


@query("u5_incremental_latest", oracle=HIST_CTE + "SELECT * FROM lat")
def u5(spark, sf):
    root = new_folder(spark, "latest")
    rows = materialize(_presence(spark, sf), "presence")
    for part in (F.col("run_id") >= "run-1996", F.col("run_id") < "run-1994", F.col("run_id").between("run-1994", "run-1995")):  # not in order of time
        upsert_state(rows.where(part), root, ["tenant_id", "workspace", "fingerprint"], H.latest_per_key, buckets=32)
    return read_state(spark, root)


@query(
    "x16_ingest_invariants",
    oracle=HIST_CTE
    + """
SELECT (SELECT count(*) FROM pres) AS presence_rows,
       (SELECT count(*) FROM (SELECT DISTINCT tenant_id, workspace, fingerprint FROM pres)) AS presence_fingerprints,
       (SELECT count(*) FROM lat) AS latest_rows,
       (SELECT count(*) FROM (SELECT DISTINCT tenant_id, workspace, fingerprint FROM lat)) AS latest_fingerprints,
       (SELECT count(*) FROM (SELECT DISTINCT tenant_id, workspace, fingerprint FROM pres
                              EXCEPT SELECT tenant_id, workspace, fingerprint FROM lat)) AS presence_missing_from_latest,
       true AS ok
""",
)
def x16(spark, sf):
    p = _presence(spark, sf)
    return H.ingest_invariants(p, H.latest_per_key(p))


RUNS_RANKED = """,
rr AS (
  SELECT *, row_number() OVER (PARTITION BY tenant_id, workspace_id ORDER BY run_ts DESC, run_id DESC) AS rank
  FROM runs WHERE status = 'ready')
"""


@query("w3_latest_ready_runs", oracle=HIST_CTE + RUNS_RANKED + "SELECT * FROM rr WHERE rank <= 2")
def w3(spark, sf):
    return H.latest_ready_runs(runs(spark, sf), 2)


@query(
    "q10_latest_run",
    oracle=HIST_CTE + RUNS_RANKED + "SELECT tenant_id, workspace_id, run_id, run_ts, status FROM rr WHERE rank = 1",
)
def q10(spark, sf):
    return H.latest_ready_runs(runs(spark, sf), 1).drop("rank")


DIFF_CTE = (
    RUNS_RANKED
    + """,
two AS (SELECT tenant_id, workspace_id FROM rr WHERE rank <= 2 GROUP BY ALL HAVING count(*) = 2),
pr AS (
  SELECT p.*, r.rank FROM pres p
  JOIN rr r ON r.tenant_id = p.tenant_id AND r.workspace_id = p.workspace AND r.run_id = p.run_id AND r.rank <= 2
  WHERE (p.tenant_id, p.workspace) IN (SELECT tenant_id, workspace_id FROM two)),
diff AS (
  SELECT c.* EXCLUDE (rank), 'new' AS change FROM pr c WHERE c.rank = 1
    AND NOT EXISTS (SELECT 1 FROM pr q WHERE q.rank = 2 AND q.tenant_id = c.tenant_id AND q.workspace = c.workspace AND q.fingerprint = c.fingerprint)
  UNION ALL
  SELECT c.* EXCLUDE (rank), 'resolved' AS change FROM pr c WHERE c.rank = 2
    AND NOT EXISTS (SELECT 1 FROM pr q WHERE q.rank = 1 AND q.tenant_id = c.tenant_id AND q.workspace = c.workspace AND q.fingerprint = c.fingerprint))
"""
)


@query("n3_run_diff", oracle=HIST_CTE + DIFF_CTE + "SELECT * FROM diff")
def n3(spark, sf):
    return _run_diff(spark, sf)


@query(
    "a14_run_diff_by_category",
    oracle=HIST_CTE
    + DIFF_CTE
    + """
SELECT tenant_id, workspace, COALESCE(category, 'unknown') AS key,
       count(*) FILTER (WHERE change = 'new') AS new_count, count(*) FILTER (WHERE change = 'resolved') AS resolved_count
FROM diff GROUP BY ALL
""",
)
def a14(spark, sf):
    return H.run_diff_rollup(_run_diff(spark, sf), "category")


@query(
    "p15_category_from_check_prefix",
    oracle=binding_cte("findings_flat")
    + """
SELECT check_id,
       CASE WHEN check_id LIKE 'aws.cloudwatch.%' OR check_id LIKE 'aws.ec2.%' OR check_id LIKE 'aws.ebs.%' OR check_id LIKE 'aws.elb%'
                 OR check_id LIKE 'aws.rds.%' OR check_id LIKE 'aws.s3.%' OR check_id LIKE 'aws.vpc.%' OR check_id LIKE 'aws.fsx.%' THEN 'cost'
            WHEN check_id LIKE 'aws.backup.%' THEN 'reliability'
            WHEN check_id LIKE 'aws.iam.%' THEN 'security' ELSE 'other' END AS derived_category,
       count(*) AS findings
FROM findings_flat GROUP BY ALL
""",
)
def p15(spark, sf):
    f = findings(spark, sf)
    return f.groupBy("check_id", H.derive_category(F.col("check_id")).alias("derived_category")).agg(F.count(F.lit(1)).alias("findings"))


@query(
    "p18_messy_number_parse",
    oracle="""
SELECT o_orderkey,
       TRY_CAST('$' || CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR) AS VARCHAR) AS raw_usd,
       CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS DOUBLE) AS usd,
       CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS DOUBLE) AS eur
FROM orders
""",
)
def p18(spark, sf):
    o = table(spark, sf, "orders")
    txt = F.col("o_totalprice").cast("decimal(18,2)").cast("string")
    raw_usd = F.concat(F.lit("$"), txt)
    raw_eur = F.concat(F.regexp_replace(txt, r"\.", ","), F.lit(" EUR"))
    return o.select("o_orderkey", raw_usd.alias("raw_usd"), messy_number(raw_usd).alias("usd"), messy_number(raw_eur).alias("eur"))


# ---------------------------------------------------------------------------
# Current view and aggregates (need governance)
# ---------------------------------------------------------------------------

GOV_CTE = f""",
pol AS (SELECT * FROM (VALUES ('security', 7), ('governance', 30), ('cost', 14), ('waste', 21), ('inventory', 45),
                              ('backup.governance', 14)) t(category, sla_days)),
days AS (SELECT l.tenant_id, l.workspace, l.fingerprint, l.detected_at, p.sla_days FROM lat l LEFT JOIN pol p USING (category)),
ev1 AS (
  SELECT tenant_id, workspace_id AS workspace, subject_id AS fingerprint, 'finding' AS source, state, snooze_until, event_ts,
         CASE WHEN state = 'resolved' THEN 'resolved' WHEN state = 'ignored' THEN 'ignored'
              WHEN state = 'snoozed' AND snooze_until > event_ts THEN 'snoozed' ELSE 'open' END AS eff
  FROM state_events
  WHERE subject_type = 'finding' AND (tenant_id, workspace_id, subject_id) IN (SELECT tenant_id, workspace, fingerprint FROM lat)),
ev2 AS (
  SELECT *, eff = 'snoozed' AS s, COALESCE(lag(eff = 'snoozed') OVER w, false) AS ps
  FROM ev1 WINDOW w AS (PARTITION BY tenant_id, workspace, fingerprint ORDER BY event_ts, source, state)),
ev3 AS (
  SELECT *, last_value(CASE WHEN s AND NOT ps THEN event_ts END IGNORE NULLS) OVER wu AS pause_from
  FROM ev2 WINDOW wu AS (PARTITION BY tenant_id, workspace, fingerprint ORDER BY event_ts, source, state
                         ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
ev4 AS (
  SELECT *, CASE WHEN NOT s AND ps THEN greatest(0, CAST(floor(epoch_us(event_ts) / 1e6 - epoch_us(pause_from) / 1e6) AS BIGINT)) ELSE 0 END AS delta
  FROM ev3),
ev5 AS (
  SELECT *, sum(delta) OVER wu AS paused, min(CASE WHEN eff = 'open' THEN event_ts END) OVER wu AS opened,
         row_number() OVER (PARTITION BY tenant_id, workspace, fingerprint ORDER BY event_ts DESC, source DESC, state DESC) AS rlast,
         count(*) OVER (PARTITION BY tenant_id, workspace, fingerprint) AS n, min(event_ts) OVER (PARTITION BY tenant_id, workspace, fingerprint) AS first_ts
  FROM ev4 WINDOW wu AS (PARTITION BY tenant_id, workspace, fingerprint ORDER BY event_ts, source, state
                         ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
ev6 AS (
  SELECT e.*, d.sla_days, d.detected_at,
         CASE WHEN opened IS NOT NULL AND d.sla_days IS NOT NULL
              THEN opened + to_days(CAST(d.sla_days AS INTEGER)) + to_seconds(CAST(paused AS BIGINT)) END AS deadline
  FROM ev5 e LEFT JOIN days d USING (tenant_id, workspace, fingerprint)),
gov AS (
  SELECT tenant_id, workspace, fingerprint, COALESCE(detected_at, first_ts) AS first_detected_at, opened AS first_opened_at, sla_days,
         CASE WHEN s THEN pause_from END AS sla_paused_at, CAST(paused AS BIGINT) AS sla_total_paused_seconds,
         CAST(0 AS BIGINT) AS sla_extension_seconds, deadline AS sla_deadline,
         (SELECT min(x.event_ts) FROM ev6 x WHERE x.tenant_id = ev6.tenant_id AND x.workspace = ev6.workspace
            AND x.fingerprint = ev6.fingerprint AND x.deadline < x.event_ts) AS sla_breached_at,
         0 AS sla_extended_count, n AS events
  FROM ev6 WHERE rlast = 1),
fs AS (
  SELECT tenant_id, workspace_id AS workspace, subject_id AS fingerprint, state AS fs_state, snooze_until AS fs_snooze FROM (
    SELECT *, row_number() OVER (PARTITION BY tenant_id, workspace_id, subject_id ORDER BY event_ts DESC, state DESC) AS r
    FROM state_events WHERE subject_type = 'finding') WHERE r = 1),
cur AS (
  SELECT l.*, COALESCE(fs.fs_state, 'open') AS state, fs.fs_snooze AS snooze_until,
         CASE WHEN fs.fs_state = 'resolved' THEN 'resolved' WHEN fs.fs_state = 'ignored' THEN 'ignored'
              WHEN fs.fs_state = 'snoozed' AND fs.fs_snooze > TIMESTAMP '{AS_OF}' THEN 'snoozed' ELSE 'open' END AS effective_state,
         g.first_detected_at, g.first_opened_at, g.sla_days, g.sla_paused_at, g.sla_total_paused_seconds, g.sla_extension_seconds,
         g.sla_deadline, g.sla_breached_at, g.sla_extended_count
  FROM lat l LEFT JOIN fs USING (tenant_id, workspace, fingerprint) LEFT JOIN gov g USING (tenant_id, workspace, fingerprint)),
cur2 AS (
  SELECT *,
         CAST(trunc((epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(first_opened_at)) / 86400e6) AS INTEGER) AS age_days_open,
         CAST(trunc((epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(first_detected_at)) / 86400e6) AS INTEGER) AS age_days_detected,
         CASE WHEN sla_deadline IS NULL THEN 'none'
              WHEN sla_breached_at IS NOT NULL THEN 'breached'
              WHEN effective_state IN ('resolved', 'ignored') THEN 'closed'
              WHEN effective_state = 'snoozed' AND snooze_until > TIMESTAMP '{AS_OF}' THEN 'paused'
              WHEN sla_deadline < TIMESTAMP '{AS_OF}' THEN 'breached'
              WHEN sla_deadline < TIMESTAMP '{AS_OF}' + INTERVAL 3 DAY THEN 'breaching_soon'
              ELSE 'active' END AS sla_status,
         CAST(trunc((epoch_us(sla_deadline) - epoch_us(TIMESTAMP '{AS_OF}')) / 86400e6) AS INTEGER) AS sla_days_remaining
  FROM cur)
"""


def _events(spark, sf):
    return state_events(spark, sf).select("tenant_id", "workspace_id", "subject_type", "subject_id", "state", "snooze_until", "event_ts")


def _current(spark, sf, *columns):
    """The current view; with ``columns`` the read model carries them and what governance needs, no more."""
    lat = _latest(spark, sf)
    if columns:
        lat = lat.select(*dict.fromkeys([*G.KEY, "category", "detected_at", "group_key", *columns]))
    # the read model is read by several branches: stored once; of the log the findings' events are read once
    lat = materialize(lat, "latest")
    ev = _events(spark, sf)
    gov = G.sla_replay(ev, lat, G.default_policies(spark), own_state=True)
    return G.finding_current(lat, ev, gov, AS_OF)


@query("g4_sla_replay", oracle=HIST_CTE + GOV_CTE + "SELECT * FROM gov")
def g4(spark, sf):
    lat = materialize(_latest(spark, sf), "latest")
    return G.sla_replay(state_events(spark, sf), lat, G.default_policies(spark))


def _group_events(lat):
    """Two state events for groups: one by the number of members, a second for some that opens them again."""
    m = lat.where(F.col("group_key").isNotNull()).groupBy("tenant_id", "workspace", "group_key").agg(F.count(F.lit(1)).alias("n"), F.max("detected_at").alias("t"))
    first = F.when(F.col("n") % 4 == 0, "snoozed").when(F.col("n") % 4 == 1, "resolved").when(F.col("n") % 4 == 2, "ignored").otherwise("open")
    base = [F.col("tenant_id"), F.col("workspace").alias("workspace_id"), F.lit("group").alias("subject_type"), F.col("group_key").alias("subject_id")]
    one = m.select(*base, first.alias("state"), F.when(F.col("n") % 4 == 0, F.col("t") + F.expr("INTERVAL 25 DAYS")).alias("snooze_until"), (F.col("t") + F.expr("INTERVAL 5 DAYS")).alias("event_ts"))
    two = m.where("n % 3 = 0").select(*base, F.lit("open").alias("state"), F.lit(None).cast("timestamp").alias("snooze_until"), (F.col("t") + F.expr("INTERVAL 60 DAYS")).alias("event_ts"))
    return one.unionByName(two)


# the same fold with events of the group, extensions and assignments
REPLAY_CTE = f""",
ext AS ({binding_cte("extensions").removeprefix("WITH extensions AS (").removesuffix(")")}),
asg AS ({binding_cte("assignments").removeprefix("WITH assignments AS (").removesuffix(")")}),
pol AS (SELECT * FROM (VALUES ('security', 7), ('governance', 30), ('cost', 14), ('waste', 21), ('inventory', 45), ('backup.governance', 14)) t(category, sla_days)),
gm AS (SELECT tenant_id, workspace, group_key, count(*) AS n, max(detected_at) AS t FROM lat WHERE group_key IS NOT NULL GROUP BY ALL),
gev AS (SELECT tenant_id, workspace, group_key, CASE n % 4 WHEN 0 THEN 'snoozed' WHEN 1 THEN 'resolved' WHEN 2 THEN 'ignored' ELSE 'open' END AS state,
               CASE WHEN n % 4 = 0 THEN t + INTERVAL 25 DAY END AS snooze_until, t + INTERVAL 5 DAY AS event_ts FROM gm
        UNION ALL SELECT tenant_id, workspace, group_key, 'open', NULL, t + INTERVAL 60 DAY FROM gm WHERE n % 3 = 0),
e0 AS (SELECT tenant_id, workspace_id AS workspace, subject_id AS fingerprint, 'finding' AS source, state, snooze_until, event_ts, CAST(NULL AS INTEGER) AS days, CAST(NULL AS VARCHAR) AS owner_id, CAST(NULL AS VARCHAR) AS team_id
       FROM state_events WHERE subject_type = 'finding'
       UNION ALL SELECT l.tenant_id, l.workspace, l.fingerprint, 'group', state, snooze_until, event_ts, NULL, NULL, NULL FROM gev g JOIN lat l USING (tenant_id, workspace, group_key)
       UNION ALL SELECT tenant_id, workspace, fingerprint, 'extension', NULL, NULL, event_ts, days, NULL, NULL FROM ext
       UNION ALL SELECT tenant_id, workspace, fingerprint, 'assignment', NULL, NULL, event_ts, NULL, owner_id, team_id FROM asg),
e1 AS (SELECT e0.*, p.sla_days, l.detected_at, source IN ('finding', 'group') AS is_state,
              row_number() OVER (PARTITION BY tenant_id, workspace, fingerprint ORDER BY event_ts, source, state, days, owner_id NULLS FIRST, team_id) AS pos
       FROM e0 JOIN lat l USING (tenant_id, workspace, fingerprint) LEFT JOIN pol p USING (category)),
e2 AS (SELECT *, last_value(CASE WHEN source = 'finding' THEN state END IGNORE NULLS) OVER wu AS fs, last_value(CASE WHEN source = 'finding' THEN pos END IGNORE NULLS) OVER wu AS fp,
              last_value(CASE WHEN source = 'group' THEN state END IGNORE NULLS) OVER wu AS gs, last_value(CASE WHEN source = 'group' THEN pos END IGNORE NULLS) OVER wu AS gp FROM e1
       WINDOW wu AS (PARTITION BY tenant_id, workspace, fingerprint ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
e3 AS (SELECT a.*, CASE WHEN NOT a.is_state THEN NULL WHEN gs IN ('resolved', 'ignored') THEN gs WHEN gs = 'snoozed' AND g.snooze_until > a.event_ts THEN 'snoozed'
                        WHEN fs IN ('resolved', 'ignored') THEN fs WHEN fs = 'snoozed' AND f.snooze_until > a.event_ts THEN 'snoozed' ELSE 'open' END AS eff
       FROM e2 a LEFT JOIN e1 f ON f.tenant_id = a.tenant_id AND f.workspace = a.workspace AND f.fingerprint = a.fingerprint AND f.pos = a.fp
                 LEFT JOIN e1 g ON g.tenant_id = a.tenant_id AND g.workspace = a.workspace AND g.fingerprint = a.fingerprint AND g.pos = a.gp),
e4 AS (SELECT *, COALESCE(last_value(eff = 'snoozed' IGNORE NULLS) OVER wu, false) AS s FROM e3 WINDOW wu AS (PARTITION BY tenant_id, workspace, fingerprint ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
e5 AS (SELECT *, COALESCE(lag(s) OVER (PARTITION BY tenant_id, workspace, fingerprint ORDER BY pos), false) AS ps FROM e4),
e6 AS (SELECT *, last_value(CASE WHEN s AND NOT ps THEN event_ts END IGNORE NULLS) OVER wu AS pause_from FROM e5 WINDOW wu AS (PARTITION BY tenant_id, workspace, fingerprint ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
e7 AS (SELECT *, sum(CASE WHEN ps AND NOT s THEN greatest(0, CAST(floor(epoch_us(event_ts) / 1e6 - epoch_us(pause_from) / 1e6) AS BIGINT)) ELSE 0 END) OVER wu AS paused, sum(COALESCE(days, 0) * 86400) OVER wu AS extra,
              min(CASE WHEN eff = 'open' THEN event_ts END) OVER wu AS opened FROM e6 WINDOW wu AS (PARTITION BY tenant_id, workspace, fingerprint ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
e8 AS (SELECT *, CASE WHEN opened IS NOT NULL AND sla_days IS NOT NULL THEN opened + to_days(CAST(sla_days AS INTEGER)) + to_seconds(CAST(paused + extra AS BIGINT)) END AS deadline FROM e7),
lift AS (SELECT tenant_id, workspace, fingerprint, max(pos) AS lifted FROM e8 WHERE source = 'extension' AND NOT COALESCE(deadline < event_ts, false) GROUP BY ALL),
stamp AS (SELECT tenant_id, workspace, fingerprint, min(event_ts) AS breached FROM e8 LEFT JOIN lift USING (tenant_id, workspace, fingerprint)
          WHERE source <> 'assignment' AND deadline < event_ts AND pos > COALESCE(lifted, 0) GROUP BY ALL),
n AS (SELECT tenant_id, workspace, fingerprint, max(pos) AS pos, min(event_ts) FILTER (is_state) AS first_ts, count(*) FILTER (is_state) AS events, count(*) FILTER (source = 'extension') AS n_ext,
             max(pos) FILTER (source = 'assignment') AS apos FROM e8 GROUP BY ALL)
"""


@query(
    "g5_g7_g11_replay",
    oracle=HIST_CTE
    + REPLAY_CTE
    + """
SELECT tenant_id, workspace, fingerprint, COALESCE(e.detected_at, first_ts) AS first_detected_at, opened AS first_opened_at, e.sla_days, CASE WHEN s THEN pause_from END AS sla_paused_at,
       CAST(paused AS BIGINT) AS sla_total_paused_seconds, CAST(extra AS BIGINT) AS sla_extension_seconds, deadline AS sla_deadline, breached AS sla_breached_at,
       CAST(n_ext AS INTEGER) AS sla_extended_count, events, a.owner_id, a.team_id, a.event_ts AS assigned_at
FROM n JOIN e8 e USING (tenant_id, workspace, fingerprint, pos) LEFT JOIN stamp USING (tenant_id, workspace, fingerprint)
LEFT JOIN (SELECT tenant_id, workspace, fingerprint, pos AS apos, owner_id, team_id, event_ts FROM e1) a USING (tenant_id, workspace, fingerprint, apos)
""",
)
def g5_g7_g11(spark, sf):
    lat = materialize(_latest(spark, sf), "latest")
    events = materialize(_events(spark, sf).unionByName(_group_events(lat)), "events")
    return G.sla_replay(events, lat, G.default_policies(spark), extensions=bound(spark, sf, "extensions"), assignments=bound(spark, sf, "assignments"))


@query(
    "g1_j9_group_states",
    oracle=HIST_CTE
    + REPLAY_CTE
    + f""",
fst AS (SELECT tenant_id, workspace_id AS workspace, subject_id AS fingerprint, state AS fs, snooze_until AS fu FROM state_events WHERE subject_type = 'finding'
        QUALIFY row_number() OVER (PARTITION BY tenant_id, workspace_id, subject_id ORDER BY event_ts DESC, state DESC) = 1),
gst AS (SELECT tenant_id, workspace, group_key, state AS gs, snooze_until AS gu FROM gev QUALIFY row_number() OVER (PARTITION BY tenant_id, workspace, group_key ORDER BY event_ts DESC, state DESC) = 1)
SELECT tenant_id, workspace, fingerprint, COALESCE(gs, fs, 'open') AS state, COALESCE(gu, fu) AS snooze_until,
       CASE WHEN gs IN ('resolved', 'ignored') THEN gs WHEN gs = 'snoozed' AND gu > TIMESTAMP '1998-06-01' THEN 'snoozed' WHEN fs IN ('resolved', 'ignored') THEN fs
            WHEN fs = 'snoozed' AND fu > TIMESTAMP '1998-06-01' THEN 'snoozed' ELSE 'open' END AS effective_state
FROM lat LEFT JOIN fst USING (tenant_id, workspace, fingerprint) LEFT JOIN gst USING (tenant_id, workspace, group_key)
""",
)
def g1_j9(spark, sf):
    lat = materialize(_latest(spark, sf), "latest")
    events = materialize(_events(spark, sf).unionByName(_group_events(lat)), "events")
    current = G.finding_current(lat, events, G.sla_replay(events, lat, G.default_policies(spark), own_state=True), "1998-06-01 00:00:00")
    return current.select("tenant_id", "workspace", "fingerprint", "state", "snooze_until", "effective_state")


@query("g2_finding_current", headline=True, oracle=HIST_CTE + GOV_CTE + "SELECT * FROM cur2")
def g2(spark, sf):
    return _current(spark, sf)


@query(
    "a7_aggregates_current",
    oracle=HIST_CTE
    + GOV_CTE
    + """
SELECT tenant_id, workspace, dimension, key, count(*) AS finding_count, CAST(sum(estimated_monthly_savings) AS DECIMAL(38,6)) AS total_savings
FROM (
  SELECT tenant_id, workspace, estimated_monthly_savings, 'effective_state' AS dimension, COALESCE(effective_state, 'open') AS key FROM cur2
  UNION ALL SELECT tenant_id, workspace, estimated_monthly_savings, 'severity', COALESCE(severity, 'unknown') FROM cur2
  UNION ALL SELECT tenant_id, workspace, estimated_monthly_savings, 'service', COALESCE(service, 'unknown') FROM cur2
  UNION ALL SELECT tenant_id, workspace, estimated_monthly_savings, 'category', COALESCE(category, 'other') FROM cur2)
GROUP BY ALL
""",
)
def a7(spark, sf):
    return H.aggregates_current(_current(spark, sf, "severity", "service", "estimated_monthly_savings"))


@query(
    "a9_facets",
    oracle=HIST_CTE
    + GOV_CTE
    + """
SELECT tenant_id, workspace, facet, value, count(*) AS count FROM (
  SELECT tenant_id, workspace, 'service' AS facet, service AS value FROM cur2
  UNION ALL SELECT tenant_id, workspace, 'region', region FROM cur2
  UNION ALL SELECT tenant_id, workspace, 'severity', severity FROM cur2
  UNION ALL SELECT tenant_id, workspace, 'effective_state', effective_state FROM cur2)
WHERE value IS NOT NULL GROUP BY ALL
""",
)
def a9(spark, sf):
    return H.facets(_current(spark, sf, "service", "region", "severity"))


@query(
    "a8_dashboard_aggregates",
    oracle=HIST_CTE
    + GOV_CTE
    + """,
by_acct AS (SELECT tenant_id, workspace, account_id AS value, count(*) AS count FROM cur2 GROUP BY ALL),
acct AS (SELECT *, row_number() OVER (PARTITION BY tenant_id, workspace ORDER BY count DESC, value) AS k FROM by_acct)
SELECT tenant_id, workspace, facet, value, count(*) AS count FROM (
  SELECT tenant_id, workspace, 'service' AS facet, service AS value FROM cur2
  UNION ALL SELECT tenant_id, workspace, 'category', category FROM cur2
  UNION ALL SELECT tenant_id, workspace, 'severity', severity FROM cur2
  UNION ALL SELECT tenant_id, workspace, 'effective_state', effective_state FROM cur2)
WHERE value IS NOT NULL GROUP BY ALL
UNION ALL SELECT tenant_id, workspace, 'account_top', value, count FROM acct WHERE k <= 3
UNION ALL SELECT tenant_id, workspace, 'total', CAST(CAST(sum(estimated_monthly_savings) AS DECIMAL(28,6)) AS VARCHAR), count(*) FROM cur2 GROUP BY ALL
""",
)
def a8(spark, sf):
    cur = _current(spark, sf, "account_id", "service", "severity", "estimated_monthly_savings").select("tenant_id", "workspace", "account_id", "service", "severity", "category", "effective_state", "estimated_monthly_savings")
    return H.dashboard_aggregates(materialize(cur, "current"), top_accounts=3)


@query(
    "g12_audit_history",
    oracle=binding_cte("state_events") + " SELECT tenant_id, workspace_id, subject_type, subject_id, state, snooze_until, event_ts FROM state_events WHERE subject_type = 'ticket'",
)
def g12(spark, sf):
    return G.audit_history(state_events(spark, sf), subject_type="ticket").select("tenant_id", "workspace_id", "subject_type", "subject_id", "state", "snooze_until", "event_ts")


@query(
    "a10_group_list",
    oracle=HIST_CTE
    + GOV_CTE
    + """
SELECT tenant_id, workspace, group_key, min(title) AS title, min(check_id) AS check_id, min(service) AS service,
       min(category) AS category, count(*) AS finding_count,
       CAST(sum(estimated_monthly_savings) AS DECIMAL(38,6)) AS total_savings,
       CASE max(CASE severity WHEN 'critical' THEN 5 WHEN 'high' THEN 4 WHEN 'medium' THEN 3 WHEN 'low' THEN 2 WHEN 'info' THEN 1 ELSE 0 END)
            WHEN 5 THEN 'critical' WHEN 4 THEN 'high' WHEN 3 THEN 'medium' WHEN 2 THEN 'low' WHEN 1 THEN 'info' ELSE 'unknown' END AS max_severity
FROM cur2 WHERE group_key IS NOT NULL GROUP BY ALL
""",
)
def a10(spark, sf):
    return H.group_list(_current(spark, sf, "title", "check_id", "service", "severity", "estimated_monthly_savings"))


@query(
    "a11_category_totals",
    oracle=HIST_CTE
    + GOV_CTE
    + """
SELECT tenant_id, workspace, COALESCE(category, 'uncategorized') AS category, count(*) AS finding_count,
       CAST(sum(estimated_monthly_savings) AS DECIMAL(38,6)) AS total_savings
FROM cur2 GROUP BY ALL
""",
)
def a11(spark, sf):
    return H.category_totals(_current(spark, sf, "estimated_monthly_savings"))


@query(
    "g8_breached_list",
    oracle=HIST_CTE + GOV_CTE + "SELECT * FROM cur2 WHERE sla_status = 'breached'",
)
def g8(spark, sf):
    return G.breached_list(_current(spark, sf))


@query(
    "g9_ageing_list",
    oracle=HIST_CTE + GOV_CTE + "SELECT * FROM cur2 WHERE age_days_open IS NOT NULL AND age_days_open BETWEEN 200 AND 1500",
)
def g9(spark, sf):
    return G.ageing_list(_current(spark, sf), 200, 1500, basis="open")


@query(
    "q6_findings_page_filtered",
    oracle=HIST_CTE
    + GOV_CTE
    + """
SELECT * FROM (
  SELECT fingerprint, check_id, service, severity, region, title, effective_state, sla_status, estimated_monthly_savings,
         detected_at, count(*) OVER () AS total_count
  FROM cur2
  WHERE effective_state IN ('open', 'snoozed') AND severity IN ('high', 'critical', 'medium') AND title ILIKE '%volume%')
ORDER BY estimated_monthly_savings DESC NULLS LAST, detected_at DESC, fingerprint LIMIT 100 OFFSET 20
""".replace("SELECT * FROM (", "SELECT * EXCLUDE (detected_at) FROM (", 1),
)
def q6(spark, sf):
    cur = _current(spark, sf)
    cur = read.multi_filters(cur, effective_state=["open", "snoozed"], severity=["high", "critical", "medium"])
    cur = read.title_contains(cur, "volume").select(
        "fingerprint", "check_id", "service", "severity", "region", "title", "effective_state", "sla_status", "estimated_monthly_savings", "detected_at"
    )
    return read.page_with_total(
        materialize(cur, "filtered"),
        [F.col("estimated_monthly_savings").desc_nulls_last(), F.col("detected_at").desc(), F.col("fingerprint")],
        limit=100,
        offset=20,
    ).select(
        "fingerprint", "check_id", "service", "severity", "region", "title", "effective_state", "sla_status", "estimated_monthly_savings", "total_count"
    )


@query(
    "q7_category_page",
    oracle=HIST_CTE
    + GOV_CTE
    + """
SELECT fingerprint, COALESCE(category, 'uncategorized') AS category, estimated_monthly_savings FROM cur2
ORDER BY COALESCE(category, 'uncategorized'), estimated_monthly_savings DESC NULLS LAST, fingerprint LIMIT 200
""",
)
def q7(spark, sf):
    cur = _current(spark, sf, "estimated_monthly_savings").withColumn("category", F.coalesce("category", F.lit("uncategorized")))
    return cur.orderBy("category", F.col("estimated_monthly_savings").desc_nulls_last(), "fingerprint").limit(200).select(
        "fingerprint", "category", "estimated_monthly_savings"
    )


@query(
    "q8_group_members",
    oracle=HIST_CTE
    + GOV_CTE
    + """
SELECT c.tenant_id, c.workspace, c.group_key, c.fingerprint, c.effective_state, g.finding_count
FROM cur2 c JOIN (SELECT tenant_id, workspace, group_key, count(*) AS finding_count FROM cur2 GROUP BY ALL HAVING count(*) >= 3) g
USING (tenant_id, workspace, group_key)
""",
)
def q8(spark, sf):
    cur = _current(spark, sf, "title", "check_id", "service", "severity", "estimated_monthly_savings").select("tenant_id", "workspace", "group_key", "fingerprint", "effective_state", "title", "check_id", "service", "category", "severity", "estimated_monthly_savings")
    cur = materialize(cur, "current")
    groups = H.group_list(cur).where(F.col("finding_count") >= 3).select("tenant_id", "workspace", "group_key", "finding_count")
    groups = materialize(groups, "groups")  # of known size: few are broadcast, and members not dealt by group
    return cur.join(groups, ["tenant_id", "workspace", "group_key"]).select(
        "tenant_id", "workspace", "group_key", "fingerprint", "effective_state", "finding_count"
    )


@query(
    "u6_state_current_versioned",
    oracle=binding_cte("state_events")
    + """
SELECT * EXCLUDE (r) FROM (
  SELECT *, count(*) OVER (PARTITION BY tenant_id, workspace_id, subject_type, subject_id) AS version,
         row_number() OVER (PARTITION BY tenant_id, workspace_id, subject_type, subject_id ORDER BY event_ts DESC, state DESC) AS r
  FROM state_events) WHERE r = 1
""",
)
def u6(spark, sf):
    return H.state_upsert(state_events(spark, sf))


@query(
    "j17_sla_days",
    oracle=HIST_CTE
    + GOV_CTE
    + "SELECT l.tenant_id, l.workspace, l.fingerprint, l.check_id, l.category, p.sla_days FROM lat l LEFT JOIN pol p USING (category)",
)
def j17(spark, sf):
    lat = _latest(spark, sf)
    d = G.resolve_sla_days(lat, G.default_policies(spark))
    return d.select("tenant_id", "workspace", "fingerprint", "check_id", "category", "sla_days")


@query(
    "g6_sla_backfill",
    oracle=HIST_CTE
    + GOV_CTE
    + """
SELECT l.tenant_id, l.workspace, l.fingerprint, l.detected_at AS first_detected_at, l.detected_at AS first_opened_at, p.sla_days,
       CASE WHEN p.sla_days IS NOT NULL THEN l.detected_at + to_days(CAST(p.sla_days AS INTEGER)) END AS sla_deadline
FROM lat l LEFT JOIN pol p USING (category)
WHERE NOT EXISTS (SELECT 1 FROM state_events x WHERE x.subject_type = 'finding' AND x.tenant_id = l.tenant_id AND x.workspace_id = l.workspace AND x.subject_id = l.fingerprint)
""",
)
def g6(spark, sf):
    return G.sla_backfill(_latest(spark, sf), G.default_policies(spark), AS_OF, state_events=state_events(spark, sf))


@query(
    "n2_run_status",
    oracle=binding_cte("run_events", "run_locks")
    + """,
last AS (SELECT * EXCLUDE (r) FROM (
  SELECT *, row_number() OVER (PARTITION BY tenant_id, workspace, run_id ORDER BY event_ts DESC, status DESC) AS r FROM run_events) WHERE r = 1)
SELECT l.tenant_id, l.workspace, l.run_id, l.event_ts,
       CASE WHEN l.status = 'running' AND k.run_id IS NULL THEN 'failed' ELSE l.status END AS status,
       (l.status = 'running' AND k.run_id IS NULL) AS stale
FROM last l LEFT JOIN run_locks k USING (tenant_id, workspace, run_id)
""",
)
def n2(spark, sf):
    from ..sources.bind import bound

    return H.run_status(bound(spark, sf, "run_events"), bound(spark, sf, "run_locks"))


@query(
    "q11_teams_member_counts",
    oracle=binding_cte("teams", "team_members")
    + """
SELECT t.tenant_id, t.team_id, COALESCE(m.member_count, 0) AS member_count
FROM teams t LEFT JOIN (SELECT tenant_id, team_id, count(*) AS member_count FROM team_members GROUP BY ALL) m USING (tenant_id, team_id)
""",
)
def q11(spark, sf):
    from ..sources.bind import bound

    return G.team_member_counts(bound(spark, sf, "teams"), bound(spark, sf, "team_members"))
