"""Run history and read model: ingest, presence, latest, run diff, aggregates.

N1 ingest_run / presence_rows    W1 latest_per_key    W2 dedup_within_run
W3 latest_ready_runs             U1/N3 run_diff       A14 run_diff_rollup
A7 aggregates_current            A9 facets            A10 group_list
A11 category_totals              X16 ingest_invariants
N2 run_status                    P15 derive_category  P16 read_model_fields
P17 group_key                    U5 upsert_latest     U6 state_upsert
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.coerce import MONEY, nullif_blank
from ..session import materialize

# Coarse category by check id prefix (first match wins, else "other").
CATEGORY_BY_PREFIX = [
    ("aws.cloudwatch.", "cost"),
    ("aws.ec2.", "cost"),
    ("aws.ebs.", "cost"),
    ("aws.elb", "cost"),
    ("aws.rds.", "cost"),
    ("aws.s3.", "cost"),
    ("aws.vpc.", "cost"),
    ("aws.fsx.", "cost"),
    ("aws.backup.", "reliability"),
    ("aws.iam.", "security"),
]

# Id patterns masked in titles before grouping (intended masking).
TITLE_ID_PATTERNS = [
    r"\barn:[^\s]+",
    r"\bi-[0-9a-f]{8,}\b",
    r"\bvol-[0-9a-f]{8,}\b",
    r"\bsg-[0-9a-f]{8,}\b",
    r"\bsubnet-[0-9a-f]{8,}\b",
    r"\bvpc-[0-9a-f]{8,}\b",
    r"\b[a-z0-9-]{1,63}\.amazonaws\.com\b",
]

#: the fixed text each of these patterns needs
TITLE_ID_TEXTS = ["arn:", "i-", "vol-", "sg-", "subnet-", "vpc-", ".amazonaws.com"]

SEVERITY_RANK = {"critical": 5, "high": 4, "medium": 3, "low": 2, "info": 1}


def derive_category(check_id: Column) -> Column:
    """Category from the check id prefix."""
    out = None
    for prefix, cat in CATEGORY_BY_PREFIX:
        cond = check_id.startswith(prefix)
        out = F.when(cond, cat) if out is None else out.when(cond, cat)
    return F.when(check_id.isNull() | (check_id == ""), "other").otherwise(out.otherwise("other"))


def normalize_title(title: Column, mask: bool = True) -> Column:
    """P17 title normalization: lower/trim; with ``mask`` ids -> <id>, digits -> <n>, spaces collapsed.

    ``mask=False`` reproduces the reference's effective behaviour (its patterns
    never match, K6): only lower + trim.
    """
    t = F.lower(F.trim(F.coalesce(title, F.lit(""))))
    if not mask:
        return t
    masked = t
    for pat in TITLE_ID_PATTERNS:
        masked = F.regexp_replace(masked, pat, "<id>")
    # the patterns are dear: only a title that holds the fixed text of one goes through them
    t = F.when(reduce(Column.__or__, [t.contains(x) for x in TITLE_ID_TEXTS]), masked).otherwise(t)
    t = F.regexp_replace(t, r"\d+", "<n>")
    t = F.regexp_replace(t, r"\s+", " ")
    return F.trim(t)


def group_key(check_id: Column, category: Column, title: Column, mask: bool = True) -> Column:
    """sha1 of 'check|category|normalized title' with outer '|' stripped; NULL if empty."""
    base = F.concat_ws(
        "|", F.trim(F.coalesce(check_id, F.lit(""))), F.coalesce(category, F.lit("")), normalize_title(title, mask)
    )
    base = F.regexp_replace(base, r"^\|+|\|+$", "")
    # sha1(NULL) is NULL: the (expensive) base text is referenced once
    return F.sha1(F.nullif(base, F.lit("")))


def _leaves(findings: DataFrame) -> DataFrame:
    """The read model's columns but the group key, whose title masking is dear; a given
    key rides along as ``_given_key``."""
    cols = set(findings.columns)

    def top(name: str) -> Column:
        return nullif_blank(F.col(name)) if name in cols else F.lit(None).cast("string")

    check = nullif_blank(F.col("check_id"))
    cat0 = F.coalesce(F.trim(F.col("category")), F.lit("")) if "category" in cols else F.lit("")
    category = F.when(cat0 == "", derive_category(F.coalesce(check, F.lit("")))).otherwise(cat0)
    return findings.select(
        "tenant_id",
        F.col("workspace_id").alias("workspace"),
        "run_id",
        "run_ts",
        "finding_id",
        "fingerprint",
        check.alias("check_id"),
        F.coalesce(nullif_blank(F.col("scope.service")), top("service")).alias("service"),
        nullif_blank(F.col("severity.level")).alias("severity"),
        nullif_blank(F.col("title")).alias("title"),
        F.col("estimated.monthly_savings").cast(MONEY).alias("estimated_monthly_savings"),
        F.col("estimated.confidence").cast("int").alias("est_confidence"),
        F.coalesce(nullif_blank(F.col("scope.region")), top("region")).alias("region"),
        F.coalesce(nullif_blank(F.col("scope.account_id")), top("account_id")).alias("account_id"),
        category.alias("category"),
        top("group_key").alias("_given_key"),
        F.col("run_ts").alias("detected_at"),
    )


def _with_group_key(leaves: DataFrame, mask_titles: bool) -> DataFrame:
    gk = F.coalesce("_given_key", group_key(F.col("check_id"), F.col("category"), F.col("title"), mask_titles))
    return leaves.select(*[gk.alias("group_key") if c == "_given_key" else F.col(c) for c in leaves.columns])


def read_model_fields(findings: DataFrame, mask_titles: bool = True) -> DataFrame:
    """P16 (+P15, P17): read-model columns with scope-then-top-level fallbacks, blanks -> NULL."""
    return _with_group_key(_leaves(findings), mask_titles)


def dedup_within_run(rows: DataFrame, order: Sequence[Column] | None = None) -> DataFrame:
    """One row per (tenant, workspace, run, fingerprint); first by finding_id wins."""
    w = Window.partitionBy("tenant_id", "workspace", "run_id", "fingerprint").orderBy(*(order or [F.col("finding_id")]))
    return rows.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def presence_rows(findings: DataFrame, mask_titles: bool = True) -> DataFrame:
    """Presence (history) rows for every run in ``findings``: fields + W2 dedup."""
    return _presence_of(_leaves(findings), mask_titles)


def _presence_of(leaves: DataFrame, mask_titles: bool, runs: DataFrame | None = None) -> DataFrame:
    """W2 over the findings of ``runs`` (keys; all without): other runs' rows do not move, and the
    group key is made for the rows that are kept."""
    rows = leaves.drop("detected_at")  # the run's time: it does not travel twice
    if runs is not None:
        rows = rows.join(runs, ["tenant_id", "workspace", "run_id"], "left_semi")
    return _with_group_key(dedup_within_run(rows).withColumn("detected_at", F.col("run_ts")).select(leaves.columns), mask_titles)


def latest_per_key(presence: DataFrame, keys: Sequence[str] = ("tenant_id", "workspace", "fingerprint")) -> DataFrame:
    """Newest row per key by (run_ts desc, run_id desc) - K9: newest run, not last ingested."""
    w = Window.partitionBy(*keys).orderBy(F.col("run_ts").desc(), F.col("run_id").desc())
    return presence.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def ready_runs(runs: DataFrame) -> DataFrame:
    """Keys of the ready runs, stored. Being files, their size is known when a join is planned:
    few runs are broadcast, and findings are not dealt by run (all of a run in one task)."""
    return materialize(runs.where(F.col("status") == "ready").select("tenant_id", F.col("workspace_id").alias("workspace"), "run_id"), "ready-runs")


def latest_of_runs(findings: DataFrame, runs: DataFrame, mask_titles: bool = True) -> DataFrame:
    """W1 over W2 in one window: the newest row per fingerprint over the ready runs.

    Same rows as ``latest_per_key(ingest_run(...)[0])``, with one shuffle (rank 1 is
    kept before it already) and the group key made for the surviving rows only.
    """
    leaves = _leaves(findings)
    # detected_at is the run's time: it does not travel twice
    rows = leaves.drop("detected_at").join(ready_runs(runs), ["tenant_id", "workspace", "run_id"], "left_semi")
    w = Window.partitionBy("tenant_id", "workspace", "fingerprint").orderBy(F.col("run_ts").desc(), F.col("run_id").desc(), F.col("finding_id"))
    rows = rows.withColumn("_rn", F.row_number().over(w)).where("_rn = 1")
    return _with_group_key(rows.withColumn("detected_at", F.col("run_ts")).select(leaves.columns), mask_titles)


def upsert_latest(latest: DataFrame, presence_new: DataFrame) -> DataFrame:
    """U5-style upsert: W1 over old latest ∪ new presence (touches only the union)."""
    return latest_per_key(latest.unionByName(presence_new, allowMissingColumns=True))


def ingest_run(findings: DataFrame, runs: DataFrame, *, mask_titles: bool = True) -> tuple[DataFrame, DataFrame]:
    """(presence, latest) from findings of ready runs. Idempotent per run:
    re-ingesting a run yields the same rows (U3 = overwrite the run partition)."""
    pres = _presence_of(_leaves(findings), mask_titles, ready_runs(runs))
    return pres, latest_per_key(pres)


def ingest_invariants(presence: DataFrame, latest: DataFrame) -> DataFrame:
    """One-row quality frame: row counts, distinct fingerprints, presence keys missing from latest.

    Both sides are tagged and grouped once by key (one shuffle), then folded.
    """
    keys = ["tenant_id", "workspace", "fingerprint"]
    tagged = presence.select(*keys, F.lit(1).alias("p"), F.lit(0).alias("l")).unionByName(
        latest.select(*keys, F.lit(0).alias("p"), F.lit(1).alias("l"))
    )
    per_key = tagged.groupBy(*keys).agg(F.sum("p").alias("n_p"), F.sum("l").alias("n_l"))
    out = per_key.agg(
        F.coalesce(F.sum("n_p"), F.lit(0)).alias("presence_rows"),
        F.count_if(F.col("n_p") > 0).alias("presence_fingerprints"),
        F.coalesce(F.sum("n_l"), F.lit(0)).alias("latest_rows"),
        F.count_if(F.col("n_l") > 0).alias("latest_fingerprints"),
        F.count_if((F.col("n_p") > 0) & (F.col("n_l") == 0)).alias("presence_missing_from_latest"),
    )
    return out.withColumn(
        "ok", (F.col("latest_rows") == F.col("latest_fingerprints")) & (F.col("presence_missing_from_latest") == 0)
    )


def latest_ready_runs(runs: DataFrame, n: int = 2) -> DataFrame:
    """Newest ``n`` ready runs per (tenant, workspace) with their rank (1 = latest)."""
    w = Window.partitionBy("tenant_id", "workspace_id").orderBy(F.col("run_ts").desc(), F.col("run_id").desc())
    return runs.where(F.col("status") == "ready").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def run_diff(presence: DataFrame, runs: DataFrame) -> DataFrame:
    """Fingerprints new in the latest ready run vs the previous one, and those gone.

    Scopes with fewer than two ready runs yield nothing. Rows meet the two runs (stored: two
    rows a scope) in a join by broadcast; one window over the fingerprint then tells which of
    them it is in. A missing fingerprint equals no other.
    """
    scope = ["tenant_id", "workspace"]
    last2 = latest_ready_runs(runs, 2).select("tenant_id", F.col("workspace_id").alias("workspace"), "run_id", "rank")
    both = last2.groupBy(*scope).agg(F.count(F.lit(1)).alias("n")).where("n = 2")
    last2 = materialize(last2.join(both.select(*scope), scope, "left_semi"), "last-two-runs")
    pr = presence.join(last2, scope + ["run_id"])
    w = Window.partitionBy(*scope, "fingerprint")
    once = pr.withColumns({"_first": F.min("rank").over(w), "_last": F.max("rank").over(w)}).where((F.col("_first") == F.col("_last")) | F.col("fingerprint").isNull())
    return once.select(*dict.fromkeys([*scope, "fingerprint", *presence.columns]), F.when(F.col("rank") == 1, "new").otherwise("resolved").alias("change"))


def run_diff_rollup(diff: DataFrame, by: str = "category") -> DataFrame:
    """Counts of new / resolved fingerprints per ``by`` (category, check_id or service)."""
    return diff.groupBy("tenant_id", "workspace", F.coalesce(F.col(by), F.lit("unknown")).alias("key")).agg(
        F.count_if(F.col("change") == "new").alias("new_count"),
        F.count_if(F.col("change") == "resolved").alias("resolved_count"),
    )


def aggregates_current(current: DataFrame) -> DataFrame:
    """(dimension, key) -> finding count, total savings for effective_state / severity / service / category.

    One pass: each row is expanded to its four (dimension, key) pairs with
    ``stack`` and aggregated once (instead of four scans + UNION ALL).
    """
    pairs = current.select(
        "tenant_id",
        "workspace",
        F.coalesce(F.col("estimated_monthly_savings"), F.lit(0).cast(MONEY)).alias("s"),
        F.expr(
            "stack(4, 'effective_state', coalesce(effective_state, 'open'), 'severity', coalesce(severity, 'unknown'),"
            " 'service', coalesce(service, 'unknown'), 'category', coalesce(category, 'other')) AS (dimension, key)"
        ),
    )
    return pairs.groupBy("tenant_id", "workspace", "dimension", "key").agg(
        F.count(F.lit(1)).alias("finding_count"), F.sum("s").cast("decimal(38,6)").alias("total_savings")
    )


def facets(current: DataFrame, dims: Sequence[str] = ("service", "region", "severity", "effective_state")) -> DataFrame:
    """Value counts per facet (non-NULL values), count desc then value."""
    expr = ", ".join(f"'{d}', CAST({d} AS STRING)" for d in dims)
    pairs = current.select("tenant_id", "workspace", F.expr(f"stack({len(dims)}, {expr}) AS (facet, value)")).where(F.col("value").isNotNull())
    return pairs.groupBy("tenant_id", "workspace", "facet", "value").agg(F.count(F.lit(1)).alias("count"))


def dashboard_aggregates(current: DataFrame, top_accounts: int = 20) -> DataFrame:
    """Counts by service / severity / category / state, top accounts, plus total and savings."""
    base = facets(current, ("service", "severity", "category", "effective_state"))
    acct = current.groupBy("tenant_id", "workspace", F.col("account_id").alias("value")).agg(F.count(F.lit(1)).alias("count"))
    w = Window.partitionBy("tenant_id", "workspace").orderBy(F.col("count").desc(), F.col("value"))
    acct = acct.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= top_accounts).drop("_r").withColumn("facet", F.lit("account_top"))
    totals = current.groupBy("tenant_id", "workspace").agg(
        F.count(F.lit(1)).alias("count"), F.sum(F.coalesce("estimated_monthly_savings", F.lit(0).cast(MONEY))).cast("string").alias("value")
    ).withColumn("facet", F.lit("total"))
    return base.unionByName(acct).unionByName(totals)


def group_list(current: DataFrame) -> DataFrame:
    """A10/Q8: groups by group_key: representative fields, count, savings, worst severity label."""
    rank = F.coalesce(*[F.when(F.col("severity") == k, F.lit(v)) for k, v in SEVERITY_RANK.items()], F.lit(0))
    g = current.where(F.col("group_key").isNotNull()).groupBy("tenant_id", "workspace", "group_key").agg(
        F.min("title").alias("title"),
        F.min("check_id").alias("check_id"),
        F.min("service").alias("service"),
        F.min("category").alias("category"),
        F.count(F.lit(1)).alias("finding_count"),
        F.sum(F.coalesce("estimated_monthly_savings", F.lit(0).cast(MONEY))).cast("decimal(38,6)").alias("total_savings"),
        F.max(rank).alias("max_rank"),
    )
    label = F.coalesce(*[F.when(F.col("max_rank") == v, F.lit(k)) for k, v in SEVERITY_RANK.items()], F.lit("unknown"))
    return g.withColumn("max_severity", label).drop("max_rank")


def category_totals(current: DataFrame) -> DataFrame:
    """Totals per category (NULL -> 'uncategorized')."""
    return current.groupBy("tenant_id", "workspace", F.coalesce("category", F.lit("uncategorized")).alias("category")).agg(
        F.count(F.lit(1)).alias("finding_count"),
        F.sum(F.coalesce("estimated_monthly_savings", F.lit(0).cast(MONEY))).cast("decimal(38,6)").alias("total_savings"),
    )


def run_status(run_events: DataFrame, live_locks: DataFrame | None = None) -> DataFrame:
    """Status per run = latest event; 'running' without a live lock is reported as stale/failed."""
    w = Window.partitionBy("tenant_id", "workspace", "run_id").orderBy(F.col("event_ts").desc(), F.col("status").desc())
    last = run_events.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")
    if live_locks is None:
        return last.withColumn("stale", F.lit(False))
    alive = live_locks.select("tenant_id", "workspace", "run_id").distinct().withColumn("_alive", F.lit(True))
    j = last.join(alive, ["tenant_id", "workspace", "run_id"], "left")
    stale = (F.col("status") == "running") & F.col("_alive").isNull()
    return j.withColumn("stale", stale).withColumn("status", F.when(stale, "failed").otherwise(F.col("status"))).drop("_alive")


def state_upsert(state_events: DataFrame, keys: Sequence[str] = ("tenant_id", "workspace_id", "subject_type", "subject_id")) -> DataFrame:
    """Current state per subject = latest event; version = number of events."""
    w = Window.partitionBy(*keys).orderBy(F.col("event_ts").desc(), F.col("state").desc())
    wc = Window.partitionBy(*keys)
    return (
        state_events.withColumn("version", F.count(F.lit(1)).over(wc))
        .withColumn("_r", F.row_number().over(w))
        .where("_r = 1")
        .drop("_r")
    )
