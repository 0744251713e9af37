"""Finding contract: storage schema, record building, identity, validation, cast.

X1  normalize_wire        X2  cast_for_storage     X3  money_type_guard
X11 missing_required      X12 enum_errors          X13 coherence_errors
X14 validate / split      X15 to_findings          X17 logical_hash
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.coerce import MONEY, blank, confidence_0_100, money_or_zero
from ..functions.identity import finding_id_col, fingerprint_col, id_salt_col, norm_str
from ..session import materialize

# Contract enumerations. ``warn`` is emitted by several
# correlation rules, so it is accepted as a status as well.
STATUS_VALUES = ("pass", "fail", "info", "unknown", "warn")
SEVERITY_VALUES = ("info", "low", "medium", "high", "critical")
LIFECYCLE_VALUES = ("open", "acknowledged", "snoozed", "resolved", "ignored")
ATTRIBUTION_VALUES = ("exact_resource_id", "tag", "heuristic", "shared_unallocated", "none")
COST_MODEL_VALUES = ("unblended", "amortized", "net", "blended")
REQUIRED_FIELDS = (
    "tenant_id",
    "finding_id",
    "fingerprint",
    "run_id",
    "run_ts",
    "check_id",
    "status",
    "severity.level",
    "scope.cloud",
    "scope.account_id",
    "scope.service",
    "source.schema_version",
)

S = T.StringType()
SCOPE_T = T.StructType(
    [
        T.StructField(n, S)
        for n in (
            "cloud",
            "provider_partition",
            "organization_id",
            "billing_account_id",
            "account_id",
            "region",
            "availability_zone",
            "service",
            "resource_type",
            "resource_id",
            "resource_arn",
        )
    ]
)
SEVERITY_T = T.StructType([T.StructField("level", S), T.StructField("score", T.IntegerType())])
ESTIMATED_T = T.StructType(
    [
        T.StructField("monthly_savings", T.DecimalType(18, 6)),
        T.StructField("monthly_cost", T.DecimalType(18, 6)),
        T.StructField("one_time_savings", T.DecimalType(18, 6)),
        T.StructField("confidence", T.ShortType()),
        T.StructField("notes", S),
    ]
)
MODEL_T = T.StructType(
    [
        T.StructField("currency", S),
        T.StructField("cost_model", S),
        T.StructField("granularity", S),
        T.StructField("period_start", T.DateType()),
        T.StructField("period_end", T.DateType()),
    ]
)
ATTRIBUTION_T = T.StructType(
    [
        T.StructField("method", S),
        T.StructField("confidence", T.ShortType()),
        T.StructField("matched_keys", T.ArrayType(S)),
    ]
)
ACTUAL_T = T.StructType(
    [T.StructField(n, T.DecimalType(18, 6)) for n in ("cost_7d", "cost_30d", "cost_mtd", "cost_prev_month", "savings_7d", "savings_30d")]
    + [T.StructField("model", MODEL_T), T.StructField("attribution", ATTRIBUTION_T)]
)
LIFECYCLE_T = T.StructType(
    [T.StructField("status", S)]
    + [T.StructField(n, T.TimestampType()) for n in ("first_seen_ts", "last_seen_ts", "resolved_ts", "snooze_until_ts")]
)
SOURCE_T = T.StructType(
    [T.StructField("source_type", S), T.StructField("source_ref", S), T.StructField("schema_version", T.IntegerType())]
)
LINK_T = T.StructType([T.StructField("label", S), T.StructField("url", S)])
SMAP = T.MapType(S, S)

FINDING_SCHEMA = T.StructType(
    [
        T.StructField("tenant_id", S),
        T.StructField("workspace_id", S),
        T.StructField("run_id", S),
        T.StructField("run_ts", T.TimestampType()),
        T.StructField("ingested_ts", T.TimestampType()),
        T.StructField("engine_name", S),
        T.StructField("engine_version", S),
        T.StructField("rulepack_version", S),
        T.StructField("finding_id", S),
        T.StructField("fingerprint", S),
        T.StructField("check_id", S),
        T.StructField("check_name", S),
        T.StructField("category", S),
        T.StructField("sub_category", S),
        T.StructField("frameworks", T.ArrayType(S)),
        T.StructField("status", S),
        T.StructField("severity", SEVERITY_T),
        T.StructField("priority", T.IntegerType()),
        T.StructField("title", S),
        T.StructField("message", S),
        T.StructField("advice", S),
        T.StructField("recommendation", S),
        T.StructField("remediation", S),
        T.StructField("links", T.ArrayType(LINK_T)),
        T.StructField("scope", SCOPE_T),
        T.StructField("estimated", ESTIMATED_T),
        T.StructField("actual", ACTUAL_T),
        T.StructField("lifecycle", LIFECYCLE_T),
        T.StructField("tags", SMAP),
        T.StructField("labels", SMAP),
        T.StructField("dimensions", SMAP),
        T.StructField("metrics", T.MapType(S, T.DecimalType(18, 6))),
        T.StructField("metadata_json", S),
        T.StructField("source", SOURCE_T),
    ]
)


def _opt(df: DataFrame, name: str, default: Column) -> Column:
    return F.col(name) if name in df.columns else default


def _empty_map(t: str = "map<string,string>") -> Column:
    return F.create_map().cast(t)


def to_findings(
    drafts: DataFrame,
    *,
    engine_name: str = "spendlens",
    engine_version: str = "0.1.0",
    rulepack_version: str = "1",
    source_type: str = "checker",
    id_salt: str = "stable",
    ingested_ts: Column | None = None,
    default_currency: str = "USD",
) -> DataFrame:
    """X15 (+X9/X10): flat detector drafts -> storage-shaped findings.

    Draft columns: tenant_id, workspace_id, run_id, run_ts, check_id, status,
    severity_level, severity_score, title, scope columns (cloud, account_id,
    region, service, resource_type, resource_id, resource_arn, ...), optional
    check_name, category, sub_category, message, recommendation, remediation,
    monthly_savings, monthly_cost, confidence, notes, tags/labels/dimensions
    maps, issue_key map, source_ref, fingerprint, finding_id. One ``select``:
    narrow, codegen'd, no shuffle.
    """
    d = drafts
    scope = F.struct(
        *[
            (F.col(f.name).cast("string") if f.name in d.columns else F.lit("")).alias(f.name)
            for f in SCOPE_T.fields
        ]
    )
    status = norm_str(F.col("status"))
    issue = F.col("issue_key") if "issue_key" in d.columns else None
    # identities given by the draft are kept; otherwise they are derived
    if "fingerprint" in d.columns:
        fp = F.col("fingerprint")
    else:
        fp = fingerprint_col(F.col("tenant_id"), F.col("check_id"), scope, issue)
    if "finding_id" in d.columns:
        fid = F.col("finding_id")
    else:
        salt = id_salt_col(id_salt, F.col("run_id"), F.col("run_ts"))
        fid = finding_id_col(F.col("tenant_id"), fp, salt)
    rec = _opt(d, "recommendation", F.lit(""))
    out = d.select(
        norm_str("tenant_id").alias("tenant_id"),
        norm_str("workspace_id", lower=False).alias("workspace_id"),
        norm_str("run_id", lower=False).alias("run_id"),
        F.col("run_ts").cast("timestamp").alias("run_ts"),
        (ingested_ts if ingested_ts is not None else F.col("run_ts").cast("timestamp")).alias("ingested_ts"),
        F.lit(engine_name).alias("engine_name"),
        F.lit(engine_version).alias("engine_version"),
        F.lit(rulepack_version).alias("rulepack_version"),
        fid.alias("finding_id"),
        fp.alias("fingerprint"),
        norm_str("check_id").alias("check_id"),
        norm_str(_opt(d, "check_name", F.col("check_id")), lower=False).alias("check_name"),
        norm_str(_opt(d, "category", F.lit(""))).alias("category"),
        norm_str(_opt(d, "sub_category", F.lit(""))).alias("sub_category"),
        _opt(d, "frameworks", F.array().cast("array<string>")).alias("frameworks"),
        status.alias("status"),
        F.struct(
            norm_str("severity_level").alias("level"), F.col("severity_score").cast("int").alias("score")
        ).alias("severity"),
        _opt(d, "priority", F.lit(0)).cast("int").alias("priority"),
        norm_str("title", lower=False).alias("title"),
        norm_str(_opt(d, "message", F.lit("")), lower=False).alias("message"),
        norm_str(rec, lower=False).alias("advice"),
        norm_str(rec, lower=False).alias("recommendation"),
        norm_str(_opt(d, "remediation", F.lit("")), lower=False).alias("remediation"),
        _opt(d, "links", F.array().cast("array<struct<label:string,url:string>>")).alias("links"),
        scope.alias("scope"),
        F.struct(
            money_or_zero(_opt(d, "monthly_savings", F.lit(None))).alias("monthly_savings"),
            money_or_zero(_opt(d, "monthly_cost", F.lit(None))).alias("monthly_cost"),
            F.lit(0).cast(MONEY).alias("one_time_savings"),
            confidence_0_100(_opt(d, "confidence", F.lit(None))).cast("short").alias("confidence"),
            norm_str(_opt(d, "notes", F.lit("")), lower=False).alias("notes"),
        ).alias("estimated"),
        F.struct(
            *[F.lit(None).cast(MONEY).alias(n) for n in ("cost_7d", "cost_30d", "cost_mtd", "cost_prev_month", "savings_7d", "savings_30d")],
            F.struct(
                F.lit(default_currency).alias("currency"),
                F.lit("").alias("cost_model"),
                F.lit("").alias("granularity"),
                F.lit(None).cast("date").alias("period_start"),
                F.lit(None).cast("date").alias("period_end"),
            ).alias("model"),
            F.struct(
                F.lit("").alias("method"), F.lit(0).cast("short").alias("confidence"), F.array().cast("array<string>").alias("matched_keys")
            ).alias("attribution"),
        ).alias("actual"),
        F.struct(
            F.when(status == "fail", F.lit("open")).otherwise(F.lit("")).alias("status"),
            *[F.lit(None).cast("timestamp").alias(n) for n in ("first_seen_ts", "last_seen_ts", "resolved_ts", "snooze_until_ts")],
        ).alias("lifecycle"),
        _opt(d, "tags", _empty_map()).alias("tags"),
        _opt(d, "labels", _empty_map()).alias("labels"),
        _opt(d, "dimensions", _empty_map()).alias("dimensions"),
        _empty_map("map<string,decimal(18,6)>").alias("metrics"),
        _opt(d, "metadata_json", F.lit("")).alias("metadata_json"),
        F.struct(
            F.lit(source_type).alias("source_type"),
            _opt(d, "source_ref", F.lit(source_type)).cast("string").alias("source_ref"),
            F.lit(1).alias("schema_version"),
        ).alias("source"),
    )
    return out


def findings_from_binding(flat: DataFrame) -> DataFrame:
    """Storage findings from the test binding's flat rows (dimensions as a map)."""
    dims = F.map_from_arrays(
        F.array(
            *[F.lit(k) for k in ("size_gb", "volume_type", "age_days", "vault_name", "namespace", "log_group", "metric_name", "alarm_count")]
        ),
        F.array(
            F.col("dim_size_gb"),
            F.col("dim_volume_type"),
            F.col("dim_age_days"),
            F.col("dim_name"),
            F.col("dim_name"),
            F.col("dim_name"),
            F.col("dim_metric_name"),
            F.col("dim_alarm_count"),
        ),
    )
    drafts = flat.withColumn("dimensions", dims).withColumnRenamed("check_title", "check_name")
    return to_findings(drafts)


# ---------------------------------------------------------------------------
# Validation
# ---------------------------------------------------------------------------


def _path(c: str) -> Column:
    return F.col(c)


def _said(errors: list[Column]) -> Column:
    """Array of the errors that are not NULL. A list joined of empty and one-element lists is
    compiled; a filter over one list (``array_compact``) interprets every check inside it."""
    none = F.array().cast("array<string>")
    return F.concat(*[F.when(e.isNotNull(), F.array(e)).otherwise(none) for e in errors])


def missing_required(df: DataFrame) -> Column:
    """X11: array of required paths that are NULL/blank."""
    return _said([F.when(blank(_path(p)), F.lit(f"missing:{p}")) for p in REQUIRED_FIELDS])


def enum_errors(df: DataFrame) -> Column:
    """Enum violations (status, severity, lifecycle, attribution, cost model)."""
    checks = [
        ("status", F.col("status"), STATUS_VALUES, False),
        ("severity.level", F.col("severity.level"), SEVERITY_VALUES, False),
        ("lifecycle.status", F.col("lifecycle.status"), LIFECYCLE_VALUES, True),
        ("actual.attribution.method", F.col("actual.attribution.method"), ATTRIBUTION_VALUES, True),
        ("actual.model.cost_model", F.col("actual.model.cost_model"), COST_MODEL_VALUES, True),
    ]
    errs = []
    for name, c, allowed, optional in checks:
        bad = ~c.isin(*allowed)
        if optional:
            bad = ~blank(c) & bad
        else:
            bad = ~blank(c) & bad
        errs.append(F.when(bad, F.concat(F.lit(f"enum:{name}="), c)))
    return _said(errs)


def coherence_errors(df: DataFrame) -> Column:
    """Ranges and cross-field rules."""
    score = F.col("severity.score")
    conf = F.col("estimated.confidence")
    has_actual = F.coalesce(
        F.col("actual.cost_7d"), F.col("actual.cost_30d"), F.col("actual.cost_mtd"), F.col("actual.cost_prev_month")
    ).isNotNull()
    errs = [
        F.when(score.isNotNull() & ((score < 0) | (score > 1000)), F.lit("range:severity.score")),
        F.when(conf.isNotNull() & ((conf < 0) | (conf > 100)), F.lit("range:estimated.confidence")),
        F.when(
            F.col("actual.attribution.confidence").isNotNull()
            & ((F.col("actual.attribution.confidence") < 0) | (F.col("actual.attribution.confidence") > 100)),
            F.lit("range:actual.attribution.confidence"),
        ),
        F.when(F.col("priority") < 0, F.lit("range:priority")),
        F.when(F.col("run_ts").isNull(), F.lit("type:run_ts")),
        F.when(
            F.col("status").isin("pass", "info") & F.col("lifecycle.status").isin("open", "acknowledged"),
            F.lit("coherence:lifecycle_needs_problem_status"),
        ),
        F.when(has_actual & blank(F.col("actual.model.currency")), F.lit("coherence:actual_requires_currency")),
        F.when(
            (F.col("source.schema_version") < 1) | (F.col("source.schema_version") > 65535), F.lit("range:source.schema_version")
        ),
    ]
    return _said(errs)


def validate(findings: DataFrame) -> DataFrame:
    """Add ``errors`` (array<string>) and ``is_valid``."""
    errors = F.concat(missing_required(findings), enum_errors(findings), coherence_errors(findings))
    return findings.withColumn("errors", errors).withColumn("is_valid", F.size("errors") == 0)


def split_valid(findings: DataFrame, samples: int = 50, keep: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """X14 lenient mode: (valid rows, invalid rows, first ``samples`` invalid rows by finding_id).

    ``keep`` names the columns the caller reads of the rows: they are stored with the errors, so
    findings are made and judged once for all three frames.
    """
    v = validate(findings)
    if keep:
        v = materialize(v.select(*dict.fromkeys([*keep, "finding_id", "check_id", "errors", "is_valid"])), "validated")
    ok = v.where("is_valid").drop("errors", "is_valid")
    bad = v.where("NOT is_valid")
    sample = bad.select("finding_id", "check_id", "errors").orderBy("finding_id").limit(samples)
    return ok, bad, sample


# ---------------------------------------------------------------------------
# Wire form -> storage
# ---------------------------------------------------------------------------

_BOOL_TRUE = ("true", "t", "yes", "y", "1")
_BOOL_FALSE = ("false", "f", "no", "n", "0")


def _cast_leaf(c: Column, to: T.DataType) -> tuple[Column, Column]:
    """Cast one wire value; returns (value, rejected flag). '' -> NULL for non-strings."""
    s = c.cast("string")
    empty = s.isNull() | (F.trim(s) == "")
    if isinstance(to, T.StringType):
        return s, F.lit(False)
    if isinstance(to, T.BooleanType):
        low = F.lower(F.trim(s))
        v = F.when(low.isin(*_BOOL_TRUE), True).when(low.isin(*_BOOL_FALSE), False)
        return F.when(~empty, v), ~empty & v.isNull()
    if isinstance(to, T.TimestampType):
        v = F.coalesce(F.try_to_timestamp(F.trim(s)), F.try_to_timestamp(F.trim(s), F.lit("yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]XXX")))
        return F.when(~empty, v), ~empty & v.isNull()
    v = F.trim(s).try_cast(to)
    return F.when(~empty, v), ~empty & v.isNull()


def _cast_value(c: Column, src: T.DataType, to: T.DataType, path: str) -> tuple[Column, Column]:
    """Cast a wire value of any shape; returns (value, array of paths that do not cast).

    Structs are cast field by field (missing fields become NULL), arrays and
    map values element by element; a leaf never raises.
    """
    none = F.array().cast("array<string>")
    if isinstance(to, T.StructType):
        if not isinstance(src, T.StructType):
            return F.lit(None).cast(to), F.when(c.isNotNull(), F.array(F.lit(path))).otherwise(none)
        have = {f.name: f.dataType for f in src.fields}
        parts, bad = [], [none]
        for f in to.fields:
            if f.name not in have:
                parts.append(F.lit(None).cast(f.dataType).alias(f.name))
                continue
            v, b = _cast_value(c.getField(f.name), have[f.name], f.dataType, f"{path}.{f.name}")
            parts.append(v.alias(f.name))
            bad.append(b)
        return F.when(c.isNotNull(), F.struct(*parts)), F.when(c.isNotNull(), F.concat(*bad)).otherwise(none)
    if isinstance(to, T.ArrayType):
        if not isinstance(src, T.ArrayType):
            return F.lit(None).cast(to), F.when(c.isNotNull(), F.array(F.lit(path))).otherwise(none)
        value = F.transform(c, lambda x: _cast_value(x, src.elementType, to.elementType, path)[0])
        bad = F.exists(c, lambda x: F.size(_cast_value(x, src.elementType, to.elementType, path)[1]) > 0)
        return value, F.when(F.coalesce(bad, F.lit(False)), F.array(F.lit(path))).otherwise(none)
    if isinstance(to, T.MapType):
        if not isinstance(src, T.MapType):
            return F.lit(None).cast(to), F.when(c.isNotNull(), F.array(F.lit(path))).otherwise(none)
        value = F.transform_values(c, lambda k, x: _cast_value(x, src.valueType, to.valueType, path)[0])
        bad = F.exists(F.map_values(c), lambda x: F.size(_cast_value(x, src.valueType, to.valueType, path)[1]) > 0)
        return value.cast(to), F.when(F.coalesce(bad, F.lit(False)), F.array(F.lit(path))).otherwise(none)
    if isinstance(src, (T.StructType, T.ArrayType, T.MapType)):
        return F.lit(None).cast(to), F.when(c.isNotNull(), F.array(F.lit(path))).otherwise(none)
    v, bad = _cast_leaf(c, to)
    return v, F.when(bad, F.array(F.lit(path))).otherwise(none)


def cast_for_storage(wire: DataFrame, schema: T.StructType = FINDING_SCHEMA) -> tuple[DataFrame, DataFrame]:
    """Cast a wire frame to the storage schema, at any depth.

    Unknown fields are dropped, missing ones become NULL, '' becomes NULL for
    non-string leaves, booleans accept common synonyms. A row with any value
    that is present but not castable (in structs, arrays and map values too)
    goes to the rejects frame, with the offending paths, instead of failing
    the job.
    """
    cols, bad = [], [F.array().cast("array<string>")]
    present = {f.name: f.dataType for f in wire.schema.fields}
    for f in schema.fields:
        if f.name not in present:
            cols.append(F.lit(None).cast(f.dataType).alias(f.name))
            continue
        v, b = _cast_value(F.col(f.name), present[f.name], f.dataType, f.name)
        cols.append(v.alias(f.name))
        bad.append(b)
    typed = wire.select(*cols, F.concat(*bad).alias("_reject"))
    ok = typed.where(F.size("_reject") == 0).drop("_reject")
    rejects = typed.where(F.size("_reject") > 0).withColumnRenamed("_reject", "reject_paths")
    return ok, rejects


def money_type_guard(wire: DataFrame, paths=("estimated.monthly_savings", "estimated.monthly_cost", "estimated.one_time_savings")) -> DataFrame:
    """Rows whose money fields are not numeric-or-NULL (booleans/strings are violations)."""
    conds = []
    for p in paths:
        dt = wire.select(F.col(p)).schema.fields[0].dataType
        if isinstance(dt, (T.NumericType,)) and not isinstance(dt, T.BooleanType):
            continue
        conds.append(F.when(F.col(p).isNotNull(), F.lit(p)))
    viol = F.array_compact(F.array(*conds)) if conds else F.array().cast("array<string>")
    return wire.withColumn("money_violations", viol).where(F.size("money_violations") > 0)


# The wire form of a finding. Text, money (decimal as text), time (ISO text in
# UTC), whole numbers with their default, lists of text, and structs of these.
_TEXT, _MONEY, _TIME, _LIST = "text", "money", "time", "list"
WIRE_STRUCTS: dict = {
    "severity": {"level": _TEXT, "score": 0},
    "scope": dict.fromkeys(
        ("cloud", "provider_partition", "organization_id", "billing_account_id", "account_id", "region", "availability_zone", "service", "resource_type", "resource_id", "resource_arn"), _TEXT
    ),
    "estimated": {"monthly_savings": _MONEY, "monthly_cost": _MONEY, "one_time_savings": _MONEY, "confidence": 0, "notes": _TEXT},
    "actual": {
        **dict.fromkeys(("cost_7d", "cost_30d", "cost_mtd", "cost_prev_month", "savings_7d", "savings_30d"), _MONEY),
        "model": dict.fromkeys(("currency", "cost_model", "granularity", "period_start", "period_end"), _TEXT),
        "attribution": {"method": _TEXT, "confidence": 0, "matched_keys": _LIST},
    },
    "lifecycle": {"status": _TEXT, **dict.fromkeys(("first_seen_ts", "last_seen_ts", "resolved_ts", "snooze_until_ts"), _TIME)},
    "source": {"source_type": _TEXT, "source_ref": _TEXT, "schema_version": 1},
}
WIRE_TEXTS = (
    "tenant_id", "workspace_id", "engine_name", "engine_version", "rulepack_version", "check_id", "check_name", "category", "sub_category", "status", "title", "message",
    "advice", "recommendation", "remediation", "metadata_json", "run_id",
)


def iso_utc(c: Column, is_time: bool) -> Column:
    """A time as ISO text in UTC (``...Z``); text that ends in Z stays, other text is parsed (no
    zone: UTC), and what is no time becomes empty."""
    text = F.lit("") if is_time else F.trim(c.cast("string"))
    t = c.cast("timestamp") if is_time else F.coalesce(F.try_to_timestamp(text), F.try_to_timestamp(text, F.lit("yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]XXX")))
    whole = F.unix_micros(t) % 1_000_000 == 0
    iso = F.when(whole, F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss'Z'")).otherwise(F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"))
    return F.coalesce(iso if is_time else F.when(text.endswith("Z"), text).otherwise(iso), F.lit(""))


def decimal_text(c: Column) -> Column:
    """A number as text; text that is no number, and NULL, become empty."""
    text = F.trim(c.cast("string"))
    return F.coalesce(F.when(text.try_cast("decimal(38,18)").isNotNull() | text.try_cast("double").isNotNull(), text), F.lit(""))


def _wire_value(c: Column | None, have: T.DataType | None, want) -> Column:
    """One value of the wire form from what the row has (``None``: nothing)."""
    if isinstance(want, dict):
        inner = have if isinstance(have, T.StructType) else T.StructType([])
        given = {f.name: f.dataType for f in inner.fields}
        return F.struct(*[_wire_value(c[n] if n in given else None, given.get(n), w).alias(n) for n, w in want.items()])
    if want == _LIST:
        return F.coalesce(c.cast("array<string>"), F.array().cast("array<string>")) if isinstance(have, T.ArrayType) else F.array().cast("array<string>")
    if isinstance(want, int):
        return F.lit(want) if c is None else F.coalesce(c.try_cast("int") if not isinstance(have, T.StringType) else F.trim(c).try_cast("int"), F.lit(want))
    if c is None:
        return F.lit("")
    if want == _TIME:
        return iso_utc(c, isinstance(have, (T.TimestampType, T.TimestampNTZType, T.DateType)))
    if want == _MONEY:
        return F.lit("") if isinstance(have, T.BooleanType) else decimal_text(c)
    return F.coalesce(c.cast("string"), F.lit(""))


def _of_value(fn):
    return lambda k, v: fn(v)


def normalize_wire(df: DataFrame) -> DataFrame:
    """Findings of any producer in the wire form: every struct and its fields there, times as
    ISO text in UTC, money as decimal text, maps of text, lists, texts never NULL, and advice
    and recommendation standing in for each other. Other columns pass through.
    """
    have = {f.name: f.dataType for f in df.schema.fields}
    col = lambda n: F.col(n) if n in have else None
    out = {n: _wire_value(col(n), have.get(n), w) for n, w in WIRE_STRUCTS.items()}
    out |= {n: _wire_value(col(n), have.get(n), _TIME) for n in ("run_ts", "ingested_ts")}
    out |= {n: _wire_value(col(n), have.get(n), _TEXT) for n in WIRE_TEXTS}
    filled = lambda a, b: F.when(out[a] == "", out[b]).otherwise(out[a])
    out |= {"advice": filled("advice", "recommendation"), "recommendation": filled("recommendation", "advice")}
    text = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    none = F.create_map().cast("map<string,string>")
    for n in ("tags", "labels", "dimensions", "metrics"):
        value = _of_value(decimal_text if n == "metrics" else text)
        out[n] = F.coalesce(F.transform_values(F.col(n), value), none) if isinstance(have.get(n), T.MapType) else none
    out["frameworks"] = _wire_value(col("frameworks"), have.get("frameworks"), _LIST)
    out["links"] = F.array().cast("array<struct<label:string,url:string>>")
    if isinstance(have.get("links"), T.ArrayType):
        cleaned = F.transform(F.col("links"), lambda x: F.struct(text(x["label"]).alias("label"), text(x["url"]).alias("url")))
        out["links"] = F.coalesce(cleaned, out["links"])
    return df.withColumns(out)


# ---------------------------------------------------------------------------
# X17 logical content hash
# ---------------------------------------------------------------------------

VOLATILE = ("ingested_ts",)


def logical_hash(df: DataFrame, drop: tuple[str, ...] = VOLATILE) -> DataFrame:
    """Order-free content hash of a dataset: one row (n_rows, hash).

    Each row is hashed from its JSON text (xxhash64 over sha2 -> stable), then
    summed: commutative, so independent of partitioning and row order, and a
    plain two-phase aggregate (no collect to one task).
    """
    keep = [c for c in df.columns if c not in drop]
    row_h = F.xxhash64(F.sha2(F.to_json(F.struct(*[F.col(c) for c in sorted(keep)])), 256))
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.sum(row_h.cast("decimal(38,0)")).cast("string").alias("content_hash"),
    )
