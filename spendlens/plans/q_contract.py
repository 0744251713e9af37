"""Registered contract and I/O queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from ..functions.arn import account_of, arn_part
from ..functions.identity import finding_id_col, fingerprint_col, id_salt_col
from ..operators import correlate as C
from ..operators import read
from ..operators.contract import cast_for_storage, findings_from_binding, normalize_wire, split_valid, to_findings, validate
from ..session import new_folder
from ..sources import findings_io as io
from ..sources.bind import bound, binding_cte, gathered_findings
from ..sources.prices import LADDER, price_ladder, prices_from_price_list
from ..sources.tables import table
from .inputs import findings
from . import q_correlate  # noqa: F401  (its rules are exported)
from .registry import REGISTRY, query

FW = binding_cte("findings_flat")
_SPRAWL = "aws.logs.correlation.retention.missing.sprawl"


def _scope(flat):
    return F.struct(
        *[F.col(c).alias(c) for c in ("account_id", "billing_account_id", "cloud", "region", "resource_arn", "resource_id", "resource_type", "service")]
    )


_CANON = """'{"check_id":"' || lower(trim(check_id)) || '","issue":{},"scope":{"account_id":"' || lower(trim(account_id))
  || '","billing_account_id":"' || lower(trim(billing_account_id)) || '","cloud":"' || lower(trim(cloud)) || '","region":"' || lower(trim(region))
  || '","resource_arn":"' || trim(resource_arn) || '","resource_id":"' || trim(resource_id) || '","resource_type":"' || lower(trim(resource_type))
  || '","service":"' || lower(trim(service)) || '"},"tenant_id":"' || lower(trim(tenant_id)) || '"}'"""


@query(
    "x9_x10_identity_hashes",
    oracle=FW
    + f"""
SELECT line_ref, fp AS fingerprint,
       sha256('{{"fingerprint":"' || fp || '","salt":"' || trim(run_id) || '","tenant_id":"' || lower(trim(tenant_id)) || '"}}') AS finding_id
FROM (SELECT *, sha256({_CANON}) AS fp FROM findings_flat)
""",
)
def x9_x10(spark, sf):
    flat = bound(spark, sf, "findings_flat")
    fp = fingerprint_col(F.col("tenant_id"), F.col("check_id"), _scope(flat))
    return flat.select("line_ref", "tenant_id", "run_id", fp.alias("fingerprint")).select(
        "line_ref",
        "fingerprint",
        finding_id_col(F.col("tenant_id"), F.col("fingerprint"), id_salt_col("per_run", F.col("run_id"))).alias("finding_id"),
    )


def _bad_drafts(spark, sf):
    flat = bound(spark, sf, "findings_flat")
    return flat.withColumns(
        {
            "status": F.when(F.col("confidence") == 84, F.lit("bogus")).otherwise(F.col("status")),
            "severity_score": F.when(F.col("dim_age_days").cast("int") >= 49, F.lit(1200)).otherwise(F.col("severity_score")),
            "account_id": F.when(F.col("resource_id").endswith("7"), F.lit("")).otherwise(F.col("account_id")),
        }
    ).drop("dim_size_gb", "dim_volume_type", "dim_age_days", "dim_name", "dim_metric_name", "dim_alarm_count", "detected_at")


@query(
    "x11_x14_validation",
    oracle=FW
    + """
SELECT finding_id, errors_text = '' AS is_valid, errors_text FROM (
  SELECT finding_id, concat_ws(';',
           CASE WHEN resource_id LIKE '%7' THEN 'missing:scope.account_id' END,
           CASE WHEN confidence = 84 THEN 'enum:status=bogus' END,
           CASE WHEN CAST(dim_age_days AS INTEGER) >= 49 THEN 'range:severity.score' END) AS errors_text
  FROM findings_flat)
""",
)
def x11_x14(spark, sf):
    v = validate(to_findings(_bad_drafts(spark, sf)))
    return v.select("finding_id", "is_valid", F.array_join("errors", ";").alias("errors_text"))


_ERRORS = """SELECT finding_id, check_id, concat_ws(';', CASE WHEN resource_id LIKE '%7' THEN 'missing:scope.account_id' END, CASE WHEN confidence = 84 THEN 'enum:status=bogus' END,
  CASE WHEN CAST(dim_age_days AS INTEGER) >= 49 THEN 'range:severity.score' END) AS errors_text FROM findings_flat"""


@query(
    "x14_split_valid",
    oracle=FW
    + f""", e AS ({_ERRORS})
SELECT 'valid' AS part, check_id AS item, CAST(count(*) AS VARCHAR) AS value FROM e WHERE errors_text = '' GROUP BY ALL
UNION ALL SELECT 'invalid', check_id, CAST(count(*) AS VARCHAR) FROM e WHERE errors_text <> '' GROUP BY ALL
UNION ALL SELECT 'sample', finding_id, errors_text FROM (SELECT * FROM e WHERE errors_text <> '' ORDER BY finding_id LIMIT 20)
""",
)
def x14(spark, sf):
    ok, bad, sample = split_valid(to_findings(_bad_drafts(spark, sf)), samples=20, keep=("check_id",))
    count = lambda df, name: df.groupBy("check_id").count().select(F.lit(name).alias("part"), F.col("check_id").alias("item"), F.col("count").cast("string").alias("value"))
    samples = sample.select(F.lit("sample").alias("part"), F.col("finding_id").alias("item"), F.array_join("errors", ";").alias("value"))
    return count(ok, "valid").unionByName(count(bad, "invalid")).unionByName(samples)


@query(
    "s3_s8_dataset_choice",
    oracle=FW
    + f""",
meta AS (SELECT * FROM ({REGISTRY["r5_retention_missing_sprawl"].oracle}))
SELECT 'raw and correlated' AS dataset, tenant_id, count(*) AS findings FROM (SELECT tenant_id FROM findings_flat UNION ALL SELECT tenant_id FROM meta) GROUP BY ALL
UNION ALL SELECT 'enriched', tenant_id, count(*) FROM findings_flat WHERE status = 'fail' GROUP BY ALL
UNION ALL SELECT 'one run', tenant_id, count(*) FROM findings_flat WHERE tenant_id = 'tenant-1' AND workspace_id = 'prod' AND run_id = 'run-1996' GROUP BY ALL
""",
)
def s3_s8(spark, sf):
    root = new_folder(spark, "datasets")
    f = findings_from_binding(gathered_findings(spark, sf))
    io.write_findings(f, f"{root}/raw", gather=False)
    f = io.read_written(spark, f"{root}/raw", f)
    meta, _ = C.correlate(f, [r for r in C.BUILTIN_RULES if r.rule_id == _SPRAWL])
    io.write_findings(meta, f"{root}/correlated")
    both = io.choose_dataset(spark, f"{root}/enriched", f"{root}/raw", f"{root}/correlated")
    io.write_findings(f.where("status = 'fail'"), f"{root}/enriched", gather=False)
    enriched = io.choose_dataset(spark, f"{root}/enriched", f"{root}/raw", f"{root}/correlated")
    run = io.scan_run(spark, f"{root}/raw", "tenant-1", "prod", "run-1996")
    parts = [("raw and correlated", both), ("enriched", enriched), ("one run", run)]
    counts = [df.groupBy("tenant_id").agg(F.count(F.lit(1)).alias("findings")).select(F.lit(n).alias("dataset"), "tenant_id", "findings") for n, df in parts]
    return reduce(lambda a, b: a.unionByName(b), counts)


@query(
    "f16_arn_parts",
    oracle=FW
    + """, a AS (SELECT finding_id, resource_arn, CASE WHEN line_ref LIKE '%.3' THEN account_id WHEN line_ref LIKE '%.4' THEN 'arn:aws:iam' ELSE resource_arn END AS name FROM findings_flat)
SELECT finding_id, split_part(resource_arn, ':', 4) AS region, split_part(resource_arn, ':', 5) AS account,
       CASE WHEN name LIKE 'arn:%:%:%:%:%' THEN split_part(name, ':', 5) WHEN name NOT LIKE 'arn:%' THEN name END AS named FROM a
""",
)
def f16(spark, sf):
    flat = bound(spark, sf, "findings_flat")
    name = F.when(F.col("line_ref").endswith(".3"), F.col("account_id")).when(F.col("line_ref").endswith(".4"), F.lit("arn:aws:iam")).otherwise(F.col("resource_arn"))
    return flat.select("finding_id", arn_part(F.col("resource_arn"), "region").alias("region"), arn_part(F.col("resource_arn"), "account").alias("account"), account_of(name).alias("named"))


@query(
    "x1_normalize_wire",
    oracle=FW
    + """
SELECT finding_id, CASE WHEN line_ref LIKE '%.1' THEN '' WHEN line_ref LIKE '%.2' THEN strftime(run_ts, '%Y-%m-%dT%H:%M:%SZ') WHEN line_ref LIKE '%.3' THEN 'not parsedZ' WHEN line_ref LIKE '%.4' THEN ''
              WHEN line_ref LIKE '%.5' THEN strftime(run_ts - INTERVAL 2 HOUR, '%Y-%m-%dT%H:%M:%SZ') ELSE strftime(run_ts, '%Y-%m-%dT%H:%M:%S') || '.250000Z' END AS run_ts,
       CASE WHEN line_ref LIKE '%.4' THEN '' ELSE COALESCE(CAST(monthly_savings AS VARCHAR), '') END AS savings, '' AS one_time,
       CASE WHEN line_ref LIKE '%.6' THEN 0 ELSE confidence END AS confidence, '' AS currency, 0 AS matched, CASE WHEN line_ref LIKE '%.2' THEN 'look at it' ELSE 'fix it' END AS advice,
       CASE WHEN line_ref LIKE '%.2' THEN 'look at it' ELSE 'fix it' END AS recommendation, CASE WHEN line_ref LIKE '%.3' THEN 'team=;n=' ELSE 'team=7' END AS tags, region, '' AS organization_id,
       COALESCE(severity_score, 0) AS score, 1 AS schema_version, '' AS remediation
FROM findings_flat
""",
)
def x1(spark, sf):
    flat = bound(spark, sf, "findings_flat")
    is_line = lambda n: F.col("line_ref").endswith(f".{n}")
    text = lambda f, t=F.col("run_ts"): F.date_format(t, f)
    null = F.lit(None).cast("string")
    wire = flat.select(
        "finding_id", "tenant_id", "check_id", "status",
        F.when(is_line(1), null).when(is_line(2), text("yyyy-MM-dd HH:mm:ss")).when(is_line(3), F.lit(" not parsedZ ")).when(is_line(4), F.lit("yesterday"))
        .when(is_line(5), text("yyyy-MM-dd'T'HH:mm:ss'+02:00'")).otherwise(text("yyyy-MM-dd'T'HH:mm:ss'.25'")).alias("run_ts"),
        F.struct(
            F.when(is_line(4), F.lit("a lot")).otherwise(F.col("monthly_savings").cast("string")).alias("monthly_savings"), F.when(is_line(6), F.lit("high")).otherwise(F.col("confidence").cast("string")).alias("confidence")
        ).alias("estimated"),
        F.struct("region", F.lit("x").alias("unknown")).alias("scope"),
        F.struct(F.col("severity_score").cast("double").alias("score")).alias("severity"),
        F.when(is_line(2), null).otherwise("fix it").alias("advice"),
        F.when(is_line(2), F.lit("look at it")).when(is_line(5), F.lit("")).otherwise("fix it").alias("recommendation"),
        F.when(is_line(3), F.create_map(F.lit("team"), F.lit(None).cast("int"), F.lit("n"), F.lit(None).cast("int"))).otherwise(F.create_map(F.lit("team"), F.lit(7))).alias("tags"),
    )
    n = normalize_wire(wire)
    tags = F.array_join(F.transform(F.map_entries("tags"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")
    return n.select(
        "finding_id", "run_ts", F.col("estimated.monthly_savings").alias("savings"), F.col("estimated.one_time_savings").alias("one_time"), F.col("estimated.confidence").alias("confidence"),
        F.col("actual.model.currency").alias("currency"), F.size("actual.attribution.matched_keys").alias("matched"), "advice", "recommendation", tags.alias("tags"), "scope.region", "scope.organization_id",
        F.col("severity.score").alias("score"), F.col("source.schema_version").alias("schema_version"), "remediation",
    )


@query(
    "x2_cast_for_storage",
    oracle=FW
    + """
SELECT finding_id,
       CASE WHEN line_ref LIKE '%.3' THEN NULL ELSE CAST(run_ts AS TIMESTAMP) END AS run_ts,
       CASE WHEN line_ref LIKE '%.5' THEN NULL ELSE confidence END AS priority,
       CASE WHEN monthly_savings IS NULL THEN NULL ELSE monthly_savings END AS est_savings,
       (line_ref LIKE '%.5' OR monthly_savings IS NULL) AS rejected,
       concat_ws(';', CASE WHEN line_ref LIKE '%.5' THEN 'priority' END,
                      CASE WHEN monthly_savings IS NULL THEN 'estimated.monthly_savings' END) AS reject_paths
FROM findings_flat
""",
)
def x2(spark, sf):
    flat = bound(spark, sf, "findings_flat")
    wire = flat.select(
        "finding_id",
        F.when(F.col("line_ref").endswith(".3"), F.lit("")).otherwise(F.date_format("run_ts", "yyyy-MM-dd HH:mm:ss")).alias("run_ts"),
        F.when(F.col("line_ref").endswith(".5"), F.lit("high")).otherwise(F.col("confidence").cast("string")).alias("priority"),
        F.struct(F.coalesce(F.col("monthly_savings").cast("string"), F.lit("n/a")).alias("monthly_savings")).alias("estimated"),
        F.lit("ignored").alias("unknown_field"),
    )
    ok, rejects = cast_for_storage(wire)
    okp = ok.select("finding_id", "run_ts", "priority", F.col("estimated.monthly_savings").alias("est_savings"), F.lit(False).alias("rejected"), F.lit("").alias("reject_paths"))
    bad = rejects.select(
        "finding_id",
        "run_ts",
        "priority",
        F.col("estimated.monthly_savings").alias("est_savings"),
        F.lit(True).alias("rejected"),
        F.array_join("reject_paths", ";").alias("reject_paths"),
    )
    return okp.unionByName(bad)


@query(
    "s6_partitioned_write_scan",
    oracle=FW
    + "SELECT CAST(CAST(run_ts AS DATE) AS VARCHAR) AS run_date, count(*) AS findings FROM findings_flat WHERE tenant_id = 'tenant-1' GROUP BY 1",
)
def s6(spark, sf):
    root = new_folder(spark, "findings-store")
    # dealt while narrow: no wide finding moves
    io.write_findings(findings_from_binding(gathered_findings(spark, sf)), root, gather=False)
    scanned = io.scan_run(spark, root, "tenant-1")
    return scanned.groupBy(F.col("run_date").cast("string").alias("run_date")).agg(F.count(F.lit(1)).alias("findings"))


@query(
    "s9_export_json_summary",
    oracle=FW
    + """
SELECT tenant_id, status, severity_level, count(*) AS cnt FROM findings_flat GROUP BY ALL
""",
)
def s9(spark, sf):
    out = new_folder(spark, "export")
    summ = read.findings_summary(findings(spark, sf)).where(F.col("dimension") == "matrix").drop("dimension")
    paths = io.export_json({"summary": summ}, out)
    back = spark.read.schema("tenant_id string, status string, severity_level string, cnt long").json(paths["summary"])
    return back


@query(
    "s9_export_artifacts",
    oracle=FW
    + f""",
meta AS (SELECT * FROM ({REGISTRY["r5_retention_missing_sprawl"].oracle})),
f AS (SELECT tenant_id, check_id, status, severity_level FROM findings_flat UNION ALL SELECT tenant_id, check_id, status, severity_level FROM meta),
top AS (SELECT tenant_id, finding_id, row_number() OVER (PARTITION BY tenant_id ORDER BY COALESCE(monthly_savings, CAST(0 AS DECIMAL(18,6))) DESC, finding_id) AS k,
               COALESCE(monthly_savings, CAST(0 AS DECIMAL(18,6))) AS savings FROM findings_flat WHERE status = 'fail')
SELECT 'findings' AS artifact, tenant_id, check_id AS item, CAST(count(*) AS VARCHAR) AS value FROM f GROUP BY ALL
UNION ALL SELECT 'summary', tenant_id, status || '|' || severity_level, CAST(count(*) AS VARCHAR) FROM f GROUP BY ALL
UNION ALL SELECT 'top_savings', tenant_id, finding_id, CAST(k AS VARCHAR) || '|' || CAST(savings AS VARCHAR) FROM top WHERE k <= 50
UNION ALL SELECT 'coverage', tenant_id, 'total|with', CAST(count(*) AS VARCHAR) || '|0' FROM f GROUP BY ALL
UNION ALL SELECT 'correlated', tenant_id, fingerprint, CAST(count(*) AS VARCHAR) FROM meta GROUP BY ALL
""",
)
def s9_artifacts(spark, sf):
    out = new_folder(spark, "export")
    f = findings(spark, sf)
    meta, _ = C.correlate(f, [r for r in C.BUILTIN_RULES if r.rule_id == _SPRAWL])
    paths = io.export_json(read.run_artifacts(io.union_findings([f, meta])), out)
    back = {name: spark.read.json(path) for name, path in paths.items()}  # the types a consumer would see
    count = F.count(F.lit(1)).cast("string").alias("value")
    rows = {
        "findings": back["findings"].groupBy("tenant_id", F.col("check_id").alias("item")).agg(count),
        "summary": back["summary"].select("tenant_id", F.concat_ws("|", "status", "severity_level").alias("item"), F.col("cnt").cast("string").alias("value")),
        "top_savings": back["top_savings"].select("tenant_id", F.col("finding_id").alias("item"), F.concat_ws("|", "rank", "est_monthly_savings").alias("value")),
        "coverage": back["coverage"].select("tenant_id", F.lit("total|with").alias("item"), F.concat_ws("|", "total", "with_actual_cost").alias("value")),
        "correlated": back["correlated"].groupBy("tenant_id", F.col("fingerprint").alias("item")).agg(count),
    }
    parts = [df.select(F.lit(name).alias("artifact"), "tenant_id", "item", "value") for name, df in rows.items()]
    return reduce(lambda a, b: a.unionByName(b), parts)


# every rung of the ladder: the pair itself, any key of the region, the key anywhere, any key
# anywhere, prices that ended or are yet to come, one that is not positive, and none at all
_RUNGS = [
    ("m0", 0, 1.0, None), ("m0", 0, 1.5, "1995-01-01"), ("m0", 0, 9.0, "2030-01-01"), ("m1", 1, 2.0, None), ("m1", 1, 0.0, "1996-01-01"),
    ("m1", None, 3.0, None), ("m2", None, 4.0, "2030-01-01"), (None, 1, 5.0, None), (None, None, 6.0, None),
]


@query(
    "j16_price_ladder",
    oracle="""
WITH p AS (SELECT * FROM (VALUES """
    + ", ".join("({}, {}, CAST({} AS DOUBLE), {})".format(f"'{m}'" if m else "'global'", f"'k{k}'" if k is not None else "'default'", v, f"TIMESTAMP '{d}'" if d else "NULL") for m, k, v, d in _RUNGS)
    + """) t(region, key, price, since) WHERE price > 0 AND (since IS NULL OR since <= TIMESTAMP '2000-01-01')),
cur AS (SELECT region, key, price FROM p QUALIFY row_number() OVER (PARTITION BY region, key ORDER BY since DESC NULLS LAST, price DESC) = 1),
l AS (SELECT l_orderkey, l_linenumber, 'm' || CAST(l_partkey % 4 AS VARCHAR) AS region, 'k' || CAST(l_suppkey % 3 AS VARCHAR) AS key, l_returnflag FROM lineitem)
SELECT l_orderkey, l_linenumber, COALESCE(a.price, b.price, c.price, CASE WHEN l_returnflag <> 'A' THEN d.price END, CASE l.key WHEN 'k0' THEN 0.5::DOUBLE END) AS usd,
       CASE WHEN a.price IS NOT NULL THEN 90 WHEN b.price IS NOT NULL THEN 75 WHEN c.price IS NOT NULL THEN 60 WHEN l_returnflag <> 'A' THEN 50 WHEN l.key = 'k0' THEN 30 ELSE 0 END AS usd_confidence
FROM l LEFT JOIN cur a ON a.region = l.region AND a.key = l.key LEFT JOIN cur b ON b.region = l.region AND b.key = 'default'
LEFT JOIN cur c ON c.region = 'global' AND c.key = l.key LEFT JOIN cur d ON d.region = 'global' AND d.key = 'default'
""",
)
def j16(spark, sf):
    rows = [(m or "global", "x", f"k{k}" if k is not None else "default", v, d) for m, k, v, d in _RUNGS]
    prices = spark.createDataFrame(rows, "region string, kind string, key string, unit_price double, effective_from string")
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.concat(F.lit("m"), (F.col("l_partkey") % 4).cast("string")).alias("place"), F.concat(F.lit("k"), (F.col("l_suppkey") % 3).cast("string")).alias("key"), (F.col("l_returnflag") == "A").alias("short"))
    climb = lambda df, rungs: price_ladder(df, prices, kind="x", region=F.col("place"), key=F.col("key"), as_of="2000-01-01", rungs=rungs, fallback={"k0": 0.5}, name="usd")
    out = climb(lines.where("NOT short"), LADDER).unionByName(climb(lines.where("short"), LADDER[:3]))
    return out.select("l_orderkey", "l_linenumber", "usd", "usd_confidence")


@query(
    "s7_cost_facts_written",
    oracle=binding_cte("cost_facts")
    + "SELECT tenant_id, strftime(usage_start, '%Y-%m') AS billing_period, account_id, count(*) AS n, CAST(sum(cost_unblended) AS DECIMAL(38,6)) AS cost, true AS bounded FROM cost_facts GROUP BY ALL",
)
def s7(spark, sf):
    root = new_folder(spark, "cost-store")
    io.write_cost_facts(bound(spark, sf, "cost_facts"), root, rows_per_file=1_000)
    stored = spark.read.parquet(root).withColumn("file", F.col("_metadata.file_path"))
    keys = ["tenant_id", "billing_period", "account_id"]
    sized = stored.groupBy(*keys, "file").agg(F.count(F.lit(1)).alias("n"), F.sum("cost_unblended").alias("cost"))
    return sized.groupBy(*[F.col(k).cast("string").alias(k) for k in keys]).agg(
        F.sum("n").alias("n"), F.sum("cost").cast("decimal(38,6)").alias("cost"), (F.max("n") <= 1_000).alias("bounded")
    )


# Price-list items built from the part table: two price dimensions per item,
# every tenth item truncated (invalid JSON); the wanted unit alternates.
PRICE_JSON_SQL = """
SELECT p.p_partkey AS p_partkey,
       CASE WHEN p.p_partkey % 2 = 0 THEN 'GB-Mo' ELSE 'Hrs' END AS want_unit,
       CASE WHEN p.p_partkey % 10 = 0 THEN '{"product":{"sku":"SKU' || CAST(p.p_partkey AS STRING) || '"'
            ELSE '{"product":{"sku":"SKU' || CAST(p.p_partkey AS STRING) || '","attributes":{"regionCode":"r'
                 || CAST(p.p_partkey % 5 AS STRING) || '"}},"terms":{"OnDemand":{"T1":{"priceDimensions":{"D1":{"unit":"'
                 || CASE WHEN p.p_partkey % 3 = 0 THEN 'GB-Mo' ELSE 'Hrs' END || '","pricePerUnit":{"USD":"'
                 || CAST(CAST(p.p_retailprice AS DECIMAL(18,2)) AS STRING) || '"}},"D2":{"unit":"GB-Mo","pricePerUnit":{"USD":"'
                 || CAST(CAST(p.p_retailprice / 100 AS DECIMAL(18,4)) AS STRING) || '"}}}}}}}' END AS json
FROM {part} p
"""


@query(
    "s10_price_list_parse",
    oracle="WITH pl AS (" + PRICE_JSON_SQL.replace("{part}", "part") + """)
SELECT p_partkey, sku, unit, unit_price_usd, 'pricing_api' AS source FROM (
  SELECT p_partkey, want_unit AS unit, json_extract_string(json, '$.product.sku') AS sku,
         CASE WHEN json_extract_string(json, '$.terms.OnDemand.T1.priceDimensions.D1.unit') = want_unit
              THEN CAST(json_extract_string(json, '$.terms.OnDemand.T1.priceDimensions.D1.pricePerUnit.USD') AS DOUBLE)
              WHEN json_extract_string(json, '$.terms.OnDemand.T1.priceDimensions.D2.unit') = want_unit
              THEN CAST(json_extract_string(json, '$.terms.OnDemand.T1.priceDimensions.D2.pricePerUnit.USD') AS DOUBLE) END AS unit_price_usd
  FROM pl WHERE json_valid(json))
WHERE unit_price_usd IS NOT NULL
""",
)
def s10(spark, sf):
    text = PRICE_JSON_SQL.replace("{", "{{").replace("}", "}}").replace("{{part}}", "{part}")
    raw = spark.sql(text, part=table(spark, sf, "part"))
    out = prices_from_price_list(raw, F.col("want_unit"), keep=("p_partkey",))
    return out.select("p_partkey", "sku", "unit", "unit_price_usd", "source")
