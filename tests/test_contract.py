"""Contract: nested casts with rejects (X2), lifecycle coherence (X13), kept currencies."""

import datetime as dt
from decimal import Decimal

from pyspark.sql import functions as F
from pyspark.sql import types as T

from spendlens.operators.contract import cast_for_storage, to_findings, validate
from spendlens.operators.cost import attribute_costs

WIRE = T.StructType(
    [
        T.StructField("finding_id", T.StringType()),
        T.StructField("metrics", T.MapType(T.StringType(), T.StringType())),
        T.StructField("actual", T.StructType([T.StructField("model", T.StructType([T.StructField("currency", T.StringType())])), T.StructField("cost_7d", T.StringType())])),
        T.StructField("frameworks", T.ArrayType(T.StringType())),
        T.StructField("unknown", T.StringType()),
    ]
)


def test_nested_leaves_cast_or_reject(spark):
    rows = [
        ("good", {"p95": "1.5"}, (("EUR",), "3.25"), ["a"], "x"),
        ("bad-map", {"p95": "n/a", "ok": "2"}, None, None, None),
        ("bad-struct", None, (("EUR",), "lots"), [], None),
        ("nulls", {"p95": None, "e": ""}, (None, None), None, None),
    ]
    ok, rejects = cast_for_storage(spark.createDataFrame(rows, WIRE))
    got = {r.finding_id: r for r in ok.collect()}
    assert set(got) == {"good", "nulls"}
    assert got["good"].metrics == {"p95": Decimal("1.500000")} and got["good"].actual.model.currency == "EUR"
    assert got["good"].actual.cost_7d == Decimal("3.250000") and got["good"].actual.attribution is None
    assert got["nulls"].metrics == {"p95": None, "e": None} and got["nulls"].actual.model is None
    assert {r.finding_id: r.reject_paths for r in rejects.collect()} == {"bad-map": ["metrics"], "bad-struct": ["actual.cost_7d"]}


def _drafts(spark, **extra):
    df = spark.createDataFrame(
        [("t", "w", "r1", dt.datetime(2024, 1, 10), "aws.x.y", "fail", "low", 1, "title", "111", "r-1", "eu-west-1", "ec2")],
        "tenant_id string, workspace_id string, run_id string, run_ts timestamp, check_id string, status string, severity_level string, severity_score int, title string, account_id string, resource_id string, region string, service string",
    )
    return to_findings(df.withColumns(extra))


def test_open_lifecycle_needs_a_problem_status(spark):
    base = _drafts(spark)

    def errors(status, state):
        life = F.col("lifecycle").withField("status", F.lit(state))
        return [e for e in validate(base.withColumn("status", F.lit(status)).withColumn("lifecycle", life)).first().errors if e.startswith("coherence:lifecycle")]

    assert not errors("fail", "open") and not errors("warn", "open") and not errors("unknown", "acknowledged") and not errors("pass", "resolved")
    assert errors("pass", "open") and errors("info", "acknowledged")


def test_existing_currency_is_kept(spark):
    f = _drafts(spark)
    f = f.withColumn("actual", F.col("actual").withField("model", F.col("actual.model").withField("currency", F.lit("EUR"))))
    facts = spark.createDataFrame(
        [("t", "111", "r-1", "eu-west-1", "ec2", dt.datetime(2024, 1, 8), Decimal("5"), "USD"), ("t", "111", "r-1", None, "EC2", dt.datetime(2023, 12, 31), Decimal("7"), "USD")],
        "tenant_id string, account_id string, resource_id string, region string, service string, usage_start timestamp, cost_unblended decimal(18,6), currency string",
    ).withColumns({"billing_period_start": F.lit(None).cast("timestamp"), "cost_net": F.lit(None).cast("decimal(18,6)"), "cost_amortized": F.lit(None).cast("decimal(18,6)")})
    a = attribute_costs(f, facts, cost_model="unblended").first().actual
    assert a.model.currency == "EUR" and a.attribution.method == "exact_resource_id"
    # month edges: the 31st counts to the previous month and the last 30 days, not to the 7 days
    assert (a.cost_7d, a.cost_30d, a.cost_mtd, a.cost_prev_month) == (Decimal(5), Decimal(12), Decimal(5), Decimal(7))
