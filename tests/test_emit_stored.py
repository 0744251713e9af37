"""Detector drafts are stored detector by detector, and a stored step leaves no shuffle files behind."""

import time

from conftest import SF001

from spendlens.operators.emit import drafts_to_findings
from spendlens.plans import q_emit as Q
from spendlens.session import materialize, materialize_union


def plan_of(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_detections_are_planned_detector_by_detector(spark, monkeypatch):
    monkeypatch.setattr(Q, "DETECTORS", ["d18_d20_ebs_volumes", "d62_d63_logs_and_custom_metrics"])
    found = Q.scan(spark, SF001)
    # one scan of stored drafts: neither the detectors' tables nor a projection a detector
    assert "p_partkey" not in plan_of(found) and plan_of(found).count("Relation") == 1
    drafts = [Q.REGISTRY[n].fn(spark, SF001) for n in Q.DETECTORS]
    plain = drafts_to_findings(drafts[0].unionByName(drafts[1]), Q.RUN_ID, Q.F.lit(Q.RUN_TS))
    key = lambda df: sorted((r.check_id, r.fingerprint, r.finding_id, str(r.estimated), str(r.dimensions)) for r in df.collect())
    assert found.columns == plain.columns and key(found) == key(plain) != []


def test_correlation_reads_stored_signals(spark, monkeypatch):
    monkeypatch.setattr(Q, "DETECTORS", ["d18_d20_ebs_volumes", "d62_d63_logs_and_custom_metrics"])
    kept = []
    monkeypatch.setattr(Q, "materialize", lambda df, name: kept.append(name) or materialize(df, name))
    out = Q.x15_r(spark, SF001)
    assert kept == ["signals"] and "detail" not in plan_of(out) and out.count() > 0


def test_union_is_stored_in_one_schema(spark):
    a = spark.sql("SELECT 1 AS n, CAST(NULL AS STRING) AS t, CAST(1.5 AS DECIMAL(5,2)) AS v")
    b = spark.sql("SELECT 'x' AS t, CAST(2 AS BIGINT) AS n, CAST(2.25 AS DECIMAL(12,4)) AS v")
    both = materialize_union({"a": a, "b": b, "none": b.where("n > 5")}, "both")
    plain = a.unionByName(b)
    assert [(f.name, f.dataType) for f in both.schema] == [(f.name, f.dataType) for f in plain.schema]
    assert sorted(map(str, both.collect())) == sorted(map(str, plain.collect()))


def test_a_stored_step_frees_its_shuffle(spark):
    files = lambda: spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n")
    dealt = lambda: {x for x in files().split("\n") if "/shuffle_" in x and x.endswith(".data")}
    before = dealt()
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    was = spark.conf.get(key)
    out = materialize(spark.range(1000).selectExpr("id % 7 AS k", "id").groupBy("k").count(), "freed")
    until = time.time() + 10
    while dealt() - before and time.time() < until:
        time.sleep(0.1)
    assert not dealt() - before and spark.conf.get(key) == was
    assert out.count() == 7
