"""Run diff: only the rows of the two runs move, and one window tells them apart."""

import datetime as dt

from spendlens.operators import history as H
from spendlens.operators.contract import to_findings

COLUMNS = "tenant_id string, workspace_id string, run_id string, run_ts timestamp, check_id string, status string, severity_level string, severity_score int, title string, account_id string, region string, service string, resource_id string, resource_arn string, finding_id string, fingerprint string"
RUNS = "tenant_id string, workspace_id string, run_id string, run_ts timestamp, status string"


def finding(i, tenant, day, fp):
    return (tenant, "prod", f"run-{day}", dt.datetime(2024, 1, day), "aws.ec2.x", "fail", "high", 1, "Volume 7", "1", "eu", "EC2", f"r-{fp}", "", f"f{i}", fp)


def run(tenant, day, status="ready"):
    return (tenant, "prod", f"run-{day}", dt.datetime(2024, 1, day), status)


def test_diff_of_the_last_two_runs(spark):
    rows = [("t", 1, "old"), ("t", 2, "both"), ("t", 2, "gone"), ("t", 2, "gone"), ("t", 3, "both"), ("t", 3, "new"), ("t", 2, None), ("t", 3, None), ("t", 4, "failed"), ("one", 3, "x")]
    f = to_findings(spark.createDataFrame([finding(i, *r) for i, r in enumerate(rows)], COLUMNS))
    runs = spark.createDataFrame([run("t", 1), run("t", 2), run("t", 3), run("t", 4, "failed"), run("one", 3)], RUNS)
    want = [("new", None, "f7"), ("new", "new", "f5"), ("resolved", None, "f6"), ("resolved", "gone", "f2")]
    for of in (runs, H.latest_ready_runs(runs, 2)):
        diff = H.run_diff(H.ingest_run(f, of)[0], runs)
        assert sorted(((r.change, r.fingerprint, r.finding_id) for r in diff.collect()), key=str) == sorted(want, key=str)
        assert diff.columns[:4] == ["tenant_id", "workspace", "fingerprint", "run_id"] and diff.columns[-1] == "change"
    text = diff._jdf.queryExecution().optimizedPlan().toString()
    # the presence is read once
    assert "LeftAnti" not in text and text.count("AS _rn#") == 1


def test_other_runs_are_left_out_before_rows_move(spark):
    f = to_findings(spark.createDataFrame([finding(0, "t", 1, "a"), finding(1, "t", 2, "a")], COLUMNS))
    presence, _ = H.ingest_run(f, spark.createDataFrame([run("t", 2)], RUNS))
    text = presence._jdf.queryExecution().optimizedPlan().toString()
    assert text.index("Window") < text.index("LeftSemi")  # printed from the top: the join lies below
    assert "sha1" not in text[text.index("Window"):]  # and the group key is made of the rows kept
    assert [(r.finding_id, r.run_id, r.detected_at == r.run_ts) for r in presence.collect()] == [("f1", "run-2", True)]
    assert presence.columns == H.presence_rows(f).columns == H.read_model_fields(f).columns
