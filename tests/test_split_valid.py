"""Findings are judged once for the valid rows, the invalid ones and the sample."""

import datetime as dt

from spendlens.operators import contract
from spendlens.operators.contract import split_valid, to_findings, validate

COLUMNS = "tenant_id string, workspace_id string, run_id string, run_ts timestamp, check_id string, status string, severity_level string, severity_score int, title string, account_id string, cloud string, region string, service string, resource_id string, finding_id string, fingerprint string"


def rows(spark):
    day = dt.datetime(2024, 1, 1)
    bad = {2: ("bogus", 1, "1"), 4: ("fail", 1200, ""), 5: (None, -1, "1")}
    made = [("t", "w", "r", day if i != 7 else None, "c", *bad.get(i, ("fail", 1, "1"))[:1], "high", bad.get(i, (0, 1))[1], "x", bad.get(i, (0, 0, "1"))[2], "aws", "eu", "EC2", "r", f"f{i}", "fp") for i in range(9)]
    return to_findings(spark.createDataFrame(made, COLUMNS))


def test_validated_rows_are_stored_once(spark, monkeypatch):
    f, kept = rows(spark), []
    store = contract.materialize
    monkeypatch.setattr(contract, "materialize", lambda df, name: kept.append(df.columns) or store(df, name))
    plain, stored = split_valid(f, samples=3), split_valid(f, samples=3, keep=("check_id",))
    assert kept == [["check_id", "finding_id", "errors", "is_valid"]]
    ids = lambda df: sorted(r.finding_id for r in df.collect())
    assert [ids(x) for x in plain] == [ids(x) for x in stored] == [["f0", "f1", "f3", "f6", "f8"], ["f2", "f4", "f5", "f7"], ["f2", "f4", "f5"]]
    for df in stored:
        assert "severity" not in df._jdf.queryExecution().optimizedPlan().toString()


def test_errors_are_compiled_and_in_order(spark):
    v = validate(rows(spark))
    errors = {r.finding_id: r.errors for r in v.collect()}
    assert errors["f2"] == ["enum:status=bogus"] and errors["f0"] == []
    assert errors["f4"] == ["missing:scope.account_id", "range:severity.score"]
    assert errors["f5"] == ["missing:status", "range:severity.score"] and errors["f7"] == ["missing:run_ts", "type:run_ts"]
    # no check is interpreted inside a filter over the list
    assert "filter(array(" not in v._jdf.queryExecution().optimizedPlan().toString()
