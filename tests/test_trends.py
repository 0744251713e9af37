"""Cost trend detectors on monthly fixtures."""

import datetime as dt
from decimal import Decimal

from spendlens.operators import trends as T


def monthly(spark, costs, service="AmazonEC2"):
    rows = [("t", "w", "1", service, dt.date(2024, 1 + i, 1), Decimal(str(c))) for i, c in enumerate(costs)]
    return spark.createDataFrame(rows, "tenant_id string, workspace string, account_id string, service string, period_start date, unblended_cost decimal(18,6)")


def checks(df):
    return sorted((r.check_id, r.method) for r in df.collect())


def test_threshold_spike_drop_and_below(spark):
    assert checks(T.cost_anomalies(monthly(spark, [100, 150]), detectors=("threshold",))) == [("aws.cost.anomaly.spike", "threshold")]
    assert checks(T.cost_anomalies(monthly(spark, [150, 100]), detectors=("threshold",))) == [("aws.cost.anomaly.drop", "threshold")]
    assert checks(T.cost_anomalies(monthly(spark, [100, 140]), detectors=("threshold",))) == []  # delta below 50


def test_zscore_prior_months(spark):
    got = T.cost_anomalies(monthly(spark, [80, 100, 120, 300]), detectors=("moving",)).collect()
    assert [(r.check_id, r.method) for r in got] == [("aws.cost.anomaly.spike", "zscore")]
    # K4 flag reproduces the window that includes the judged month (z <= sqrt(2): never fires)
    k4 = T.TrendParams(zscore_include_current=True)
    assert T.cost_anomalies(monthly(spark, [80, 100, 120, 300]), k4, detectors=("moving",)).count() == 0


def test_discovery(spark):
    assert checks(T.cost_anomalies(monthly(spark, [10, 30]), detectors=("discovery",))) == [("aws.cost.service.new", "discovery")]
    assert checks(T.cost_anomalies(monthly(spark, [30, 10]), detectors=("discovery",))) == [("aws.cost.service.absent", "discovery")]
