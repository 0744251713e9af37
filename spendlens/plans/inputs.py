"""Engine inputs derived from the driver's tables (Spark side of the binding)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.contract import findings_from_binding
from ..sources.bind import bound


def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings_from_binding(bound(spark, sf_dir, "findings_flat"))


def cost_facts_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bound(spark, sf_dir, "cost_facts")


def metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bound(spark, sf_dir, "metrics")


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bound(spark, sf_dir, "runs")


def state_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bound(spark, sf_dir, "state_events")


def actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bound(spark, sf_dir, "actions")
