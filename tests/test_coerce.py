"""X4 confidence, X5 money, P18 messy numbers."""

from decimal import Decimal

from pyspark.sql import functions as F

from spendlens.functions.coerce import confidence_0_100, messy_number, money_or_zero


def test_confidence(spark):
    vals = ["low", "M", "HIGH", "72.5", "73.5", "150", "-3", "n/a", None, "h"]
    df = spark.createDataFrame([(v,) for v in vals], "v string")
    got = [r.c for r in df.select(confidence_0_100(F.col("v")).alias("c")).collect()]
    assert got == [30, 60, 85, 72, 74, 100, 0, 0, 0, 85]  # half-even rounding like Python round()


def test_money_or_zero(spark):
    df = spark.createDataFrame([("12.5",), ("abc",), (None,)], "v string")
    got = [r.m for r in df.select(money_or_zero(F.col("v")).alias("m")).collect()]
    assert got == [Decimal("12.500000"), Decimal("0E-6"), Decimal("0E-6")]


def test_messy_number(spark):
    vals = ["$1,234.50", "12,5", "1.234,50", "€ 99", "", "abc", "1,234,567"]
    df = spark.createDataFrame([(v,) for v in vals], "v string")
    got = [r.n for r in df.select(messy_number(F.col("v")).alias("n")).collect()]
    assert got == [1234.5, 12.5, 1.2345, 99.0, None, None, None]
