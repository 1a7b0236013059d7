import math

import pytest
from pyspark.sql import functions as F

from tarn.functions import money


def summed(spark, *amounts):
    df = spark.createDataFrame([(a,) for a in amounts], "x double")
    return df.agg(money.exact_sum(F.col("x")).alias("s")).first().s


def test_exact_sum(spark):
    assert summed(spark, 0.5, 0.25, 0.125) == 0.875
    assert summed(spark, -1.005, 2.5, None) == pytest.approx(1.495, abs=1e-12)
    assert summed(spark, None) is None
    assert summed(spark, -123456789.0199, 123456789.02) == pytest.approx(0.0001, abs=1e-7)
    assert summed(spark, -0.25, -0.5) == -0.75


def test_sum_beyond_double_precision(spark):
    df = spark.range(1000).select(F.lit(90_000_000_000.01).alias("x"))
    got = df.agg(money.total(F.col("x")).alias("s")).first().s
    assert got == 90000000000010.0


def test_rows_are_not_rounded(spark):
    small = spark.range(10_000).select(F.lit(0.000049).alias("x"))
    assert small.agg(money.total(F.col("x"))).first()[0] == 0.49
    assert small.agg(money.exact_sum(F.col("x"))).first()[0] == pytest.approx(0.49, abs=1e-12)


def test_decimals_are_summed_as_decimals(spark):
    df = spark.range(3).select(F.lit("0.1000000001").cast("decimal(20,10)").alias("x"))
    assert df.agg(money.exact_sum(F.col("x"))).first()[0] == 0.3000000003


def test_large_and_odd_amounts_do_not_fail(spark):
    assert summed(spark, 1e15, 0.5) == 1e15 + 0.5
    assert summed(spark, 1e18, 2e18) == 3e18
    assert summed(spark, 1e300, 1.0) == 1e300
    assert summed(spark, float("inf"), 1.0) == float("inf")
    assert math.isnan(summed(spark, float("nan"), 1.0))


def test_partitioning_changes_nothing(spark):
    df = spark.range(50_000).select((F.rand(7) * 1e6).alias("x")).cache()
    results = {df.repartition(n).agg(money.exact_sum(F.col("x"))).first()[0] for n in (1, 3, 16)}
    assert len(results) == 1


def test_report_aggregates(spark):
    df = spark.createDataFrame([(1.0, True), (2.5, False), (None, True)], "x double, ok boolean")
    x, ok = F.col("x"), F.col("ok")
    got = df.agg(money.total(x), money.total(x, ~ok), money.mean(x), money.count_where(ok)).first()
    assert tuple(got) == (3.5, 2.5, 1.75, 2)
    none = df.limit(0).agg(money.total(x), money.mean(x), money.count_where(ok)).first()
    assert tuple(none) == (None, None, 0)
