import numpy as np
import pytest
from pyspark.sql import functions as F

from tarn.functions.vectors import numeric_vector
from tarn.operators import outliers


@pytest.fixture(scope="module")
def planted(spark):
    rng = np.random.default_rng(3)
    points = rng.standard_normal((3000, 4))
    points[:5] += 12
    data = [(i, f"2025-05-{1 + i % 28:02d}", [float(x) for x in p]) for i, p in enumerate(points)]
    return spark.createDataFrame(data, "id long, day string, features array<double>").repartition(6).cache()


def test_planted_rows_are_flagged(planted):
    got = outliers.isolation_forest(planted, "features", ["id"])
    flagged = {r.id for r in got.where("is_anomaly").collect()}
    assert {0, 1, 2, 3, 4} <= flagged
    assert 120 <= len(flagged) <= 150
    top = [r.id for r in got.orderBy(F.col("score").desc()).limit(5).collect()]
    assert set(top) == {0, 1, 2, 3, 4}


def test_same_seed_same_scores(planted):
    def scores(df, seed):
        return {r.id: r.score for r in outliers.isolation_forest(df, "features", ["id"], seed=seed).collect()}

    first = scores(planted, 42)
    assert first == scores(planted.repartition(3), 42)
    assert first != scores(planted, 43)


def test_trees_get_full_samples(planted):
    forest = outliers.fit_forest(planted, "features", ["id"], trees=20)
    assert len(forest.trees) == 20 and forest.sample == 256
    # 2 x 256 - 1 nodes at most; the depth limit cuts most trees earlier.
    assert all(20 < len(t["left"]) <= 511 for t in forest.trees)


def test_newest_rows_only(planted):
    got = outliers.isolation_forest(planted, "features", ["id"], newest=("day", 500))
    assert got.count() == 500 and got.agg(F.min("day")).first()[0] >= "2025-05-23"


def test_tiny_and_constant_tables(spark):
    few = spark.createDataFrame([(i, float(i)) for i in range(3)], "id long, x double")
    few = few.select("id", numeric_vector(F.col("x")).alias("features"))
    assert outliers.isolation_forest(few, "features", ["id"]).count() == 3
    flat = spark.range(1000).select("id", F.array(F.lit(1.0)).alias("features"))
    assert outliers.isolation_forest(flat, "features", ["id"]).where("is_anomaly").count() == 0


def test_copies_of_one_key(spark):
    """A third of the rows share one key; every task still hands on a bounded sample."""
    df = spark.range(9000).select(
        F.when(F.col("id") < 3000, 0).otherwise(F.col("id")).alias("id"),
        F.array(F.rand(1), F.rand(2)).alias("features"),
    )
    got = outliers.isolation_forest(df, "features", ["id"], trees=10)
    assert got.count() == 9000


def test_mean_path():
    assert outliers.mean_path(1) == 0.0 and outliers.mean_path(2) == 1.0
    assert outliers.mean_path(256) == pytest.approx(10.2448, abs=1e-3)
