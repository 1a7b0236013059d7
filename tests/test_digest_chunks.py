import pytest
from pyspark.sql import functions as F

from tarn.operators.generation import folded
from tarn.sources.lake import Lake


class Echo:
    """A model that answers with the size of its prompt and what it was asked about."""

    batch = 4

    def generate(self, prompts):
        return [f"{len(p)}:{p[-60:]}" for p in prompts]


def prompts(df, order, chunk):
    return folded(df, "k", "t", order, (F.lit(""), F.lit(": ")), Echo(), chunk)


def test_equal_texts_are_one_line_with_their_number(spark):
    df = spark.range(60_000, numPartitions=6).select(F.lit("a").alias("k"), F.lit("the same reading again").alias("t"))
    (r,) = prompts(df, ["t"], 32 << 10).collect()
    assert r.summary == "39:a: the same reading again (60000 times)"
    (r,) = folded(df, "k", "t", ["t"], (F.lit(""), F.lit(""))).collect()
    assert r.summary == "- the same reading again (60000 rows)\n60000 rows"


def test_no_prompt_is_larger_than_a_chunk_and_a_little(spark):
    rows = [("a", "x" * 100_000), ("a", "é" * 50_000), *[("a", f"line {i}") for i in range(500)], ("b", None), ("b", "")]
    df = spark.createDataFrame(rows, "k string, t string")
    seen = spark.sparkContext.accumulator(0)

    class Measuring:
        batch = 2

        def generate(self, prompts):
            big = max(len(p.encode()) for p in prompts)
            if big > 6000:
                seen.add(1)
            return ["ok"] * len(prompts)

    got = folded(df, "k", "t", ["t"], (F.lit(""), F.lit(": ")), Measuring(), 2000)
    assert {r.k: r.summary for r in got.collect()} == {"a": "ok", "b": "ok"} and seen.value == 0
    offline = {r.k: r.summary.split("\n")[-1] for r in folded(df, "k", "t", ["t"], (F.lit(""), F.lit("")), None, 2000).collect()}
    assert offline == {"a": "502 rows", "b": "1 rows"}


def test_a_name_defined_by_with_opens_no_other_table(spark, tmp_path):
    spark.range(3).createOrReplaceTempView("secret")
    lake = Lake(spark, str(tmp_path))
    with pytest.raises(PermissionError):
        lake.sql("WITH secret AS (SELECT * FROM secret) SELECT * FROM secret", names=[])
    with pytest.raises(PermissionError):
        lake.sql("SELECT * FROM (WITH secret AS (SELECT 1 AS x) SELECT * FROM secret) JOIN secret", names=[])
    assert lake.sql("WITH mine AS (SELECT 1 AS x) SELECT * FROM mine", names=[]).count() == 1
    spark.catalog.dropTempView("secret")
