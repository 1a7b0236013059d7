import pytest
from pyspark.sql import functions as F

from tarn.llm import mixing
from tests import compare


def targets(spark, sizes, weights=(1, 2, 3)):
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    return {r.source: r.target for r in mixing.source_targets(df, weights).collect()}


def plain(sizes, weights=(1, 2, 3), most=3):
    """Share, stop, share the excess again, until none is above its limit."""
    names = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    stopped, total = set(), sum(sizes.values())
    while True:
        left = total - sum(most * sizes[s] for s in stopped)
        free = sum(w for s, w in weight.items() if s not in stopped)
        share = {s: most * sizes[s] if s in stopped else w * left / free for s, w in weight.items()}
        above = {s for s in names if s not in stopped and share[s] > most * sizes[s]}
        if not above:
            return share
        stopped |= above


@pytest.mark.parametrize(
    "sizes",
    [
        {"a": 10, "b": 10, "c": 10},
        {"a": 1, "b": 5, "c": 1000, None: 7},
        {"z": 0, "é": 4, "b": 900, "a": 3, "c": 2, "d": 800},
        {"only": 5},
    ],
)
def test_targets(spark, sizes):
    assert targets(spark, sizes) == pytest.approx(plain(sizes))


def test_odd_rows(odd_docs, odd_rows, no_docs):
    sized = odd_docs.select("*", mixing.word_count(F.col("text")).alias("size"), mixing.quality_of(F.col("text")).alias("quality"))
    # Names that the operator uses itself.
    sized = sized.withColumns({"bucket": F.lit("x"), "key": F.lit(1), "target": F.lit("old")})
    got = mixing.mix(sized).collect()
    assert len(got) == len(odd_rows)
    by_source = {}
    for r in got:
        assert r.bucket == "x" and r.taken <= 3 * r["size"]
        taken, target = by_source.get(r.source, (0, 0))
        by_source[r.source] = (taken + r.taken, r.target)
    assert all(taken == int(target) for taken, target in by_source.values())
    assert sorted(map(repr, mixing.mix(sized.repartition(7)).collect())) == sorted(map(repr, got))
    empty = no_docs.select("*", F.lit(1).alias("size"), F.lit(1.0).alias("quality"))
    assert mixing.mix(empty).count() == 0


def test_epochs_come_before_the_sample_and_quality_counts(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 50)
    df = spark.range(4000).select(
        F.col("id").alias("doc_id"),
        F.when(F.col("id") < 3000, "big").otherwise("small").alias("source"),
        F.lit(10).alias("size"),
        F.when(F.col("id") % 2 == 0, 1.0).otherwise(0.25).alias("quality"),
    )
    got = mixing.mix(df, weights=(1, 1)).toPandas()
    small = got[got.source == "small"]
    assert small.taken.sum() == 20_000 and set(small.taken) == {20}
    big = got[got.source == "big"]
    assert big.taken.sum() == 20_000 and set(big.taken) == {0, 10}
    even, odd = (big[big.doc_id % 2 == k].taken.sum() for k in (0, 1))
    assert even > 1.3 * odd


def test_sql(spark):
    sf = "/root/testdata/sf0.001"
    rows = compare.spark_rows(mixing.op3_mix_sources(spark, sf))
    assert compare.difference(rows, compare.oracle_rows(compare.connect(sf), mixing.ORACLE_SQL)) is None


def test_repeated_ids_and_rows_mix_alike_on_every_partitioning(spark, monkeypatch, tmp_path):
    """Half of the rows share an id and differ in size, a third of them are equal and have no id."""
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 20)
    rows = [(1, " ".join("abcdefg"[: 1 + i % 7]), "s", str(i)) for i in range(100)]
    rows += [(None, "x y z", "s", "")] * 100 + [(i, "p q", "t", "") for i in range(10, 110)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, note string")
    df = df.withColumns({"size": mixing.word_count(F.col("text")), "quality": F.lit(1.0), "digest": mixing.digest_of(F.col("text"))}).drop("note")
    found = []
    for parts in (1, 3, 8, 16):
        spark.conf.set("spark.sql.shuffle.partitions", str(parts + 1))
        got = mixing.mix(df.repartition(parts), identity=("doc_id", "digest"), weights=(1, 3)).collect()
        found.append(sorted((repr(r.doc_id), r.text, r.source, r.taken) for r in got))
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert all(f == found[0] for f in found[1:]) and len(found[0]) == 300
    equal = [t for i, _, _, t in found[0] if i == "None"]
    assert len(equal) == 100 and len(set(equal)) > 1
    df.drop("size", "quality", "digest").write.parquet(str(tmp_path / "documents.parquet"))
    rows = compare.spark_rows(mixing.op3_mix_sources(spark, str(tmp_path)))
    con = compare.duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert compare.difference(rows, compare.oracle_rows(con, mixing.ORACLE_SQL)) is None


def test_repeats_are_numbered_in_bounded_slices(spark):
    from tarn.llm.common import number_repeats

    rows = [(None, "a")] * 500 + [(1, "a")] * 3 + [(1, None)] * 2 + [(i, "b") for i in range(200)]
    for parts in (1, 5):
        df = spark.createDataFrame(rows, "k long, high string").repartition(parts)
        got = number_repeats(df, ["k", "high"], "n", slice_rows=16)
        assert got.columns == ["k", "high", "n"]
        found = {}
        for r in got.collect():
            found.setdefault((r.k, r.high), []).append(r.n)
        assert sorted(found[None, "a"]) == list(range(500)) and sorted(found[1, "a"]) == [0, 1, 2] and sorted(found[1, None]) == [0, 1]
        assert len(found) == 203 and all(found[i, "b"] == [0] for i in range(200))
    assert number_repeats(df.limit(0), ["k"], "n").count() == 0
