import zlib
from collections import Counter

from pyspark.sql import functions as F

from tarn.llm import sharding


def test_all_rows_once_in_random_order(odd_docs, odd_rows, no_docs, tmp_path, spark):
    df = odd_docs.withColumns({"shard": F.lit("old"), "bucket": F.lit(3), "order": F.lit(None).cast("string")})
    got = sharding.write_shards(df, str(tmp_path / "s"), shards=4, bucket_bytes=2000).collect()
    assert Counter((r.doc_id, r.text) for r in got) == Counter((r[0], r[1]) for r in odd_rows)
    assert all(r.bucket == 3 for r in got)
    for shard in range(4):
        assert sorted(r.slot for r in got if r.shard == shard) == list(range(sum(r.shard == shard for r in got)))
    assert len({r.shard for r in got if r.doc_id == 2}) == 1
    assert sharding.write_shards(no_docs, str(tmp_path / "e")).count() == 0


def test_law_and_digests(spark):
    sf = "/root/testdata/sf0.01"
    got = sharding.op9_shuffle_shards(spark, sf).toPandas().set_index("doc_id")
    docs = spark.read.parquet(f"{sf}/documents.parquet").toPandas().set_index("doc_id")
    assert len(got) == len(docs)
    assert all(zlib.crc32(docs.text[i].encode()) == c for i, c in got.text_crc32.items())
    assert all(len(docs.text[i].encode()) + 1 == s for i, s in got["size"].items())
    # One more shard takes rows only into itself.
    moved = got[got.grown_shard != got["shard"]]
    assert set(moved.grown_shard) == {8} and 0.05 < len(moved) / len(got) < 0.18
    # The order in a shard has nothing of the order of ids.
    first = got[got["shard"] == 0].sort_values("slot").index.to_series()
    assert abs(first.reset_index(drop=True).corr(first.reset_index(drop=True).index.to_series())) < 0.35
    sizes = got.groupby("shard").size()
    assert sizes.min() > 80 and sizes.max() < 170


def test_the_shuffle_is_uniform(spark, tmp_path):
    """Where one row lands among twelve: every place about as often."""
    places = Counter()
    for seed in range(16):
        df = spark.range(12).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
        got = sharding.write_shards(df.coalesce(1), str(tmp_path / str(seed)), shards=1, seed=seed)
        places.update({r.slot: 1 for r in got.where("doc_id < 3").collect()})
    assert len(places) >= 9
