from datetime import date
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tarn.operators import vector_store
from tarn.plans import daily
from tarn.sources.lake import Lake, with_source_date, write_day
from tests.conftest import rows


class Counting:
    """A model that leaves a file for each text it is asked for."""

    dim, batch = 2, 3

    def __init__(self, folder):
        self.folder = folder

    def embed(self, texts):
        import uuid

        for text in texts:
            (Path(self.folder) / f"{uuid.uuid4().hex}").write_text(text)
        return [[float(len(t)), 1.0] for t in texts]

    def asked(self):
        return sorted(p.read_text() for p in Path(self.folder).iterdir())


@pytest.fixture
def model(tmp_path):
    (tmp_path / "calls").mkdir()
    return Counting(str(tmp_path / "calls"))


def frame(spark, *texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, content string").repartition(3)


def test_only_new_texts_go_to_the_model(spark, tmp_path, model):
    store = str(tmp_path / "store")
    first = vector_store.embed_changed(frame(spark, "a", "bb", "a", None, ""), store, "2024-01-01", model)
    assert rows(first, "id", "embedding") == [(0, [1.0, 1.0]), (1, [2.0, 1.0]), (2, [1.0, 1.0]), (3, None), (4, [0.0, 1.0])]
    assert model.asked() == ["", "a", "bb"]
    second = vector_store.embed_changed(frame(spark, "bb", "ccc", "ccc", "a"), store, "2024-01-02", model)
    got = {(r.content, r.first_day, tuple(r.embedding)) for r in second.collect()}
    assert got == {("bb", date(2024, 1, 1), (2.0, 1.0)), ("ccc", date(2024, 1, 2), (3.0, 1.0)), ("a", date(2024, 1, 1), (1.0, 1.0))}
    assert model.asked() == ["", "a", "bb", "ccc"]
    assert vector_store.add_missing(frame(spark, "bb", "a"), store, "2024-01-03", model) == 0
    assert vector_store.stored_vectors(spark, store).count() == 4


def test_a_text_of_a_third_of_all_rows_is_asked_once(spark, tmp_path, model):
    df = spark.range(900, numPartitions=6).select("id", F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("t"), F.col("id") % 5)).alias("content"))
    got = vector_store.embed_changed(df, str(tmp_path / "store"), "2024-01-01", model)
    assert got.count() == 900 and got.where("embedding IS NULL").isEmpty()
    assert model.asked() == ["hot", "t0", "t1", "t2", "t3", "t4"]


def test_a_run_that_dies_after_embedding_pays_once(spark, tmp_path, model):
    store = str(tmp_path / "store")
    vector_store.add_missing(frame(spark, "a", "b"), store, "2024-01-01", model)
    vector_store.embed_changed(frame(spark, "a", "b", "c"), store, "2024-01-01", model).count()
    assert model.asked() == ["a", "b", "c"]


def test_clashing_columns_and_empty_tables(spark, tmp_path, model):
    store = str(tmp_path / "store")
    df = frame(spark, "a").withColumns({"embedding": F.lit("old"), "first_day": F.lit(1), "content_key": F.lit("k")})
    (r,) = vector_store.embed_changed(df, store, "2024-01-01", model).collect()
    assert r.embedding == [1.0, 1.0] and r.first_day == date(2024, 1, 1) and r.asDict().keys() == {"id", "content", "embedding", "first_day"}
    assert vector_store.embed_changed(df.limit(0), store, "2024-01-02", model).count() == 0


def test_a_daily_job_copies_vectors_from_day_to_day(spark, tmp_path, model):
    lake = Lake(spark, str(tmp_path / "lake"))
    for day, names in (("2024-01-01", ["x", "y"]), ("2024-01-02", ["x", "y", "z"])):
        df = spark.createDataFrame([(n, n) for n in names], "Id string, Name string")
        write_day(with_source_date(df, day), lake.root, day, source="jellyfin")
        daily.embed_sources(lake, day, ["jellyfin"], embedder=model, model="counting")
    assert model.asked() == ["x", "y", "z"]
    stored = daily.embeddings(lake, "jellyfin")
    assert rows(stored, "id", "day") == [("x", "01"), ("x", "02"), ("y", "01"), ("y", "02"), ("z", "02")]
    assert set(stored.columns) == {"id", "source", "content", "embedding", "source_date", "ingested_at", "year", "month", "day"}
