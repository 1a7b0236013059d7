import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tarn.functions.vectors import checked_vector, cosine
from tarn.operators import similarity
from tests.conftest import rows

DIM = 8


def table(spark, matrix, key):
    data = [(i, [float(x) for x in v]) for i, v in enumerate(matrix)]
    return spark.createDataFrame(data, f"{key} long, embedding array<double>")


def brute(vectors, queries, k):
    def unit(m):
        n = np.linalg.norm(m, axis=1, keepdims=True)
        return m / np.where(n, n, 1), n[:, 0] > 0

    v, v_ok = unit(vectors)
    q, q_ok = unit(queries)
    found = {}
    for i in np.flatnonzero(q_ok):
        scores = np.round(v @ q[i], 9)
        order = sorted(np.flatnonzero(v_ok), key=lambda j: (-scores[j], j))[:k]
        found[int(i)] = [(int(j), float(scores[j])) for j in order]
    return found


def answers(df):
    found = {}
    for r in df.orderBy("query_id", "rank").collect():
        found.setdefault(r.query_id, []).append((r.id, r.score))
        assert r["rank"] == len(found[r.query_id])
    return found


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(5)
    vectors = rng.standard_normal((600, DIM))
    # A third of the rows are copies of one vector, and some have no direction.
    vectors[100:300] = vectors[0]
    vectors[590:] = 0
    queries = np.vstack([vectors[:3], rng.standard_normal((17, DIM)), np.zeros((1, DIM))])
    return vectors, queries


@pytest.mark.parametrize("limit", [similarity.QUESTION_BYTES, 5 * 8 * DIM])
def test_exact_topk_equals_brute_force(spark, data, limit):
    vectors, queries = data
    got = similarity.cosine_topk(
        table(spark, vectors, "id").repartition(7), table(spark, queries, "query_id"), 12, question_bytes=limit
    )
    got, expected = answers(got), brute(vectors, queries, 12)
    assert got.keys() == expected.keys()
    for q in expected:
        assert [i for i, _ in got[q]] == [i for i, _ in expected[q]]
        assert np.allclose([s for _, s in got[q]], [s for _, s in expected[q]], atol=1e-8)


def test_many_batches_per_task(spark, data):
    vectors, queries = data
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "40")
    try:
        got = answers(
            similarity.cosine_topk(table(spark, vectors, "id").coalesce(1), table(spark, queries, "query_id"), 12)
        )
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    expected = brute(vectors, queries, 12)
    assert {q: [i for i, _ in hits] for q, hits in got.items()} == {
        q: [i for i, _ in hits] for q, hits in expected.items()
    }


@pytest.mark.parametrize("probes", [1, 3, 6])
def test_cells_are_exact(spark, data, probes):
    vectors, queries = data
    got = similarity.ann_topk(
        table(spark, vectors, "id"), table(spark, queries, "query_id"), 10, cells=6, probes=probes
    )
    expected = brute(vectors, queries, 10)
    assert {q: [i for i, _ in hits] for q, hits in answers(got).items()} == {
        q: [i for i, _ in hits] for q, hits in expected.items()
    }


def test_stored_index_reads_few_cells(spark, tmp_path):
    rng = np.random.default_rng(1)
    centres = rng.standard_normal((20, 16)) * 8
    vectors = centres[rng.integers(0, 20, 2000)] + rng.standard_normal((2000, 16)) * 0.2
    queries = centres[:2] + rng.standard_normal((2, 16)) * 0.2
    path = str(tmp_path / "index")
    similarity.build_index(table(spark, np.vstack([vectors, np.zeros((3, 16))]), "id"), path, cells=20)
    assert spark.read.parquet(f"{path}/rows").count() == 2000
    asked = table(spark, queries, "query_id")
    got = similarity.search_index(spark, path, asked, 5, probes=1)
    expected = brute(vectors, queries, 5)
    assert {q: [i for i, _ in h] for q, h in answers(got).items()} == {q: [i for i, _ in h] for q, h in expected.items()}
    plan = got._jdf.queryExecution().executedPlan().toString()
    filters = [part.split("]")[0] for part in plan.split("PartitionFilters: [")[1:]]
    pruned = [f for f in filters if "_cell" in f]
    assert all(0 < len(set(re.findall(r"\bIN \((.*?)\)", f)[0].split(","))) <= 6 for f in pruned if " IN " in f), filters


def test_other_columns_come_along(spark):
    v = spark.createDataFrame([("a", "s1", "text", [1.0, 0.0])], "id string, source string, content string, embedding array<float>")
    q = spark.createDataFrame([("q", [1.0, 1.0])], "query_id string, embedding array<double>")
    got = similarity.cosine_topk(v, q).first()
    assert (got.source, got.content, got["rank"]) == ("s1", "text", 1)
    assert got.score == pytest.approx(0.5**0.5)


def test_empty_sides(spark):
    v, q = table(spark, np.ones((3, DIM)), "id"), table(spark, np.ones((2, DIM)), "query_id")
    assert similarity.cosine_topk(v.limit(0), q).count() == 0
    assert similarity.cosine_topk(v, q.limit(0)).count() == 0


def test_wrong_length_is_an_error(spark):
    v, q = table(spark, np.ones((3, DIM)), "id"), table(spark, np.ones((2, DIM + 1)), "query_id")
    with pytest.raises(Exception, match=f"expected {DIM + 1} values, found {DIM}"):
        similarity.cosine_topk(v, q).collect()
    with pytest.raises(Exception, match="expected 5 values, found 8"):
        v.select(checked_vector(F.col("embedding"), 5)).collect()


def test_cosine_of_a_row(spark):
    df = spark.createDataFrame([([3.0, 4.0], [4.0, 3.0]), ([0.0, 0.0], [1.0, 1.0])], "a array<double>, b array<double>")
    assert rows(df.select(cosine(F.col("a"), F.col("b")))) == [(0.96,), (None,)]


def test_rows_that_share_an_id_are_hits_once_each(spark, tmp_path):
    same = [("x", [1.0, 0.1 * (i % 3)], f"text {i % 3}", None) for i in range(50)]
    df = spark.createDataFrame([*same, ("y", [0.0, 1.0], "other", None)], "id string, embedding array<double>, content string, note string")
    asked = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 2.0])], "query_id long, embedding array<double>")
    path = str(tmp_path / "index")
    similarity.build_index(df, path, 2, cells=2)
    for got in (similarity.cosine_topk(df, asked, 5, dim=2), similarity.search_index(spark, path, asked, 5)):
        found = sorted((r.query_id, r["rank"], r.id, r.content) for r in got.collect())
        assert found[:5] == [(1, n, "x", "text 0") for n in range(1, 6)]
        assert found[5:] == [(2, 1, "y", "other")] + [(2, n, "x", "text 2") for n in range(2, 6)]
        assert got.columns == ["query_id", "id", "content", "note", "score", "rank"]


def test_many_rounds_are_one_pass_over_the_vectors(spark, data):
    vectors, queries = data
    got = similarity.cosine_topk(table(spark, vectors, "id"), table(spark, queries, "query_id"), 12, question_bytes=2 * 8 * DIM)
    assert got._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1


def test_searches_bring_no_question_to_the_driver(spark, data, tmp_path, monkeypatch):
    vectors, queries = data
    path, asked = str(tmp_path / "index"), table(spark, queries, "query_id")
    similarity.build_index(table(spark, vectors, "id"), path, DIM, cells=6)
    monkeypatch.setattr(type(asked), "toArrow", lambda _: pytest.fail("questions came to the driver"))
    # The cell of the copies is cut into several blocks, small cells share one.
    monkeypatch.setattr(similarity, "LEAST_ROWS", 40)
    expected = brute(vectors, queries, 10)
    got = answers(similarity.search_index(spark, path, asked, 10, probes=2))
    assert {q: [i for i, _ in h] for q, h in got.items()} == {q: [i for i, _ in h] for q, h in expected.items()}


def test_matrices_of_many_cells_are_cut():
    for width in (10, 700, 131072):
        cut = list(similarity._chunks(10_000, width, 10_000))
        assert cut[0][0] == 0 and cut[-1][1] == 10_000 and all(a[1] == b[0] for a, b in zip(cut, cut[1:]))
        assert all(8 * width * (stop - start) <= similarity.PRODUCT_BYTES for start, stop in cut)


def test_cells_and_their_blocks():
    sizes = np.array([3, 4, 25, 2, 9])
    assert [x.tolist() for x in similarity._blocks_of(sizes, 10, True)] == [[0, 0, 1, 4, 5], [1, 1, 3, 1, 1]]
    assert [x.tolist() for x in similarity._blocks_of(sizes, 10, False)] == [[0, 1, 2, 5, 6], [1, 1, 3, 1, 1]]


def test_equal_rows_are_held_k_times():
    keys = pa.table({"id": [1, 2, 1, 1, 3], similarity.ROW: [7, 8, 7, 7, 9]})
    left, matrix = similarity._without_copies(keys, np.arange(10.0).reshape(5, 2), 2)
    assert left["id"].to_pylist() == [1, 2, 1, 3] and matrix[:, 0].tolist() == [0, 2, 4, 8]
