import random
from pathlib import Path

import pytest

from tarn.operators import growing_index, similarity
from tests.conftest import rows

SHAPE = "id long, embedding array<double>"


def clusters(spark, ids, seed=0, many=6, dim=5):
    rng = random.Random(seed)
    base = [[rng.gauss(0, 1) for _ in range(dim)] for _ in range(many)]
    data = [(i, [x + rng.gauss(0, 0.2) for x in base[i % many]]) for i in ids]
    return spark.createDataFrame(data, SHAPE)


def questions(spark, seed=9, n=12, dim=5):
    rng = random.Random(seed)
    return spark.createDataFrame([(i, [rng.gauss(0, 1) for _ in range(dim)]) for i in range(n)], "query_id long, embedding array<double>")


def files(path):
    return {str(p.relative_to(path)): p.stat().st_mtime_ns for p in Path(path, "rows").rglob("*.parquet")}


def cell_of(name):
    return name.split("/")[1]


def hits(df):
    return rows(df, "query_id", "rank", "id", "score")


def exact(spark, path, *parts, k=4):
    asked, whole = questions(spark), parts[0]
    for part in parts[1:]:
        whole = whole.unionAll(part)
    return hits(similarity.search_index(spark, path, asked, k, probes=1)) == hits(similarity.cosine_topk(whole, asked, k, dim=5))


@pytest.fixture
def index(spark, tmp_path):
    path, first = str(tmp_path / "index"), clusters(spark, range(120))
    similarity.build_index(first, path, 5, cells=6)
    return path, first


def test_search_stays_exact_and_only_touched_cells_get_files(spark, index):
    path, first = index
    before = files(path)
    one = clusters(spark, [6 * i + 1 for i in range(200, 215)])
    assert growing_index.append_index(spark, path, one, "a", most_rows=1000)
    after = files(path)
    assert before.items() <= after.items()
    fresh = {cell_of(f) for f in after.keys() - before.keys()}
    assert 1 <= len(fresh) < 6 and all("_batch=a" in f for f in after.keys() - before.keys())
    assert exact(spark, path, first, one)
    far = spark.createDataFrame([(10_000, [-9.0, 9.0, 9.0, -9.0, 0.1]), (10_001, [0.0] * 5)], SHAPE)
    growing_index.append_index(spark, path, far, "b", most_rows=1000)
    assert exact(spark, path, first, one, far)


def test_a_batch_counts_once(spark, index):
    path, first = index
    one = clusters(spark, range(300, 330))
    assert growing_index.append_index(spark, path, one, "a")
    before = files(path)
    assert not growing_index.append_index(spark, path, one, "a") and files(path) == before
    assert exact(spark, path, first, one)


def test_crowded_cells_split_and_others_keep_their_files(spark, index):
    path, first = index
    before = files(path)
    one = clusters(spark, [6 * i + 2 for i in range(200, 400)])
    growing_index.append_index(spark, path, one, "a", most_rows=50)
    after = files(path)
    gone = {cell_of(f) for f in before.keys() - after.keys()}
    assert gone and gone != {cell_of(f) for f in before}
    assert all(after[f] == before[f] for f in before if cell_of(f) not in gone)
    known, _ = similarity.read_centres(spark, path)
    sizes = {r.cell: r.rows for r in known.collect()}
    assert sum(sizes.values()) == 320 and max(sizes.values()) < 200 and {f"_cell={c}" for c in sizes} == {cell_of(f) for f in after}
    assert exact(spark, path, first, one)


@pytest.mark.parametrize("point", ["write_centres", "_write_rows", "log", "split_cells", "_dealt", "publish"])
def test_a_run_that_dies_may_be_repeated(spark, index, monkeypatch, point):
    path, first = index
    one, two = clusters(spark, [6 * i + 3 for i in range(200, 320)]), clusters(spark, range(900, 930))
    real = {n: getattr(growing_index, n) for n in ("write_centres", "_write_rows", "split_cells", "_dealt")}
    calls = []

    def dies(*args, **kwargs):
        raise RuntimeError("lost")

    def dies_late(centres, where, version):
        calls.append(version)
        if len(calls) == 2:
            raise RuntimeError("lost")
        return real["write_centres"](centres, where, version)

    def dies_after(df, where):
        real["_write_rows"](df, where)
        raise RuntimeError("lost")

    name, fake = {"log": ("_write_rows", dies_after), "publish": ("write_centres", dies_late)}.get(point, (point, dies))
    monkeypatch.setattr(growing_index, name, fake)
    with pytest.raises(RuntimeError):
        growing_index.append_index(spark, path, one, "a", most_rows=60)
    monkeypatch.setattr(growing_index, name, real[name])
    growing_index.append_index(spark, path, one, "a", most_rows=60)
    growing_index.append_index(spark, path, two, "b", most_rows=60)
    assert exact(spark, path, first, one, two)


def test_a_cell_of_equal_rows_stays_whole(spark, index):
    path, first = index
    same = spark.createDataFrame([(5000 + i, [3.0, 1.0, 0.0, 0.0, 2.0]) for i in range(300)], SHAPE)
    growing_index.append_index(spark, path, same, "a", most_rows=40)
    before = files(path)
    growing_index.append_index(spark, path, same.limit(0), "b", most_rows=400)
    assert files(path) == before
    assert exact(spark, path, first, same)


def test_a_split_gathers_the_batches_of_a_cell(spark, index):
    path, first = index
    one = clusters(spark, [6 * i + 2 for i in range(200, 400)])
    before = files(path)
    growing_index.append_index(spark, path, one, "a", most_rows=50)
    made = {f for f in files(path) if cell_of(f) not in {cell_of(b) for b in before}}
    assert made and all("_batch=first" in f for f in made)
    assert not growing_index.append_index(spark, path, one, "a", most_rows=50)
    assert exact(spark, path, first, one)
