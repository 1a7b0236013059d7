import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline as cp
from tarn.llm import mixing
from tests.llm.test_ngram_join import plain as plain_components

SF = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Each stage's rows, from its stored predecessor."""
    folder = tmp_path_factory.mktemp("stages")
    docs, found = spark.read.parquet(f"{SF}/documents.parquet"), {"documents": None}
    found["documents"] = docs.toPandas()
    for name, apply in cp.STAGES:
        apply(spark, docs, SF).write.parquet(str(folder / name))
        docs = spark.read.parquet(str(folder / name))
        found[name] = docs.toPandas()
    return found


def test_stages_keep_the_columns(stages):
    names = [n for n, _ in cp.STAGES]
    assert names == ["toxicity", "quality", "near_copies", "mixing", "packing"]
    for name in names[:-1]:
        assert sorted(stages[name].columns) == sorted(cp.COLUMNS)


def test_filters(spark, stages):
    labels = spark.read.parquet(f"{SF}/labels.parquet").toPandas().set_index("doc_id")
    after = stages["quality"].set_index("doc_id").join(labels, how="inner")
    clean = labels[(labels.toxic == 0) & (labels.quality == 1)]
    assert len(after[(after.toxic == 0) & (after.quality == 1)]) >= 0.99 * len(clean)
    # Fifty toxic labels teach little about the rarer languages; test_models has the larger fixture.
    assert after.toxic.sum() <= 0.2 * labels.toxic.sum()


def test_one_of_each_group_stays(stages):
    before = stages["quality"]
    rows = [(r.doc_id, r.text) for r in before.itertuples()]
    kept = {i for i, _, c in plain_components(rows) if i == c}
    assert set(stages["near_copies"].doc_id) == kept


def test_the_mix_takes_what_targets_say(stages):
    before, after = stages["near_copies"], stages["mixing"]
    count = lambda t: len(WORD.findall(t or ""))
    sizes = before.assign(size=[count(t) for t in before.text]).groupby("source")["size"].sum().to_dict()
    taken = after.assign(size=[count(t) for t in after.text]).groupby("source")["size"].sum().to_dict()
    from tests.llm.test_mixing import plain

    targets = plain(sizes)
    assert taken == {s: int(t + 1e-6) for s, t in targets.items() if int(t + 1e-6)}
    texts = dict(zip(before.doc_id, before.text))
    for r in after.itertuples():
        assert r.text == texts[r.doc_id] or " ".join(WORD.findall(texts[r.doc_id])).startswith(r.text)
        assert r.n_chars == len(r.text)


def test_packing_holds_every_row(stages):
    packed = stages["packing"]
    assert set(packed.doc_id) == set(stages["mixing"].doc_id)
    assert packed.groupby("sequence_id").length.sum().max() <= 4096


def test_registered_and_rerun_gives_the_same(spark, stages):
    assert entry.queries()["pipeline"] is cp.run and cp.ORACLE_SQL is None
    again = cp.run(spark, SF).toPandas()
    columns = ["doc_id", "start", "length", "ids_crc32"]
    key = lambda d: sorted(map(tuple, d[columns].values.tolist()))
    assert key(again) == key(stages["packing"])


@pytest.mark.parametrize("position", range(5))
def test_odd_rows_and_empty_tables(spark, odd_docs, no_docs, position):
    name, apply = cp.STAGES[position]
    clashing = odd_docs.withColumns({"score": F.lit("x"), "size": F.lit(1), "bucket": F.lit(2)})
    got = apply(spark, clashing, SF)
    assert got.count() >= 1
    assert apply(spark, no_docs, SF).count() == 0


def test_near_copies_go_by_row_whatever_the_ids(spark, tmp_path):
    long = "a b c d e f"
    rows = [(1, long, "en", "s", 1), (1, "x y z", "en", "s", 1), (1, long, "en", "s", 1), (2, "q", None, None, None), (3, long, "de", "t", 9)]
    rows += [(None, "no id but words", None, None, None)] * 3 + [(None, long.upper(), None, None, None), (4, None, "x", None, None), (5, "", "y", None, 0)]
    docs = spark.createDataFrame(rows, odd_schema()).repartition(3)
    docs.write.parquet(str(tmp_path / "d"))
    got = cp.drop_near_copies(spark, spark.read.parquet(str(tmp_path / "d")), SF).collect()
    expected = [(1, long), (1, "x y z"), (2, "q"), (None, "no id but words"), (4, None), (5, "")]
    assert sorted(((r.doc_id, r.text) for r in got), key=repr) == sorted(expected, key=repr)


def odd_schema():
    from tests.llm.conftest import SCHEMA

    return SCHEMA


def test_empty_mix_and_targets(spark):
    df = spark.createDataFrame([], "source string, source_size long")
    assert mixing.source_targets(df).count() == 0
