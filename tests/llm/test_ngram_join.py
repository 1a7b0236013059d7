import re

import pytest

from tarn.llm import ngram_join
from tarn.llm.components import components
from tests.conftest import rows as sorted_rows
from tests.llm.conftest import SCHEMA, words

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(rows):
    """Every pair compared."""
    sets = []
    for i, t, *_ in rows:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                up[find(a)] = find(b)
    least = {}
    for k, (i, *_) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(least.get(find(k), i), i)
    return sorted(
        ((i, len(sets[k]), least.get(find(k)) if sets[k] else i) for k, (i, *_) in enumerate(rows)), key=repr
    )


def got(df):
    return sorted_rows(ngram_join.jaccard_components(df), "doc_id", "n_shingles", "component_id")


def test_odd_rows(odd_docs, odd_rows, no_docs):
    assert got(odd_docs) == plain(odd_rows)
    assert got(no_docs) == []


@pytest.mark.parametrize("members", [1000, 12])
def test_near_copies_around_the_threshold(spark, tmp_path, monkeypatch, members):
    """Copies that differ in more and more words, groups that share a passage, and a common token."""
    import random

    monkeypatch.setattr(ngram_join, "MEMBERS", members)
    monkeypatch.setattr(ngram_join, "COMMON", 5)
    rng = random.Random(8)
    passage = words(rng, 30)
    rows = []
    for group in range(12):
        base = words(rng, rng.randint(6, 90)).split()
        for _ in range(25):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, len(copy) // 25))):
                copy[rng.randrange(len(copy))] = words(rng, 1)
            text = " ".join(copy)
            rows.append((len(rows), f"{passage} {text}" if group % 2 else text, "en", "s", 1))
    rows += [(1000 + i, f"{passage} {words(rng, rng.randint(2, 12))}", "en", "s", 1) for i in range(60)]
    path = str(tmp_path / "d")
    spark.createDataFrame(rows, SCHEMA).repartition(4).write.parquet(path)
    assert got(spark.read.parquet(path)) == plain(rows)


def test_columns_of_the_same_names(odd_docs, odd_rows):
    from pyspark.sql import functions as F

    clashing = odd_docs.withColumns({"marks": F.lit(1), "token": F.lit("x"), "component_id": F.lit(0)})
    assert got(clashing) == plain(odd_rows)


def test_components_of_a_chain_and_a_star(spark):
    nodes = spark.range(400).withColumnRenamed("id", "node")
    edges = [(i, i + 1) for i in range(0, 99)] + [(399, i) for i in range(200, 300)] + [(5, 5)]
    df = spark.createDataFrame(edges, "a long, b long")
    labels = {r.node: r.label for r in components(nodes, df).collect()}
    assert all(labels[i] == 0 for i in range(100)) and all(labels[i] == 200 for i in [*range(200, 300), 399])
    assert all(labels[i] == i for i in range(100, 200))


def test_numbers_as_bytes():
    import numpy as np

    for values in ([], [0], [0, 0], [1, 255, 256, 1 << 56], [2**64 - 1]):
        packed = ngram_join.squeeze(np.array(values, np.uint64))
        assert ngram_join.unsqueeze(packed, len(values)).tolist() == values
