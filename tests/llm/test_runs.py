import hashlib
import random
import re
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarn.llm import runs
from tests.llm.conftest import words

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_runs(w, least=6, periods=4):
    """Every period in turn: stretches in which words that far apart are equal, at their smallest period."""
    found = {}
    for q in range(1, len(w) // periods + 1):
        i = 0
        while i + q < len(w):
            if w[i] != w[i + q]:
                i += 1
                continue
            start = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            length = i + q - start
            if length >= max(least, periods * q):
                found.setdefault((start, length), q)
    return sorted((s, n, q) for (s, n), q in found.items())


def plain_edit(w, doc_id):
    if doc_id is None:
        return w
    h, n = zlib.crc32(str(doc_id).encode()), len(w)
    if h % 10 or not n:
        return w
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]


def plain_row(doc_id, text):
    w = plain_edit(WORD.findall(text or ""), doc_id)
    found = plain_runs(w)
    best = (None,) * 4
    if found:
        s, n, q = min(found, key=lambda r: (-r[1] * 10**12 // r[2], r[0], r[2]))
        best = (s, n, q, 1000 * n // q)
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    kept = " ".join(x for i, x in enumerate(w) if i not in gone)
    listed = "".join(f"{s},{n},{q}\n" for s, n, q in sorted(found, key=lambda r: (r[0], r[2])))
    return (doc_id, len(found), *best, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest())


def found_in(sequences, **options):
    symbols = np.array([x + 1 for s in sequences for x in s], np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    bounds = np.concatenate([[0], np.cumsum([len(s) for s in sequences])]).astype(np.int64)
    rows = runs.find_runs(symbols, bounds, **options).tolist()
    return [sorted(tuple(r[1:]) for r in rows if r[0] == k) for k in range(len(sequences))]


def sequences(seed, many):
    rng = random.Random(seed)
    for _ in range(many):
        letters = rng.choice([1, 2, 2, 3, 5, 50])
        s = [rng.randrange(letters) for _ in range(rng.randint(0, 60))]
        for _ in range(rng.randint(0, 3)):
            unit = [rng.randrange(letters) for _ in range(rng.randint(1, 7))]
            at = rng.randint(0, len(s))
            s[at:at] = (unit * rng.randint(2, 12))[rng.randint(0, len(unit) - 1) :]
        yield s


def test_equals_every_period_in_turn():
    cases = list(sequences(1, 1500))
    assert found_in(cases) == [plain_runs(s) for s in cases]
    assert sum(map(len, found_in(cases))) > 1000


def test_other_lengths_and_periods():
    cases = list(sequences(2, 400))
    for least, periods in ((2, 2), (9, 3), (12, 4), (1, 5)):
        assert found_in(cases, least=least, periods=periods) == [plain_runs(s, least, periods) for s in cases]


@pytest.mark.parametrize(
    "case",
    [[], [1] * 5, [1] * 6, [1, 2] * 4, [1, 2] * 3 + [1], [1, 2] * 4 + [1], [0] + [1] * 9 + [0] + [1] * 7, ([1] * 6 + [2]) * 5, ([1, 1, 2] * 4 + [3]) * 4],
)
def test_edges(case):
    assert found_in([case]) == [plain_runs(case)]


def test_equal_texts_have_their_own_runs():
    case = [5, *[1, 2, 3] * 5, 6]
    assert found_in([case, [], case, case]) == [plain_runs(case), [], plain_runs(case), plain_runs(case)]


@pytest.mark.parametrize("make", [
    lambda: [1] * 60_000,
    lambda: [1, 2] * 30_000,
    lambda: (list(range(2, 1002)) * 60)[:60_000],
    lambda: [x for k in range(400) for x in [1000 + k, *[1] * 150]],
    lambda: [x for k in range(10_000) for x in [1000 + k, 1, 2, 3, 4, 5]],
    lambda: [x for k in range(6_000) for x in [*range(10), 1000 + k % 7]],
])
def test_repetitive_texts_take_little_time(make):
    case, began = make(), time.time()
    got = found_in([case])[0]
    assert time.time() - began < 12
    assert all(case[s : s + n - q] == case[s + q : s + n] for s, n, q in got[:50])


def test_rows_equal_the_plain_ones(spark, odd_docs, odd_rows, no_docs, tmp_path):
    rng = random.Random(5)
    rows = [(r[0], r[1]) for r in odd_rows if r[0] != 10]
    rows += [(1000 + i, words(rng, rng.randint(1, 60))) for i in range(300)]
    rows += [(2000 + i, "\n".join([words(rng, 3)] * rng.randint(1, 9)) + rng.choice(["", "\t", " end"])) for i in range(100)]
    path = str(tmp_path / "sf")
    spark.createDataFrame(rows, "doc_id long, text string").repartition(4).write.parquet(f"{path}/documents.parquet")
    got = [tuple(r) for r in runs.op13_periodic_runs(spark, path).collect()]
    assert sorted(got, key=repr) == sorted((plain_row(*r) for r in rows), key=repr)
    assert sum(r[1] > 0 for r in got) > 40
    assert runs.periodic_runs(odd_docs).count() == len(odd_rows)
    assert runs.periodic_runs(no_docs).count() == 0


def test_query_equals_the_plain_rows(spark):
    sf = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    got = sorted(tuple(r) for r in runs.op13_periodic_runs(spark, sf).collect())
    assert got == sorted(plain_row(*r) for r in rows)
    assert sum(r[1] > 0 for r in got) > 10


def test_real_outputs_and_clashing_columns(spark):
    df = spark.createDataFrame([(1, "x " + "Tick tock " * 5 + "end", "k"), (2, None, None)], "doc_id long, text string, body string")
    df = df.withColumns({"runs": F.lit("old"), "number": F.lit(30), "at": F.lit(None).cast("int")})
    got = runs.periodic_runs(df).orderBy("doc_id").collect()
    assert got[0].asDict(recursive=True) == {
        "doc_id": 1, "body": "k", "number": 30, "at": None, "n_words": 12,
        "runs": [{"start": 1, "length": 10, "period": 2}], "collapsed": "x Tick tock end"}
    assert got[1].n_words == 0 and got[1].runs == [] and got[1].collapsed == ""


def test_edit_repeats_the_tail():
    counts, numbers = np.array([10, 0, 7, 9]), np.array([40, 10, 11, -1])
    index = runs.edited(counts, numbers)
    # g = 4, a = 4, p = 1 + 6 // 7
    assert index.tolist() == [0, 1, 2, 3, 4, 4, 4, 4, 4, 4, *range(10, 26)]
