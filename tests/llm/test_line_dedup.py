import hashlib
import random
import re
from collections import defaultdict

from pyspark.sql import functions as F

from tarn.llm import line_dedup

BLANK = "\x20\x09\x0a\x0b\x0c\x0d"
LOWER = {c: c + 32 for c in range(65, 91)}
LOW = -(10**30)


def plain(rows, least_chars=20, least_docs=3):
    """Rows of (id, text) -> sorted (id, lines, dropped, kept text)."""
    key = lambda line: line.strip(BLANK).translate(LOWER)
    found = defaultdict(set)
    for i, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= least_chars:
                found[key(line)].add(LOW if i is None else i)
    keeper = {k: max(ids) for k, ids in found.items() if len(ids) >= least_docs}
    out = []
    for i, text in rows:
        own = LOW if i is None else i
        lines = (text or "").split("\n")
        kept = [line for line in lines if keeper.get(key(line), own) == own]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


def found(df, **options):
    got = line_dedup.dedup_lines(df, **options)
    return sorted(((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in got.collect()), key=repr)


def test_equals_brute_force_on_odd_rows(spark, odd_docs, odd_rows, no_docs):
    assert found(odd_docs) == plain([(r[0], r[1]) for r in odd_rows])
    assert found(no_docs) == []


def test_equals_brute_force_on_mixed_lines(spark):
    rng = random.Random(2)
    shared = ["This line is on many pages of the site", "ÄPFEL und Birnen sind überall zu haben", "short line", "x" * 19, "Y" * 20]
    lines = [*shared, "", " ", "\t", *(f"a line of its own number {i}" for i in range(30))]
    dress = lambda s: rng.choice(["", " ", "\t\x0b ", "\r"]) + rng.choice([s, s.lower(), s.upper()]) + rng.choice(["", " ", "\r", " "])
    rows = [(rng.choice([None, *range(-5, 60)]), "\n".join(dress(rng.choice(lines)) for _ in range(rng.randint(0, 9)))) for _ in range(200)]
    rows += [(3, None), (None, None), (70, ""), *[(71, "\n".join(shared))] * 5, (72, "\n".join(shared * 3))]
    for parts in (1, 7):
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
        assert found(df) == plain(rows)
        assert found(df, least_chars=1, least_docs=2) == plain(rows, 1, 2)


def test_threshold_and_keeper(spark):
    line = "twenty code points é"
    assert len(line) == 20
    two = [(1, line), (2, line), (2, line)]
    assert [r[2] for r in found(spark.createDataFrame(two, "doc_id long, text string"))] == [0, 0, 0]
    three = [*two, (None, f"{line}\nrest")]
    assert found(spark.createDataFrame(three, "doc_id long, text string")) == [
        (1, 1, 1, ""), (2, 1, 0, line), (2, 1, 0, line), (None, 2, 1, "rest")]


def test_other_columns_stay_and_clashing_ones_give_way(spark):
    rows = [(i, "the same line in every document\nown %d" % i, "k", -1) for i in range(4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, line string, n_lines int")
    df = df.withColumns({"left": F.lit("l"), "at": F.lit(7), "doc": F.lit("d"), "drop": F.lit(None).cast("int")})
    got = line_dedup.dedup_lines(df).orderBy("doc_id")
    assert got.columns == ["doc_id", "text", "line", "left", "at", "doc", "drop", "n_lines", "n_dropped"]
    assert [tuple(r) for r in got.collect()][2:] == [
        (2, "own 2", "k", "l", 7, "d", None, 2, 1), (3, rows[3][1], "k", "l", 7, "d", None, 2, 0)]


def test_a_line_of_a_third_of_all_rows_is_counted_before_the_shuffle(spark):
    """The common key leaves each task once for a document, and each text drops it by itself."""
    n = 3000
    rows = spark.range(n, numPartitions=6).select(
        F.col("id").alias("doc_id"),
        F.when(F.col("id") % 3 == 0, "a very common line of the corpus").otherwise(F.concat(F.lit("some line of its own "), "id")).alias("text"),
    )
    got = line_dedup.dedup_lines(rows)
    assert got.where("n_dropped > 0").count() == n // 3 - 1
    assert [r.doc_id for r in got.where("n_dropped = 0 AND doc_id % 3 = 0").collect()] == [n - 3]


def test_a_very_long_text(spark):
    many = "\n".join(f"line {i % 50_000} of a very long text" for i in range(100_000))
    rows = [(i, many) for i in range(3)] + [(9, "\n".join(f"LINE {i} of a very long text " for i in range(0, 50_000, 2)))]
    got = {r[0]: r for r in found(spark.createDataFrame(rows, "doc_id long, text string"))}
    assert [got[i][1:3] for i in (0, 1, 2, 9)] == [(100_000, 100_000), (100_000, 100_000), (100_000, 50_000), (25_000, 0)]
    assert got[2][3].startswith("line 1 of") and got[0][3] == ""


def test_query_digests_the_kept_text(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    expected = [(i, n, d, hashlib.sha256(t.encode()).hexdigest()) for i, n, d, t in plain(rows)]
    got = [tuple(r) for r in line_dedup.op11_line_dedup(spark, sf).collect()]
    assert sorted(got, key=repr) == sorted(expected, key=repr)


def test_main_path_is_native(spark):
    plan = line_dedup.op11_line_dedup(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert not re.search(r"Python|Pandas|Arrow(?!ToRow)", plan)
