import hashlib
import random

import pytest
from pyspark.sql import functions as F

from tarn.llm import fingerprints as fp

LOW = [(i, f"w{i} " * (i % 7)) for i in range(-700, 700, 3)]


def test_next_row_over_blocks(spark):
    """Ids with gaps, negative ones, and far apart ones are linked in descending order, the last with the first."""
    ids = [*range(0, 5000, 7), -3, -900_000, 1 << 40, (1 << 62) + 5, -(1 << 61)]
    df = spark.createDataFrame([(i, f"t{i}") for i in ids], "doc_id long, text string").repartition(5)
    got = {r.doc_id: r.next for r in fp.with_next(df, {"next": "text"}).collect()}
    order = sorted(ids, reverse=True)
    assert got == {a: f"t{b}" for a, b in zip(order, [*order[1:], order[0]])}


def test_next_row_of_few(spark, no_docs):
    one = spark.createDataFrame([(5, "x", 1)], "doc_id long, text string, at int")
    assert [r.next for r in fp.with_next(one, {"next": "text"}).collect()] == ["x"]
    assert fp.with_next(no_docs, {"next": "text"}).count() == 0


def test_edited_texts(odd_docs, odd_rows, tmp_path, spark):
    got = fp.op1_scaled_sketch(spark, str(odd_docs.inputFiles()[0]).removeprefix("file:").rsplit("/documents.parquet", 1)[0])
    rows = got.collect()
    assert len(rows) == len(odd_rows)
    texts = {i: t or "" for i, t, *_ in odd_rows}
    order = sorted((i for i in texts if i is not None), reverse=True)
    follows = dict(zip(order, [*order[1:], None]))
    for r in rows:
        if r.doc_id in (None, 1) or odd_rows.count(next(x for x in odd_rows if x[0] == r.doc_id)) > 1:
            continue
        own, other = texts[r.doc_id], texts[follows[r.doc_id]]
        half = len(own) // 2
        edited = own[: len(own) - half] + other[:half]
        assert r.n_chars == len(own)
        assert r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        if own == edited:
            assert r.fingerprint == r.edited_fingerprint and r.near_edited == 1
    same = {r.fingerprint for r in rows if r.doc_id in (1, 2)}
    assert len(same) == 1


@pytest.mark.parametrize("size", [3, 60, 3000])
def test_sketch_and_likeness(spark, size):
    text = " ".join(f"word{i}" for i in range(size))
    longer = text + " " + " ".join(f"other{i}" for i in range(9 * size))
    df = spark.createDataFrame([(text, longer, "nothing in common here at all", "")], "a string, b string, c string, d string")
    a, b, c, d = (fp.sketch(F.col(x)) for x in "abcd")
    r = df.select(
        fp.likeness(a, b).alias("inside"),
        fp.likeness(a, a).alias("same"),
        fp.likeness(a, c).alias("apart"),
        fp.likeness(d, d).alias("empty"),
        fp.likeness(a, d).alias("none"),
        F.size(a["hashes"]).alias("n"),
        (fp.merge(b, c) == fp.merge(fp.merge(c, b), a)).alias("merged") if size > 4 else F.lit(True).alias("merged"),
    ).first()
    assert r.same == 1 and r.empty == 1 and r.apart == 0 and r.none == 0 and r.merged
    if size > 4:
        assert r.inside == 1
        whole = size - 4
        assert r.n == min(whole, fp.LEAST_KEPT) if whole < 100 else abs(r.n - whole / fp.SCALE) < 120


def shingles(text):
    import re

    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").lower())
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def test_merged_sketches_hold_their_parts(spark):
    """Texts of 3 to 3000 words: a merged sketch is like each of its parts, and has what both have below the lower limit."""
    rng = random.Random(1)
    make = lambda: " ".join(f"w{rng.randrange(10**6)}" for _ in range(rng.choice([3, 7, 7, 40, 90, 300, 3000])))
    df = spark.createDataFrame([(make(), make(), make()) for _ in range(300)], "a string, b string, c string")
    a, b, c = (fp.sketch(F.col(x)) for x in "abc")
    both = fp.merge(a, b)
    seen = lambda x: (F.size(F.filter(x["hashes"], lambda h: h < both["limit"])) > 0).cast("double")
    short = (F.size(F.split("a", " ")) < 60) & (F.size(F.split("b", " ")) < 60)
    got = df.select(
        seen(a).alias("seen_a"),
        seen(b).alias("seen_b"),
        short.alias("short"),
        fp.likeness(both, a).alias("with_a"),
        fp.likeness(both, b).alias("with_b"),
        fp.likeness(both, c).alias("with_c"),
        (fp.merge(both, c) == fp.merge(a, fp.merge(c, b))).alias("any_order"),
        F.size(both["hashes"]).alias("n"),
        F.size(fp.merge(both, both)["hashes"]).alias("again"),
    ).collect()
    assert all(r.with_a == r.seen_a and r.with_b == r.seen_b and r.with_c == 0 and r.any_order and r.n > 0 and r.n == r.again for r in got)
    # Only a text of a few shingles may have none below the limit of a long one; short texts keep all they have.
    assert all(r.with_a == r.with_b == 1 for r in got if r.short) and sum(r.short for r in got) > 50
    assert sum(r.with_a + r.with_b for r in got) > 1.4 * len(got)


def test_likeness_estimates_containment(spark):
    """Every document of the fixture against its first half and the text that follows: the error of the estimate."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    pairs = []
    for r, after in zip(docs, docs[1:]):
        half = (r.text or "")[: len(r.text or "") // 2] + (after.text or "")[: len(after.text or "") // 3]
        pairs.append((r.text, half))
        pairs.append((r.text, after.text))
    df = spark.createDataFrame([(i, x, y) for i, (x, y) in enumerate(pairs)], "i int, a string, b string").repartition(8)
    got = {r.i: r.like for r in df.select("i", fp.likeness(fp.sketch(F.col("a")), fp.sketch(F.col("b"))).alias("like")).collect()}
    errors = []
    for i, (x, y) in enumerate(pairs):
        p, q = shingles(x), shingles(y)
        if p and q:
            errors.append(abs(got[i] - len(p & q) / min(len(p), len(q))))
    assert sum(errors) / len(errors) < 0.03 and max(errors) < 0.35


def test_sketches_are_small_beside_their_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("length(text) > 4000")
    r = docs.select(F.length(fp.as_text(fp.sketch(F.col("text")))).alias("n"), F.octet_length("text").alias("m")).agg(F.sum("n"), F.sum("m")).first()
    assert r[0] < 0.35 * r[1]


def test_hashes_below_the_limit_are_picked_once(spark):
    """Before anything is sorted; the sketch is what sorting all hashes first would give."""
    texts = [(" ".join(f"w{i * i % 7919}" for i in range(n)),) for n in (0, 3, 40, 68, 69, 900, 1100, 5000)]
    df = spark.createDataFrame(texts, "t string")
    plan = df.select(fp.sketch(F.col("t")).alias("s"))._jdf.queryExecution().analyzed().toString()
    assert plan.count("filter(") == 2  # words that are not empty, hashes below the limit
    for r in df.select(fp.sketch(F.col("t")).alias("s"), F.sort_array(F.array_distinct(fp.shingle_hashes(F.col("t")))).alias("all")).collect():
        below = [h for h in r["all"] if h < fp.limit_of(fp.SCALE)]
        whole = (fp.HIGHEST, r["all"]) if len(r["all"]) <= fp.LEAST_KEPT else (r["all"][fp.LEAST_KEPT], r["all"][: fp.LEAST_KEPT])
        assert tuple(r.s) == ((fp.limit_of(fp.SCALE), below) if len(below) >= fp.LEAST_KEPT else whole)
