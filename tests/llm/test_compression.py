import os
import random
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import functions as F

from tarn.llm import compression
from tarn.llm.words import passes
from tests.llm.conftest import words

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text):
    w = WORD.findall(text or "")
    lines = [s for s in (text or "").split("\n") if WORD.search(s)]
    grams = list(zip(w, w[1:], w[2:]))
    count = Counter(grams)
    covered = {i + k for i, g in enumerate(grams) if count[g] > 1 for k in range(3)}
    symbols = sum((text or "").count(c) for c in "#*$%&|<>")
    return len(w), sum(map(len, w)), symbols, len(lines) - len(set(lines)), len(covered)


def counts(texts, limit=1 << 20):
    found = []
    for _, part in passes(pa.array(texts, pa.string()), limit):
        c = compression.base_counts(part)
        names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
        found += list(zip(*(c[n].tolist() for n in names)))
    return found


def test_counts_equal_brute_force(odd_rows):
    rng = random.Random(3)
    texts = [t for _, t, *_ in odd_rows] + ["a b c a b c", "x\nx\n\n x\nx \nx", "\n", "a b\na b\na b", "ab c\nab c", "#é| | <"]
    texts += ["\n".join(rng.choice(["a b", "b a a", "", " ", "c"]) for _ in range(rng.randint(0, 12))) for _ in range(300)]
    expected = [plain(t) for t in texts]
    assert counts(texts) == expected
    assert counts(texts, limit=7) == expected


def test_verdicts(spark, odd_docs, odd_rows, no_docs):
    rng = random.Random(1)
    prose = [words(rng, n) for n in (60, 400, 5000)]
    noise = os.urandom(3000).hex() + " " + " ".join(os.urandom(40).hex() for _ in range(60))
    again = "\n".join(f"{a} line number {i} says the same thing again and again" for i, a in enumerate("abcd" * 60))
    rows = [(i, t) for i, t in enumerate([*prose, "word " * 500, "short text", None, again, noise])]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"kept": F.lit("old"), "body": F.lit(1)})
    got = {r.doc_id: r for r in compression.quality_rules(df).collect()}
    assert [got[i].kept for i in range(6)] == [True, True, True, False, False, False]
    assert got[3].base_failed and got[4].base_failed and got[5].n_words == 0 and got[0].body == 1
    assert not got[6].kept
    assert got[3].ratio < 0.05 < 0.3 < got[2].ratio
    assert compression.quality_rules(odd_docs).count() == len(odd_rows)
    assert compression.quality_rules(no_docs).count() == 0


def test_bands_follow_the_length():
    import numpy as np

    sizes = np.array([30, 30, 5000, 5000, 5000])
    assert compression.in_band(sizes, np.array([1.5, 0.2, 0.5, 0.1, 0.95])).tolist() == [True, True, True, False, False]


def test_query_keeps_clean_documents(spark):
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    got = compression.op10_compression_bands(spark, sf)
    assert got.count() == 10_000
    clean = got.join(labels, "doc_id").where("quality = 1 AND NOT base_failed")
    assert clean.where("NOT kept").count() == 0


def test_junk_that_passes_the_base_rules_is_rejected(spark):
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    sizes = docs.select("doc_id", F.octet_length("text").alias("size"))
    got = compression.op10_compression_bands(spark, sf).where("NOT base_failed").join(labels, "doc_id").join(sizes, "doc_id").toPandas()
    good, junk = got[got.quality == 1], got[got.quality == 0]
    long = junk[junk["size"] >= 2048]
    assert len(good) == 3243 and good.kept.all()
    assert len(junk) == 291 and (~junk.kept).sum() >= 150
    assert (~long.kept).mean() >= 0.95


def test_limits_come_from_the_rows(spark):
    rng = random.Random(8)
    plain = [words(rng, rng.randint(450, 1400)) for _ in range(400)]
    listed = [" | ".join(words(rng, rng.randint(450, 1400)).split()) for _ in range(12)]
    copies = [plain[0]] * 300
    df = spark.createDataFrame(list(enumerate([*plain, *listed, *copies])), "doc_id long, text string").repartition(5)
    got = {r.doc_id: r for r in compression.quality_rules(df).collect()}
    assert not any(r.base_failed for r in got.values())
    assert all(got[i].kept for i in range(400))
    assert not any(got[400 + i].kept for i in range(12))
    assert all(got[i].odd_chunks > compression.MOST_ODD_CHUNKS for i in range(400, 412))
    assert all(got[412 + i].kept for i in range(300))


def test_a_small_script_is_judged_like_the_large_one(spark):
    """Clean English documents, and the same ones in Cyrillic letters, one for one: what is kept is the same."""
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang")
    clean = docs.where("lang = 'en'").join(labels.where("quality = 1 AND toxic = 0"), "doc_id", "left_semi").orderBy("doc_id").limit(400)
    letters = "".join(chr(ord("а") + i) for i in range(26))
    written = clean.select(
        (F.col("doc_id") + 10_000_000).alias("doc_id"), F.translate(F.lower("text"), "abcdefghijklmnopqrstuvwxyz", letters).alias("text"))
    plain = clean.select((F.col("doc_id") + 20_000_000).alias("doc_id"), F.lower("text").alias("text"))
    got = {r.doc_id: r.kept for r in compression.quality_rules(docs.select("doc_id", "text").unionByName(written)).collect()}
    latin = {r.doc_id: r.kept for r in compression.quality_rules(docs.select("doc_id", "text").unionByName(plain)).collect()}
    ids = [r.doc_id for r in clean.collect()]
    assert [got[i + 10_000_000] for i in ids] == [latin[i + 20_000_000] for i in ids]
    assert all(got[i] == got[i + 10_000_000] for i in ids) and sum(got[i] for i in ids) > 350


def test_alphabets():
    import numpy as np

    points = lambda s: np.array([ord(c) for c in s], np.uint32)
    assert compression.own_alphabet(points("")) == b"" and compression.own_alphabet(points("aba")) == b"\0\1\0"
    assert compression.own_alphabet(points("жюж")) == compression.own_alphabet(points("😀😁😀")) == b"\0\1\0"
    many = points("".join(chr(0x4E00 + i) for i in range(300)))
    assert len(compression.own_alphabet(many)) == 600


def test_few_rows_lean_on_the_bands_and_more_rows_on_themselves():
    import numpy as np

    def limits(n):
        return compression.fit_limits(np.full(n, 160), np.full(n, 0.5) + np.arange(n) % 5 / 100, np.ones(n, int), 4, 6)

    widths = [float(x.greatest[0] - x.least[0]) for x in map(limits, (1, 10, 100, 10_000))]
    assert widths == sorted(widths, reverse=True) and widths[0] > 0.6 and widths[-1] < 0.3
