import random
import re
from collections import Counter, defaultdict

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tarn.llm import collocations
from tarn.llm.words import passes

LOWER = {c: c + 32 for c in range(65, 91)}


def plain_pieces(text):
    for piece in re.split(r"[.,;:!?\x0a-\x0d]", (text or "").translate(LOWER)):
        yield re.findall(r"[^\x20\x09]+", piece)


def plain(rows, most=4, least=30, top=2000, percent=80):
    """Rows of (text, lang) -> lang, rank, phrase, a, l, r, n, score, by counting every run of words."""
    counts, totals = defaultdict(Counter), Counter()
    for text, lang in rows:
        for w in plain_pieces(text):
            totals[lang or "und" if lang is None else lang] += len(w)
            for size in range(1, most + 1):
                counts["und" if lang is None else lang].update(tuple(w[i : i + size]) for i in range(len(w) - size + 1))
    out = []
    for lang, f in counts.items():
        candidates = {g: a for g, a in f.items() if len(g) > 1 and a >= least}
        found = []
        for g, a in candidates.items():
            inside = lambda c: any(c[i : i + len(g)] == g for i in range(len(c) - len(g) + 1))  # noqa: E731, B023
            if any(len(c) > len(g) and 100 * b >= percent * a and inside(c) for c, b in candidates.items()):
                continue
            score, k = min((2_000_000 * a // (f[g[:k]] + f[g[k:]]), k) for k in range(1, len(g)))
            found.append((-score, -a, " ".join(g).encode(), f[g[:k]], f[g[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, totals[lang], -score))
    return sorted(out)


def found(df, **options):
    return sorted(tuple(r) for r in collocations.collocations(df, **options).collect())


def corpus(rng, many):
    stock = ["Of the", "in THE end", "one of the most", "a b a b", "x", "straße und weg", "É é", "the the the", "tab\there", "99 % of"]
    joints = [" ", "  ", "\t", " ", ", ", ". ", "\n", "\r\n", "!", " \x0b", "-"]
    for _ in range(many):
        text = "".join(rng.choice(stock) + rng.choice(joints) for _ in range(rng.randint(0, 25)))
        yield text, rng.choice(["en", "en", "en", "de", None, ""])


@pytest.mark.parametrize("modulus", [1, 2, 16, 1 << 40])
def test_equals_counting_everything(spark, modulus):
    rows = list(corpus(random.Random(modulus), 400)) + [(None, "en"), ("", "fr"), ("   ", None), ("word", "it")]
    rows += [rows[0]] * 40
    df = spark.createDataFrame(rows, "text string, lang string").repartition(5)
    got = found(df, modulus=modulus)
    assert got == plain(rows)
    assert len(got) > 40


def test_other_limits(spark):
    rows = list(corpus(random.Random(9), 300))
    df = spark.createDataFrame(rows, "text string, lang string")
    for options in ({"most_words": 2, "least_count": 5}, {"most_words": 6, "least_count": 8, "percent": 50}, {"least_count": 2, "top": 7, "percent": 100}):
        expected = plain(rows, *(options.get(n, d) for n, d in (("most_words", 4), ("least_count", 30), ("top", 2000), ("percent", 80))))
        assert found(df, **options) == expected


def test_odd_rows(spark, odd_docs, odd_rows, no_docs):
    assert found(odd_docs, least_count=3) == plain([(r[1], r[2]) for r in odd_rows], least=3)
    assert found(no_docs) == []
    clash = odd_docs.withColumns({"phrase": F.lit("p"), "chunk": F.lit(1), "n": F.lit(None).cast("long"), "owned": F.lit("o")})
    assert found(clash, least_count=3) == found(odd_docs, least_count=3)


def test_every_run_of_words_is_owned_once(spark):
    rng = random.Random(4)
    rows = [*list(corpus(rng, 60)), ("a " * 5000, "en"), (" ".join(rng.choice("ab") for _ in range(3000)), "en")]
    df = spark.createDataFrame(rows, "text string, lang string")
    for overlap, modulus in ((1, 2), (3, 1), (3, 4)):
        chunks = collocations.parse(df, "text", "lang", overlap, modulus).collect()
        got, expected = Counter(), Counter()
        for r in chunks:
            w = r.chunk.split(" ")
            for size in range(1, overlap + 2):
                for i in range(r.owned):
                    if i + size <= len(w):
                        got[r.lang, tuple(w[i : i + size])] += r.times
        for text, lang in rows:
            for w in plain_pieces(text):
                for size in range(1, overlap + 2):
                    expected.update(("und" if lang is None else lang, tuple(w[i : i + size])) for i in range(len(w) - size + 1))
        assert got == expected


def test_a_shared_passage_gives_the_same_chunks(spark):
    rng = random.Random(6)
    passage = " ".join(f"w{rng.randrange(500)}" for _ in range(400))
    rows = [(" ".join(f"v{rng.randrange(9**9)}" for _ in range(40)) + " " + passage, "en") for _ in range(100)]
    df = spark.createDataFrame(rows, "text string, lang string")
    times = sorted((r.times for r in collocations.parse(df, "text", "lang", 3).collect()), reverse=True)
    assert times[:15] == [100] * 15


def test_products_beyond_64_bits(spark):
    rows = [("en", 1, "p", 9 * 10**18), ("en", 1, "q", 9 * 10**18 - 1), ("en", 2, "p q", 8 * 10**18 + 7)]
    counts = spark.createDataFrame(rows, "lang string, size int, phrase string, n long")
    (r,) = collocations.scored(counts).collect()
    assert r.score == 2_000_000 * rows[2][3] // (rows[0][3] + rows[1][3])


def test_a_crowded_sieve_changes_nothing(spark):
    rows = list(corpus(random.Random(3), 200))
    chunks = collocations.parse(spark.createDataFrame(rows, "text string, lang string"), "text", "lang", 3).cache()
    roomy, crowded = (sorted(tuple(r) for r in collocations.phrase_counts(chunks, 4, 6, bits).collect()) for bits in (20, 6))
    assert roomy == crowded and len(roomy) > 50


def test_words_and_pieces():
    texts = ["One  two\tTHREE. four", "", None, "ÄÖ é,x", ".,;", "a\x0bb c\x1cd"]
    got = []
    for _, part in passes(pa.array(texts)):
        words, bounds = collocations.pieces(part)
        for a, b in zip(bounds, bounds[1:]):
            got.append([words.texts.data[s:e].tobytes().decode() for s, e in zip(words.starts[a:b], words.ends[a:b])])
    assert got == [w for t in texts for w in plain_pieces(t) if w]
