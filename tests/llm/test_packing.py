import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarn.llm import packing


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(packing.tokenizer_path())


def expected(tokenizer, text):
    return np.array(tokenizer.encode(text or "", add_special_tokens=False).ids + [2], "<u4")


def check(got, texts, tokenizer, window):
    sequences, pieces = {}, {}
    for r in got:
        ids = expected(tokenizer, texts[r.doc_id])
        assert r.doc_tokens == len(ids)
        assert zlib.crc32(ids[r.start : r.start + r.length].tobytes()) == r.ids_crc32
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
        pieces.setdefault(r.doc_id, []).append((r.start, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= window
    return sequences, pieces


def test_odd_rows(odd_docs, odd_rows, no_docs, tokenizer):
    docs = odd_docs.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    cut = packing.cut_documents(docs.withColumns({"ids": F.lit("old"), "batch": F.lit(1)}), packing.tokenizer_path())
    packed = packing.pack(cut.cache()).cache()
    texts = {r[0]: r[1] for r in odd_rows}
    sequences, pieces = check(packed.collect(), texts, tokenizer, packing.WINDOW)
    for i, parts in pieces.items():
        at = 0
        for start, length in sorted(parts):
            assert start == at
            at += length
        assert at == len(expected(tokenizer, texts[i]))
    filled = packing.sequences(packed).collect()
    assert {r.sequence_id: r.n_tokens for r in filled} == {k: sum(n for _, n in v) for k, v in sequences.items()}
    assert all(len(r.ids) == packing.WINDOW or len(r.ids) & (len(r.ids) - 1) == 0 for r in filled)
    assert packing.pack_documents(no_docs).count() == 0
    assert packing.pack_documents(odd_docs).count() >= len(odd_rows)


def test_words_are_encoded_like_whole_texts(tokenizer, odd_rows):
    words = packing.WordTokens(packing.tokenizer_path())
    hard = ["Don't STOP  now", "a b c\x1cd\x85e", "ΣΟΦΟΣ İstanbul ǅ", "é ́x ﬁ", "<|endoftext|> x<|startoftext|>y", "1234 5,6\r\n\tx", "Ärger--- straße?? x'y. ÉÉ!! İ! ª º.", "a\x0bb\x0cc\u2003d\u3000e\u1680f\u2028g"]
    for text in [*hard, *(t or "" for _, t, *_ in odd_rows)]:
        assert words.encode(text) == expected(tokenizer, text)[:-1].tobytes()


@pytest.mark.parametrize("ways", [1, 2, 3, 7, 40])
def test_differencing(ways):
    rng = np.random.default_rng(ways)
    sizes = rng.integers(1, 1000, 200)
    part = packing.differencing(sizes, ways)
    sums = np.bincount(part, weights=sizes, minlength=ways)
    assert sums.sum() == sizes.sum() and len(sums) == ways
    assert sums.max() - sums.min() <= (2 if ways < 8 else 150)
    assert packing.differencing(np.array([], int), 3).tolist() == []


def test_the_window_count_rises_when_one_overflows():
    part = packing.windows_for(np.array([6, 6, 6]), 10)
    assert sorted(np.bincount(part, weights=[6, 6, 6])) == [6, 6, 6]


def test_little_padding(spark):
    got = packing.op7_pack_windows(spark, "/root/testdata/sf0.1").toPandas()
    assert got.length.sum() / (packing.WINDOW * got.sequence_id.nunique()) > 0.97
