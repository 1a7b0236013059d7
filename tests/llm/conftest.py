import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6))) for _ in range(n))


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls in every column, empty and very long texts, repeated rows, ties, and near copies."""
    rng = random.Random(4)
    base = words(rng, 200)
    rows = [
        (1, base, "en", "a", 1),
        (2, base, "en", "a", 1),
        (2, base, "en", "a", 1),
        (3, base.replace(" ", "  ", 3) + " tail", "de", "b", None),
        (4, None, None, None, None),
        (5, "", "en", "b", 0),
        (6, " \t\n", "en", "b", 3),
        (7, "one", "en", None, 3),
        (8, "One  TWO three", "en", "c", 3),
        (9, "one two three", "en", "c", 3),
        (10, words(rng, 60_000), "fr", "c", 9),
        (None, words(rng, 30), "fr", "c", 9),
        (11, "é😀 " * 40, "fr", "c", 9),
        (12, "<|im_end|> a\\b \n\n <script> #*$%&|<> </p>", "fr", "c", 9),
    ]
    rows += [(20 + i, words(rng, rng.randint(1, 80)), "en", rng.choice("abc"), 5) for i in range(60)]
    return rows


@pytest.fixture(scope="session")
def odd_docs(spark, odd_rows, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("docs") / "documents.parquet")
    spark.createDataFrame(odd_rows, SCHEMA).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
