import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarn.functions import text, vectors
from tarn.operators import content, generation
from tests.conftest import rows


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def content_of(spark, source, ddl, *data):
    df = content.build_content(spark.createDataFrame(list(data), ddl), source)
    return [r.content for r in df.select("content").collect()]


def test_media_text(spark):
    got = content_of(
        spark, "jellyfin", "Name string, Type string, ShortOverview string",
        ("Film", " ", None), (None, "", "\u00a0"), ("A", "B", "C"),
    )
    assert got == ["Film", "Jellyfin activity", "A | B | C"]
    assert content_of(spark, "jellyfin", "Id string", ("1",)) == ["Jellyfin activity"]


def test_pool_text_rounds_like_printf(spark):
    gib = 1 << 30
    got = content_of(
        spark, "truenas", "name string, status string, allocated long, free long",
        ("tank", "ONLINE", gib * 5 // 4, gib * 7 // 4), (None, None, None, None),
    )
    expected = f"Pool tank: ONLINE, {1.25:.1f}GB used, {1.75:.1f}GB free"
    assert got == [expected, "Pool unknown: unknown, 0.0GB used, 0.0GB free"]


def test_weather_text(spark):
    got = content_of(
        spark, "weather", "timestamp string, temperature_2m double, precipitation double",
        ("2025-05-27T14:00", 71.5, None),
    )
    assert got == ["Weather 2025-05-27T14:00: 71.5F apparent F, % humidity, 0in precip, mph wind"]


def test_voice_text(spark):
    ddl = "utterance string, query string, a string, b string, n int"
    got = content_of(
        spark, "alexa", ddl, (None, "play", "x", "y", 1), ("", None, "x", " ", 1), (None, None, None, "", 1)
    )
    assert got == ["play", "x", "Alexa activity"]


def test_log_text_and_own_rule(spark):
    assert content_of(spark, "truenas_logs", "content string", ("  a \n",), (" ",)) == ["a", "TrueNAS log entry"]
    content.register_content("shop", lambda df: F.upper("title"))
    assert content_of(spark, "shop", "title string", ("mug",)) == ["MUG"]


def test_record_ids(spark):
    df = spark.createDataFrame([(7, "x")], "Id int, content string")
    assert rows(content.with_record_id(df), "id") == [("7",)]
    df = spark.createDataFrame([("x",)], "content string")
    assert rows(content.with_record_id(df), "id") == [("9dd4e461268c8034f5c8564e155c67a6",)]


def reference_vector(value, dim):
    import hashlib

    out = np.zeros(dim)
    for token in re.findall(r"[^\W_]+", value.lower()):
        out[int(hashlib.md5(token.encode()).hexdigest()[:8], 16) % dim] += 1
    return out / (np.linalg.norm(out) or 1)


@pytest.mark.parametrize("value", ["The cat, the CAT and 2 dogs", "été à Zürich", "", " .,; ", "a" * 5000 + " b" * 5000])
def test_hashed_vector(spark, value):
    df = spark.createDataFrame([(value,)], "t string").select(vectors.hashed_vector(F.col("t"), 96).alias("v"))
    assert np.allclose(df.first().v, reference_vector(value, 96), atol=1e-12)


class CountingModel:
    """Records the largest batch in its own output."""

    dim, batch = 2, 100

    def embed(self, texts):
        assert len(texts) <= self.batch
        return [[float(len(t)), float(len(texts))] for t in texts]


def test_external_model_gets_batches(spark):
    df = spark.range(250).coalesce(1).select(F.col("id").cast("string").alias("content"))
    got = content.embed(df, CountingModel()).select("embedding").collect()
    assert sorted({r.embedding[1] for r in got}) == [50.0, 100.0]


def test_sizes_match_c_formatting(spark):
    import math

    def expected(n):
        if n == 0:
            return "0 B"
        e = min(int(math.log(n, 1024)), 4)
        return f"{n / 1024**e:.1f} {['B', 'KB', 'MB', 'GB', 'TB'][e]}"

    sizes = [0, 1, 1023, 1024, 1280, 1536, 1152, 1 << 20, (1 << 30) + (1 << 28), 1 << 40, 3 << 50, 10**15 + 7]
    df = spark.createDataFrame([(s,) for s in sizes], "n long").select("n", text.human_size(F.col("n")).alias("s"))
    assert {r.n: r.s for r in df.collect()} == {s: expected(s) for s in sizes}


@pytest.mark.parametrize(
    "name, slug",
    [("My Catalog", "my-catalog"), ("  a__b -- c ", "a-b-c"), ("Größe №5!", "größe-5"), ("!!!", "item"), ("", "item")],
)
def test_slugs(spark, name, slug):
    expected = re.sub(r"[\s_-]+", "-", re.sub(r"[^\w\s-]", "", name.lower())).strip("-") or "item"
    assert expected == slug
    assert one(spark, text.slugify(F.lit(name))) == slug


def test_freshness_edges(spark):
    now = F.lit("2025-05-10 00:00:00").cast("timestamp")

    def age(seconds):
        return one(spark, text.freshness(now - F.make_dt_interval(secs=F.lit(seconds)), now))

    assert [age(s) for s in (0, 25 * 3600, 25 * 3600 + 1, 48 * 3600, 48 * 3600 + 1)] == [
        "green", "green", "yellow", "yellow", "red",
    ]
    assert one(spark, text.freshness(F.lit(None).cast("timestamp"), now)) == "red"
    assert one(spark, text.timestamp_label(F.lit(None), "Never")) == "Never"
    assert one(spark, text.same_name(F.lit("Default"), F.lit("dEFAULT")))


def test_context_styles(spark):
    hits = spark.createDataFrame(
        [(1, 2, "b", "second", 0.0001, "2025-05-27 01:02:03"), (1, 1, "a", "first", 1.0, "2025-05-27 01:02:03.5")],
        "query_id int, rank int, source string, content string, score double, ingested_at string",
    )
    assert generation.rag_context(hits).first().context == "[a] first\n[b] second"
    assert generation.rag_context(hits, "cited").first().context == (
        "[a @ 2025-05-27 01:02:03.500000 (score=1.0)]:\nfirst\n\n[b @ 2025-05-27 01:02:03 (score=0.0001)]:\nsecond"
    )
    with pytest.raises(ValueError):
        generation.rag_context(hits, "other")


class Echo:
    batch = 2

    def generate(self, prompts):
        assert len(prompts) <= self.batch
        return [p.upper() for p in prompts]


def test_answers_come_from_the_model(spark):
    questions = spark.createDataFrame([(1, "why?"), (2, "no hits")], "query_id int, question string")
    contexts = spark.createDataFrame([(1, "[a] x")], "query_id int, context string")
    got = generation.rag_answer(questions, contexts, Echo()).collect()
    assert len(got) == 1 and got[0].answer == got[0].prompt.upper()
    assert got[0].prompt.endswith("Context from data lake:\n[a] x\n\nQuestion: why?")


def test_digest_holds_every_row(spark):
    data = [("s", i, None if i < 3 else f"line {i}") for i in range(10)] + [("empty", 0, None)]
    df = spark.createDataFrame(data, "source string, n int, t string")
    got = generation.daily_digest(df, "2025-05-27", "t", ["n"])
    assert rows(got.select("source", "summary")) == [("s", "- line 3 (7 rows)\n7 rows")]
    prompt = generation.daily_digest(df, "2025-05-27", "t", ["n"], Echo()).first().summary
    assert prompt == "SUMMARIZE THE FOLLOWING S ACTIVITY FROM 2025-05-27 IN 3-5 BULLET POINTS:\n\n" + "\n".join(
        f"LINE {i}" for i in range(3, 10)
    )


class Count:
    """Numbers in a prompt, summed up."""

    batch = 50

    def generate(self, prompts):
        return [str(sum(int(w) for w in re.findall(r"\b\d+\b", p.split("points:")[1]))) for p in prompts]


def test_rounds_lose_no_row(spark, monkeypatch):
    monkeypatch.setattr(generation, "COMBINED", 4)
    df = spark.range(2000).select(F.lit("s").alias("source"), "id", F.col("id").cast("string").alias("t"))
    got = generation.daily_digest(df, "2025-05-27", "t", ["id"], Count(), chunk_bytes=64).first()
    assert got.summary == str(sum(range(2000)))
    offline = generation.daily_digest(df, "2025-05-27", "t", ["id"], chunk_bytes=64).first().summary
    assert offline.endswith("\n2000 rows") and 2 <= len(offline.split("\n")) <= 5


def test_anomaly_report(spark):
    df = spark.createDataFrame([(i, f"row {i}", i % 2 == 0) for i in range(100)], "id int, content string, is_anomaly boolean")
    got = generation.anomaly_report(df, "logs", ["id"]).first()
    assert got.report == "- row 0 (50 rows)\n50 rows"
    none = generation.anomaly_report(df.where("not is_anomaly"), "logs", ["id"]).first()
    assert none.report == "No anomalies detected."
