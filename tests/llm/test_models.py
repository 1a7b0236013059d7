import numpy as np
import pytest
from pyspark.sql import functions as F

from tarn.llm import quality, toxicity
from tarn.llm.common import labelled_texts
from tarn.llm.linear import fit_logistic, sigmoid

SF = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet").toPandas().set_index("doc_id")


def test_toxicity_on_held_out_rows(spark, labels):
    got = toxicity.op4_toxicity(spark, SF).toPandas().set_index("doc_id")
    assert len(got) == 10_000 and got.score.between(0, 1).all()
    assert ((got.score >= 0.5) == (got.predicted == 1)).all()
    held = got[got.held_out].join(labels, how="inner")
    clean, toxic = held[held.toxic == 0], held[held.toxic == 1]
    assert (clean.predicted == 0).mean() > 0.99
    # Some toxic labels are on junk without any toxic word.
    assert (toxic.predicted == 1).mean() > 0.9


def test_toxicity_of_odd_rows(spark, odd_docs, odd_rows, no_docs):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    got = toxicity.toxicity_scores(odd_docs.withColumn("score", F.lit("old")), none).collect()
    assert len(got) == len(odd_rows) and all(0 <= r.score <= 1 for r in got)
    some = spark.createDataFrame([(1, 1), (7, 0), (8, None), (None, 1)], "doc_id long, toxic int")
    assert toxicity.toxicity_scores(odd_docs, some).count() == len(odd_rows)
    assert toxicity.toxicity_scores(no_docs, none).count() == 0


def test_label_model_finds_accurate_and_dependent_voters():
    rng = np.random.default_rng(0)
    y = rng.random(40_000) < 0.1
    voters = toxicity.Voters(np.arange(5, dtype=np.uint64), {3: np.zeros(0, np.uint64)})
    m = voters.count
    votes = np.zeros((len(y), m), np.uint8)
    for j, (hit, miss) in enumerate([(0.6, 0.001), (0.5, 0.002), (0.4, 0.001), (0.3, 0.2)]):
        votes[:, j] = np.where(y, rng.random(len(y)) < hit, rng.random(len(y)) < miss)
    votes[:, 4] = votes[:, 0]
    model = toxicity.fit_label_model(len(y), votes.astype(float).T @ votes, voters, 0.1)
    assert model.dependent[0, 4] and model.weights[0] < 0.8 * np.log(0.6 / 0.001)
    assert model.weights[1] > 3 and abs(model.weights[3]) < 1
    assert model.hits[2] == pytest.approx(0.4, abs=0.15)


def test_quality_on_held_out_rows(spark, labels):
    got = quality.op5_empirical_bayes(spark, SF).toPandas().set_index("doc_id")
    assert len(got) == 10_000 and got.score.between(0, 1).all()
    held = got[got.held_out].join(labels, how="inner")
    assert held[held.quality == 1].kept.mean() > 0.99 and held[held.quality == 0].kept.mean() < 0.1


def test_quality_of_odd_rows(spark, odd_docs, odd_rows, no_docs):
    none = spark.createDataFrame([], "doc_id long, quality int")
    clashing = odd_docs.withColumns({"share": F.lit("mine"), "evidence": F.lit("old"), "host": F.lit(1)})
    got = quality.quality_scores(clashing, none).collect()
    assert len(got) == len(odd_rows) and all(r.share == "mine" and 0 <= r.score <= 1 for r in got)
    some = spark.createDataFrame([(1, 1), (7, 0), (10, 1)], "doc_id long, quality int")
    assert quality.quality_scores(odd_docs, some).count() == len(odd_rows)
    assert quality.quality_scores(no_docs, none).count() == 0


def test_sparse_sites_shrink(spark):
    rng = np.random.default_rng(1)
    rows = []
    for host in range(40):
        rate = 0.95 if host % 2 else 0.45
        n = 3 if host == 0 else 200
        rows += [(f"h{host}", f"p{k % 2}", float(rng.random() < rate)) for k in range(n)]
    df = spark.createDataFrame(rows, "host string, path string, share double")
    rates, centre = quality.site_rates(df, "host", "path", "share")
    got = {(r.host, r.path): r for r in rates.collect()}
    assert 0.6 < centre < 0.8
    assert got["h1", "p0"].host_rate > 0.88 and got["h2", "p0"].host_rate < 0.55
    own = np.mean([s for h, _, s in rows if h == "h0"])
    assert abs(got["h0", "p0"].host_rate - centre) < abs(own - centre)


def test_logistic_fit():
    rng = np.random.default_rng(2)
    x = rng.standard_normal((5000, 3))
    y = (rng.random(5000) < sigmoid(x @ [2, -1, 0] + 0.5)).astype(float)
    weights, bias = fit_logistic(x, y)
    assert np.allclose(weights, [2, -1, 0], atol=0.2) and abs(bias - 0.5) < 0.2
    assert fit_logistic(x[:0], y[:0])[0].tolist() == [0, 0, 0]


def test_small_shares_still_draw_rows(spark):
    """One row in more than 2**20: a share that a coarse threshold rounds to nothing."""
    n = 6_000_000
    ids = spark.range(n).withColumnsRenamed({"id": "doc_id"})
    labels = ids.withColumn("toxic", (F.col("doc_id") % 2).cast("int"))
    found, prior = labelled_texts(ids.withColumn("text", F.lit("a b c")), labels, "text", "doc_id", "toxic", sample=5)
    assert 1 <= found.count() <= 20 and prior == 0.5


def test_empty_samples_of_full_tables_fail(spark, no_docs):
    labels = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit(1).alias("toxic"))
    other = spark.createDataFrame([(-1, "a b"), (-2, "c d")], "doc_id long, text string")
    with pytest.raises(ValueError, match="labelled"):
        labelled_texts(other, labels, "text", "doc_id", "toxic", sample=100)
    assert labelled_texts(no_docs, labels, "text", "doc_id", "toxic", sample=100)[0].count() == 0
    assert labelled_texts(other, labels, "text", "doc_id", "toxic", sample=10_000)[0].count() == 0
    voters = toxicity.Voters(np.arange(5, dtype=np.uint64), {})
    model = toxicity.fit_label_model(2, np.zeros((voters.count, voters.count)), voters, 0.1)
    with pytest.raises(ValueError, match="sample"):
        toxicity.fit_classifier(other, "text", "doc_id", 10**15, voters, model)
