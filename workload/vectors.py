"""Text, embeddings, retrieval, digests and outliers on the fixture tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.functions.vectors import DEFAULT_DIM, numeric_vector
from tarn.operators import content, generation, growing_index, outliers, similarity, vector_store
from tarn.operators.ranking import newest_rows
from tarn.plans import daily
from tarn.session import scratch_path
from tarn.sources.lake import Lake, with_source_date, write_day
from workload.landing import ORACLE as LANDING_ORACLE
from workload.landing import log_table
from workload.tables import table

DAY = "2024-01-15"


def activities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as media activity, with some blank fields."""
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("Id"),
        F.col("source").alias("Name"),
        F.nullif(F.col("lang"), F.lit("fr")).alias("Type"),
        F.when(F.col("lang") == "es", " \n").otherwise(F.col("text")).alias("ShortOverview"),
    )


def content_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = content.build_content(activities(spark, sf_dir), "jellyfin")
    return content.with_record_id(rows).select("id", "content")


def content_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    pools = table(spark, sf_dir, "supplier").select(
        F.when(F.col("s_acctbal") > 0, F.col("s_name")).alias("name"),
        F.when(F.col("s_nationkey") > 5, "ONLINE").alias("status"),
        (F.col("s_acctbal") * 1e8).cast("bigint").alias("allocated"),
        F.when(F.col("s_nationkey") > 12, F.col("s_suppkey") * 268435456).alias("free"),
    )
    rows = content.build_content(pools, "truenas")
    return content.with_record_id(rows).select("id", "content")


def content_weather(spark: SparkSession, sf_dir: str) -> DataFrame:
    readings = table(spark, sf_dir, "events").select(
        F.col("event_id").alias("ID"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm").alias("timestamp"),
        F.col("value").alias("temperature_2m"),
        F.col("user_id").alias("relative_humidity_2m"),
        F.when(F.col("event_type") != "view", F.col("value")).alias("precipitation"),
        F.col("user_id").alias("wind_speed_10m"),
    )
    rows = content.build_content(readings, "weather")
    return content.with_record_id(rows).select("id", "content")


def content_voice(spark: SparkSession, sf_dir: str) -> DataFrame:
    exports = table(spark, sf_dir, "conversations").select(
        F.when(F.col("turn") > 1, F.col("text")).alias("query"),
        F.when(F.col("role") == "user", " ").otherwise(F.col("role")).alias("device"),
        F.when(F.col("turn") == 1, F.concat(F.lit("turn of "), "role")).alias("note"),
    )
    rows = content.build_content(exports, "alexa")
    return content.with_record_id(rows).select("id", "content")


def content_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = content.build_content(log_table(spark, sf_dir), "truenas_logs")
    return content.with_record_id(rows).select("id", "log_type", "content")


def embed_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = content.embedding_rows(activities(spark, sf_dir), "jellyfin", DAY)
    weighed = F.transform("embedding", lambda w, i: F.struct(i.alias("bucket"), w.alias("weight")))
    entries = rows.select("id", F.explode(F.filter(weighed, lambda e: e["weight"] != 0)).alias("e"))
    return entries.select("id", "e.bucket", F.round("e.weight", 9).alias("weight"))


def embed_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents landed as a raw day, embedded by the daily job and read back."""
    lake = Lake(spark, scratch_path(spark, "embed"))
    write_day(with_source_date(activities(spark, sf_dir), DAY), lake.root, DAY, source="jellyfin")
    daily.embed_sources(lake, DAY, ["jellyfin", "weather"])
    return daily.embeddings(lake).select(
        "id",
        "source",
        F.md5("content").alias("content_md5"),
        F.size(F.filter("embedding", lambda w: w != 0)).alias("buckets"),
        F.date_format("source_date", "yyyy-MM-dd").alias("source_date"),
    )


def embed_changed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as activity on two days. On the second a third of the texts are new, the others keep their vectors."""
    store = scratch_path(spark, "vectors")
    first = activities(spark, sf_dir)
    edited = F.when(F.col("Id") % 3 == 0, F.concat(F.lit("Edited "), "Name")).otherwise(F.col("Name"))
    vector_store.changed_embedding_rows(first.where("Id % 7 <> 0"), "jellyfin", DAY, store).count()
    second = vector_store.changed_embedding_rows(first.withColumn("Name", edited), "jellyfin", "2024-01-16", store)
    return second.select(
        "id",
        F.md5("content").alias("content_md5"),
        F.size(F.filter("embedding", lambda w: w != 0)).alias("buckets"),
        F.date_format("first_day", "yyyy-MM-dd").alias("first_day"),
    )


def _vectors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """All vectors, and those with an id divisible by 20 as questions."""
    rows = table(spark, sf_dir, "embeddings")
    return rows.select(F.col("vec_id").alias("id"), "label", "embedding"), rows.where("vec_id % 20 = 0").select(
        F.col("vec_id").alias("query_id"), "embedding"
    )


def _hits(df: DataFrame) -> DataFrame:
    return df.select("query_id", "id", "label", "rank", F.round("score", 6).alias("score"))


def cosine_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hits(similarity.cosine_topk(*_vectors(spark, sf_dir), k=10, dim=64))


def cosine_topk_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same answer when the questions are too many to send to every task at once."""
    return _hits(similarity.cosine_topk(*_vectors(spark, sf_dir), k=10, dim=64, question_bytes=4 * 1024))


def ann_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hits(similarity.ann_topk(*_vectors(spark, sf_dir), k=10, dim=64))


def ann_every_cell(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every cell looked into at once."""
    return _hits(similarity.ann_topk(*_vectors(spark, sf_dir), k=10, dim=64, cells=16, probes=16))


def ann_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same search over rows stored by cell."""
    rows, questions = _vectors(spark, sf_dir)
    path = scratch_path(spark, "index")
    similarity.build_index(rows, path, 64)
    return _hits(similarity.search_index(spark, path, questions, k=10))


def ann_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index over a quarter of the vectors takes the rest in three batches, one of them twice; crowded cells are split."""
    rows, questions = _vectors(spark, sf_dir)
    path = scratch_path(spark, "grown")
    similarity.build_index(rows.where("id % 4 = 0"), path, 64)
    for part in (1, 2, 3, 2):
        growing_index.append_index(spark, path, rows.where(F.col("id") % 4 == part), f"part {part}", most_rows=60)
    return _hits(similarity.search_index(spark, path, questions, k=10))


def _document_hits(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Benchmark texts as questions to the documents."""
    questions = table(spark, sf_dir, "benchmark").select(
        F.col("item_id").alias("query_id"), F.col("text").alias("question")
    )
    rows = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("id"), "source", F.col("text").alias("content")
    )
    rows = content.embed(rows).withColumn("ingested_at", F.lit("2024-01-16 06:30:00").cast("timestamp"))
    asked = content.embed(questions, text="question").select("query_id", "embedding")
    return questions, similarity.cosine_topk(rows, asked, k=5, dim=DEFAULT_DIM)


def rag_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return generation.rag_context(_document_hits(spark, sf_dir)[1])


def rag_context_cited(spark: SparkSession, sf_dir: str) -> DataFrame:
    return generation.rag_context(_document_hits(spark, sf_dir)[1], "cited")


def rag_answer(spark: SparkSession, sf_dir: str) -> DataFrame:
    questions, hits = _document_hits(spark, sf_dir)
    return generation.rag_answer(questions, generation.rag_context(hits))


def daily_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").withColumn("source", F.col("role"))
    digest = generation.daily_digest(rows, DAY, "text", ["conv_id", "turn"])
    return digest.withColumn("date", F.date_format("date", "yyyy-MM-dd"))


def _share(rows: DataFrame, planted: str) -> float:
    """The share of planted rows, so that as many rows are flagged."""
    total, found = rows.agg(F.count("*"), F.count_if(F.expr(planted))).first()
    return (found + 0.5) / total


def _planted_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vectors; one in fifty is many times longer than the others."""
    rows = table(spark, sf_dir, "embeddings")
    longer = F.transform("embedding", lambda x: x * F.when(F.expr("vec_id % 50 = 7"), 40.0).otherwise(1.0))
    return rows.select("vec_id", "label", longer.alias("embedding"))


def vector_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _planted_vectors(spark, sf_dir)
    flagged = outliers.isolation_forest(rows, "embedding", ["vec_id"], _share(rows, "vec_id % 50 = 7"))
    return flagged.select("vec_id", "label", "is_anomaly")


def numeric_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items; those of some orders are far larger in every number."""
    planted = "l_orderkey % 97 = 3"
    factor = F.when(F.expr(planted), 1000.0).otherwise(1.0)
    items = table(spark, sf_dir, "lineitem")
    numbers = [F.col(c) * factor for c in ("l_quantity", "l_extendedprice")]
    numbers += [(F.col(c) + 0.01) * factor for c in ("l_discount", "l_tax")]
    key = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    rows = items.select(*key, numeric_vector(*numbers).alias("features"))
    flagged = outliers.isolation_forest(rows, "features", key, _share(items, planted))
    return flagged.groupBy("l_orderkey").agg(F.count_if("is_anomaly").alias("flagged"), F.count("*").alias("line_items"))


def anomaly_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _planted_vectors(spark, sf_dir)
    flagged = outliers.isolation_forest(rows, "embedding", ["vec_id"], _share(rows, "vec_id % 50 = 7"))
    named = flagged.withColumn("content", F.concat(F.lit("vector "), "vec_id"))
    return generation.anomaly_report(named, "vectors", ["vec_id"], chunk_bytes=64)


def newest_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest rows, as the outlier job may be told to use."""
    events = table(spark, sf_dir, "events")
    return newest_rows(events, "ts", 5000, "event_id")


QUERIES = {
    "content_media": content_media,
    "content_pool": content_pool,
    "content_weather": content_weather,
    "content_voice": content_voice,
    "content_logs": content_logs,
    "embed_documents": embed_documents,
    "embed_day": embed_day,
    "embed_changed": embed_changed,
    "cosine_topk": cosine_topk,
    "cosine_topk_rounds": cosine_topk_rounds,
    "ann_topk": ann_topk,
    "ann_every_cell": ann_every_cell,
    "ann_index": ann_index,
    "ann_append": ann_append,
    "rag_context": rag_context,
    "rag_context_cited": rag_context_cited,
    "rag_answer": rag_answer,
    "daily_digest": daily_digest,
    "vector_outliers": vector_outliers,
    "numeric_outliers": numeric_outliers,
    "anomaly_report": anomaly_report,
    "newest_events": newest_events,
}

_MEDIA = r"""
    SELECT CAST(doc_id AS VARCHAR) AS id,
           concat_ws(' | ', CASE WHEN regexp_matches(source, '\S') THEN source END, nullif(lang, 'fr'),
                     CASE WHEN lang <> 'es' AND regexp_matches(text, '\S') THEN text END) AS content
    FROM documents
"""


def _weights(rows: str, key: str, text: str) -> str:
    """Hashed token weights of every text, as rows."""
    return rf"""
        SELECT {key}, bucket, n / sqrt(sum(n * n) OVER (PARTITION BY {key})) AS weight
        FROM (
            SELECT {key}, CAST(('0x' || substr(md5(token), 1, 8)) AS BIGINT) % {DEFAULT_DIM} AS bucket,
                   CAST(count(*) AS DOUBLE) AS n
            FROM (SELECT {key}, unnest(regexp_split_to_array(lower({text}), '[^\p{{L}}\p{{N}}]+')) AS token
                  FROM {rows})
            WHERE token <> '' GROUP BY 1, 2
        )
    """


_TOPK = """
    SELECT query_id, id, label, rank, round(score, 6) AS score
    FROM (
        SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INTEGER) AS rank
        FROM (
            SELECT q.vec_id AS query_id, v.vec_id AS id, v.label,
                   round(list_cosine_similarity(v.embedding::DOUBLE[], q.embedding::DOUBLE[]), 9) AS score
            FROM embeddings q CROSS JOIN embeddings v WHERE q.vec_id % 20 = 0
        ) WHERE NOT isnan(score)
    ) WHERE rank <= 10
"""

_HITS = f"""
    WITH d AS ({_weights('documents', 'doc_id', 'text')}),
    q AS ({_weights('benchmark', 'item_id', 'text')}),
    scored AS (
        SELECT item_id AS query_id, doc_id AS id, round(sum(d.weight * q.weight), 9) AS score
        FROM d JOIN q USING (bucket) GROUP BY 1, 2
    ),
    hits AS (
        SELECT s.*, source, text AS content,
               row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank
        FROM scored s JOIN documents ON doc_id = id
        QUALIFY rank <= 5
    ),
    plain AS (
        SELECT query_id, string_agg('[' || source || '] ' || content, chr(10) ORDER BY rank) AS context
        FROM hits GROUP BY 1
    )
"""


def _lines(text: str) -> str:
    return rf"list_filter(string_split({text}, chr(10)), lambda x: regexp_matches(x, '\S'))"


def _extract(context: str) -> str:
    return f"array_to_string(list_transform({_lines(context)}, lambda x: '- ' || x), chr(10))"


def _folded(rows: str, order: str, chunk_bytes: int) -> str:
    """Chunks of ``rows`` (source, text, place) and a summary per source."""
    return rf"""
        sized AS (
            SELECT *, greatest(1, CAST(ceil(sum(strlen(text)) OVER (PARTITION BY source) / {chunk_bytes}::DOUBLE) AS BIGINT))
                AS chunks
            FROM ({rows}) WHERE text IS NOT NULL
        ),
        chunks AS (
            SELECT source, CAST(('0x' || substr(md5(place), 1, 8)) AS BIGINT) % chunks AS part,
                   string_agg(text, chr(10) ORDER BY {order}) AS texts, count(*) AS n
            FROM sized GROUP BY ALL
        ),
        folded AS (
            SELECT source, string_agg('- ' || coalesce({_lines('texts')}[1], '') || ' (' || n || ' rows)', chr(10)
                ORDER BY part) || chr(10) || sum(n) || ' rows' AS summary
            FROM chunks GROUP BY source
        )
    """


ORACLE = {
    "content_media": _MEDIA,
    "content_pool": """
        WITH c AS (
            SELECT 'Pool ' || CASE WHEN s_acctbal > 0 THEN s_name ELSE 'unknown' END || ': ' ||
                   CASE WHEN s_nationkey > 5 THEN 'ONLINE' ELSE 'unknown' END || ', ' ||
                   printf('%.1f', trunc(s_acctbal * 1e8) / 1073741824.0) || 'GB used, ' ||
                   printf('%.1f', CASE WHEN s_nationkey > 12 THEN s_suppkey * 0.25::DOUBLE ELSE 0 END) ||
                   'GB free' AS content
            FROM supplier
        )
        SELECT md5(content) AS id, content FROM c
    """,
    "content_weather": """
        SELECT CAST(event_id AS VARCHAR) AS id,
               'Weather ' || strftime(ts, '%Y-%m-%dT%H:%M') || ': ' || value || 'F apparent F, ' || user_id ||
               '% humidity, ' || CASE WHEN event_type <> 'view' THEN CAST(value AS VARCHAR) ELSE '0' END ||
               'in precip, ' || user_id || 'mph wind' AS content
        FROM events
    """,
    "content_voice": r"""
        WITH c AS (
            SELECT coalesce(
                CASE WHEN turn > 1 AND regexp_matches(text, '\S') THEN text END,
                nullif(concat_ws(' | ', CASE WHEN role <> 'user' THEN role END,
                                 CASE WHEN turn = 1 THEN 'turn of ' || role END), ''),
                'Alexa activity') AS content
            FROM conversations
        )
        SELECT md5(content) AS id, content FROM c
    """,
    "content_logs": f"SELECT id, log_type, content FROM ({LANDING_ORACLE['log_table']})",
    "embed_documents": f"""
        WITH m AS ({_MEDIA})
        SELECT id, CAST(bucket AS INTEGER) AS bucket, round(weight, 9) AS weight
        FROM ({_weights('m', 'id', 'content')})
    """,
    "embed_day": f"""
        WITH m AS ({_MEDIA}), w AS ({_weights('m', 'id', 'content')})
        SELECT id, 'jellyfin' AS source, md5(content) AS content_md5, CAST(count(*) AS INTEGER) AS buckets,
               '2024-01-15' AS source_date
        FROM m JOIN w USING (id) GROUP BY id, content
    """,
    "embed_changed": f"""
        WITH documents AS (
            SELECT doc_id, lang, text, CASE WHEN doc_id % 3 = 0 THEN 'Edited ' || source ELSE source END AS source, source AS old_source
            FROM main.documents
        ),
        m AS ({_MEDIA}), old AS ({_MEDIA.replace("source", "old_source")} WHERE doc_id % 7 <> 0), w AS ({_weights('m', 'id', 'content')})
        SELECT id, md5(content) AS content_md5, CAST(count(*) AS INTEGER) AS buckets,
               CASE WHEN content IN (SELECT content FROM old) THEN '2024-01-15' ELSE '2024-01-16' END AS first_day
        FROM m JOIN w USING (id) GROUP BY id, content
    """,
    "cosine_topk": _TOPK,
    "cosine_topk_rounds": _TOPK,
    "ann_topk": _TOPK,
    "ann_index": _TOPK,
    "ann_append": _TOPK,
    "ann_every_cell": _TOPK,
    "rag_context": f"{_HITS} SELECT query_id, context FROM plain",
    "rag_context_cited": f"""
        {_HITS}
        SELECT query_id, string_agg('[' || source || ' @ 2024-01-16 06:30:00 (score=' ||
               CAST(round(score, 4) AS VARCHAR) || ')]:' || chr(10) || content, chr(10) || chr(10)
               ORDER BY rank) AS context
        FROM hits GROUP BY 1
    """,
    "rag_answer": f"""
        {_HITS}
        SELECT query_id, text AS question,
               'You are an assistant that answers questions about home data.' || chr(10) || chr(10) ||
               'Context from data lake:' || chr(10) || context || chr(10) || chr(10) || 'Question: ' || text
                   AS prompt,
               {_extract('context')} AS answer
        FROM plain JOIN benchmark ON item_id = query_id
    """,
    "daily_digest": f"""
        WITH {_folded("SELECT role AS source, conv_id, turn, text, concat_ws('|', conv_id, turn) AS place FROM conversations",
                      "conv_id, turn", 32768)}
        SELECT source, '2024-01-15' AS date, summary FROM folded
    """,
    "vector_outliers": "SELECT vec_id, label, vec_id % 50 = 7 AS is_anomaly FROM embeddings",
    "numeric_outliers": """
        SELECT l_orderkey, CASE WHEN l_orderkey % 97 = 3 THEN count(*) ELSE 0 END AS flagged, count(*) AS line_items
        FROM lineitem GROUP BY 1
    """,
    "anomaly_report": f"""
        WITH {_folded("SELECT 'vectors' AS source, vec_id, 'vector ' || vec_id AS text, CAST(vec_id AS VARCHAR) AS place "
                      "FROM embeddings WHERE vec_id % 50 = 7", "vec_id", 64)}
        SELECT source, summary AS report FROM folded
    """,
    "newest_events": "SELECT * FROM events ORDER BY ts DESC, event_id LIMIT 5000",
}
