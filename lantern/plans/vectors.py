"""Queries of the vector jobs; embeddings play the points, every twentieth id the queries."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..operators import vectors
from .registry import query, table

POINTS = """
    SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS embedding, 'c' || label AS category, 's' || (vec_id % 5) AS source,
           TIMESTAMP '2024-01-01' + to_hours(CAST(vec_id AS INTEGER)) AS created_at,
           CASE vec_id % 7 WHEN 0 THEN 'archived' WHEN 1 THEN NULL ELSE 'actual' END AS status
    FROM embeddings"""
KEEP = "category = 'c3' AND created_at >= TIMESTAMP '2024-01-03' AND coalesce(status, '') <> 'archived'"


def points(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("id"), "embedding", F.concat(F.lit("c"), F.col("label").cast("string")).alias("category"), F.concat(F.lit("s"), (F.col("vec_id") % 5).cast("string")).alias("source"),
        F.timestamp_seconds(F.unix_timestamp(F.lit("2024-01-01 00:00:00").cast("timestamp")) + F.col("vec_id") * 3600).alias("created_at"),
        F.when(F.col("vec_id") % 7 == 0, "archived").when(F.col("vec_id") % 7 == 1, F.lit(None)).otherwise("actual").alias("status"),
    )


def asked(spark, sf_dir):
    return points(spark, sf_dir).filter("id % 20 = 0").select(F.col("id").alias("query_id"), "embedding")


def _top(score: str, where: str, k: int) -> str:
    return f"""SELECT query_id, rank, id, round(score, 6) AS score FROM (SELECT q.id AS query_id, p.id, {score} AS score, row_number() OVER (PARTITION BY q.id ORDER BY round({score}, 12) DESC, p.id) AS rank
    FROM ({POINTS}) q JOIN ({POINTS}) p ON true WHERE q.id % 20 = 0 AND {where}) WHERE rank <= {k}"""


COSINE, DOT = "list_cosine_similarity(q.embedding, p.embedding)", "list_inner_product(q.embedding, p.embedding)"


@query("flt1_payload_filter", f"SELECT id, category, status FROM ({POINTS}) WHERE {KEEP}")
def flt1(spark, sf_dir):
    return points(spark, sf_dir).filter(vectors.matching("c3", created_after="2024-01-03 00:00:00")).select("id", "category", "status")


@query("flt8_wrong_size", f"SELECT id, len(embedding) AS size, 64 AS expected FROM (SELECT id, CASE WHEN id % 9 = 0 THEN embedding[:60] ELSE embedding END AS embedding FROM ({POINTS})) WHERE len(embedding) <> 64")
def flt8(spark, sf_dir):
    cut = F.when(F.col("id") % 9 == 0, F.slice("embedding", 1, 60)).otherwise(F.col("embedding"))
    return vectors.wrong_size(points(spark, sf_dir).withColumn("embedding", cut), 64)


@query("jn3_filtered_top_k", _top(COSINE, KEEP.replace("category", "p.category").replace("created_at", "p.created_at").replace("status", "p.status"), 5))
def jn3(spark, sf_dir):
    kept = points(spark, sf_dir).filter(vectors.matching("c3", created_after="2024-01-03 00:00:00"))
    return vectors.top_k(asked(spark, sf_dir), kept, 5).withColumn("score", F.round("score", 6))


@query("jn4_top_k_dot", _top(DOT, "true", 10))
def jn4(spark, sf_dir):
    return vectors.top_k(asked(spark, sf_dir), points(spark, sf_dir), 10, "dot").withColumn("score", F.round("score", 6))


@query("top2_per_question_top_k", _top(COSINE, "true", 5))
def top2(spark, sf_dir):
    return vectors.top_k(asked(spark, sf_dir), points(spark, sf_dir), 5).withColumn("score", F.round("score", 6))


@query(
    "jn16_agreement",
    f"""WITH a AS ({_top(COSINE, "true", 5)}), b AS ({_top(DOT, "true", 5)})
    SELECT query_id, x = y AS same_order, coalesce(shared, 0) AS shared, shared IS NOT NULL AS any_shared FROM (SELECT query_id, list(id ORDER BY rank) AS x FROM a GROUP BY 1) JOIN (SELECT query_id, list(id ORDER BY rank) AS y FROM b GROUP BY 1) USING (query_id)
    LEFT JOIN (SELECT a.query_id, count(*) AS shared FROM a JOIN b USING (query_id, id) GROUP BY 1) USING (query_id)""",
)
def jn16(spark, sf_dir):
    q, p = asked(spark, sf_dir), points(spark, sf_dir)
    found = vectors.agreement(vectors.top_k(q, p, 5), vectors.top_k(q, p, 5, "dot"))
    return found.select("query_id", "same_order", "shared", F.col("most_apart").isNotNull().alias("any_shared"))


@query(
    "fn25_vector_maths",
    f"SELECT id, round(sqrt(list_inner_product(embedding, embedding)), 6) AS norm, round(list_cosine_similarity(embedding, list_reverse(embedding)), 6) AS cosine, abs(sqrt(list_inner_product(embedding, embedding)) - 1) <= 1e-3 AS unit FROM ({POINTS})",
)
def fn25(spark, sf_dir):
    e = F.col("embedding")
    return points(spark, sf_dir).select("id", F.round(vectors.norm(e), 6).alias("norm"), F.round(vectors.cosine(e, F.reverse(e)), 6).alias("cosine"), (F.abs(vectors.norm(e) - 1) <= 1e-3).alias("unit"))


_FRESH = f"SELECT id, CASE WHEN id % 4 = 0 THEN category || 'x' ELSE category END AS category, source FROM ({POINTS}) WHERE id % 3 <> 0"
_CURRENT = f"SELECT id, category, source FROM ({POINTS}) WHERE id % 5 <> 0"


def _snapshots(spark, sf_dir):
    p = points(spark, sf_dir).select("id", "category", "source")
    return p.filter("id % 5 <> 0"), p.filter("id % 3 <> 0").withColumn("category", F.when(F.col("id") % 4 == 0, F.concat("category", F.lit("x"))).otherwise(F.col("category")))


@query(
    "snk1_upsert",
    f"""SELECT id, coalesce(b.category, a.category) AS category, coalesce(b.source, a.source) AS source, CASE WHEN b.id IS NULL THEN 'left' WHEN a.id IS NULL THEN 'inserted' WHEN a.category = b.category AND a.source = b.source THEN 'left' ELSE 'updated' END AS action
    FROM ({_CURRENT}) a FULL JOIN ({_FRESH}) b USING (id)""",
)
def snk1(spark, sf_dir):
    return vectors.upserted(*_snapshots(spark, sf_dir), ["category", "source"])


@query("snk2_stale_points", f"SELECT id FROM ({_CURRENT}) WHERE id NOT IN (SELECT id FROM ({_FRESH}))")
def snk2(spark, sf_dir):
    return vectors.stale(*_snapshots(spark, sf_dir))


@query("set2_id_difference", f"SELECT id FROM ({_FRESH}) EXCEPT SELECT id FROM ({_CURRENT})")
def set2(spark, sf_dir):
    current, fresh = _snapshots(spark, sf_dir)
    return vectors.stale(fresh, current)


@query("agg25_cache_contents", f"SELECT source AS model, len(embedding) AS dim, count(*) AS n FROM ({POINTS}) GROUP BY ALL")
def agg25(spark, sf_dir):
    return points(spark, sf_dir).groupBy(F.col("source").alias("model"), F.size("embedding").alias("dim")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "fn26_trigram_buckets",
    """SELECT conv_id, turn, bucket, count(*) AS n FROM (SELECT conv_id, turn, CAST('0x' || substr(h, 7, 2) || substr(h, 5, 2) || substr(h, 3, 2) || substr(h, 1, 2) AS BIGINT) % 4096 AS bucket FROM (
    SELECT conv_id, turn, md5(substr(low, i, 3)) AS h FROM (SELECT conv_id, turn, ' ' || lower(text) || ' ' AS low, unnest(range(1, greatest(length(text), 1) + 1)) AS i FROM conversations))) GROUP BY ALL""",
)
def fn26(spark, sf_dir):
    return vectors.trigram_counts(table(spark, sf_dir, "conversations"), ["conv_id", "turn"], "text")


def _lengths(texts: list[str]) -> np.ndarray:
    """A stand-in model: characters, bytes, words."""
    return np.array([[len(t), len(t.encode()), t.count(" ") + 1] for t in texts], np.float32)


@query(
    "jn6_embedding_cache",
    """SELECT doc_id, list_contains(['en', 'de'], lang) OR text IN (SELECT text FROM documents WHERE lang IN ('en', 'de')) AS cached, length(text) AS chars FROM documents WHERE trim(text) <> ''""",
)
def jn6(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text").filter(F.trim("text") != "")
    cache = vectors.embedded(docs.filter(F.col("lang").isin("en", "de")), "text", _lengths)
    return vectors.with_cache(docs, "text", cache, _lengths).select("doc_id", "cached", F.col("vector")[0].cast("long").alias("chars"))


@query("flt9_empty_texts", "SELECT doc_id FROM (SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN '  ' ELSE text END AS text FROM documents) WHERE trim(text) = ''")
def flt9(spark, sf_dir):
    text = F.when(F.col("doc_id") % 10 == 0, F.lit("  ")).otherwise(F.col("text"))
    return table(spark, sf_dir, "documents").withColumn("text", text).filter(F.trim("text") == "").select("doc_id")
