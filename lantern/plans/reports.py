"""Queries of the report tables; events and line items play the answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import reports
from .registry import query, table


def _events(spark, d):
    return table(spark, d, "events")


@query("agg14_judged_answers", "SELECT round(avg(CASE WHEN event_id % 11 <> 0 THEN event_id % 5 + 1 END), 2) AS mean, min(CASE WHEN event_id % 11 <> 0 THEN event_id % 5 + 1 END) AS least, round(avg(event_id % 4 / 4.0), 3) AS keyword_recall, count(*) FILTER (WHERE event_id % 9 = 0) AS violations, count(*) FILTER (WHERE event_id % 11 = 0) AS errors FROM events")
def agg14(spark, d):
    e = F.col("event_id")
    items = _events(spark, d).select(F.when(e % 11 != 0, e % 5 + 1).alias("correctness"), ((e % 4) / 4.0).alias("keyword_recall"), (e % 9 == 0).cast("int").alias("violations"), F.when(e % 11 == 0, "x").alias("error"))
    return reports.judged_answers(items)


@query("agg17_shares_by_group", "SELECT 'all' AS \"group\", count(*) AS n, round(avg(CASE WHEN value > 30 THEN 1.0 ELSE 0 END), 4) AS share FROM events UNION ALL SELECT 'free', count(*), round(avg(CASE WHEN value > 30 THEN 1.0 ELSE 0 END), 4) FROM events WHERE event_type IN ('click', 'view') UNION ALL SELECT 'golden', count(*), round(avg(CASE WHEN value > 30 THEN 1.0 ELSE 0 END), 4) FROM events WHERE user_id % 2 = 0")
def agg17(spark, d):
    rows = _events(spark, d).withColumn("flag", F.col("value") > 30)
    return reports.shares_by_group(rows, [("all", F.lit(True)), ("free", F.col("event_type").isin("click", "view")), ("golden", F.col("user_id") % 2 == 0)], "flag")


@query("agg16_free_checks", "SELECT round(avg(CASE WHEN p <= 5 THEN 1.0 ELSE 0 END), 4) AS hit, round(avg(CASE WHEN p <= 5 THEN 1.0 / p ELSE 0 END), 4) AS mrr, round(avg(CASE WHEN event_id % 3 = 0 THEN 1.0 ELSE 0 END), 4) AS marked FROM (SELECT event_id, event_id % 7 + 1 AS p FROM events)")
def agg16(spark, d):
    e = F.col("event_id")
    files = F.to_json(F.transform(F.sequence(F.lit(0), F.lit(6)), lambda i: F.concat(F.lit("f"), i.cast("string"))))
    rows = _events(spark, d).select(files.alias("files"), F.concat(F.lit("f"), (e % 7).cast("string")).alias("reference"), F.when(e % 3 == 0, "yes [1]").otherwise("yes").alias("answer"))
    return reports.free_checks(rows)


@query("agg23_implementations", "SELECT event_type AS implementation, round(avg(value), 4) AS value_mean, round(median(value), 4) AS value_p50, string_agg(DISTINCT 'm' || (user_id % 3), ',' ORDER BY 'm' || (user_id % 3)) AS models FROM events GROUP BY 1")
def agg23(spark, d):
    return reports.implementations(_events(spark, d).select(F.col("event_type").alias("implementation"), "value", F.concat(F.lit("m"), (F.col("user_id") % 3).cast("string")).alias("model")), ["value"])


@query(
    "agg24_pair_benchmark",
    """WITH s AS (SELECT l_orderkey AS query, l_linenumber AS n, l_extendedprice AS score, rank() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC) AS rank FROM lineitem),
    q AS (SELECT query, max(CASE WHEN n = 1 THEN score END) AS r, max(CASE WHEN n = 2 THEN score END) AS i, min(CASE WHEN n = 1 THEN rank END) AS rank FROM s GROUP BY 1)
    SELECT count(*) AS pairs, round(avg(CASE WHEN r > i THEN 1.0 ELSE 0 END), 4) AS accuracy, round(avg(r - i), 4) AS margin, round(avg(CASE WHEN rank <= 1 THEN 1.0 ELSE 0 END), 4) AS hit1, round(avg(CASE WHEN rank <= 3 THEN 1.0 ELSE 0 END), 4) AS hit3, round(avg(1.0 / rank), 4) AS mrr FROM q WHERE r IS NOT NULL AND i IS NOT NULL""",
)
def agg24(spark, d):
    kind = F.when(F.col("l_linenumber") == 1, "relevant").when(F.col("l_linenumber") == 2, "irrelevant").otherwise("other")
    return reports.pair_benchmark(table(spark, d, "lineitem").select(F.col("l_orderkey").alias("query"), F.col("l_partkey").alias("doc"), F.col("l_extendedprice").alias("score"), kind.alias("kind")))


@query("agg29_prompt_variants", "SELECT event_type AS variant, round(avg(CASE WHEN user_id % 3 <> 0 AND value > 5 THEN 1.0 WHEN user_id % 3 <> 0 THEN 0 END), 4) AS answered, round(avg(CASE WHEN user_id % 3 <> 0 AND value > 20 THEN 1.0 WHEN user_id % 3 <> 0 THEN 0 END), 4) AS cited, round(1 - avg(CASE WHEN user_id % 3 = 0 AND value > 5 THEN 1.0 WHEN user_id % 3 = 0 THEN 0 END), 4) AS refused, round(avg(CASE WHEN event_id % 6 <> 0 THEN value END), 4) AS seconds FROM events GROUP BY 1")
def agg29(spark, d):
    rows = _events(spark, d).select(F.col("event_type").alias("variant"), (F.col("user_id") % 3 != 0).alias("inside"), (F.col("value") > 5).alias("answered"), (F.col("value") > 20).alias("cited"), (F.col("event_id") % 6 == 0).alias("guarded"), F.col("value").alias("seconds"))
    return reports.prompt_variants(rows)


@query(
    "jn7_reranked",
    """SELECT question, rank, position, score, cached FROM (SELECT conv_id AS question, turn AS position, CAST(length(text) + length(role) AS DOUBLE) AS score, role = 'user' AS cached, row_number() OVER (PARTITION BY conv_id ORDER BY length(text) + length(role) DESC, turn) AS rank FROM conversations) WHERE rank <= 2""",
)
def jn7(spark, d):
    c = table(spark, d, "conversations").select(F.col("conv_id").alias("question"), F.col("turn").alias("position"), F.col("role").alias("query"), "text")
    key = F.sha2(F.concat_ws("\x1f", F.lit("m"), "query", "text"), 256)
    cache = c.filter("query = 'user'").select(key.alias("key"), (F.char_length("text") + F.char_length("query")).cast("double").alias("score")).distinct()
    return reports.reranked(c, cache, "m", lambda pairs: [len(q) + len(t) for q, t in pairs], 2)


@query(
    "top5_source_list",
    """SELECT doc_id // 5 AS question, doc_id % 5 + 1 AS id, source || '.md' AS file_name, 'docs/' || source AS source, lang AS category, doc_id % 4 AS page, coalesce(round((n_chars % 9973) / 9973.0, 3), 0) AS score,
    substring(trim(regexp_replace(coalesce(text, ''), '[\\s\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]+', ' ', 'g')), 1, 200) AS snippet, list_contains([doc_id // 5 % 5 + 1, doc_id // 5 % 3 + 1, doc_id // 5 % 7 + 1], doc_id % 5 + 1) AS cited FROM documents""",
)
def top5(spark, d):
    docs = table(spark, d, "documents").withColumn("question", F.expr("doc_id div 5"))
    name = F.concat("source", F.lit(".md"))
    fragments = docs.select("question", (F.col("doc_id") % 5 + 1).alias("number"), "text", name.alias("file_name"), F.concat(F.lit("docs/"), "source").alias("source"), F.col("lang").alias("category"), (F.col("doc_id") % 4).alias("page"), ((F.col("n_chars") % 9973) / 9973.0).alias("score"))
    n = lambda k: (F.col("question") % k + 1).cast("string")
    answers = docs.select("question").distinct().withColumn("answer", F.concat(F.lit("as ["), n(5), F.lit(", "), n(3), F.lit("] say and ["), n(7), F.lit("] too")))
    return reports.source_list(fragments, answers)
