"""Queries of the corpus readers, chunkers and the rest of the tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import chunking
from ..sources import corpus
from ..sources.shared import shared_folder
from ..streaming import chats as streams
from .registry import query, table


def _docs(spark, d):
    return table(spark, d, "documents")


@query("src1_corpus_files", "SELECT source AS category, count(*) AS lines, sum(length(replace(replace(text, chr(10), ' '), chr(13), ' ')))::BIGINT AS chars FROM documents WHERE source NOT IN ('src3', 'src5') AND text IS NOT NULL GROUP BY source")
def src1(spark, d):
    """The documents as files in a folder for each category, listed without two ignored folders and read whole."""
    root = f"{shared_folder(spark)}/files-{uuid.uuid4().hex}"
    _docs(spark, d).filter("text IS NOT NULL").select("source", F.translate("text", "\n\r", "  ").alias("value")).write.partitionBy("source").text(root)
    found = corpus.files(spark, root, ["source=src3/", "source=src5/"]).select(F.regexp_extract("path", "source=([^/]+)/", 1).alias("category"), F.col("content").cast("string").alias("text"))
    lines = found.select("category", F.explode(F.split(F.regexp_replace("text", r"\n\z", ""), "\n")).alias("line"))
    return lines.groupBy("category").agg(F.count(F.lit(1)).alias("lines"), F.sum(F.char_length("line").cast("long")).alias("chars"))


_MISSING = "concat_ws(', ', CASE WHEN doc_id % 5 = 0 OR coalesce(trim(lang), '') = '' THEN 'title' END, CASE WHEN coalesce(trim(text), '') = '' THEN 'text' END)"


@query("src2_json_lines", f"SELECT doc_id AS number, CASE WHEN error IS NULL THEN lang END AS title, CASE WHEN error IS NULL THEN sha256(text) END AS sha, error FROM (SELECT *, CASE WHEN doc_id % 7 = 0 THEN 'not JSON' WHEN {_MISSING} <> '' THEN 'missing: ' || {_MISSING} END AS error FROM documents)")
def src2(spark, d):
    good = F.to_json(F.struct(F.concat(F.lit("a"), F.col("doc_id").cast("string")).alias("id"), F.when(F.col("doc_id") % 5 != 0, F.col("lang")).alias("title"), "text"))
    lines = _docs(spark, d).select(F.col("doc_id").alias("number"), F.when(F.col("doc_id") % 7 == 0, F.concat(F.lit("{bad "), good)).otherwise(good).alias("value"))
    fine = lambda c: F.when(F.col("error").isNull(), c)
    return corpus.json_lines(lines).select("number", fine(F.col("row.title")).alias("title"), fine(F.sha2("row.text", 256)).alias("sha"), "error")


# the text of a section, without the signs that would open another one; compared without white space
_SECTION = r"sha256('Heading' || n || regexp_replace(translate(coalesce(text, ''), '#<', ''), '\s+', '', 'g'))"


@query("src3_markdown_sections", f"SELECT doc_id, n AS number, 'Heading ' || n AS heading, CASE WHEN n = 2 THEN 'own' ELSE lang END AS category, {_SECTION} AS sha FROM documents, (SELECT unnest([1, 2, 3]) AS n)")
def src3(spark, d):
    part = lambda n, c: F.concat(F.lit(f"## Heading {n}\n{c}\n"), F.translate(F.coalesce("text", F.lit("")), "#<", ""), F.lit("\n\n"))
    text = F.concat(F.lit("---\ncategory: "), "lang", F.lit("\nproduct: p\n---\nintro\n\n"), part(1, ""), part(2, "<!-- category: own; status: archived -->"), part(3, ""))
    sections = corpus.markdown_sections(_docs(spark, d).select("doc_id", text.alias("value")))
    return sections.select("doc_id", "number", "heading", F.col("meta")["category"].alias("category"), F.sha2(F.regexp_replace("text", r"\s+", ""), 256).alias("sha"))


@query("src4_html_articles")
def src4(spark, d):
    return table(spark, d, "pages").select("page_id", corpus.page("html").alias("p")).select("page_id", "p.*")


@query("src5_knowledge_base", "SELECT 'a' || doc_id AS id, lang AS product, source || ',' || lang AS keywords, sha256(text) AS sha FROM documents")
def src5(spark, d):
    article = F.struct(F.concat(F.lit("a"), F.col("doc_id").cast("string")).alias("id"), F.col("lang").alias("product"), F.array("source", "lang").alias("keywords"), "text")
    articles = corpus.knowledge_base(_docs(spark, d).select(F.to_json(F.struct(F.array(article).alias("articles"))).alias("value")))
    return articles.select("id", "product", F.array_join("keywords", ",").alias("keywords"), F.sha2("text", 256).alias("sha"))


@query("src7_tagged_logs", "SELECT 'answer' AS kind, count(*) AS n, sum(event_id) AS total FROM events WHERE event_id % 2 = 0 UNION ALL SELECT 'score', count(*), sum(event_id) FROM events WHERE event_id % 2 = 1")
def src7(spark, d):
    lines = table(spark, d, "events").select(F.to_json(F.struct(F.when(F.col("event_id") % 2 == 0, "answer").otherwise("score").alias("kind"), F.col("event_id").alias("id"))).alias("value"))
    split = corpus.tagged(lines, "kind", {"answer": "id long", "score": "id long"})
    return split["answer"].withColumn("kind", F.lit("answer")).unionByName(split["score"].withColumn("kind", F.lit("score"))).groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.sum("id").alias("total"))


@query("flt4_required_fields", "SELECT doc_id, CASE WHEN doc_id % 6 = 0 THEN 'missing title' WHEN coalesce(trim(text), '') = '' THEN 'missing text' WHEN doc_id % 5 = 0 THEN 'status draft' END AS reason FROM documents")
def flt4(spark, d):
    rows = _docs(spark, d).select("doc_id", F.when(F.col("doc_id") % 6 != 0, "t").otherwise(" ").alias("title"), "text", F.col("source").alias("category"), F.col("lang").alias("product"), F.when(F.col("doc_id") % 5 == 0, "draft").otherwise("actual").alias("status"))
    return corpus.accepted(rows).select("doc_id", "reason")


@query("flt5_repeated_keys", "SELECT md5(text) AS key, count(*) AS n, min(source) AS first, max(source) AS last FROM documents GROUP BY 1 HAVING count(*) > 1")
def flt5(spark, d):
    return corpus.repeated_keys(_docs(spark, d).select(F.md5("text").alias("key"), "source"), "key", "source")


@query("flt6_gold_validation", "SELECT o_orderkey AS question, CASE WHEN o_custkey % 9 = 0 THEN 'unknown id' WHEN o_custkey % 9 = o_orderkey % 9 THEN 'repeated id' END AS error FROM orders WHERE o_custkey % 9 = 0 OR o_custkey % 9 = o_orderkey % 9 OR o_orderkey % 9 = 0".replace("WHEN o_custkey % 9 = 0 THEN", "WHEN o_custkey % 9 = 0 OR o_orderkey % 9 = 0 THEN"))
def flt6(spark, d):
    gold = table(spark, d, "orders").select(F.col("o_orderkey").alias("question"), F.array(F.col("o_custkey") % 9, F.col("o_orderkey") % 9).alias("ids"))
    known = spark.range(1, 9).toDF("id")
    unknown = gold.select("question", F.explode("ids").alias("id")).join(F.broadcast(known), "id", "left_anti").select("question").distinct().withColumn("u", F.lit(True))
    error = F.when(F.col("u"), "unknown id").when(F.size(F.array_distinct("ids")) < F.size("ids"), "repeated id")
    return gold.join(unknown, "question", "left").select("question", error.alias("error")).filter("error IS NOT NULL")


@query("flt7_score_guard", "SELECT l_orderkey AS question, max(l_discount) AS best, max(l_discount) >= 0.05 AS passed FROM lineitem GROUP BY 1")
def flt7(spark, d):
    return table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("question")).agg(F.max("l_discount").alias("best")).withColumn("passed", F.col("best") >= 0.05)


@query("chk1_fixed_chunks")
def chk1(spark, d):
    return chunking.chunked(_docs(spark, d))


@query("chk2_recursive_chunks")
def chk2(spark, d):
    return chunking.chunked(_docs(spark, d), how="recursive")


@query("agg9_chunk_stats")
def agg9(spark, d):
    return chunking.stats(chunking.chunked(_docs(spark, d)))


@query(
    "win14_semantic_boundaries",
    """WITH one AS (SELECT l_orderkey AS doc_id, l_linenumber AS place, min(l_partkey) AS part, arg_min(l_discount, (l_partkey, l_discount)) AS distance FROM lineitem GROUP BY 1, 2),
    l AS (SELECT doc_id, quantile_cont(distance, 0.95) AS lim FROM one GROUP BY 1)
    SELECT doc_id, place, part, coalesce(sum(CASE WHEN distance > lim THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS chunk FROM one JOIN l USING (doc_id)""",
)
def win14(spark, d):
    one = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("place")).agg(F.min(F.struct("l_partkey", "l_discount")).alias("r"))
    rows = one.select("doc_id", "place", F.col("r.l_partkey").alias("part"), F.col("r.l_discount").alias("distance"))
    return chunking.boundaries(rows).select("doc_id", "place", "part", "chunk")


@query("agg10_inventory", "SELECT source AS category, lang AS format, count(*) AS files, sum(n_chars) AS bytes FROM documents GROUP BY ROLLUP (source, lang)")
def agg10(spark, d):
    return _docs(spark, d).withColumnsRenamed({"source": "category", "lang": "format"}).rollup("category", "format").agg(F.count(F.lit(1)).alias("files"), F.sum("n_chars").alias("bytes"))


@query("top1_top_n", "SELECT doc_id, n_chars FROM documents ORDER BY n_chars DESC, doc_id LIMIT 20")
def top1(spark, d):
    return _docs(spark, d).select("doc_id", "n_chars").orderBy(F.desc("n_chars"), "doc_id").limit(20)


_CONTEXT = "SELECT l_orderkey AS question, l_linenumber AS n, l_partkey AS f, l_suppkey AS s FROM (SELECT DISTINCT ON (l_orderkey, l_linenumber) * FROM lineitem ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey)"


@query("top4_numbered_context", f"SELECT question, string_agg('[' || n || '] (f' || f || ')' || chr(10) || 's' || s, chr(10) || chr(10) ORDER BY n) AS context FROM ({_CONTEXT}) GROUP BY question")
def top4(spark, d):
    one = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("question"), F.col("l_linenumber").alias("n")).agg(F.min(F.struct("l_partkey", "l_suppkey")).alias("r"))
    text = lambda c: F.col(c).cast("string")
    line = F.concat(F.lit("["), text("n"), F.lit("] (f"), text("r.l_partkey"), F.lit(")\ns"), text("r.l_suppkey"))
    return one.groupBy("question").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n", line.alias("line")))), lambda x: x["line"]), "\n\n").alias("context"))


@query("top3_rerank_order", "SELECT l_orderkey AS question, l_linenumber AS position, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_discount DESC, l_linenumber, l_partkey) AS rank, l_partkey AS part FROM lineitem QUALIFY rank <= 2")
def top3(spark, d):
    from pyspark.sql import Window

    order = Window.partitionBy("l_orderkey").orderBy(F.desc("l_discount"), "l_linenumber", "l_partkey")
    return table(spark, d, "lineitem").withColumn("rank", F.row_number().over(order)).filter("rank <= 2").select(F.col("l_orderkey").alias("question"), F.col("l_linenumber").alias("position"), "rank", F.col("l_partkey").alias("part"))


@query("set1_union_of_readers", "SELECT 'd' AS kind, count(*) AS n FROM documents UNION ALL SELECT 'p', count(*) FROM pages")
def set1(spark, d):
    both = _docs(spark, d).select(F.lit("d").alias("kind"), "text").unionByName(table(spark, d, "pages").select(F.lit("p").alias("kind"), F.col("html").alias("text")))
    return both.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query("snk4_replace_merge", "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN 'fresh' ELSE 'old' END AS state FROM orders")
def snk4(spark, d):
    old = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.lit("old").alias("state"))
    fresh = old.filter("id % 3 = 0").withColumn("state", F.lit("fresh"))
    return old.join(fresh.select("id"), "id", "left_anti").unionByName(fresh)


@query("win13_rate_limit")
def win13(spark, d):
    return streams.rate_limited_batch(table(spark, d, "events").select(F.col("user_id").cast("string").alias("client"), "ts"), 2, 86400.0)


@query("fn19_score_thresholds", "SELECT event_id, array_to_string(list_filter([CASE WHEN value >= 50 THEN 'a' END, CASE WHEN value % 7 >= 3 THEN 'b' END], lambda x: x IS NOT NULL), ',') AS categories FROM events")
def fn19(spark, d):
    scores = F.create_map(F.lit("a"), F.col("value"), F.lit("b"), F.col("value") % 7)
    limits = F.create_map(F.lit("a"), F.lit(50.0), F.lit("b"), F.lit(3.0))
    over = F.map_filter(scores, lambda k, v: v >= F.element_at(limits, k))
    return table(spark, d, "events").select("event_id", F.array_join(F.array_sort(F.map_keys(over)), ",").alias("categories"))
