"""Queries of the text functions, over documents and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import questions, texts
from .registry import query, table

NAMESPACE = "3b8f6c1e-2d4a-4f7b-9c5e-8a1d0e6f4b27"
_PATH = "CASE WHEN doc_id % 5 = 0 THEN '' ELSE source || '/' END || 'file_' || lang || CASE WHEN doc_id % 3 = 0 THEN '_v' || (doc_id % 7) || '.' || (doc_id % 4) ELSE '' END || CASE doc_id % 3 WHEN 0 THEN '.pdf' WHEN 1 THEN '.md' ELSE '.html' END"


def _docs(spark, sf_dir):
    return table(spark, sf_dir, "documents")


def _path():
    return F.expr(_PATH.replace("(doc_id % 7)", "cast(doc_id % 7 as string)").replace("(doc_id % 4)", "cast(doc_id % 4 as string)"))


@query("fn1_redact_pii")
def fn1(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", texts.masked(F.col("text")).alias("masked"))


@query("fn2_pii_counts")
def fn2(spark, sf_dir):
    counted = _docs(spark, sf_dir).select(F.explode(texts.masked_counts(F.col("text"))).alias("label", "n"))
    return counted.groupBy("label").agg(F.sum("n").alias("n"), F.count_if(F.col("n") > 0).alias("texts"))


@query("fn3_preview")
def fn3(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", texts.preview(F.col("text")).alias("preview"))


@query("fn4_fingerprints", "SELECT doc_id, 'sha256:' || substr(sha256(text), 1, 16) AS fingerprint FROM documents")
def fn4(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.concat(F.lit("sha256:"), texts.fingerprint(F.col("text"))).alias("fingerprint"))


@query("fn5_masked_log_rows")
def fn5(spark, sf_dir):
    row = F.create_map(F.lit("request_id"), F.lpad(F.col("conv_id").cast("string"), 12, "1"), F.lit("phone"), F.concat(F.lit("8 495 123-45-"), F.lpad((F.col("turn") % 100).cast("string"), 2, "0")), F.lit("text"), F.col("text"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.to_json(texts.masked_map(row)).alias("row"))


@query(
    "fn6_normalized_question",
    "SELECT conv_id, turn, trim(regexp_replace(regexp_replace(lower(text), '[.,!?;:«»\"''()\\[\\]{}…—–-]+', ' ', 'g'), '[ \\t\\n\\r\\f\\v\\x{00a0}\\x{1680}\\x{2000}-\\x{200b}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}\\x{feff}]+', ' ', 'g'), ' ') AS question FROM conversations",
)
def fn6(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", questions.normalized_question(F.col("text")).alias("question"))


@query(
    "fn8_clean_text",
    "SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(regexp_replace(text, '\\r\\n?', chr(10), 'g'), chr(160), ' '), '[ \\t\\v\\f]+\\n', chr(10), 'g'), '\\n{3,}', chr(10) || chr(10), 'g'), '^\\s+', ''), '\\s+$', '') AS clean FROM documents",
)
def fn8(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", texts.clean(F.col("text")).alias("clean"))


@query("fn9_clean_upload")
def fn9(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.sha2(texts.clean_upload(F.col("text")), 256).alias("sha"))


@query(
    "fn10_file_metadata",
    f"""SELECT doc_id, CASE WHEN path LIKE '%/%' THEN split_part(path, '/', 1) ELSE 'general' END AS category,
    nullif(regexp_extract(regexp_replace(path, '\\.(pdf|docx|html|htm|md|txt)$', ''), '[_-][vV](\\d+(?:\\.\\d+)*)$', 1), '') AS version, path || '' AS file FROM (SELECT doc_id, {_PATH} AS path FROM documents)""",
)
def fn10(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", _path().alias("path")).select("doc_id", texts.category_of(F.col("path")).alias("category"), texts.version_of(F.col("path")).alias("version"), texts.file_of(F.concat("path", F.lit("#p2"))).alias("file"))


@query("fn11_utc_text", "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS at, strftime(ts, '%Y-%m-%d') AS day FROM events")
def fn11(spark, sf_dir):
    text = F.concat(F.date_format(F.timestamp_add("hour", F.lit(3), F.col("ts")), "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+03:00"))
    return table(spark, sf_dir, "events").select("event_id", texts.utc(text).alias("at"), texts.iso_date(F.date_format("ts", "'D:'yyyyMMddHHmmss")).alias("day"))


@query(
    "fn12_stable_ids",
    f"""SELECT doc_id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab', (instr('0123456789abcdef', substr(h, 17, 1)) - 1) % 4 + 1, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS id
    FROM (SELECT doc_id, sha1(unhex('{NAMESPACE.replace("-", "")}') || encode(source || '#' || doc_id)) AS h FROM documents)""",
)
def fn12(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", texts.uuid5(NAMESPACE, F.concat_ws("#", "source", F.col("doc_id").cast("string"))).alias("id"))


@query("fn13_cache_keys", """SELECT doc_id, sha256('["trigram", "' || lang || '", "' || source || '"]') AS key FROM documents""")
def fn13(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", texts.cache_key(F.lit("trigram"), F.col("lang"), F.col("source")).alias("key"))


_ANSWER = "text || ' [' || (doc_id % 9) || ', ' || (doc_id % 4) || '] [' || (doc_id % 6 + 1) || '] .'"


def _answers(spark, sf_dir):
    n = lambda e: F.expr(f"cast({e} as string)")
    return _docs(spark, sf_dir).select("doc_id", F.concat("text", F.lit(" ["), n("doc_id % 9"), F.lit(", "), n("doc_id % 4"), F.lit("] ["), n("doc_id % 6 + 1"), F.lit("] .")).alias("answer"))


@query("fn14_citations", f"SELECT doc_id, array_to_string(list_sort(list_distinct(list_filter([doc_id % 9, doc_id % 4, doc_id % 6 + 1], lambda x: x BETWEEN 1 AND 5))), ',') AS cited FROM documents")
def fn14(spark, sf_dir):
    return _answers(spark, sf_dir).select("doc_id", F.array_join(F.transform(texts.cited(F.col("answer"), F.lit(5)), lambda x: x.cast("string")), ",").alias("cited"))


@query("fn15_without_citations", "SELECT doc_id, trim(regexp_replace(text || '.', '[ \\t]+([.,;:!?])', '\\1', 'g'), E' \\n\\t\\r') AS plain FROM documents")
def fn15(spark, sf_dir):
    return _answers(spark, sf_dir).select("doc_id", texts.without_citations(F.col("answer")).alias("plain"))


@query("fn16_refusals", "SELECT conv_id, turn, conv_id % 4 = 0 AS refused FROM conversations")
def fn16(spark, sf_dir):
    answer = F.when(F.col("conv_id") % 4 == 0, F.concat(F.lit("К сожалению, По базе не нашел, "), "text")).otherwise(F.col("text"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", texts.is_refusal(answer).alias("refused"))


_STEM = "CASE WHEN rtrim(w, 'аеиоуыэюяйь') = '' THEN w ELSE rtrim(w, 'аеиоуыэюяйь') END[:5]"


@query(
    "fn17_terms",
    "SELECT conv_id, turn, s AS term FROM (SELECT DISTINCT conv_id, turn, (CASE WHEN rtrim(w, 'аеиоуыэюяйь') = '' THEN w ELSE rtrim(w, 'аеиоуыэюяйь') END)[:5] AS s FROM (SELECT conv_id, turn, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')) AS w FROM conversations)) WHERE length(s) > 1",
)
def fn17(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.explode(texts.terms(F.col("text"))).alias("term"))


@query("fn23_ticket_category", "SELECT conv_id, turn, CASE conv_id % 4 WHEN 0 THEN 'FAQ' WHEN 1 THEN 'тех. проблема' WHEN 2 THEN 'жалоба' ELSE 'прочее' END AS category FROM conversations")
def fn23(spark, sf_dir):
    said = F.element_at(F.array(*map(F.lit, ("Это частый вопрос, не жалоба", "Техническая проблема!", "«Жалоба» (тех. проблема)", "непонятно"))), (F.col("conv_id") % 4 + 1).cast("int"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", texts.ticket_category(said).alias("category"))


@query("fn24_json_object", "SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events")
def fn24(spark, sf_dir):
    answer = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("Вот ответ:\n```json\n"), "props", F.lit("\n``` готово"))).otherwise(F.concat(F.lit("ответ "), "props", F.lit(" всё")))
    return table(spark, sf_dir, "events").select("event_id", F.from_json(texts.json_object(answer), "k int")["k"].alias("k"))


@query("fn27_token_counts", "SELECT doc_id, CAST(ceil(strlen(text) / 4.0) AS BIGINT) AS tokens FROM documents")
def fn27(spark, sf_dir):
    from ..operators.chat_history import tokens

    return _docs(spark, sf_dir).select("doc_id", tokens(F.col("text")).alias("tokens"))


@query(
    "fn27_truncated",
    "SELECT doc_id, CASE WHEN strlen(text) <= 196 THEN text ELSE text[:list_max(list_filter(range(0, 197), lambda k: strlen(text[:k]) <= 196))] END AS text FROM documents",
)
def fn27_truncated(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", texts.truncated(F.col("text"), 49).alias("text"))


@query(
    "fn9_shortened",
    r"""SELECT doc_id, CASE WHEN length(text) <= 300 THEN text ELSE regexp_replace(text[:cut], '\s+$', '') || chr(10) || '[…текст обрезан: показано ' || cut || ' из ' || length(text) || ' символов]' END AS text
    FROM (SELECT doc_id, text, CASE WHEN strpos(reverse(text[271:300]), ' ') > 0 THEN 300 - strpos(reverse(text[271:300]), ' ') ELSE 300 END AS cut FROM documents)""".replace("\\s", "\s"),
)
def fn9_shortened(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", texts.shortened(F.col("text"), 300).alias("text"))


@query("fn28_prefixes", "SELECT doc_id, sha256(CASE doc_id % 3 WHEN 0 THEN 'passage: ' WHEN 1 THEN 'search_document: ' ELSE '' END || text) AS sha FROM documents")
def fn28(spark, sf_dir):
    model = F.element_at(F.array(F.lit("intfloat/multilingual-e5-small"), F.lit("nomic-embed-text"), F.lit("bge-m3")), (F.col("doc_id") % 3 + 1).cast("int"))
    return _docs(spark, sf_dir).select("doc_id", F.sha2(texts.with_prefix(model, F.col("text"), False), 256).alias("sha"))


@query("fn29_clean_query", "SELECT conv_id, turn, nullif(trim(split_part(trim(text, E' \\n'), chr(10), 1))[:300], '') AS query FROM conversations")
def fn29(spark, sf_dir):
    raw = F.concat(F.lit("\n  Вопрос: «"), F.substring_index(F.trim(F.col("text"), F.lit(" \n")), "\n", 1), F.lit("»\nеще строка"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", texts.clean_query(raw).alias("query"))


@query("fn30_normal_forms", "SELECT doc_id, lower(trim(regexp_replace(replace(replace(text, chr(160), ' '), chr(8239), ' '), '\\s+', ' ', 'g'))) AS quotes, translate(lower(source), '–—', '--') AS keywords FROM documents")
def fn30(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", texts.for_quotes(F.col("text")).alias("quotes"), texts.for_keywords(F.col("source")).alias("keywords"))
