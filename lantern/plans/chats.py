"""Queries of the chat store.

The conversations table plays the messages: chats are conversations, a chat's clock starts conv_id hours after
2024-01-01 and turn t comes t * (t + 3) seconds later; owner and interface follow from conv_id.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import chat_history, chat_stats
from ..sources import chat_store
from ..streaming import answers
from .registry import query, table

SINCE = dt.datetime(2024, 1, 3)
MESSAGES = """
    SELECT conv_id AS chat_id, turn AS seq, role, text AS content,
           TIMESTAMP '2024-01-01' + to_hours(CAST(conv_id AS INTEGER)) + to_seconds(CAST(turn * (turn + 3) AS DOUBLE)) AS created_at,
           'u' || (conv_id % 17) AS owner,
           CASE conv_id % 3 WHEN 0 THEN 'telegram' WHEN 1 THEN 'web' ELSE 'cli' END AS interface
    FROM conversations"""
INCIDENTS = """
    SELECT doc_id AS id, CASE WHEN doc_id % 2 = 0 THEN 'input' ELSE 'output' END AS direction,
           TIMESTAMP '2024-01-01' + to_seconds(CAST(doc_id * 60 AS DOUBLE)) AS created_at
    FROM labels WHERE toxic = 1"""
VOTES = """
    SELECT doc_id AS id, doc_id // 4 AS message_id, 'u' || (doc_id % 3) AS owner,
           CASE WHEN quality = 1 THEN 'up' ELSE 'down' END AS value,
           TIMESTAMP '2024-01-01' + to_seconds(CAST(doc_id * 90 AS DOUBLE)) AS created_at
    FROM labels"""
QUESTION = """trim(regexp_replace(regexp_replace(lower(content), '[.,!?;:«»"''()\\[\\]{}…—–-]+', ' ', 'g'),
    '[ \\t\\n\\r\\f\\v\\x{00a0}\\x{1680}\\x{2000}-\\x{200b}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}\\x{feff}]+', ' ', 'g'), ' ')"""
IN_PERIOD = "created_at >= TIMESTAMP '2024-01-03'"

FULL_STATS = f"""
WITH m AS ({MESSAGES}), i AS ({INCIDENTS}), v AS ({VOTES}),
lagged AS (SELECT role, created_at, lag(role) OVER w AS prev_role, lag(created_at) OVER w AS prev_at FROM m WINDOW w AS (PARTITION BY chat_id ORDER BY created_at, seq)),
q AS (SELECT question, count(*) AS n FROM (SELECT {QUESTION} AS question FROM m WHERE role = 'user' AND {IN_PERIOD}) WHERE question <> '' GROUP BY question ORDER BY n DESC, question LIMIT 5),
a AS (SELECT count(*) AS total_messages, count(*) FILTER (WHERE role = 'user') AS user_messages FROM m WHERE {IN_PERIOD}),
b AS (SELECT count(DISTINCT (interface, owner)) AS active_users FROM m WHERE role = 'user' AND {IN_PERIOD}),
c AS (SELECT round(avg((epoch_us(created_at) - epoch_us(prev_at)) / 1000), 1) AS avg_latency_ms FROM lagged WHERE role = 'assistant' AND prev_role = 'user' AND {IN_PERIOD}),
d AS (SELECT count(*) AS moderation_blocks, count(*) FILTER (WHERE direction = 'input') AS input_blocks FROM i WHERE {IN_PERIOD}),
e AS (SELECT count(*) FILTER (WHERE value = 'up') AS votes_up, count(*) FILTER (WHERE value = 'down') AS votes_down FROM v WHERE {IN_PERIOD}),
f AS (SELECT coalesce(string_agg(question || '=' || n, chr(10) ORDER BY n DESC, question), '') AS top_questions FROM q)
SELECT a.*, b.*, c.*, d.*, e.*, round(votes_up / nullif(votes_up + votes_down, 0), 4) AS up_ratio, f.*,
       CASE WHEN user_messages + input_blocks > 0 THEN round(moderation_blocks / (user_messages + input_blocks), 4) ELSE 0.0 END AS block_rate
FROM a, b, c, d, e, f"""


@query("agg6_full_stats", FULL_STATS)
def agg6_full_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_stats.full_stats(chat_store.messages(spark, sf_dir), chat_store.incidents(spark, sf_dir), chat_store.votes(spark, sf_dir), SINCE)


LIVE = f"SELECT *, CASE WHEN (chat_id + seq) % 11 = 0 THEN created_at + INTERVAL 1 DAY END AS deleted_at FROM ({MESSAGES})"
CHATS = f"SELECT chat_id, owner, interface, min(created_at) AS created_at FROM ({MESSAGES}) GROUP BY ALL"


def _m(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_store.messages(spark, sf_dir)


@query("src6_chat_messages", f"SELECT chat_id, seq, role, created_at, owner, interface, length(content) AS n FROM ({MESSAGES})")
def src6(spark, sf_dir):
    return _m(spark, sf_dir).select("chat_id", "seq", "role", "created_at", "owner", "interface", F.char_length("content").cast("long").alias("n"))


@query("flt2_live_messages", f"SELECT chat_id, seq FROM ({LIVE}) WHERE deleted_at IS NULL")
def flt2(spark, sf_dir):
    return chat_history.live(_m(spark, sf_dir)).select("chat_id", "seq")


@query("flt3_rolling_period", f"SELECT chat_id, seq, created_at FROM ({MESSAGES}) WHERE {IN_PERIOD}")
def flt3(spark, sf_dir):
    return _m(spark, sf_dir).filter(chat_stats.within(SINCE)).select("chat_id", "seq", "created_at")


@query("jn1_messages_of_chats", f"WITH m AS ({MESSAGES}), c AS ({CHATS}) SELECT m.chat_id, m.seq, c.owner, c.interface FROM m JOIN c USING (chat_id)")
def jn1(spark, sf_dir):
    return chat_history.with_chats(_m(spark, sf_dir), chat_store.chats(spark, sf_dir)).select("chat_id", "seq", "owner", "interface")


@query("agg1_message_counts", f"SELECT count(*) AS total_messages, count(*) FILTER (WHERE role = 'user') AS user_messages FROM ({MESSAGES}) WHERE {IN_PERIOD}")
def agg1(spark, sf_dir):
    return chat_stats.message_counts(_m(spark, sf_dir), SINCE)


@query("agg2_active_users", f"SELECT count(DISTINCT (interface, owner)) AS active_users FROM ({MESSAGES}) WHERE role = 'user' AND {IN_PERIOD}")
def agg2(spark, sf_dir):
    return chat_stats.active_users(_m(spark, sf_dir), SINCE)


@query("agg3_moderation_counts", f"SELECT count(*) AS moderation_blocks, count(*) FILTER (WHERE direction = 'input') AS input_blocks FROM ({INCIDENTS}) WHERE {IN_PERIOD}")
def agg3(spark, sf_dir):
    return chat_stats.moderation_counts(chat_store.incidents(spark, sf_dir), SINCE)


@query(
    "agg4_vote_counts",
    f"SELECT *, round(votes_up / nullif(votes_up + votes_down, 0), 4) AS up_ratio FROM (SELECT count(*) FILTER (WHERE value = 'up') AS votes_up, count(*) FILTER (WHERE value = 'down') AS votes_down FROM ({VOTES}) WHERE {IN_PERIOD})",
)
def agg4(spark, sf_dir):
    return chat_stats.vote_counts(chat_store.votes(spark, sf_dir), SINCE)


@query("agg5_top_questions", f"SELECT question, count(*) AS n FROM (SELECT {QUESTION} AS question FROM ({MESSAGES}) WHERE role = 'user' AND {IN_PERIOD}) WHERE question <> '' GROUP BY question ORDER BY n DESC, question LIMIT 5")
def agg5(spark, sf_dir):
    return chat_stats.top_questions(_m(spark, sf_dir), SINCE)


@query(
    "agg7_recent_users",
    f"""WITH m AS ({MESSAGES}), c AS ({CHATS}) SELECT c.owner, c.interface, count(DISTINCT c.chat_id) AS chats, greatest(max(c.created_at), coalesce(max(m.created_at), max(c.created_at))) AS last_seen
    FROM c LEFT JOIN m USING (chat_id) GROUP BY c.owner, c.interface ORDER BY last_seen DESC, c.owner, c.interface LIMIT 50""",
)
def agg7(spark, sf_dir):
    return chat_history.recent_users(chat_store.chats(spark, sf_dir), _m(spark, sf_dir))


@query("jn2_chats_left_messages", f"WITH m AS ({MESSAGES}), c AS ({CHATS}) SELECT c.chat_id, count(m.seq) AS answers FROM c LEFT JOIN (SELECT * FROM m WHERE role = 'assistant') m USING (chat_id) GROUP BY 1")
def jn2(spark, sf_dir):
    answers = _m(spark, sf_dir).filter("role = 'assistant'").select("chat_id", "seq")
    return chat_store.chats(spark, sf_dir).join(answers, "chat_id", "left").groupBy("chat_id").agg(F.count("seq").alias("answers"))


@query("agg8_recipients", f"SELECT owner, min(created_at) AS first_chat FROM ({CHATS}) WHERE interface = 'telegram' GROUP BY owner")
def agg8(spark, sf_dir):
    return chat_history.recipients(chat_store.chats(spark, sf_dir), "telegram")


@query(
    "win1_answer_latency",
    f"""SELECT round(avg((epoch_us(created_at) - epoch_us(prev_at)) / 1000), 1) AS avg_latency_ms FROM (SELECT role, created_at, lag(role) OVER w AS prev_role, lag(created_at) OVER w AS prev_at
    FROM ({MESSAGES}) WINDOW w AS (PARTITION BY chat_id ORDER BY created_at, seq)) WHERE role = 'assistant' AND prev_role = 'user' AND {IN_PERIOD}""",
)
def win1(spark, sf_dir):
    return chat_stats.answer_latency(_m(spark, sf_dir), SINCE)


@query(
    "win2_last_messages",
    f"""SELECT chat_id, seq, row_number() OVER (PARTITION BY chat_id ORDER BY created_at, seq) AS place FROM (SELECT *, row_number() OVER (PARTITION BY chat_id ORDER BY created_at DESC, seq DESC) AS back
    FROM ({LIVE}) WHERE deleted_at IS NULL) WHERE back <= 3 AND trim(content) <> ''""",
)
def win2(spark, sf_dir):
    return chat_history.last_messages(_m(spark, sf_dir), 3).select("chat_id", "seq", "place")


@query(
    "win3_fit_to_budget",
    f"""WITH a AS (SELECT *, CAST(ceil(strlen(content) / 4.0) AS BIGINT) + 4 AS cost, max(CASE WHEN role <> 'system' THEN 1 ELSE 0 END) OVER (PARTITION BY chat_id ORDER BY created_at, seq) AS others,
        row_number() OVER (PARTITION BY chat_id ORDER BY created_at DESC, seq DESC) AS back FROM ({MESSAGES})),
    b AS (SELECT *, others = 0 OR back = 1 AS always FROM a),
    c AS (SELECT *, sum(CASE WHEN always THEN cost ELSE 0 END) OVER (PARTITION BY chat_id) + 2 + sum(CASE WHEN always THEN 0 ELSE cost END) OVER (PARTITION BY chat_id ORDER BY created_at DESC, seq DESC) AS total FROM b)
    SELECT chat_id, seq, cost FROM c WHERE always OR total <= 200""",
)
def win3(spark, sf_dir):
    return chat_history.fit_to_budget(_m(spark, sf_dir), 200).select("chat_id", "seq", "cost")


@query(
    "win4_condensed_history",
    f"""SELECT chat_id, string_agg(line, chr(10) ORDER BY back DESC) AS history FROM (SELECT chat_id, back, role, CASE role WHEN 'user' THEN 'Пользователь: ' ELSE 'Ассистент: ' END || CASE WHEN length(t) > 400 THEN t[:400] || '…' ELSE t END AS line
    FROM (SELECT *, trim(regexp_replace(content, '\\s*\\[\\d+(?:\\s*,\\s*\\d+)*\\]', '', 'g')) AS t, row_number() OVER (PARTITION BY chat_id ORDER BY created_at DESC, seq DESC) AS back FROM ({MESSAGES}) WHERE role IN ('user', 'assistant')) WHERE back <= 6)
    GROUP BY chat_id HAVING bool_or(role = 'user')""",
)
def win4(spark, sf_dir):
    return chat_history.condensed(_m(spark, sf_dir))


@query(
    "win5_retrieval_query",
    f"SELECT chat_id, string_agg(content, chr(10) ORDER BY back DESC) AS query FROM (SELECT *, row_number() OVER (PARTITION BY chat_id ORDER BY created_at DESC, seq DESC) AS back FROM ({MESSAGES}) WHERE role = 'user') WHERE back <= 2 GROUP BY chat_id",
)
def win5(spark, sf_dir):
    return chat_history.retrieval_query(_m(spark, sf_dir))


@query("win7_earliest_chat", f"SELECT owner, interface, arg_min(chat_id, (created_at, chat_id)) AS chat_id FROM ({CHATS}) GROUP BY owner, interface")
def win7(spark, sf_dir):
    return chat_history.earliest_chat(chat_store.chats(spark, sf_dir))


@query(
    "win12_first_votes",
    f"SELECT id, row_number() OVER w = 1 AS saved, first_value(value) OVER w AS stored FROM ({VOTES}) WINDOW w AS (PARTITION BY owner, message_id ORDER BY created_at, id)",
)
def win12(spark, sf_dir):
    return chat_history.first_votes(chat_store.votes(spark, sf_dir)).select("id", "saved", "stored")


@query("set4_distinct_texts", "SELECT min(doc_id) AS doc_id, text FROM documents GROUP BY text")
def set4(spark, sf_dir):
    return chat_history.distinct_texts(table(spark, sf_dir, "documents"), "text", "doc_id")


@query("str4_streamed_answers", f"SELECT chat_id AS answer_id, string_agg(content, ' ' ORDER BY seq) AS text FROM ({MESSAGES}) WHERE role = 'assistant' GROUP BY 1")
def str4(spark, sf_dir):
    deltas = _m(spark, sf_dir).filter("role = 'assistant'").select(F.col("chat_id").alias("answer_id"), "seq", F.concat("content", F.lit(" ")).alias("delta"))
    return answers.guarded_batch(deltas).select("answer_id", F.regexp_replace(F.array_join("parts", ""), " $", "").alias("text"))
