"""Queries of the streams: each runs its stream over the given table to its end and returns what it wrote."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import functions as F

from ..sources import chat_store
from ..sources.shared import shared_folder
from ..streaming import chats, ingest, moderation, replay
from .registry import query, table
from .safety import PROBES


def _stand_in(texts: list[str]) -> np.ndarray:
    """A stand-in model: characters and bytes."""
    return np.array([[len(t), len(t.encode())] for t in texts], np.float32)


@query(
    "str1_incremental_ingest",
    """SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN 'failed' WHEN doc_id % 5 = 0 THEN 'new' WHEN doc_id % 4 = 0 THEN 'changed' WHEN doc_id % 3 = 0 THEN 'unchanged' ELSE 'new' END AS state,
    CASE WHEN doc_id % 11 = 0 THEN 0 ELSE 1 END AS live, doc_id % 11 <> 0 AS whole, CASE WHEN doc_id % 11 <> 0 THEN sha256(text) END AS sha FROM documents""",
)
def str1(spark, d):
    """Two deliveries: every document but each fifth, each fourth in an older wording; then what is new, changed, the same or can't be read."""
    folder = f"{shared_folder(spark)}/ingest-{uuid.uuid4().hex}"
    job = ingest.Ingest(f"{folder}/index", _stand_in, how="fixed", overlap=0)
    docs = table(spark, d, "documents").select("doc_id", F.concat(F.lit("d/"), F.col("doc_id").cast("string")).alias("file"), "text")
    same = lambda c: docs.filter(c).select("file", F.col("file").alias("doc_id"), "text", F.lit(None).cast("string").alias("error"), F.lit("1").alias("at"))
    older = same("doc_id % 5 <> 0 AND (doc_id % 4 <> 0 OR doc_id % 11 = 0)").unionByName(same("doc_id % 5 <> 0 AND doc_id % 4 = 0 AND doc_id % 11 <> 0").withColumn("text", F.concat(F.coalesce("text", F.lit("")), F.lit(" old"))))
    newer = same("doc_id % 11 = 0 OR doc_id % 5 = 0 OR doc_id % 4 = 0 OR doc_id % 3 = 0").withColumn("error", F.when(F.substring("file", 3, 20).cast("long") % 11 == 0, "can't be read"))
    for delivery in (older, newer):
        delivery.write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema(older.schema).parquet(f"{folder}/in")
        ingest.ingest(stream, job).trigger(availableNow=True).start().awaitTermination()
    states = ingest.reports(spark, job.folder).groupBy("file").agg(F.max_by("state", "v").alias("state"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("number", "text"))), lambda x: x["text"]), " ")
    live = ingest.documents(spark, job.folder).filter("status = 'live'").groupBy("file").agg(F.count(F.lit(1)).alias("live"))
    chunks = ingest.snapshot(spark, job.folder).groupBy("file").agg(F.sha2(joined, 256).alias("chunk_sha"))
    words = F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"(?U)[\s\x{1C}-\x{1F}\x{85}]+", " "))
    texts = docs.select("doc_id", "file", F.sha2("text", 256).alias("sha"), F.sha2(words, 256).alias("word_sha"))
    found = texts.join(states, "file", "left").join(live, "file", "left").join(chunks, "file", "left")
    # a live document without words has no chunk, and nothing is missing of it
    whole = F.col("live").isNotNull() & (F.coalesce("chunk_sha", F.sha2(F.lit(""), 256)) == F.col("word_sha"))
    return found.select("doc_id", "state", F.coalesce("live", F.lit(0)).cast("int").alias("live"), F.coalesce(whole, F.lit(False)).alias("whole"), F.when(F.col("live") > 0, F.col("sha")).alias("sha"))


def answer_deltas(spark, d):
    """answer_id, seq, delta, last, ts: the turns of a conversation as the deltas of one answer, some with a probe across two of them."""
    n = len(PROBES)
    probe = F.element_at(F.array(*map(F.lit, PROBES)), (F.col("chat_id") % n + 1).cast("int"))
    part = F.when(F.col("seq") % 2 == 0, F.substring(probe, 1, 12)).otherwise(F.substring(probe, 13, 100))
    text = F.when(F.col("chat_id") % 3 == 0, F.concat(F.when(F.col("seq") % 2 == 0, F.concat("content", F.lit(" "))).otherwise(F.lit("")), part)).otherwise(F.concat("content", F.lit(" ")))
    return chat_store.messages(spark, d).select(F.col("chat_id").alias("answer_id"), F.col("seq").cast("long").alias("seq"), text.alias("delta"), F.lit(False).alias("last"), F.col("created_at").alias("ts"))


@query("str5_running_moderation")
def str5(spark, d):
    return replay.replayed(answer_deltas(spark, d), "ts", lambda s: moderation.moderated(s, idle=86400.0 * 365))


@query(
    "str7_rolling_counts",
    """WITH w AS (SELECT time_bucket(INTERVAL '1 hour', ts) AS start, user_id, event_type FROM events), m AS (SELECT max(ts) AS latest FROM events)
    SELECT start, count(*) AS messages, count(*) FILTER (WHERE event_type = 'click') AS asked, count(DISTINCT user_id) FILTER (WHERE event_type = 'click') AS users
    FROM w, m GROUP BY start, latest HAVING start + INTERVAL '1 hour' <= latest - INTERVAL '1 hour'""",
)
def str7(spark, d):
    events = table(spark, d, "events").select(F.col("ts").cast("timestamp").alias("created_at"), F.col("user_id").alias("owner"), F.when(F.col("event_type") == "click", "user").otherwise("other").alias("role"))
    return replay.replayed(events, "created_at", chats.rolling_counts).withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("str3_rate_limit_stream")
def str3(spark, d):
    requests = table(spark, d, "events").select(F.col("user_id").cast("string").alias("client"), F.col("ts").cast("timestamp").alias("ts"))
    return replay.replayed(requests, "ts", lambda s: chats.rate_limited(s, 2, 86400.0))


@query("str6_first_votes_stream", "SELECT user_id AS owner, message AS message_id, count(*) AS votes FROM (SELECT DISTINCT user_id, event_id % 50 AS message FROM events WHERE event_type = 'purchase') GROUP BY ALL")
def str6(spark, d):
    votes = table(spark, d, "events").filter("event_type = 'purchase'").select(F.col("event_id").alias("id"), F.col("user_id").alias("owner"), (F.col("event_id") % 50).alias("message_id"), F.col("ts").cast("timestamp").alias("created_at"))
    found = replay.replayed(votes, "created_at", lambda s: chats.first_votes(s, "10000 days"))
    return found.groupBy("owner", "message_id").agg(F.count(F.lit(1)).alias("votes"))
