"""Statistics of the chat store over a period that starts at `since`."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.questions import normalized_question


def within(since: dt.datetime, column: str = "created_at") -> Column:
    return F.col(column) >= F.lit(since.isoformat(sep=" ")).cast("timestamp")


def message_counts(messages: DataFrame, since: dt.datetime) -> DataFrame:
    """One row: total_messages, user_messages; messages hidden later count too."""
    return messages.filter(within(since)).agg(F.count(F.lit(1)).alias("total_messages"), F.count_if(F.col("role") == "user").alias("user_messages"))


def active_users(messages: DataFrame, since: dt.datetime) -> DataFrame:
    """One row: active_users, the distinct (interface, owner) that asked; messages carry their chat's owner."""
    asked = messages.filter(within(since) & (F.col("role") == "user"))
    return asked.agg(F.count_distinct(F.struct("interface", "owner")).alias("active_users"))


def answer_latency(messages: DataFrame, since: dt.datetime) -> DataFrame:
    """One row: avg_latency_ms of answers right after a question; the look back isn't cut by the period."""
    order = Window.partitionBy("chat_id").orderBy("created_at", "seq")
    narrow = messages.select("chat_id", "seq", "role", "created_at")
    pairs = narrow.withColumns({"prev_role": F.lag("role").over(order), "prev_at": F.lag("created_at").over(order)})
    answers = pairs.filter((F.col("role") == "assistant") & (F.col("prev_role") == "user") & within(since))
    wait = (F.unix_micros("created_at") - F.unix_micros("prev_at")) / 1000
    return answers.agg(F.round(F.avg(wait), 1).alias("avg_latency_ms"))


def moderation_counts(incidents: DataFrame, since: dt.datetime) -> DataFrame:
    """One row: moderation_blocks, input_blocks."""
    return incidents.filter(within(since)).agg(F.count(F.lit(1)).alias("moderation_blocks"), F.count_if(F.col("direction") == "input").alias("input_blocks"))


def block_rate(blocks: Column, user_messages: Column, input_blocks: Column) -> Column:
    """Blocks per question asked, rejected ones included; 0 if none was asked."""
    asked = user_messages + input_blocks
    return F.when(asked > 0, F.round(blocks / asked, 4)).otherwise(F.lit(0.0))


def vote_counts(votes: DataFrame, since: dt.datetime) -> DataFrame:
    """One row: votes_up, votes_down, up_ratio (null without votes)."""
    counts = votes.filter(within(since)).agg(F.count_if(F.col("value") == "up").alias("votes_up"), F.count_if(F.col("value") == "down").alias("votes_down"))
    return counts.withColumn("up_ratio", F.round(F.try_divide(F.col("votes_up"), F.col("votes_up") + F.col("votes_down")), 4))


def top_questions(messages: DataFrame, since: dt.datetime, top: int = 5) -> DataFrame:
    """question, n: the most frequent questions in their counted form, ties by the text's bytes."""
    asked = messages.filter(within(since) & (F.col("role") == "user")).select(normalized_question(F.col("content")).alias("question"))
    return asked.filter("question <> ''").groupBy("question").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "question").limit(top)


def full_stats(messages: DataFrame, incidents: DataFrame, votes: DataFrame, since: dt.datetime, top: int = 5) -> DataFrame:
    """All of the above in one row; every part is one row, so the cross joins are of one row each."""
    listed = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(-F.col("n"), "question"))), lambda x: F.concat_ws("=", x["question"], (-x["col1"]).cast("string"))), "\n")
    questions = top_questions(messages, since, top).agg(listed.alias("top_questions"))
    row = message_counts(messages, since)
    for part in (active_users(messages, since), answer_latency(messages, since), moderation_counts(incidents, since), vote_counts(votes, since), questions):
        row = row.crossJoin(part)
    return row.withColumn("block_rate", block_rate(F.col("moderation_blocks"), F.col("user_messages"), F.col("input_blocks")))
