"""The chat store's tables, as views over the conversations table or any table of that shape."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Interfaces of a chat, by conv_id modulo their number.
INTERFACES = ("telegram", "web", "cli")


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """chat_id, seq, role, content, created_at, owner, interface, deleted_at."""
    conversations = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    start = F.lit("2024-01-01 00:00:00").cast("timestamp")
    created = F.timestamp_seconds(F.unix_timestamp(start) + F.col("conv_id") * 3600 + F.col("turn") * (F.col("turn") + 3))
    return conversations.select(
        F.col("conv_id").alias("chat_id"),
        F.col("turn").alias("seq"),
        "role",
        F.col("text").alias("content"),
        created.alias("created_at"),
        F.concat(F.lit("u"), (F.col("conv_id") % 17).cast("string")).alias("owner"),
        F.element_at(F.array(*map(F.lit, INTERFACES)), (F.col("conv_id") % 3 + 1).cast("int")).alias("interface"),
        F.when((F.col("conv_id") + F.col("turn")) % 11 == 0, F.timestamp_add("day", F.lit(1), created)).alias("deleted_at"),
    )


def chats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """chat_id, owner, interface, created_at: a chat opens with its first message."""
    return messages(spark, sf_dir).groupBy("chat_id", "owner", "interface").agg(F.min("created_at").alias("created_at"))


def incidents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, direction, created_at: labels with toxic = 1 play the moderation incidents."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").filter("toxic = 1")
    return labels.select(
        F.col("doc_id").alias("id"),
        F.when(F.col("doc_id") % 2 == 0, "input").otherwise("output").alias("direction"),
        F.timestamp_seconds(F.unix_timestamp(F.lit("2024-01-01 00:00:00").cast("timestamp")) + F.col("doc_id") * 60).alias("created_at"),
    )


def votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, message_id, owner, value, created_at: labels play the feedback votes, several to a message."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return labels.select(
        F.col("doc_id").alias("id"),
        F.floor(F.col("doc_id") / 4).alias("message_id"),
        F.concat(F.lit("u"), (F.col("doc_id") % 3).cast("string")).alias("owner"),
        F.when(F.col("quality") == 1, "up").otherwise("down").alias("value"),
        F.timestamp_seconds(F.unix_timestamp(F.lit("2024-01-01 00:00:00").cast("timestamp")) + F.col("doc_id") * 90).alias("created_at"),
    )
