"""Screening of whole dialogues and of masked message streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import safety, texts


def screened_history(messages: DataFrame, rule: str = "rule") -> DataFrame:
    """Messages that may stay, with blocked: a rejected earlier user turn goes with the reply after it, a rejected answer
    goes; a rejected last user or system turn blocks the dialogue (all of its rows are kept, marked)."""
    order = Window.partitionBy("chat_id").orderBy("created_at", "seq")
    whole = Window.partitionBy("chat_id")
    bad = F.col(rule).isNotNull()
    m = messages.withColumns({"last_user": F.max(F.when(F.col("role") == "user", F.struct("created_at", "seq"))).over(whole), "after_bad": F.coalesce(F.lag((F.col("role") == "user") & bad).over(order), F.lit(False))})
    last = F.struct("created_at", "seq") == F.col("last_user")
    m = m.withColumn("blocked", F.max(bad & ((F.col("role") == "system") | last)).over(whole))
    gone = (bad & F.col("role").isin("user", "assistant") & ~last) | (F.col("after_bad") & (F.col("role") == "assistant"))
    return m.filter(F.col("blocked") | ~F.coalesce(gone, F.lit(False))).drop("last_user", "after_bad")


def screened_messages(messages: DataFrame) -> DataFrame:
    """id, masked, categories, rule, allowed, text_hash: what a stream of messages is split by; works on streams too."""
    matchable = messages.withColumn("m", safety.for_match(F.col("content"))).withColumn("rule", safety.input_rule(F.col("content")))
    judged = matchable.withColumn("categories", safety.moderated(F.col("m"))).drop("m")
    allowed = F.col("rule").isNull() & (F.size("categories") == 0)
    return judged.select("id", F.when(allowed, texts.masked(F.col("content"))).alias("masked"), "categories", "rule", allowed.alias("allowed"), texts.fingerprint(F.col("content")).alias("text_hash"))
