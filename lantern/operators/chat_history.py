"""What a chat's messages become: users, recipients, histories that fit a prompt, votes that count."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Tokens that every message and every request cost beside their text.
PER_MESSAGE, PER_REQUEST = 4, 2


def live(messages: DataFrame) -> DataFrame:
    """Messages that weren't deleted."""
    return messages.filter(F.col("deleted_at").isNull())


def with_chats(messages: DataFrame, chats: DataFrame) -> DataFrame:
    """Messages with their chat's owner and interface."""
    return messages.drop("owner", "interface").join(chats.select("chat_id", "owner", "interface"), "chat_id")


def recent_users(chats: DataFrame, messages: DataFrame, limit: int = 50) -> DataFrame:
    """owner, interface, chats, last_seen: latest first; owners without messages count by their chats."""
    last = messages.groupBy("chat_id").agg(F.max("created_at").alias("last_message"))
    seen = F.greatest(F.max("created_at"), F.max("last_message"))  # greatest() skips nulls
    users = chats.join(last, "chat_id", "left").groupBy("owner", "interface").agg(F.count_distinct("chat_id").alias("chats"), seen.alias("last_seen"))
    return users.orderBy(F.desc("last_seen"), "owner", "interface").limit(limit)


def recipients(chats: DataFrame, interface: str) -> DataFrame:
    """owner, first_chat of an interface's owners, in the order of their first chats."""
    return chats.filter(F.col("interface") == interface).groupBy("owner").agg(F.min("created_at").alias("first_chat")).orderBy("first_chat", "owner")


def earliest_chat(chats: DataFrame) -> DataFrame:
    """owner, interface, chat_id of each owner's first chat; a partial aggregate, so no owner is gathered."""
    first = F.min_by("chat_id", F.struct("created_at", "chat_id"))
    return chats.groupBy("owner", "interface").agg(first.alias("chat_id"))


def last_messages(messages: DataFrame, n: int) -> DataFrame:
    """The last n live messages of each chat in (created_at, seq) order, with place counted from the oldest."""
    newest = Window.partitionBy("chat_id").orderBy(F.desc("created_at"), F.desc("seq"))
    oldest = Window.partitionBy("chat_id").orderBy("created_at", "seq")
    kept = live(messages).withColumn("back", F.row_number().over(newest)).filter(F.col("back") <= n).filter("trim(content) <> ''")
    return kept.withColumn("place", F.row_number().over(oldest)).drop("back")


def tokens(text: Column) -> Column:
    """A quarter of the UTF-8 bytes, rounded up: the count where no tokeniser is at hand."""
    return F.ceil(F.octet_length(text) / 4).cast("long")


def fit_to_budget(messages: DataFrame, budget: int, count: Column | None = None) -> DataFrame:
    """Messages of each chat that fit: leading system messages and the last message always, then the newest ones
    while the running cost stays within the budget; at the first that doesn't fit, everything older goes."""
    cost = (tokens(F.col("content")) if count is None else count) + PER_MESSAGE
    order = Window.partitionBy("chat_id").orderBy("created_at", "seq")
    newest = Window.partitionBy("chat_id").orderBy(F.desc("created_at"), F.desc("seq"))
    whole = Window.partitionBy("chat_id")
    m = messages.withColumns({"cost": cost, "others": F.max(F.when(F.col("role") != "system", F.lit(1)).otherwise(0)).over(order), "back": F.row_number().over(newest)})
    m = m.withColumn("always", (F.col("others") == 0) | (F.col("back") == 1))
    fixed = F.sum(F.when(F.col("always"), F.col("cost")).otherwise(0)).over(whole) + PER_REQUEST
    running = F.sum(F.when(F.col("always"), F.lit(0)).otherwise(F.col("cost"))).over(newest)
    return m.withColumn("total", fixed + running).filter(F.col("always") | (F.col("total") <= budget)).select(*messages.columns, "cost")


def condensed(messages: DataFrame, turns: int = 6, chars: int = 400) -> DataFrame:
    """chat_id, history: the last user and assistant turns as labelled lines without citations, long ones cut; chats
    without a user turn among them are left out."""
    said = messages.filter(F.col("role").isin("user", "assistant"))
    newest = Window.partitionBy("chat_id").orderBy(F.desc("created_at"), F.desc("seq"))
    last = said.withColumn("back", F.row_number().over(newest)).filter(F.col("back") <= turns)
    text = F.trim(F.regexp_replace("content", r"\s*\[\d+(?:\s*,\s*\d+)*\]", ""))
    short = F.when(F.char_length(text) > chars, F.concat(F.substring(text, 1, chars), F.lit("…"))).otherwise(text)
    line = F.concat(F.when(F.col("role") == "user", "Пользователь: ").otherwise("Ассистент: "), short)
    lines = F.sort_array(F.collect_list(F.struct(-F.col("back"), line.alias("line"))))
    joined = last.groupBy("chat_id").agg(F.array_join(F.transform(lines, lambda x: x["line"]), "\n").alias("history"), F.bool_or(F.col("role") == "user").alias("asked"))
    return joined.filter("asked").select("chat_id", "history")


def retrieval_query(messages: DataFrame) -> DataFrame:
    """chat_id, query: the last two user texts, older first."""
    newest = Window.partitionBy("chat_id").orderBy(F.desc("created_at"), F.desc("seq"))
    last = messages.filter(F.col("role") == "user").withColumn("back", F.row_number().over(newest)).filter(F.col("back") <= 2)
    texts = F.sort_array(F.collect_list(F.struct(-F.col("back"), "content")))
    return last.groupBy("chat_id").agg(F.array_join(F.transform(texts, lambda x: x["content"]), "\n").alias("query"))


def first_votes(votes: DataFrame) -> DataFrame:
    """All votes with saved (whether the vote is its owner's first on the message) and stored (the value that counts)."""
    order = Window.partitionBy("owner", "message_id").orderBy("created_at", "id")
    return votes.withColumns({"saved": F.row_number().over(order) == 1, "stored": F.first("value").over(order)})


def distinct_texts(rows: DataFrame, text: str, order: str) -> DataFrame:
    """Each text once, with the smallest `order` of its rows; a partial aggregate over the text's hash.  Null is a text of its own."""
    key = F.sha2(F.col(text), 256)
    return rows.groupBy(key.alias("__key")).agg(F.min(order).alias(order), F.first(text).alias(text)).select(order, text)
