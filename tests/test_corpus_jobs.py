"""Snapshots, distinct texts, chunks and cuts on the cases that the queries' own tables don't hold."""

import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lantern.functions import texts
from lantern.operators import chat_history, chunking, vectors


def test_upsert_sees_values_that_move_between_columns(spark):
    schema = "id int, author string, category string"
    old = spark.createDataFrame([(1, "x", None), (2, None, None), (3, "a", "b"), (4, "a", "b"), (6, None, "c")], schema)
    new = spark.createDataFrame([(1, None, "x"), (2, None, None), (3, "a", "b"), (5, "n", None), (6, "c", None)], schema)
    got = {r["id"]: (r["author"], r["category"], r["action"]) for r in vectors.upserted(old, new, ["author", "category"]).collect()}
    assert got == {1: (None, "x", "updated"), 2: (None, None, "left"), 3: ("a", "b", "left"), 4: ("a", "b", "left"), 5: ("n", None, "inserted"), 6: ("c", None, "updated")}


def test_distinct_texts_with_ties_and_nulls(spark):
    rows = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a"), (3, None), (4, ""), (5, None), (None, "c")], "n int, text string")
    assert sorted(map(tuple, chat_history.distinct_texts(rows, "text", "n").collect()), key=str) == [(1, "a"), (1, "b"), (3, None), (4, ""), (None, "c")]
    assert chat_history.distinct_texts(rows.limit(0), "text", "n").count() == 0


def test_chunks_keep_their_limit_and_every_word():
    r = random.Random(1)
    samples = ["word " * 2000, "Одно предложение. Другое! " * 300, "x" * 5000 + " tail", "a b\n\nc d. e", "", "   ", *(" ".join("é" * r.randint(1, 30) + r.choice(["", ".", "!\n\n"]) for _ in range(400)) for _ in range(5))]
    for text in samples:
        for size, overlap in ((512, 64), (64, 0), (16, 8), (5, 1)):
            for cut in (chunking.window_chunks, chunking.recursive_chunks):
                found = cut(text, size, overlap)
                assert all(chunking.token_count(c) <= size for c in found if len(c.split()) > 1)
                assert set(" ".join(found).split()) == set(text.split())
            assert " ".join(chunking.window_chunks(text, size, 0)).split() == text.split()
            assert " ".join(chunking.recursive_chunks(text, size, 0)).split() == text.split()


@settings(max_examples=20, deadline=None)
@given(found=st.lists(st.text(alphabet="aбé€🎉 \n", max_size=40), min_size=1, max_size=20))
def test_truncation_is_the_longest_prefix_that_fits(spark, found):
    rows = spark.createDataFrame(list(enumerate(found)), "i int, t string")
    cut = {k: texts.truncated(F.col("t"), k) for k in (0, 1, 3, 7)}
    for row in rows.select("t", *(c.alias(f"c{k}") for k, c in cut.items())).collect():
        for k in cut:
            want = max((row["t"][:n] for n in range(len(row["t"]) + 1) if len(row["t"][:n].encode()) <= 4 * k), key=len)
            assert row[f"c{k}"] == want


def test_shortened(spark):
    rows = spark.createDataFrame([("a" * 95 + " " + "b" * 50,), ("a" * 200,), ("short",), (None,), ("a b " * 40,)], "t string")
    got = [r[0] for r in rows.select(texts.shortened(F.col("t"), 100)).collect()]
    note = lambda cut, n: f"\n[…текст обрезан: показано {cut} из {n} символов]"
    assert got == ["a" * 95 + note(95, 146), "a" * 100 + note(100, 200), "short", None, ("a b " * 40)[:99].rstrip() + note(99, 160)]


def test_trigram_counts_are_the_buckets(spark):
    rows = spark.createDataFrame([(1, "Hello, hello hello"), (2, ""), (3, None), (4, "x"), (5, "日本語 🎉 é" * 50), (1, "again"), (None, "key")], "k int, t string")
    got = {(r["k"], r["bucket"]): r["n"] for r in vectors.trigram_counts(rows, ["k"], "t").collect()}
    exploded = rows.filter("t IS NOT NULL").select("k", F.explode(vectors.trigram_buckets(F.col("t"))).alias("bucket"))
    assert got == {(r["k"], r["bucket"]): r["n"] for r in exploded.groupBy("k", "bucket").agg(F.count("*").alias("n")).collect()}
    assert vectors.trigram_counts(rows.limit(0), ["k"], "t").count() == 0
