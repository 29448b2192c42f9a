"""The pipeline, and the operators that keep a caller's columns, on hard rows; the measures of op1 against their definitions."""

import math
import random
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from lantern.llm import anchors, compression, fertility, minhash_join
from lantern.llm.groups import shared_folder

BYTES, PIECES = (public_tokenizers.path(x) for x in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(r, n):
    vocab = ["".join(r.choices(["th", "er", "on", "an", "re", "ing", "tion", "ha"], k=r.randint(1, 4))) for _ in range(500)]
    return " ".join(r.choices(vocab, k=n))


def hard_rows():
    r = random.Random(11)
    base = prose(r, 150)
    texts = [None, "", " \n\t", "one", base, base, base + " tail", prose(r, 30_000), "x" * 200_000, prose(r, 80), "日本語 🎉 " * 40, prose(r, 60) + " " + base]
    out = [(i, t, "en" if i % 2 else None, "s", len(t or "")) for i, t in enumerate(texts)]
    return [*out, out[4], out[7], (4, prose(r, 40), "en", "s", 1), (None, base, None, None, None), (None, None, None, None, None)]


def with_nested(df):
    return df.withColumn("a b", F.struct(F.lit(1).alias("c d"), F.array(F.struct(F.lit("x").alias("e,f"))).alias("g")))


@pytest.mark.parametrize("kept", [
    lambda d: fertility.good(d, BYTES, PIECES), lambda d: compression.not_toxic(d, d.select("doc_id", (F.col("doc_id") % 2).alias("toxic"))), lambda d: minhash_join.one_of_each(d), lambda d: anchors.without_repeats(d),
])
def test_nested_columns_stay(spark, kept):
    df = with_nested(spark.createDataFrame([(i, prose(random.Random(i), 60), "en", "s", 1) for i in range(6)], SCHEMA))
    out = kept(df)
    assert out.columns == df.columns and out.schema["a b"].dataType.simpleString() == df.schema["a b"].dataType.simpleString()
    assert all(r["a b"]["g"][0]["e,f"] == "x" for r in out.collect()) and out.count()


@pytest.mark.parametrize("rows", [hard_rows(), []])
def test_pipeline_takes_hard_rows(spark, tmp_path, rows):
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (4, 1, 1), (None, 0, 1), (4, 0, None)][: len(rows)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    packed = corpus_pipeline.run(spark, str(tmp_path)).toPandas()
    assert packed.groupby("sequence_id").length.sum().max() <= 1024 if len(packed) else not rows
    pieces = packed.groupby("doc_id", dropna=False)
    assert all(sorted(p.start) == sorted({0, *(p.start + p.length)} - {(p.start + p.length).max()}) for _, p in pieces if p.piece.is_unique)


def test_measures_are_their_definitions(spark):
    rows = [(i, t, g) for i, t, g, *_ in hard_rows() if t is not None and len(t) < 10_000]
    got = {(r["doc_id"], r["text"]): r["__q"] for r in fertility.judged(spark.createDataFrame(rows, "doc_id long, text string, lang string"), BYTES, PIECES).select("doc_id", "text", "__q").collect()}
    tokens, pieces = Tokenizer.from_file(BYTES), sentencepiece.SentencePieceProcessor(model_file=PIECES)
    for i, t, _ in rows:
        q = got[i, t]
        ids = tokens.encode(t, add_special_tokens=False).ids
        own = [p for w in t.split() for p in pieces.encode(w)]
        assert (q["n_tokens"], q["n_pieces"], q["n_fallback"]) == (len(ids), len(own), sum(map(pieces.is_byte, own)))
        assert q["chars_per_token"] == (len(t) / len(ids) if ids else None) and q["chars_per_piece"] == (sum(map(len, t.split())) / len(own) if own else None)
        want = -sum(n / len(ids) * math.log(n / len(ids)) for n in Counter(ids).values()) / math.log(len(ids)) if len(ids) > 1 else q["token_entropy"]
        assert q["token_entropy"] is want or q["token_entropy"] == pytest.approx(want, abs=1e-6)


def test_bounds_are_of_the_group_not_of_the_table(spark):
    """Outliers of a language and length go, a small language keeps its bounds however large the rest is, and short texts meet bounds of their own."""
    r = random.Random(2)
    word = lambda: "".join(r.choices(["tion", "ing", "the", "and", "re", "ha", "on", "er"], k=r.randint(1, 3)))
    odd = lambda n: " ".join(r.choice("qxzj") + r.choice("0123456789") + r.choice("QXZ") for _ in range(n))
    small = [(i, " ".join(word() for _ in range(120)), "aa") for i in range(150)] + [(150, odd(120), "aa")]
    short = [(200 + i, " ".join(word() for _ in range(14)), "bb") for i in range(150)] + [(350, odd(14), "bb")]
    large = [(1000 + i, odd(40 + i % 20), "cc") for i in range(400)]
    for table in (small + short, small + short + large):
        kept = {x["doc_id"] for x in fertility.quality(spark.createDataFrame(table, "doc_id long, text string, lang string"), BYTES, PIECES).filter("kept").collect()}
        assert 150 not in kept and 350 not in kept
        assert len(kept & set(range(150))) > 140 and len(kept & set(range(200, 350))) > 140


def test_no_shared_folder_on_a_cluster():
    class Conf:
        def get(self, key, default=None):
            return {"spark.master": "spark://host:7077"}.get(key, default)

    with pytest.raises(ValueError):
        shared_folder(type("Session", (), {"conf": Conf()})())
