"""Every stage of the pipeline on the smallest tables, held against what it must leave behind."""

import os
import re

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        found = spark.read.parquet(str(tmp_path / name))
        if name != "best_fit_packing":
            assert sorted(found.columns) == sorted(docs.columns)
        docs, seen[name] = found, found.toPandas()
    for name in ("toxicity", "quality_rules", "ngram_jaccard_join", "substring_dedup"):
        assert seen[name].doc_id.is_unique and len(seen[name])
    assert seen["quality_rules"].text.map(lambda t: len(words(t))).min() >= 10
    grams = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in map(words, seen["ngram_jaccard_join"].text)]
    assert not any(len(a & b) >= 0.8 * len(a | b) for i, a in enumerate(grams) for b in grams[:i])
    before = dict(zip(seen["ngram_jaccard_join"].doc_id, seen["ngram_jaccard_join"].text, strict=True))
    first = {}
    for d, t in before.items():
        w = words(t)
        for i in range(len(w) - 49):
            first[tuple(w[i : i + 50])] = min(d, first.get(tuple(w[i : i + 50]), d))
    for d, t in zip(seen["substring_dedup"].doc_id, seen["substring_dedup"].text, strict=True):
        w, gone = words(before[d]), set()
        for i in range(len(w) - 49):
            if first[tuple(w[i : i + 50])] < d:
                gone |= set(range(i, i + 50))
        assert words(t) == [x for i, x in enumerate(w) if i not in gone]
    packed, tokenizer = seen["best_fit_packing"], Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = sum(len(e.ids) + 1 for e in tokenizer.encode_batch([t or "" for t in seen["substring_dedup"].text], add_special_tokens=False))
    assert packed.length.sum() == want and packed.groupby("sequence_id").length.sum().max() <= 1024
