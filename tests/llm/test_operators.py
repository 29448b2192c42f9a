"""The operators against brute force on small tables that hold the hard cases."""

import bisect
import cProfile
import hashlib
import os
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lantern.llm import anchors, byte_pairs, compression, fertility, kmeans_tree, licenses, minhash_join, packing, placement, rotation

BYTES, PIECES = (public_tokenizers.path(x) for x in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, th int, runs string, score double, part int, uid long, __x string"


def rows():
    r = random.Random(3)
    vocab = ["".join(r.choices(["th", "er", "on", "an", "re", "ing", "tion", "ha", "é", "ñ"], k=r.randint(1, 4))) for _ in range(400)]
    text = lambda n: " ".join(r.choices(vocab, k=n))
    passage, base = text(70), text(200)
    near = base.split()
    near[100] = "other"
    texts = [
        None, "", " \n\t", "one", "one two three", base, base, " ".join(near), base + " tail", text(30) + " " + passage + " " + text(40), text(300) + "\n" + passage, passage, text(60) + passage,
        "a b c d e f " * 30, "<|endoftext|> x <|endoftext|>", "it's I'll 'tis 　 日本語 🎉 ½", text(6000), "x" * 5000, "line one here\nline one here\n\nline two", base,
        "Released under the MIT License.\n" + text(50), text(90) + " Licensed under the Apache License, Version 2.0. " + text(20),
    ]
    out = [(i, t, "en", "s", len(t or ""), 1, "r", 0.5, 2, 3, "x") for i, t in enumerate(texts)]
    out += [out[5], (9, "same id, other text " + passage, None, None, None, None, None, None, None, None, None), (None, base, None, None, None, None, None, None, None, None, None), (None, passage + " " + text(5), None, None, None, None, None, None, None, None, None)]
    return out


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def collected(df):
    return sorted(map(tuple, df.collect()), key=str)


def words(text):
    return WORD.findall(text or "")


def test_anchor_cover():
    plan = anchors.Anchoring()
    assert plan.length == 20
    with pytest.raises(ValueError):
        anchors.Anchoring(cover=(1, 2, 3))


def test_substring_dedup(docs, none):
    first = {}
    for d, t, *_ in rows():
        w = words(t)
        for i in range(len(w) - 49) if d is not None else ():
            key = tuple(w[i : i + 50])
            first[key] = min(d, first.get(key, d))
    want = []
    for d, t, *_ in rows():
        w = words(t)
        gone = set()
        for i in range(len(w) - 49) if d is not None else ():
            if first[tuple(w[i : i + 50])] < d:
                gone |= set(range(i, i + 50))
        want.append((d, len(w), len(gone), hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in gone).encode()).hexdigest()))
    assert collected(anchors.digests(docs)) == sorted(want, key=str)
    assert anchors.digests(none).count() == 0
    kept = anchors.without_repeats(docs)
    assert kept.columns == docs.columns and kept.count() == len(want)


def brute_links():
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set()) for w in (words(r[1]) for r in rows())]
    group, links = list(range(len(sets))), [0] * len(sets)
    for i, a in enumerate(sets):
        for j, b in enumerate(sets):
            if i != j and a and len(a & b) >= 0.8 * len(a | b):
                links[i] += 1
                old, new = max(group[i], group[j]), min(group[i], group[j])
                group = [new if g == old else g for g in group]
    least = defaultdict(list)
    for g, r in zip(group, rows(), strict=True):
        least[g] += [r[0]] if r[0] is not None else []
    return sorted(((r[0], min(least[g], default=None), n) for r, g, n in zip(rows(), group, links, strict=True)), key=str), len(set(group))


@pytest.mark.parametrize("plan", [minhash_join.Join(), minhash_join.Join(part=2, block=2)])
def test_jaccard_join(docs, none, plan):
    want, groups = brute_links()
    assert collected(minhash_join.similarity_classes(docs, plan)) == want
    assert minhash_join.similarity_classes(none, plan).count() == 0
    kept = minhash_join.one_of_each(docs, plan)
    assert kept.columns == docs.columns and kept.count() == groups


def test_banding():
    bands, size = minhash_join.banding(0.8, 0.9999)
    assert 1 - (1 - 0.8**size) ** bands >= 0.9999 > 1 - (1 - 0.8**size) ** (bands - 1)


def test_bpe_round_trip(docs, none):
    tokenizer = Tokenizer.from_file(BYTES)
    want = []
    for d, t, *_ in rows():
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids
        want.append((d, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(tokenizer.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert collected(byte_pairs.digests(docs, BYTES)) == sorted(want, key=str)
    assert byte_pairs.digests(none, BYTES).count() == 0
    got = byte_pairs.encoded(docs, BYTES).collect()
    assert sorted(r["decoded"] for r in got) == sorted(r[1] or "" for r in rows())


def test_bpe_random_texts():
    tokenizer, codec = Tokenizer.from_file(BYTES), byte_pairs.PairIndexCodec(open(BYTES, "rb").read(), most_known=50)
    r = random.Random(1)
    signs = [*"ab'stredvlm  \n\t12é中🎉!.#", "<|endoftext|>", "'ll", "  ", "aaaa"]
    texts = ["".join(r.choices(signs, k=r.randint(0, 60))) for _ in range(3000)]
    for lo in range(0, 3000, 500):
        part = [t.encode() for t in texts[lo : lo + 500]]
        ids, at = codec.encode(np.frombuffer(b"".join(part), np.uint8), np.append(0, np.cumsum([len(p) for p in part])))
        for i, e in enumerate(tokenizer.encode_batch(texts[lo : lo + 500], add_special_tokens=False)):
            assert ids[at[i] : at[i + 1]].tolist() == e.ids


def test_fertility(docs, none):
    want = []
    for d, t, *_ in rows():
        w, t = words(t), t or ""
        runs, held, lines, repeated = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)), set(), set(), 0
        for i in range(len(w) - 4):
            if runs[tuple(w[i : i + 5])] > 1:
                held |= set(range(i, i + 5))
        for line in t.split("\n"):
            repeated += bool(WORD.search(line)) and line in lines
            lines.add(line)
        want.append((d, len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), repeated, len(held), len(w) < 10 or 100 * len(held) > 20 * len(w)))
    got = fertility.quality(docs, BYTES, PIECES)
    assert collected(got.select(*got.columns[:7])) == sorted(want, key=str)
    assert got.filter("base_failed AND kept").count() == 0
    assert fertility.quality(none, BYTES, PIECES).count() == 0
    assert fertility.good(docs, BYTES, PIECES).columns == docs.columns
    strict = fertility.Rules(languages={"en": fertility.Band((9.0, 10.0), (0.0, 9.0), 1.0, (0.0, 1.0))})
    assert fertility.quality(docs, BYTES, PIECES, strict).filter("kept AND n_words > 100").count() < got.filter("kept AND n_words > 100").count()


def test_fertility_bounds_by_language(spark):
    sf = "/root/testdata/sf0.01"
    if not os.path.isdir(sf):
        pytest.skip("no test tables")
    got = fertility.quality(spark.read.parquet(f"{sf}/documents.parquet"), BYTES, PIECES).filter("NOT base_failed")
    seen = {r["quality"]: (r["n"], r["kept"]) for r in got.join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").groupBy("quality").agg(F.count("*").alias("n"), F.sum(F.col("kept").cast("int")).alias("kept")).collect()}
    assert seen[0][1] < 0.3 * seen[0][0] and seen[1][1] > 0.95 * seen[1][0], seen


def test_fertility_of_short_texts_and_few_documents(spark):
    short = " ".join(f"{c}\U00012000" if c < "f" else c for c in "abcdefghijkl")
    got = {r["doc_id"]: r for r in fertility.quality(spark.createDataFrame([(1, short, "en"), (2, "a b c d e f g h i j k l", None)], "doc_id long, text string, lang string"), BYTES, PIECES).collect()}
    assert got[1]["fallback_share"] > 0.1 and not got[1]["base_failed"] and not got[1]["kept"] and got[2]["kept"]


def test_fertility_encodes_frequent_words_once_and_makes_no_call_for_a_word():
    content = open(PIECES, "rb").read()
    plain, pieces = sentencepiece.SentencePieceProcessor(model_proto=content), fertility.Pieces(content, most_known=400)
    r, encoded, calls = random.Random(2), [], cProfile.Profile()
    counted = pieces._counted
    pieces._counted = lambda part: encoded.extend(part) or counted(part)
    signs = [*"abcdeésth▁日\x00\U00012000", "<s>", "tion"]
    new = lambda n: ["".join(r.choices(signs, k=9)).encode() for _ in range(n)]
    frequent = new(100)
    for _ in range(20):
        block = list(dict.fromkeys([*frequent, *new(200)]))
        got = calls.runcall(pieces.of, pa.array(block, pa.large_binary()))
        want = [plain.encode(w.decode()) for w in block]
        assert got.tolist() == [[len(ids), sum(map(plain.is_byte, ids))] for ids in want]
    assert len(encoded) <= len(set(encoded)) + 10 and set(frequent) <= set(encoded)
    assert sum(e.callcount for e in calls.getstats()) < len(encoded)


def test_packing(docs, none):
    tokenizer = Tokenizer.from_file(BYTES)
    plan = packing.Packing(chunk=8)
    got = packing.packed(docs, BYTES, plan).toPandas()
    want = Counter()
    for d, t, *_ in rows():
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        head = len(ids) % 1024 or 1024
        for k, start in enumerate([0, *range(head, len(ids), 1024)]):
            end = head if k == 0 else start + 1024
            want[(d, k, start, end - start, zlib.crc32(ids[start:end].tobytes()))] += 1
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert Counter((None if np.isnan(r[0]) else int(r[0]), *map(int, r[1:])) for r in got[columns].itertuples(index=False)) == want
    for _, s in got.groupby("sequence_id"):
        s = s.sort_values("offset")
        assert s.offset.tolist() == np.cumsum([0, *s.length[:-1]]).tolist() and s.length.sum() <= 1024
    assert packing.packed(none, BYTES, plan).count() == 0


def test_packing_beats_first_fit():
    r = np.random.default_rng(2)
    lengths = r.integers(300, 700, 400)
    chunk = packing.Chunk(lengths, packing.Packing(), 1)
    start = chunk.fresh(0.0)
    best = chunk.evolved([], 6, 60)[0]
    assert chunk.cost(best) <= chunk.cost(start)
    assert np.bincount(best, lengths).max() <= 1024 and (best >= 0).all()


def best_fit_decreasing(lengths):
    room, out = [], 0
    for n in sorted(lengths, reverse=True):
        i = bisect.bisect_left(room, n)
        out += i == len(room)
        left = room.pop(i) - n if i < len(room) else 1024 - n
        bisect.insort(room, left)
    return out


def test_packing_over_chunks(spark):
    """Open bins of all chunks packed again: fewer sequences than with chunks apart, close to the bound; nothing is lost on the way."""
    r = np.random.default_rng(4)
    lengths = r.integers(20, 900, 1500).tolist()
    short = spark.createDataFrame(list(enumerate(lengths)), "uid long, length long")
    apart = packing.sequences(short, packing.Packing(chunk=100, open_bins=0)).select("sequence_id").distinct().count()
    one = packing.sequences(short, packing.Packing()).select("sequence_id").distinct().count()
    assert one <= best_fit_decreasing(lengths)
    for plan in (packing.Packing(chunk=100), packing.Packing(chunk=100, merge=4, open_bins=12)):
        got = packing.sequences(short, plan).toPandas()
        assert sorted(got.uid) == list(range(1500))
        got["length"] = [lengths[u] for u in got.uid]
        for _, s in got.groupby("sequence_id"):
            s = s.sort_values("offset")
            assert s.offset.tolist() == np.cumsum([0, *s.length[:-1]]).tolist() and s.length.sum() <= 1024
        assert got.sequence_id.nunique() < apart, plan
        # where few bins are opened the others keep their room
        assert plan.open_bins < 32 or got.sequence_id.nunique() <= 1.01 * sum(lengths) / 1024, plan


def test_migration(spark):
    state = spark.createDataFrame([(c, i, [f"{c}{i}".encode(), b"other"]) for c in (1, 2) for i in range(3)], "chunk long, island int, population array<binary>")
    got = {(r["chunk"], r["island"]): bytes(r["elite"]) for r in packing.migrated(state, packing.Packing()).collect()}
    assert got == {(c, i): f"{c}{(i + 2) % 3}".encode() for c in (1, 2) for i in range(3)}


def test_crossover_keeps_whole_bins():
    r = np.random.default_rng(3)
    lengths = r.integers(100, 700, 200)
    chunk = packing.Chunk(lengths, packing.Packing(), 5)
    giver, taker = chunk.fresh(0.0), chunk.fresh(0.3)
    child = chunk.crossed(giver, taker)
    assert (child >= 0).all() and np.bincount(child, lengths).max() <= 1024
    bins = lambda x: {frozenset(np.flatnonzero(x == b).tolist()) for b in set(x.tolist())}
    half = np.quantile([sum(lengths[list(b)]) for b in bins(giver)], 0.5)
    injected = bins(child) & bins(giver) - bins(taker)
    assert injected and any(sum(lengths[list(b)]) >= half for b in injected)


def test_placement(spark, docs, none):
    shards = [f"s{i}" for i in range(7)]
    table = placement.filled(shards, 101)
    assert max(Counter(table).values()) - min(Counter(table).values()) <= 1
    fewer = placement.filled(shards[:-1], 101)
    assert sum(a != b for a, b in zip(table, fewer, strict=True) if a != 6) < 40
    heavy = Counter(placement.filled(["a", "b"], 101, [3, 1]))
    assert abs(heavy[0] - 3 * heavy[1]) <= 3
    with pytest.raises(ValueError):
        placement.filled(shards, 100)
    got = placement.placed(docs.select("doc_id", "text"), shards, 101, rows_per_part=10_000)
    assert got.count() == len(rows()) and all(r["shard"] == shards[table[r["slot"]]] for r in got.collect())
    assert len({r["slot"] for r in got.filter("doc_id = 5").collect()}) == 1
    assert placement.placed(none, shards, 101).count() == 0


def test_placement_table():
    shards, n = ["a", "b", "c"], 13
    order = {}
    for i, s in enumerate(shards):
        offset, step = xxhash.xxh3_64_intdigest(s, seed=1) % n, xxhash.xxh3_64_intdigest(s, seed=2) % (n - 1) + 1
        order[i] = [(offset + k * step) % n for k in range(n)]
        assert sorted(order[i]) == list(range(n))
    want, turn = {}, 0
    while len(want) < n:
        want[next(s for s in order[turn % 3] if s not in want)] = turn % 3
        turn += 1
    assert placement.filled(shards, n) == [want[i] for i in range(n)]


def test_placement_of_a_hot_key(spark):
    """The same rows get the same places however they are partitioned; equal rows are spread evenly."""
    shards = [f"s{i}" for i in range(7)]
    hot = spark.range(20000).selectExpr("CASE WHEN id % 2 = 0 THEN 7 ELSE id + 100000 END AS doc_id", "CASE WHEN id % 4 = 0 THEN 'copy' ELSE cast(id AS string) END AS text", "'mine' AS Part", "id % 3 AS slot", "5 AS shard")
    hot = hot.withColumn("slot", F.when(F.col("text") == "copy", 0).otherwise(F.col("slot")))
    seen = [Counter(map(tuple, placement.placed(hot.repartition(k), shards, 101, rows_per_part=358).collect())) for k in (2, 5)]
    assert seen[0] == seen[1]
    got = placement.placed(hot, shards, 101, rows_per_part=358)
    assert got.columns == ["doc_id", "text", "Part", "slot", "shard", "placed_part", "placed_slot", "placed_shard"]
    assert collected(got.select(*hot.columns)) == collected(hot)
    table = placement.filled(shards, 101)
    assert all(r["placed_shard"] == shards[table[r["placed_slot"]]] for r in got.collect())
    assert got.filter("doc_id <> 7 AND placed_part <> 0").count() == 0
    copies = Counter(r["placed_part"] for r in got.filter("text = 'copy'").collect())
    assert len(copies) == 28 and max(copies.values()) - min(copies.values()) <= 1
    sizes = Counter(r["placed_part"] for r in got.filter("doc_id = 7").collect())
    assert max(sizes.values()) < 1.3 * 10000 / 28


def test_placement_of_a_key_is_its_own(spark):
    """A key's places don't move with the rest of the table, and neither way of finding the cut keys changes them; slots follow from key and part."""
    shards = [f"s{i}" for i in range(7)]
    some = spark.range(600).selectExpr("CASE WHEN id < 300 THEN 7 WHEN id < 302 THEN 8 ELSE id END AS doc_id", "cast(id AS string) AS text")
    more = some.unionByName(spark.range(5000, 9000).selectExpr("id AS doc_id", "'x' AS text"))
    places = lambda d, **how: {tuple(r) for r in placement.placed(d, shards, 101, rows_per_part=50, **how).collect()}
    few = places(some)
    assert few <= places(more) and few == places(some, most_hot=0)
    assert {r[2] for r in few if r[0] == 7} == set(range(6)) and {r[2] for r in few if r[0] != 7} == {0}
    assert all(r[4] == shards[placement.filled(shards, 101)[r[3]]] for r in few)
    slot = {(r[0], r[2]): r[3] for r in few}
    assert all(slot[r[0], r[2]] == r[3] for r in few) and len({s for (d, _), s in slot.items() if d == 7}) > 1


NAMES = ["th", "TH2", "score", "predicted", "__m", "__q", "__b", "__id", "__th", "__runs", "__copy", "fp", "class", "part", "slot", "shard", "__key", "__part", "uid", "aside0", "__lang", "__script", "__length"]


@pytest.fixture(scope="module")
def clashing(spark):
    """Documents with columns of the operators' own names, of values that are theirs alone."""
    base = spark.createDataFrame([(*r[:5],) for r in rows()], "doc_id long, text string, lang string, source string, n_chars long")
    return base.withColumns({c: F.concat(F.lit(f"{c}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))) for c in NAMES})


@pytest.mark.parametrize("kept", [
    lambda d: minhash_join.one_of_each(d), lambda d: fertility.good(d, BYTES, PIECES), lambda d: anchors.without_repeats(d),
    lambda d: compression.not_toxic(d, d.select("doc_id", (F.col("doc_id") % 2).alias("toxic"))), lambda d: placement.placed(d, ["a", "b"], 101),
])
def test_columns_of_the_caller_stay(clashing, kept):
    out = kept(clashing)
    assert out.columns[: len(clashing.columns)] == clashing.columns
    found = out.collect()
    assert found and all(r[c] == f"{c}:{'-' if r['doc_id'] is None else r['doc_id']}" for r in found for c in NAMES)
    assert {(r["doc_id"], r["lang"], r["source"]) for r in found} <= {(r[0], r[2], r[3]) for r in rows()}


@pytest.mark.parametrize("found", [
    lambda d: minhash_join.similarity_classes(d), lambda d: fertility.quality(d, BYTES, PIECES), lambda d: anchors.digests(d), lambda d: byte_pairs.digests(d, BYTES),
    lambda d: packing.packed(d, BYTES, packing.Packing(chunk=8)).drop("sequence_id", "offset"), lambda d: licenses.scanned(d),
    lambda d: compression.toxicity(d, d.select("doc_id", (F.col("doc_id") % 2).alias("toxic"))),
])
def test_columns_of_the_caller_change_nothing(clashing, found):
    assert collected(found(clashing)) == collected(found(clashing.select("doc_id", "text", "lang", "source", "n_chars")))


def test_licenses(docs, none):
    got = {(r["doc_id"], r["license"]) for r in licenses.scanned(docs).collect()}
    assert got == {(20, "MIT"), (21, "Apache-2.0")}
    assert licenses.scanned(none).count() == 0


def test_rotation(spark):
    turns = [(1, 0, "system", "be kind"), (1, 1, "user", "hi"), (1, 2, "assistant", "hello"), (1, 2, "assistant", "hello"), (1, None, None, None), (None, 300, "user", "x"), (2, 0, "system", "alone")]
    got = {(r["conv_id"], r["perspective"]): r for r in rotation.rotated(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS masks")).collect()}
    assert set(got) == {(1, "user"), (1, "assistant"), (1, "unknown"), (None, "user")}
    r = got[1, "user"]
    assert r["text"].startswith("<|user name=unknown|>\n<|end|>\n<|system|>\nbe kind") and r["n_turns"] == 4
    start, length = map(int, r["masks"].split(":"))
    assert r["text"][start : start + length] == "hi<|end|>"
    assert got[None, "user"]["part"] == 2
    assert rotation.rotated(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_nearest(spark):
    r = np.random.default_rng(1)
    x = r.normal(size=(1500, 16)).astype(np.float32)
    x[600:900] = x[0]
    table = [(i, v.tolist(), 1) for i, v in enumerate(x)] + [(1500, None, 1), (1520, [0.0] * 16, 1), (1540, [float("nan")] * 16, 1), (None, x[3].tolist(), 1), (1560, [1.0, 2.0], 1), (1580, [None] * 16, 1)]
    df = spark.createDataFrame(table, "vec_id long, embedding array<float>, rank int")
    got = kmeans_tree.search(df, how=kmeans_tree.Tree(block=100)).toPandas()
    x, ids, hit = x.astype(np.float64), np.arange(1500), 0
    for q in range(0, 1500, 20):
        score = x @ x[q]
        score[q] = -np.inf
        mine = got[got.query_id == q].sort_values("rank")
        assert mine["rank"].tolist() == list(range(1, 21)) and np.allclose(mine.score, score[mine.vec_id])
        hit += len(set(np.lexsort((ids, -score))[:20]) & set(mine.vec_id))
    assert hit / (75 * 20) >= 0.9
    assert set(got.query_id) == set(range(0, 1500, 20))
    assert kmeans_tree.search(df.limit(0)).count() == 0
    assert kmeans_tree.search(df.filter("vec_id < 8")).count() == 7


def test_toxicity(spark):
    r = random.Random(4)
    syllables = ["th", "er", "on", "an", "re", "ing", "tion", "ha", "en", "nd"]
    ordinary = lambda: "".join(r.choices(syllables, k=r.randint(1, 4)))
    bad = ["zwirk", "plomfug", "quabbe"]
    docs, labels = [], []
    for i in range(900):
        toxic = int(i % 4 == 0)
        w = [ordinary() for _ in range(r.randint(40, 160))]
        for _ in range(4 * toxic):
            w.insert(r.randrange(len(w)), r.choice(bad))
        docs.append((i, " ".join(w), 9))
        labels.append((i, toxic))
    docs += [(900, None, 9), (901, "", 9), (None, "zwirk", 9), (5, docs[5][1], 9)]
    d, lab = spark.createDataFrame(docs, "doc_id long, text string, score int"), spark.createDataFrame(labels + [(3, None), (None, 1)], "doc_id long, toxic int")
    got = compression.toxicity(d, lab)
    assert got.count() == len(docs)
    held = {x["doc_id"]: x for x in got.filter("held_out").collect()}
    assert all(zlib.crc32(str(i).encode()) % 5 == 0 for i in held)
    right = sum(x["predicted"] == int(i % 4 == 0) for i, x in held.items() if i < 900)
    assert right / len([i for i in held if i < 900]) > 0.95
    assert compression.not_toxic(d, lab).columns == d.columns
    rows = compression.sample(d, lab, compression.Training())
    model, apart = compression.fit(rows), rows.filter("apart")
    assert len(model.toxic) <= 100_000 and compression.spelled("plomfug") in model.toxic and compression.spelled("plomfug") not in model.ordinary
    found = lambda m: compression.scored(d.filter("doc_id % 4 = 0"), m).filter("predicted = 1").count()
    assert found(model) > 180
    same = compression.calibrated(apart, compression.Model(model.toxic, model.toxic, model.distances, ()))
    assert found(same) < 45  # without two dictionaries nothing tells: it is the distance that decides
    assert compression.toxicity(d.limit(0), lab).count() == 0
    assert compression.toxicity(d, lab.limit(0)).filter("predicted = 1 OR score > 0").count() == 0
