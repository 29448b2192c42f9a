"""The n-gram join where a band holds more classes than one group takes."""

import numpy as np
from pyspark.sql import functions as F

from lantern.llm import groups, minhash_join


def test_a_pair_whose_leaders_are_unlike(spark):
    """A and B are near; the leader of each in its own part is near it, and the two leaders share next to nothing."""
    a = np.arange(120) % 251
    b = a.copy()
    b[:20] = (a[:20] + 100) % 251  # 100 of 120 places: 0.83
    lead_a, lead_b = a.copy(), b.copy()
    lead_a[60:103] = (a[60:103] + 50) % 251  # 77 of 120 with A
    lead_b[20:60] = (b[20:60] + 70) % 251
    lead_b[103:106] = (b[103:106] + 70) % 251  # 77 of 120 with B
    sigs = [x.astype(np.uint8) for x in (a, b, lead_a, lead_b)]
    alike = lambda x, y: (sigs[x] == sigs[y]).mean()
    assert alike(0, 1) > 0.8 and alike(0, 2) >= 0.6 and alike(1, 3) >= 0.6 and alike(2, 3) < 0.3
    seen = set()
    for trial in range(40):  # whatever parts their hashes fall in
        fps = [bytes([n, trial]) + b"fingerprint..." for n in (7, 8, 1, 2)]
        rows = [(fp, [5], s.tobytes()) for fp, s in zip(fps, sigs, strict=True)]
        classes = spark.createDataFrame(rows, "fp binary, bands array<long>, sig binary")
        parts = {bytes(r["fp"]): r["p"] for r in classes.select("fp", F.pmod(F.xxhash64("fp", F.col("bands")[0]), F.lit(2)).alias("p")).collect()}
        shape = tuple(parts[x] for x in fps)
        if (shape[0], shape[1]) != (shape[2], shape[3]) or shape[0] == shape[1] or shape in seen:
            continue
        seen.add(shape)
        found = {bytes(r["node"]): bytes(r["component"]) for r in minhash_join._candidates(classes, minhash_join.Join(part=2)).collect()}
        assert found[fps[0]] == found[fps[1]]
    assert seen


def test_recall_in_a_band_of_many_unlike_classes(spark):
    """Texts of a common passage and words of their own, thousands in one band that is cut in many parts; all pairs over the threshold are linked, by all-pairs counts."""
    r = np.random.default_rng(5)
    common = [f"c{i}" for i in range(66)]
    texts = []
    for i in range(5000):
        own = [f"w{i}x{j}" for j in range(38)]
        texts.append(own)
        if i % 10 == 0:  # a near copy, from well over the threshold to just below it
            changed = list(own)
            for j in r.choice(38, int(r.integers(0, 4)), replace=False):
                changed[j] = f"v{i}y{j}"
            texts.append(changed)
    grams = [{tuple(([*common, *w])[k : k + 5]) for k in range(66 + 38 - 4)} for w in texts]
    where = {}
    for i, g in enumerate(grams):  # words of one's own tell which pairs can be similar at all: the passage alone gives less than the threshold
        for x in g:
            where.setdefault(x, []).append(i)
    pairs = {(o[0], o[1]) for x, o in where.items() if len(o) == 2}
    assert len(set(map(frozenset, grams[:2]))) == 2 and 62 / (100 + 100 - 62) < 0.8
    want = {(i, j) for i, j in pairs if len(grams[i] & grams[j]) >= 0.8 * len(grams[i] | grams[j])}
    assert len(want) > 300 and len(pairs) > len(want)
    df = spark.createDataFrame([(i, " ".join([*common, *w])) for i, w in enumerate(texts)], "doc_id long, text string").repartition(4)
    plan = minhash_join.Join(rows=1, part=512, leaders=100)  # one row a band: most of these texts share each of its hashes
    sizes = minhash_join.signatures(df, plan).select(F.explode("bands").alias("b")).groupBy("b").count()
    assert sizes.agg(F.max("count")).first()[0] > 3000
    ids = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in minhash_join.similarity_classes(df, plan).collect()}
    links = np.zeros(len(texts), int)
    for i, j in want:
        links[i] += 1
        links[j] += 1
    lost = sum(ids[i][0] != ids[j][0] for i, j in want)
    assert lost <= 1e-4 * len(want), lost
    assert [ids[i][1] for i in range(len(texts))] == links.tolist()


def test_few_files_for_few_rows(spark, monkeypatch):
    """Rounds over few edges aren't written as a file for each partition of a shuffle."""
    written = []

    def durable(df, *rows, plain=groups.durable):
        out = plain(df, *rows)
        written.append(out.rdd.getNumPartitions())
        return out

    monkeypatch.setattr(groups, "durable", durable)
    held = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in held}
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        found = groups.components(spark.createDataFrame([(k, k - k % 5) for k in range(200)], "a long, b long")).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert {r["node"]: r["component"] for r in found} == {k: k - k % 5 for k in range(200)}
    assert len(written) > 2 and max(written[1:]) <= spark.sparkContext.defaultParallelism
