"""Similarity join of documents on word n-grams: MinHash banding, then exact Jaccard on the full n-gram sets.

1. Every text gives its set of n-grams (64-bit hashes), a 128-bit fingerprint of that set, and MinHash values in
   `bands` bands of `rows` rows; both numbers follow from the recall wanted at the threshold (`banding`).
2. Documents of equal sets are one class from here on.  Classes are shuffled on their band hashes.
3. In each bucket, leaders take in the members whose MinHash estimate is near; no bucket is compared pair by pair.  A
   large bucket is cut into parts, each with leaders of its own, and then every member meets the leaders of all parts.
   The edges' connected components hold every candidate pair: by the triangle inequality of the Jaccard distance, a
   pair over the threshold that meets in a bucket shares a leader within the looser radius, whichever parts the two are in.
   Estimates from one byte of each MinHash value decide what is near, so this holds up to their error, which the tests measure.
4. In each component the full sets are compared, all pairs, in numpy blocks; large components as pairs of blocks
   over many tasks.  Links between different sets are counted with the number of copies on the other side.
5. The links' connected components are the classes returned.

Defined results: a text of 1 to n - 1 words has one n-gram, all its words; a text without words (null, empty) has
none, links with nothing and is a class of its own id; rows with the same id and text are copies of each other;
a null id sorts last in the choice of a class id; other columns aren't looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .groups import components, durable, set_aside, whole_groups
from .texts import Words, blocks, mix, text_column, windows


def banding(threshold: float, recall: float, at_rows: int = 5) -> tuple[int, int]:
    """Bands and rows with which a pair at the threshold meets in a bucket with at least this probability."""
    return math.ceil(math.log1p(-recall) / math.log1p(-(threshold**at_rows))), at_rows


@dataclass(frozen=True)
class Join:
    n: int = 5
    threshold: float = 0.8
    recall: float = 0.9999
    rows: int = 5
    near: float = 0.6  # a leader takes in members of at least this estimate
    loose: float = 0.3  # and is joined with those of at least this one
    part: int = 4096  # about the most members of a bucket that are compared with leaders in one group
    leaders: int = 1024  # about the most leaders of other parts that they are then compared with in one group
    block: int = 256  # most sets of one side of a comparison of full sets

    @property
    def bands(self) -> int:
        return banding(self.threshold, self.recall, self.rows)[0]


def _sets(words: Words, n: int) -> Iterator[np.ndarray]:
    """The sorted n-gram hashes of each text of a block."""
    hashes = words.hashes()
    grams = windows(hashes, n)
    for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True):
        if b - a >= n:
            yield np.unique(grams[a : b - n + 1])
        elif b > a:
            yield windows(hashes[a:b], b - a)
        else:
            yield np.empty(0, np.uint64)


def _minima(sets: list[np.ndarray], k: int) -> np.ndarray:
    """len(sets) x k MinHash values (upper 32 bits of multiplied and mixed hashes)."""
    out = np.empty((len(sets), k), np.uint32)
    factors = mix(np.arange(1, k + 1, dtype=np.uint64)) | np.uint64(1)
    shifts = mix(np.arange(1, k + 1, dtype=np.uint64) + np.uint64(1 << 32))
    lo = 0
    while lo < len(sets):
        hi, size = lo, 0
        while hi < len(sets) and (size < 1 << 14 or hi == lo):
            size += len(sets[hi])
            hi += 1
        flat = np.concatenate(sets[lo:hi])
        starts = np.cumsum([0, *(len(s) for s in sets[lo : hi - 1])])
        for j in range(k):
            out[lo:hi, j] = np.minimum.reduceat(((flat * factors[j] + shifts[j]) >> np.uint64(32)).astype(np.uint32), starts)
        lo = hi
    return out


def signatures(df: DataFrame, plan: Join) -> DataFrame:
    """doc_id, th, fp binary (null without words), bands array<long>, sig binary (a byte of each MinHash value)."""
    k = plan.bands * plan.rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in blocks(text_column(batch)):
                sets = list(_sets(Words(data, offsets), plan.n))
                some = [i for i, s in enumerate(sets) if len(s)]
                minima = _minima([sets[i] for i in some], k) if some else np.empty((0, k), np.uint32)
                keys = np.zeros((len(some), plan.bands), np.uint64)
                for j in range(k):
                    keys[:, j // plan.rows] = mix(keys[:, j // plan.rows] * np.uint64(31) + minima[:, j] + np.uint64(j + 1))
                fp, bands, sig = [None] * (hi - lo), [None] * (hi - lo), [None] * (hi - lo)
                for i, key, low in zip(some, keys.view(np.int64), minima.astype(np.uint8), strict=True):
                    fp[i], bands[i], sig[i] = xxhash.xxh3_128_digest(sets[i].tobytes()), key, low.tobytes()
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(i).slice(lo, hi - lo) for i in (0, 1)), pa.array(fp, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(sig, pa.binary())],
                    names=["doc_id", "th", "fp", "bands", "sig"],
                )

    kind = df.schema["doc_id"].dataType.simpleString()
    return df.select("doc_id", F.xxhash64("text").alias("th"), "text").mapInArrow(run, f"doc_id {kind}, th long, fp binary, bands array<long>, sig binary")


def _led(members: DataFrame, plan: Join) -> DataFrame:
    """Edges a, b of members to their leaders, and the leaders themselves (b null), from bucket, fp, sig.

    All buckets of a batch go on together: in each round every bucket that has members without a leader makes the
    first of them one and compares all its members with it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, cuts in whole_groups(batches, "bucket"):
            fp, sig = batch.column(1), np.stack([np.frombuffer(s, np.uint8) for s in batch.column(2).to_pylist()])
            k = sig.shape[1]
            member, free = np.arange(len(sig)), np.ones(len(sig), bool)
            group = np.repeat(np.arange(len(cuts) - 1), np.diff(cuts))
            of_member = np.full(len(sig), -1)
            edges, leaders = [], []
            while len(member):
                waiting = member[free[member]]
                if not len(waiting):
                    break
                head = waiting[np.append(True, group[waiting][1:] != group[waiting][:-1])]
                of = np.full(len(cuts) - 1, -1)
                of[group[head]] = head
                member = member[of[group[member]] >= 0]
                leader = of[group[member]]
                alike = np.concatenate([(sig[m] == sig[x]).sum(1) for m, x in zip(np.array_split(member, 1 + len(member) // 4096), np.array_split(leader, 1 + len(member) // 4096), strict=True)]) / k
                take = (alike >= plan.loose) & (member != leader)
                m, x = member[take], leader[take]
                # a member's first leader takes its edge; later ones are joined with that leader, once for each two
                led = of_member[m] >= 0
                edges.append(np.stack((m[~led], x[~led]), 1))
                edges.append(np.unique(np.stack((x[led], of_member[m[led]]), 1), axis=0))
                of_member[m[~led]] = x[~led]
                leaders.append(head)
                of_member[head] = np.where(of_member[head] < 0, head, of_member[head])
                free[member[alike >= plan.near]] = False
                free[head] = False
            e, h = np.concatenate(edges), np.concatenate(leaders)
            none = pa.nulls(len(h), pa.binary())
            yield pa.RecordBatch.from_arrays(
                [pa.concat_arrays([fp.take(pa.array(e[:, 0])), fp.take(pa.array(h))]), pa.concat_arrays([fp.take(pa.array(e[:, 1])), none]), pa.concat_arrays([batch.column(0).take(pa.array(i)) for i in (e[:, 0], h)])],
                names=["a", "b", "bucket"],
            )

    dealt = members.select("bucket", "fp", "sig").repartition("bucket").sortWithinPartitions("bucket", "fp")
    return dealt.mapInArrow(run, "a binary, b binary, bucket string")


def _met(groups: DataFrame, plan: Join) -> DataFrame:
    """Edges a, b of members to leaders that other parts of their band chose, from bucket, leads, fp, sig.

    Every member of a group is compared with every leader in it; the first leader that is near enough takes the
    member's edge, later ones are joined with that leader, once for each two.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, cuts in whole_groups(batches, "bucket"):
            leads, fp = batch.column(1).to_numpy(zero_copy_only=False), batch.column(2)
            sig = np.stack([np.frombuffer(s, np.uint8) for s in batch.column(3).to_pylist()])
            found = []
            for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                own = np.arange(lo, hi)
                heads, members = own[leads[lo:hi]], own[~leads[lo:hi]]
                led = np.full(len(members), -1)
                for head in heads.tolist():
                    alike = (sig[members] == sig[head]).sum(1) / sig.shape[1]
                    near = np.flatnonzero(alike >= plan.loose)
                    fresh = near[led[near] < 0]
                    found.append(np.stack((members[fresh], np.full(len(fresh), head)), 1))
                    before = np.unique(led[near[led[near] >= 0]])
                    found.append(np.stack((np.full(len(before), head), before), 1))
                    led[fresh] = head
            e = np.concatenate(found)
            yield pa.RecordBatch.from_arrays([fp.take(pa.array(e[:, 0])), fp.take(pa.array(e[:, 1]))], names=["a", "b"])

    dealt = groups.select("bucket", "leads", "fp", "sig").repartition("bucket").sortWithinPartitions("bucket", "leads", "fp")
    return dealt.mapInArrow(run, "a binary, b binary")


def _candidates(classes: DataFrame, plan: Join) -> DataFrame:
    """node, component: the classes of which some pair may be over the threshold."""
    dealt = classes.select("fp", F.explode("bands").alias("band"))
    sizes = dealt.groupBy("band").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    # a part number spreads a large bucket over several groups
    met = dealt.join(sizes, "band").withColumn("parts", F.ceil(F.col("size") / plan.part))
    met = met.withColumn("own", F.pmod(F.xxhash64("fp", "band"), F.col("parts")))
    members = met.withColumn("bucket", F.concat_ws("/", "band", "own")).join(classes.select("fp", "sig"), "fp")
    led = durable(_led(members, plan))
    edges = led.filter("b IS NOT NULL").select("a", "b")
    # in a band that was cut, every member meets the leaders of all parts, in groups of a part and a block of leaders
    cut = sizes.filter(F.col("size") > plan.part).select(F.col("band").cast("string").alias("band"), F.ceil(F.col("size") / plan.part).alias("parts"))
    heads = led.filter("b IS NULL").select(F.col("a").alias("fp"), F.substring_index("bucket", "/", 1).alias("band")).join(cut, "band").distinct()
    blocks = heads.groupBy("band").agg(F.ceil(F.count(F.lit(1)) / plan.leaders).alias("blocks"))
    numbers = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    lead = heads.join(blocks, "band").withColumn("part", numbers("parts")).withColumn("block", F.pmod(F.xxhash64("fp", F.lit(3)), F.col("blocks"))).select("band", "part", "block", "fp", F.lit(True).alias("leads"))
    follow = met.filter(F.col("size") > plan.part).select(F.col("band").cast("string").alias("band"), F.col("own").alias("part"), "fp").join(blocks, "band").withColumn("block", numbers("blocks")).select("band", "part", "block", "fp", F.lit(False).alias("leads"))
    groups = lead.unionByName(follow).withColumn("bucket", F.concat_ws("/", "band", "part", "block")).join(classes.select("fp", "sig"), "fp")
    return components(edges.unionByName(_met(groups, plan)))


def _once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches sorted by pair and fp, without rows that repeat the one before (as where a skewed join was split)."""
    last = None
    for batch in batches:
        rows = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
        fresh = [row != before for row, before in zip(rows, [last, *rows[:-1]], strict=True)]
        last = rows[-1] if rows else last
        yield batch.filter(pa.array(fresh, pa.bool_()))


def _compared(members: DataFrame, plan: Join) -> DataFrame:
    """From pair (of blocks), side, fp, copies, grams: fp a, b with links 0 for links that join (a forest), and fp a, b null with its number of links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, cuts in whole_groups(_once(batches), "pair"):
            fps, sides, copies = batch.column(1), batch.column(2).to_numpy(), batch.column(3).to_numpy()
            grams = batch.column(4)
            a_out, b_out, n_out = [], [], []
            for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                sets = [np.frombuffer(grams[i].as_py(), np.uint64) for i in range(lo, hi)]
                linked = _linked(sets, plan.threshold)
                side = sides[lo:hi]
                if side[0] >= 0:  # two blocks: each block's own pairs are another group's
                    linked &= side[:, None] != side[None, :]
                links = linked @ copies[lo:hi]
                i, j = _forest(linked)
                some = np.flatnonzero(links)
                a_out += [lo + i, lo + some]
                b_out += [lo + j, np.full(len(some), -1)]
                n_out += [np.zeros(len(i), np.int64), links[some]]
            a, b, n = map(np.concatenate, (a_out, b_out, n_out))
            yield pa.RecordBatch.from_arrays([fps.take(pa.array(a)), fps.take(pa.array(b, mask=b < 0)), pa.array(n.astype(np.int64))], names=["a", "b", "links"])

    return members.repartition("pair").sortWithinPartitions("pair", "fp").mapInArrow(run, "a binary, b binary, links long")


def _linked(sets: list[np.ndarray], threshold: float) -> np.ndarray:
    """Whether each two of the sets have at least this Jaccard similarity; the diagonal is false."""
    sizes = np.array([len(s) for s in sets], np.int64)
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), sizes)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    number = np.cumsum(np.append(True, flat[1:] != flat[:-1])) - 1
    often = np.bincount(number)[number] > 1
    number, owner = number[often], owner[often]
    if len(number):
        number = np.cumsum(np.append(True, number[1:] != number[:-1])) - 1
    common = np.zeros((len(sets), len(sets)), np.float64)
    step = 8192
    cuts = np.searchsorted(number, np.arange(0, (number[-1] + 1 if len(number) else 0) + step, step))
    for k, (a, b) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)):
        if a < b:
            held = np.zeros((len(sets), step), np.float32)
            held[owner[a:b], number[a:b] - k * step] = 1
            common += held @ held.T
    union = sizes[:, None] + sizes[None, :] - common
    out = common >= threshold * union - 1e-9
    np.fill_diagonal(out, False)
    return out


def _forest(linked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges that join the same nodes as all links, at most one for each node."""
    left, edges = set(range(len(linked))), []
    while left:
        stack = [left.pop()]
        while stack:
            i = stack.pop()
            for j in np.flatnonzero(linked[i]).tolist():
                if j in left:
                    left.discard(j)
                    edges.append((i, j))
                    stack.append(j)
    found = np.array(edges, np.int64).reshape(-1, 2)
    return found[:, 0], found[:, 1]


def _full_sets(df: DataFrame, chosen: DataFrame, plan: Join) -> DataFrame:
    """pair, fp, side, copies, grams for the chosen documents (doc_id, th, fp, copies, pairs)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()  # a class's row may be repeated in the table; its copies come to the same task
        for batch in batches:
            fps = batch.column(0).to_pylist()
            first = [fp not in seen and not seen.add(fp) for fp in fps]
            batch = batch.filter(pa.array(first, pa.bool_()))
            for lo, hi, data, offsets in blocks(text_column(batch)):
                grams = [s.tobytes() for s in _sets(Words(data, offsets), plan.n)]
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(lo, hi - lo) for i in range(3)), pa.array(grams, pa.binary())], names=["fp", "copies", "pairs", "grams"])

    texts = df.select("doc_id", F.xxhash64("text").alias("th"), "text")
    found = texts.join(chosen, (texts["th"] == chosen["th"]) & texts["doc_id"].eqNullSafe(chosen["doc_id"])).select("fp", "copies", "pairs", "text")
    sets = found.mapInArrow(run, "fp binary, copies long, pairs array<struct<pair:string,side:int>>, grams binary")
    return sets.select(F.explode("pairs").alias("p"), "fp", "copies", "grams").select("p.pair", "fp", "p.side", "copies", "grams")


def _labelled(df: DataFrame, plan: Join) -> DataFrame:
    """doc_id, th, class (null without words), n_links of every row; a checkpoint."""
    base = durable(signatures(df, plan))
    n = base.count()
    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "th"))
    per_class = base.filter("fp IS NOT NULL").groupBy("fp").agg(F.count(F.lit(1)).alias("copies"), first.alias("first"), F.first("bands").alias("bands"), F.first("sig").alias("sig"))
    classes = durable(per_class.select("fp", "copies", "first.doc_id", "first.th", "bands", "sig"), n)
    found = durable(_candidates(classes, plan), n)
    sizes = found.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    # blocks of a component: own = this class's block; pairs with every block, the smaller number first
    sized = found.join(sizes, "component").withColumn("blocks", F.ceil(F.col("size") / plan.block))
    own = F.pmod(F.xxhash64("node", F.lit(7)), F.col("blocks"))
    pairs = F.transform(
        F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1),
        lambda o: F.struct(F.concat_ws("/", F.hex("component"), F.least(F.col("own"), o), F.greatest(F.col("own"), o)).alias("pair"), F.when(F.col("own") == o, -1).otherwise((F.col("own") > o).cast("int")).alias("side")),
    )
    chosen = sized.withColumn("own", own).select(F.col("node").alias("fp"), pairs.alias("pairs")).join(classes.select("fp", "copies", "doc_id", "th"), "fp")
    results = durable(_compared(_full_sets(df, chosen, plan), plan))
    joined = components(results.filter("b IS NOT NULL").select("a", "b")).select(F.col("node").alias("fp"), "component")
    counted = results.filter("b IS NULL").groupBy(F.col("a").alias("fp")).agg(F.sum("links").alias("links"))
    of_class = classes.select("fp", "copies").join(joined, "fp", "left").join(counted, "fp", "left")
    of_class = of_class.select("fp", F.coalesce("component", "fp").alias("class"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    return durable(base.select("doc_id", "th", "fp").join(of_class, "fp", "left").select("doc_id", "th", "class", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links")), n)


def similarity_classes(df: DataFrame, plan: Join = Join()) -> DataFrame:
    """doc_id, class_id (the smallest id that a chain of links reaches), n_links (other rows that are similar enough)."""
    rows = _labelled(df, plan)
    least = durable(rows.filter("class IS NOT NULL").groupBy("class").agg(F.min("doc_id").alias("class_id")))  # so that a large class's rows can be split in the join
    return rows.join(least, "class", "left").select("doc_id", F.when(F.col("class").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), "n_links")


def one_of_each(df: DataFrame, plan: Join = Join()) -> DataFrame:
    """The rows of df, one for each class: that of the smallest id; rows without words all stay, and columns of any name are kept as they are."""
    df, back = set_aside(df, "doc_id", "text")
    rows = _labelled(df, plan)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "th")).alias("f")
    chosen = rows.filter("class IS NOT NULL").groupBy("class").agg(first).select(F.col("f.doc_id").alias("doc_id"), F.col("f.th").alias("th"))
    docs = df.withColumn("th", F.xxhash64("text"))
    kept = docs.join(chosen, (docs["th"] == chosen["th"]) & docs["doc_id"].eqNullSafe(chosen["doc_id"]), "left_semi").dropDuplicates(["doc_id", "th"])
    wordless = docs.filter(F.col("text").isNull() | ~F.col("text").rlike("[^\\x20\\x09-\\x0D]"))
    return back(kept.unionByName(wordless))
