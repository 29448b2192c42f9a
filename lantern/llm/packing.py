"""Best-fit packing of documents into sequences by a grouping genetic algorithm on islands.

A document is its token ids and an end id, cut only if it is longer than a sequence: then into whole sequences
and a first piece with the rest.  Whole pieces are sequences of their own.  The shorter ones are dealt out evenly
into chunks of bounded size; each chunk is packed by several islands, each a row of a DataFrame with its own
population.  An island starts from best-fit decreasing with random preferences; a crossover injects the
best-filled bins of one parent into the other, drops the bins that held the same documents and best-fits the
displaced ones.  Between rounds each island's elite moves to the next island of its chunk through a join.  A chunk whose
elite reaches the lower bound (tokens over capacity, rounded up) stops there.

A chunk packed alone wastes the room of its last sequences.  So of every chunk only the fuller bins are settled; the
`open_bins` least filled ones of `merge` chunks become one chunk of the next level, whose islands start from these
bins as well as from best fits of their documents, and so on until one chunk is left.  The number of sequences never
grows from level to level, and a chunk of any level holds at most merge x open_bins bins.

Defined results: null text as the empty text, which is the end id alone; repeated rows are packed as often as they
occur; an empty table gives no rows; other columns aren't looked at.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .byte_pairs import codec, shared_file
from .groups import durable
from .texts import blocks, text_column


@dataclass(frozen=True)
class Packing:
    capacity: int = 1024
    end_id: int = 2
    chunk: int = 8192  # documents, about, that are packed together
    islands: int = 3
    population: int = 6
    generations: int = 12
    rounds: int = 3
    open_bins: int = 32  # of each chunk, packed again with those of other chunks
    merge: int = 64  # chunks that become one
    seed: int = 11


def pieces(df: DataFrame, vocabulary: str, plan: Packing) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of all pieces of all documents; one pass."""
    content = shared_file(df, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(content.value)
        end = np.array([plan.end_id], np.uint32)
        for batch in batches:
            for lo, hi, data, offsets in blocks(text_column(batch), 8 << 20):
                ids, at = own.encode(data, offsets)
                row, number, start, length, crc = [], [], [], [], []
                for r, (a, b) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), strict=True)):
                    whole = np.append(ids[a:b].astype(np.uint32), end)
                    cuts = list(range(len(whole) % plan.capacity or plan.capacity, len(whole) + 1, plan.capacity))
                    for k, (x, y) in enumerate(zip([0, *cuts[:-1]], cuts, strict=True)):
                        row.append(r)
                        number.append(k)
                        start.append(x)
                        length.append(y - x)
                        crc.append(zlib.crc32(whole[x:y].astype("<u4").tobytes()))
                key = batch.column(0).slice(lo, hi - lo).take(pa.array(row, pa.int64()))
                yield pa.RecordBatch.from_arrays([key, pa.array(number, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    kind = df.schema["doc_id"].dataType.simpleString()
    return df.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


class Chunk:
    """Packings of one chunk; a packing is the bin of each document."""

    def __init__(self, lengths: np.ndarray, plan: Packing, seed: int):
        self.lengths, self.capacity = lengths, plan.capacity
        self.random = np.random.default_rng(seed)
        self.bound = -(-int(lengths.sum()) // plan.capacity)

    def best_fit(self, bins: np.ndarray, items: np.ndarray) -> np.ndarray:
        """Place items, in the given order, each into the fullest bin that takes it."""
        lengths = self.lengths.tolist()
        used = np.bincount(bins[bins >= 0], self.lengths[bins >= 0], minlength=0).astype(int).tolist()
        by_room: list[list[int]] = [[] for _ in range(self.capacity + 1)]
        rooms = 0  # bit r: there is a bin with just r left
        for b, n in enumerate(used):
            if n:
                by_room[self.capacity - n].append(b)
                rooms |= 1 << (self.capacity - n)
        rooms &= ~1
        next_bin, out = len(used), bins.copy()
        for i in items.tolist():
            n = lengths[i]
            fits = rooms >> n
            if fits:
                room = n + (fits & -fits).bit_length() - 1
                b = by_room[room].pop()
                if not by_room[room]:
                    rooms &= ~(1 << room)
            else:
                room, b = self.capacity, next_bin
                next_bin += 1
            out[i] = b
            if room > n:
                by_room[room - n].append(b)
                rooms |= 1 << (room - n)
        return out

    def fresh(self, noise: float) -> np.ndarray:
        order = np.argsort(-self.lengths * (1 + noise * self.random.standard_normal(len(self.lengths))), kind="stable")
        return self.best_fit(np.full(len(self.lengths), -1), order)

    def fills(self, bins: np.ndarray) -> np.ndarray:
        return np.bincount(bins, self.lengths)

    def cost(self, bins: np.ndarray) -> tuple[int, float]:
        """Number of bins, then how unevenly they are filled (the more uneven, the better)."""
        fills = self.fills(bins)
        fills = fills[fills > 0]
        return len(fills), -float(((fills / self.capacity) ** 2).sum())

    def crossed(self, giver: np.ndarray, taker: np.ndarray) -> np.ndarray:
        """taker with whole well-filled bins of giver in place of the bins that hold the same documents."""
        fills = self.fills(giver)
        good = np.flatnonzero(fills >= np.quantile(fills[fills > 0], 0.5))
        chosen = self.random.permutation(good)[: max(1, int(len(good) * self.random.uniform(0.2, 0.6)))]
        injected = np.isin(giver, chosen)
        hit = np.isin(taker, np.unique(taker[injected]))
        child = np.where(hit, -1, taker)
        child[injected] = giver[injected] + (taker.max() + 1)
        _, child_bins = np.unique(child[child >= 0], return_inverse=True)
        child[child >= 0] = child_bins
        loose = np.flatnonzero(child < 0)
        return self.best_fit(child, loose[np.argsort(-self.lengths[loose], kind="stable")])

    def evolved(self, population: list[np.ndarray], size: int, generations: int) -> list[np.ndarray]:
        given = len(population)
        while len(population) < size:
            population.append(self.fresh(0.05 * (len(population) - given)))
            if self.cost(population[-1])[0] <= self.bound:
                return [population[-1]]
        population.sort(key=self.cost)
        for _ in range(generations):
            if self.cost(population[0])[0] <= self.bound:
                return population[:1]
            i, j = self.random.choice(len(population), 2, replace=False)
            child = self.crossed(population[min(i, j)], population[max(i, j)])
            if self.cost(child) < self.cost(population[-1]):
                population[-1] = child
                population.sort(key=self.cost)
        return population


def _evolve(state: DataFrame, plan: Packing, number: int) -> DataFrame:
    """chunk, island, uids, lengths, population, bins (of the elite); a row of state is an island, homes its documents' bins so far."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            chunk, island, uids, lengths, homes, population, elite = (batch.column(i) for i in range(7))
            new, bins = [], []
            for r in range(batch.num_rows):
                sizes = lengths[r].values.to_numpy(zero_copy_only=False)
                seed = hash((plan.seed, number, chunk[r].as_py(), island[r].as_py())) & 0x7FFFFFFF
                own = Chunk(sizes, plan, seed)
                old = [np.frombuffer(p, np.int32).astype(np.int64) for p in (population[r].as_py() or [])]
                guest = elite[r].as_py()
                if guest is not None:
                    old = [*old[: plan.population - 1], np.frombuffer(guest, np.int32).astype(np.int64)]
                elif not old and homes[r].is_valid:
                    old = [np.unique(homes[r].values.to_numpy(zero_copy_only=False), return_inverse=True)[1]]
                best = own.evolved(old, plan.population, plan.generations)
                new.append([p.astype(np.int32).tobytes() for p in best])
                bins.append(own.cost(best[0])[0])
            yield pa.RecordBatch.from_arrays([chunk, island, uids, lengths, pa.array(new, pa.list_(pa.binary())), pa.array(bins, pa.int64())], names=["chunk", "island", "uids", "lengths", "population", "bins"])

    columns = ["chunk", "island", "uids", "lengths", "homes", "population", "elite"]
    return state.select(*columns).mapInArrow(run, "chunk long, island int, uids array<long>, lengths array<long>, population array<binary>, bins long")


def _bred(items: DataFrame, plan: Packing, level: int) -> DataFrame:
    """chunk, uids, lengths, bins: the best packing of each chunk's items (chunk, uid, length, home) over all islands and rounds."""
    # a chunk has about plan.chunk items or those of merge x open_bins bins, whatever the size of the table
    gathered = items.groupBy("chunk").agg(F.sort_array(F.collect_list(F.struct("uid", "length", "home"))).alias("i"))
    homes = F.when(F.exists("i", lambda x: x["home"].isNotNull()), F.col("i.home")).alias("homes")
    start = gathered.select("chunk", F.explode(F.sequence(F.lit(0), F.lit(plan.islands - 1))).alias("island"), F.col("i.uid").alias("uids"), F.col("i.length").alias("lengths"), homes)
    state = start.withColumns({"population": F.lit(None).cast("array<binary>"), "elite": F.lit(None).cast("binary")}).repartition("chunk", "island")
    for number in range(plan.rounds):
        state = durable(_evolve(state, plan, 1000 * level + number))
        if number + 1 < plan.rounds:
            state = migrated(state, plan).withColumn("homes", F.lit(None).cast("array<long>"))
    best = state.groupBy("chunk").agg(F.min_by(F.struct("uids", "lengths", F.col("population")[0].alias("bins")), F.struct("bins", "island")).alias("b"))
    return best.select("chunk", "b.uids", "b.lengths", "b.bins")


def migrated(state: DataFrame, plan: Packing) -> DataFrame:
    """state with the elite of each chunk's island before, the last one's for the first."""
    elites = state.select("chunk", ((F.col("island") + 1) % plan.islands).alias("island"), F.col("population")[0].alias("elite"))
    return state.join(elites, ["chunk", "island"])


def _placed(best: DataFrame, plan: Packing, level: int, open_bins: int) -> DataFrame:
    """uid, length, chunk, sequence_id, offset, open (in one of the chunk's open_bins least filled bins) from each chunk's best packing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                uids, lengths = (batch.column(i)[r].values.to_numpy(zero_copy_only=False) for i in (1, 2))
                bins, chunk = np.frombuffer(batch.column(3)[r].as_py(), np.int32), batch.column(0)[r].as_py()
                fills = np.bincount(bins, lengths)
                least = np.argsort(np.where(fills > 0, fills, np.inf), kind="stable")[:open_bins]
                order = np.argsort(bins, kind="stable")
                ends = np.cumsum(lengths[order])
                heads = np.append(True, np.diff(bins[order]) != 0)
                offset = ends - lengths[order]
                offset = offset - np.maximum.accumulate(np.where(heads, offset, 0))
                sequence = (((level << 30) + chunk) << 24) + bins[order].astype(np.int64)
                left = np.isin(bins[order], least)
                columns = [uids[order], lengths[order], np.full(len(order), chunk), sequence, offset, left]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["uid", "length", "chunk", "sequence_id", "offset", "open"])

    return best.mapInArrow(run, "uid long, length long, chunk long, sequence_id long, offset long, open boolean")


def sequences(short: DataFrame, plan: Packing) -> DataFrame:
    """uid, sequence_id, offset of pieces (uid, length) shorter than a sequence."""
    chunks, level, done = max(1, -(-short.count() // plan.chunk)), 0, None
    items = short.select(F.pmod(F.xxhash64("uid"), F.lit(chunks)).alias("chunk"), "uid", "length", F.lit(None).cast("long").alias("home"))
    while True:
        rows = durable(_placed(_bred(items, plan, level), plan, level, plan.open_bins if chunks > 1 else 0))
        settled = rows.filter("NOT open").select("uid", "sequence_id", "offset")
        done = settled if done is None else done.unionByName(settled)
        if chunks == 1:
            return done
        chunks, level = -(-chunks // plan.merge), level + 1
        items = rows.filter("open").select(F.floor(F.col("chunk") / plan.merge).alias("chunk"), "uid", "length", F.col("sequence_id").alias("home"))


def packed(df: DataFrame, vocabulary: str, plan: Packing = Packing()) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece."""
    whole = durable(pieces(df, vocabulary, plan).withColumn("uid", F.monotonically_increasing_id()))
    short = whole.filter(F.col("length") < plan.capacity)
    alone = whole.filter(F.col("length") == plan.capacity).withColumns({"sequence_id": -F.col("uid") - 1, "offset": F.lit(0).cast("long")})
    return short.join(sequences(short.select("uid", "length"), plan), "uid").unionByName(alone).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
