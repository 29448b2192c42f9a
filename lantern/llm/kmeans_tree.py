"""Approximate nearest neighbours by a hierarchical k-means tree with best-bin-first traversal.

The tree is fitted on a bounded sample of the vectors (`Tree.sample` rows of the smallest hashes) and broadcast; its
size is bounded by the sample.  Every vector is indexed in the leaf that a greedy descent reaches.  A query walks
the tree with a priority queue, always opening the most promising node (largest inner product with the node's
centre), so that leaves come in order of promise.  The number of leaves to visit is widened until calibration queries
reach the wanted recall; their true neighbours come from an exact pass over all vectors.

Queries and vectors meet leaf by leaf, as pairs of bounded blocks joined on the leaf's number, so a leaf that holds a
third of all vectors is many tasks.  Scores are inner products in double precision, each summed in the same order.

Defined results: a vector that is null, zero, or has a null or non-finite component takes no part, as does one of
another length than most vectors have, and a row without an id; ties go to the smaller id; rows with the same id are
candidates each by itself, none for a query of that id; a query sees enough leaves for 20 candidates if there are as many.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .groups import durable


@dataclass(frozen=True)
class Tree:
    k: int = 20
    sample: int = 16_000
    branch: int = 8
    least: int = 160  # sampled vectors below which a node isn't divided
    rounds: int = 8
    calibration: int = 64  # queries
    recall: float = 0.97
    block: int = 1024


class Node:
    def __init__(self, centre: np.ndarray):
        self.centre = centre
        self.children: list[Node] = []
        self.leaf = -1


def grown(vectors: np.ndarray, how: Tree) -> tuple[Node, int]:
    """The root and the number of leaves."""
    random, leaves = np.random.default_rng(5), 0
    root = Node(vectors.mean(0))
    todo = [(root, vectors)]
    while todo:
        node, own = todo.pop()
        groups = _clustered(own, how, random) if len(own) >= how.least else []
        if len(groups) < 2:
            node.leaf, leaves = leaves, leaves + 1
            continue
        for g in groups:
            node.children.append(Node(own[g].mean(0)))
            todo.append((node.children[-1], own[g]))
    return root, leaves


def _clustered(vectors: np.ndarray, how: Tree, random: np.random.Generator) -> list[np.ndarray]:
    centres = vectors[random.choice(len(vectors), how.branch, replace=False)]
    for _ in range(how.rounds):
        nearest = _nearest(vectors, centres)
        centres = np.stack([vectors[nearest == c].mean(0) if (nearest == c).any() else centres[c] for c in range(len(centres))])
    nearest = _nearest(vectors, centres)
    return [g for c in range(len(centres)) if len(g := np.flatnonzero(nearest == c))]


def _nearest(vectors: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres**2).sum(1)[None, :] - 2 * vectors @ centres.T).argmin(1)


def leaves_of(root: Node, vectors: np.ndarray) -> np.ndarray:
    """The leaf of each vector, by greedy descent."""
    out = np.empty(len(vectors), np.int64)
    todo = [(root, np.arange(len(vectors)))]
    while todo:
        node, rows = todo.pop()
        if not node.children:
            out[rows] = node.leaf
            continue
        nearest = _nearest(vectors[rows], np.stack([c.centre for c in node.children]))
        todo += [(c, rows[nearest == i]) for i, c in enumerate(node.children) if (nearest == i).any()]
    return out


def best_bins(root: Node, query: np.ndarray) -> Iterator[int]:
    """Leaves, best bin first."""
    queue: list[tuple[float, int, Node]] = [(0.0, 0, root)]
    count = 1
    while queue:
        node = heapq.heappop(queue)[2]
        if not node.children:
            yield node.leaf
            continue
        for child, promise in zip(node.children, np.stack([c.centre for c in node.children]) @ query, strict=True):
            heapq.heappush(queue, (-float(promise), count, child))
            count += 1


def usable(df: DataFrame) -> DataFrame:
    """vec_id, v array<double> of the rows that take part."""
    v = df.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v")).filter("vec_id IS NOT NULL AND v IS NOT NULL AND size(v) > 0")
    sound = v.filter(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0))
    common = sound.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "d").limit(1)
    return sound.join(F.broadcast(common.select("d")), F.size("v") == F.col("d"), "left_semi")


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _top(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query number, vector number, score) of each query's k best in a block, ties to the smaller id."""
    rough = queries @ vectors.T
    rough[query_ids[:, None] == ids[None, :]] = -np.inf
    kth = np.partition(rough, -k, axis=1)[:, -k] if len(ids) > k else np.full(len(queries), -np.inf)
    near = (rough >= (kth - 1e-9 * (1 + np.abs(kth)))[:, None]) & np.isfinite(rough)
    q, c = np.nonzero(near)
    score = (queries[q] * vectors[c]).sum(1)
    order = np.lexsort((ids[c], -score, q))
    q, c, score = q[order], c[order], score[order]
    place = np.arange(len(q)) - np.searchsorted(q, q)
    keep = place < k
    return q[keep], c[keep], score[keep]


def _best(found: DataFrame, k: int) -> DataFrame:
    """query_id, rank, vec_id, score (and other columns) of the k best of each query."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def exact(queries: list[tuple[int, list[float]]], indexed: DataFrame, k: int) -> DataFrame:
    """query_id, rank, vec_id, score, leaf for a bounded list of queries against all indexed vectors, in blocks."""
    shared = indexed.sparkSession.sparkContext.broadcast(queries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        qid, q = np.array([x for x, _ in shared.value]), np.array([x for _, x in shared.value])
        for batch in batches:
            ids, leaf = batch.column(0).to_numpy(), batch.column(2).to_numpy()
            i, c, score = _top(qid, q, ids, _matrix(batch.column(1)), k)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (qid[i], ids[c], score, leaf[c])], names=["query_id", "vec_id", "score", "leaf"])

    found = indexed.select("vec_id", "v", "leaf").mapInArrow(run, "query_id long, vec_id long, score double, leaf long")
    return _best(found, k)


def _blocks(rows: DataFrame, size: int) -> DataFrame:
    """leaf, ids, vectors: the rows of each leaf in blocks of about `size`."""
    counts = rows.groupBy("leaf").agg(F.count(F.lit(1)).alias("n"))  # a row for each leaf of the tree
    dealt = rows.join(F.broadcast(counts), "leaf").withColumn("block", F.pmod(F.xxhash64("vec_id"), F.ceil(F.col("n") / size)))
    gathered = dealt.groupBy("leaf", "block").agg(F.collect_list(F.struct("vec_id", "v")).alias("rows"))
    return gathered.select("leaf", F.col("rows.vec_id").alias("ids"), F.flatten("rows.v").alias("vectors"))


def search(embeddings: DataFrame, every: int = 20, how: Tree = Tree()) -> DataFrame:
    """query_id, rank, vec_id, score of the nearest of each row whose id is divisible by `every`."""
    spark = embeddings.sparkSession
    vectors = usable(embeddings)
    sample = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(how.sample).collect()
    empty = "query_id long, rank int, vec_id long, score double"
    if not sample:
        return spark.createDataFrame([], empty)
    root, n_leaves = grown(np.array([r["v"] for r in sample]), how)
    tree = spark.sparkContext.broadcast(root)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaf = leaves_of(tree.value, _matrix(batch.column(1)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaf)], names=["vec_id", "v", "leaf"])

    indexed = durable(vectors.mapInArrow(index, "vec_id long, v array<double>, leaf long"))
    queries = indexed.filter(F.col("vec_id") % every == 0).select("vec_id", "v")
    sizes = {r["leaf"]: r["count"] for r in indexed.groupBy("leaf").count().collect()}  # a number for each leaf
    visits = _calibrated(queries, indexed, root, n_leaves, how)

    def routed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, leaves = [], []
            for i, q in enumerate(_matrix(batch.column(1))):
                seen = 0
                for n, leaf in enumerate(best_bins(tree.value, q)):
                    if n >= visits and seen > how.k:
                        break
                    seen += sizes.get(leaf, 0)
                    rows.append(i)
                    leaves.append(leaf)
            take = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), pa.array(leaves, pa.int64())], names=["vec_id", "v", "leaf"])

    asked = queries.mapInArrow(routed, "vec_id long, v array<double>, leaf long")
    sides = _blocks(asked, how.block).select("leaf", F.col("ids").alias("q_ids"), F.col("vectors").alias("q")), _blocks(indexed, how.block)

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                q_ids, q, ids, v = (batch.column(i)[r].values.to_numpy(zero_copy_only=False) for i in range(4))
                i, c, score = _top(q_ids, q.reshape(len(q_ids), -1), ids, v.reshape(len(ids), -1), how.k)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (q_ids[i], ids[c], score)], names=["query_id", "vec_id", "score"])

    pairs = sides[0].join(sides[1], "leaf").select("q_ids", "q", "ids", "vectors").repartition(F.xxhash64("q_ids", "ids"))
    return _best(pairs.mapInArrow(compared, "query_id long, vec_id long, score double"), how.k).select("query_id", "rank", "vec_id", "score")


def _calibrated(queries: DataFrame, indexed: DataFrame, root: Node, n_leaves: int, how: Tree) -> int:
    """Leaves to visit, widened until the calibration queries reach the recall."""
    asked = [(r["vec_id"], r["v"]) for r in queries.orderBy(F.xxhash64("vec_id", F.lit(3)), "vec_id").limit(how.calibration).collect()]
    if not asked:
        return 1
    order = {}
    for vec_id, v in asked:
        order[vec_id] = {leaf: n for n, leaf in enumerate(best_bins(root, np.array(v)))}
    truth = exact(asked, indexed, how.k).select("query_id", "leaf").collect()  # at most calibration x k rows
    ranks = np.array([order[r["query_id"]][r["leaf"]] for r in truth])
    visits = 1
    while visits < n_leaves and len(ranks) and (ranks < visits).mean() < how.recall:
        visits += 1
    return visits
