"""Vector snapshots and exact vector search."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """0 where a vector has no length."""
    return F.coalesce(F.try_divide(dot(a, b), norm(a) * norm(b)), F.lit(0.0))


def normalized(a: Column) -> Column:
    """Of length 1, in single precision; a zero vector stays as it is."""
    size = norm(a)
    return F.transform(a, lambda x: F.when(size > 0, x / size).otherwise(x.cast("double")).cast("float"))


def matching(category: str | None = None, source: str | None = None, created_after: str | None = None, include_archived: bool = False) -> Column:
    """The payload filter; a row without status isn't archived."""
    keep = F.lit(True)
    if category is not None:
        keep &= F.col("category") == category
    if source is not None:
        keep &= F.col("source") == source
    if created_after is not None:
        keep &= F.col("created_at") >= F.lit(created_after).cast("timestamp")
    return keep if include_archived else keep & (F.coalesce("status", F.lit("")) != "archived")


def wrong_size(points: DataFrame, dim: int) -> DataFrame:
    """id, size, expected of the rows whose vector has another length."""
    return points.filter(F.coalesce(F.size("embedding"), F.lit(-1)) != dim).select("id", F.size("embedding").alias("size"), F.lit(dim).alias("expected"))


def top_k(queries: DataFrame, points: DataFrame, k: int, metric: str = "cosine", most_queries: int = 50_000) -> DataFrame:
    """query_id, rank, id, score of each query's k best points, ties to the smaller id.

    Queries (query_id, embedding) come in blocks of about most_queries, each broadcast; a partition of points keeps k rows
    a query, and only those are shuffled.  A task scores a part of its block at a time.
    """
    asked = queries.select(F.col("query_id").cast("long").alias("query_id"), F.col("embedding").cast("array<double>").alias("q"))
    n = asked.count()
    parts = max(1, -(-n // most_queries))
    found = [_of_block(asked.filter(F.pmod(F.xxhash64("query_id"), F.lit(parts)) == i), points, k, metric) for i in range(parts)]
    whole = found[0]
    for f in found[1:]:
        whole = whole.unionByName(f)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return whole.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "id", "score")


def _of_block(block: DataFrame, points: DataFrame, k: int, metric: str, most_scores: int = 2_000_000) -> DataFrame:
    rows = block.collect()  # a block of queries, of bounded size
    ids, matrix = np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], np.float64)
    shared = points.sparkSession.sparkContext.broadcast((ids, matrix))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q_ids, q = shared.value
        at, ids, best = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)  # the k best so far of every query
        least = np.full(len(q_ids), -np.inf)
        for batch in batches:
            if not batch.num_rows or not len(q_ids):
                continue
            own = batch.column(0).to_numpy()
            v = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(len(own), -1)
            step = max(1, most_scores // len(own))
            for lo in range(0, len(q), step):
                some = q[lo : lo + step]
                scores = some @ v.T
                if metric == "cosine":
                    scale = np.linalg.norm(some, axis=1)[:, None] * np.linalg.norm(v, axis=1)[None, :]
                    scores = np.divide(scores, scale, out=np.zeros_like(scores), where=scale > 0)
                even = np.round(scores, 12)
                bound = least[lo : lo + step]
                if len(own) > k:
                    bound = np.maximum(bound, np.partition(even, len(own) - k, axis=1)[:, len(own) - k])
                row, column = np.nonzero(even >= bound[:, None])  # ties of the k-th among them
                at, ids, best = np.concatenate((at, lo + row)), np.concatenate((ids, own[column])), np.concatenate((best, scores[row, column]))
            order = np.lexsort((ids, -np.round(best, 12), at))
            at, ids, best = at[order], ids[order], best[order]
            place = np.arange(len(at)) - np.searchsorted(at, at)
            at, ids, best, place = (x[place < k] for x in (at, ids, best, place))
            least[at[place == k - 1]] = np.round(best[place == k - 1], 12)
        yield pa.RecordBatch.from_arrays([pa.array(q_ids[at]), pa.array(ids), pa.array(best)], names=["query_id", "id", "score"])

    narrow = points.select(F.col("id").cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("v"))
    return narrow.mapInArrow(run, "query_id long, id long, score double")


def upserted(current: DataFrame, fresh: DataFrame, columns: list[str]) -> DataFrame:
    """id, columns, action of the next snapshot: inserted, updated (only if something differs), or left.

    Whole rows are compared, null as a value of its own: a value that moves to another column is a change.
    """
    a = current.select("id", F.struct(*columns).alias("old"))
    b = fresh.select("id", F.struct(*columns).alias("new"))
    both = a.join(b, "id", "full_outer")
    action = F.when(F.col("new").isNull(), "left").when(F.col("old").isNull(), "inserted").when(F.col("old").eqNullSafe(F.col("new")), "left").otherwise("updated")
    return both.select("id", F.coalesce("new", "old").alias("row"), action.alias("action")).select("id", "row.*", "action")


def stale(current: DataFrame, fresh: DataFrame) -> DataFrame:
    """Ids of points that the source no longer has."""
    return current.select("id").join(fresh.select("id"), "id", "left_anti")


def agreement(a: DataFrame, b: DataFrame) -> DataFrame:
    """query_id, same_order, shared, most_apart of two result lists (query_id, rank, id, score)."""
    order = lambda d, name: d.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "id")))["id"].alias(name))
    near = a.join(b.withColumnRenamed("score", "other"), ["query_id", "id"]).groupBy("query_id").agg(F.count(F.lit(1)).alias("shared"), F.round(F.max(F.abs(F.col("score") - F.col("other"))), 9).alias("most_apart"))
    return order(a, "x").join(order(b, "y"), "query_id").join(near, "query_id", "left").select("query_id", (F.col("x") == F.col("y")).alias("same_order"), F.coalesce("shared", F.lit(0)).alias("shared"), "most_apart")


def trigram_buckets(text: Column, dims: int = 4096) -> Column:
    """bucket to count of the text's letter triples, hashed by the first four bytes of MD5, little-endian."""
    low = F.concat(F.lit(" "), F.lower(text), F.lit(" "))
    letters = F.split(low, "")  # once a text: a substring at each place would walk the text anew
    after = lambda n: F.slice(letters, n + 1, F.greatest(F.size(letters) - n, F.lit(0)))
    pairs = F.zip_with(letters, after(1), lambda a, b: F.concat(a, b))
    whole = F.filter(F.zip_with(pairs, after(2), lambda a, b: F.concat(a, b)), lambda t: t.isNotNull())
    triples = F.when(F.coalesce(F.char_length(low), F.lit(0)) < 3, F.array(low)).otherwise(whole)

    def bucket(t: Column) -> Column:
        h = F.md5(t)
        return F.conv(F.concat(F.substring(h, 7, 2), F.substring(h, 5, 2), F.substring(h, 3, 2), F.substring(h, 1, 2)), 16, 10).cast("long") % dims

    return F.transform(triples, bucket)


def trigram_counts(rows: DataFrame, keys: list[str], text: str, dims: int = 4096, most_letters: int = 500_000, most_known: int = 1_000_000) -> DataFrame:
    """keys, bucket, n: the buckets of `trigram_buckets` with their counts, as rows; rows of equal keys are added up, null text has none.

    One Arrow pass counts the triples of some rows as numbers and hashes each distinct one once.  It takes rows of about
    most_letters bytes at a time and remembers at most most_known hashes, so its memory doesn't grow with texts or table.
    """

    def bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(len(keys))), 0).to_numpy(zero_copy_only=False).astype(np.int64))
            lo = 0
            while lo < batch.num_rows:
                hi = max(lo + 1, int(np.searchsorted(size, (size[lo - 1] if lo else 0) + most_letters, "right")))
                yield batch.slice(lo, hi - lo)
                lo = hi

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, int] = {}
        for batch in bounded(batches):
            row, code, count = [], [], []
            if len(known) > most_known:
                known.clear()
            for k, low in enumerate(batch.column(len(keys)).to_pylist()):
                if low is None:
                    continue
                letters = np.frombuffer(low.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
                if len(letters) < 3:
                    letters = np.append(letters, np.full(3 - len(letters), 0x1FFFFF, np.uint64))  # no letter
                codes, n = np.unique((letters[:-2] << np.uint64(42)) | (letters[1:-1] << np.uint64(21)) | letters[2:], return_counts=True)
                row.append(np.full(len(codes), k))
                code.append(codes)
                count.append(n)
            if not row:
                continue
            distinct, at = np.unique(np.concatenate(code), return_inverse=True)
            for c in distinct.tolist():
                if c not in known:
                    triple = "".join(chr(x) for x in (c >> 42, (c >> 21) & 0x1FFFFF, c & 0x1FFFFF) if x != 0x1FFFFF)
                    known[c] = int.from_bytes(hashlib.md5(triple.encode("utf-8", "surrogatepass")).digest()[:4], "little") % dims
            bucket = np.array([known[c] for c in distinct.tolist()], np.int64)[at]
            pairs, inverse = np.unique(np.concatenate(row) * dims + bucket, return_inverse=True)
            n = np.bincount(inverse, np.concatenate(count)).astype(np.int64)
            where = pa.array(pairs // dims)
            yield pa.RecordBatch.from_arrays([*(batch.column(i).take(where) for i in range(len(keys))), pa.array(pairs % dims), pa.array(n)], names=[*keys, "bucket", "n"])

    low = F.concat(F.lit(" "), F.lower(text), F.lit(" "))
    narrow = rows.select(*keys, low.alias("__low"))
    schema = T.StructType([*narrow.schema.fields[:-1], T.StructField("bucket", T.LongType()), T.StructField("n", T.LongType())])
    return narrow.mapInArrow(run, schema).groupBy(*keys, "bucket").agg(F.sum("n").alias("n"))


def in_batches(keys: list, texts: list[str], embed: Callable[[list[str]], np.ndarray], batch: int = 128, tokens: int = 8192) -> Iterator[pa.RecordBatch]:
    """key, vector of texts: embed runs on batches bounded by count and by tokens (a quarter of the bytes)."""
    lo = 0
    while lo < len(texts):
        hi, cost = lo, 0
        while hi < len(texts) and hi - lo < batch and (hi == lo or cost + len(texts[hi].encode()) // 4 <= tokens):
            cost += len(texts[hi].encode()) // 4
            hi += 1
        vectors = np.asarray(embed(texts[lo:hi]), np.float32)
        yield pa.RecordBatch.from_arrays([pa.array(keys[lo:hi]), pa.array(list(vectors), pa.list_(pa.float32()))], names=["key", "vector"])
        lo = hi


def embedded(rows: DataFrame, text: str, embed: Callable[[list[str]], np.ndarray], batch: int = 128, tokens: int = 8192) -> DataFrame:
    """key, vector for each distinct text, in batches (`in_batches`)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            yield from in_batches(part.column(0).to_pylist(), part.column(1).to_pylist(), embed, batch, tokens)

    distinct = rows.filter(F.trim(text) != "").groupBy(F.sha2(F.col(text), 256).alias("key")).agg(F.first(text).alias("text"))
    return distinct.select("key", "text").mapInArrow(run, "key string, vector array<float>")


def with_cache(rows: DataFrame, text: str, cache: DataFrame, embed: Callable[[list[str]], np.ndarray]) -> DataFrame:
    """rows with vector and cached: texts in the cache (key, vector) aren't computed again."""
    keyed = rows.withColumn("key", F.sha2(F.col(text), 256))
    missing = keyed.join(cache.select("key"), "key", "left_anti")
    fresh = embedded(missing, text, embed).withColumn("cached", F.lit(False))
    return keyed.join(cache.select("key", "vector").withColumn("cached", F.lit(True)).unionByName(fresh), "key", "left")
