"""Streaming over sorted partitions, durable intermediate results, and connected components."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import shared_folder


def durable(df: DataFrame, rows: int | None = None, per_file: int = 50_000) -> DataFrame:
    """A checkpoint in the shared folder.

    rows: about how many df has, where that is known; then there are as many files as cores, or one for each per_file rows,
    and not one for every partition of a shuffle.  On a local file system Spark starts a process for each file it makes.
    """
    context = df.sparkSession.sparkContext
    if rows is not None:
        df = df.coalesce(max(context.defaultParallelism, -(-rows // per_file)))
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def set_aside(df: DataFrame, *used: str) -> tuple[DataFrame, Callable[..., DataFrame]]:
    """df with every column but the `used` ones under a neutral name, and the step that gives all of them their names back (and adds the columns that it is given).

    Between the two an operator may add columns of any name: no column of the caller's is met or replaced.
    """
    inner = [c if c in used else f"aside{i}" for i, c in enumerate(df.columns)]

    def back(out: DataFrame, *more: Column) -> DataFrame:
        return out.select(*(F.col(i).alias(c) for i, c in zip(inner, df.columns, strict=True)), *more)

    return df.toDF(*inner), back


def whole_groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Of batches sorted by key: batches that hold whole groups, and the groups' bounds in each."""
    carried: list[pa.RecordBatch] = []

    def joined(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        return pa.Table.from_batches(parts).combine_chunks().to_batches()[0]

    def bounds(batch: pa.RecordBatch) -> np.ndarray:
        keys = batch.column(batch.schema.get_field_index(key))
        changes = pc.not_equal(keys[1:], keys[:-1]).to_numpy(zero_copy_only=False) if len(keys) > 1 else np.empty(0, bool)
        return np.concatenate(([0], np.flatnonzero(changes) + 1, [len(keys)]))

    for batch in batches:
        if not batch.num_rows:
            continue
        cuts = bounds(batch)
        at = batch.schema.get_field_index(key)
        if carried and carried[-1].column(at)[-1].as_py() == batch.column(at)[0].as_py():
            carried.append(batch.slice(0, cuts[1]))
            if len(cuts) == 2:
                continue
            done = joined(carried)
            yield done, bounds(done)
            batch, cuts = batch.slice(cuts[1]), cuts[1:] - cuts[1]
        elif carried:
            done = joined(carried)
            yield done, bounds(done)
        last = int(cuts[-2])
        if last:
            yield batch.slice(0, last), cuts[:-1]
        carried = [batch.slice(last)]
    if carried:
        done = joined(carried)
        yield done, bounds(done)


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """node, component (its smallest node) of the undirected edges a, b; alternating large and small stars.

    Every round replaces edges by edges to smaller nodes and is checkpointed; the loop ends when a round changes
    nothing.  Smallest neighbours are found by a partial aggregate and joined back, so a node of very many
    edges isn't gathered anywhere.
    """
    current = durable(edges.select("a", "b").filter("a <> b").distinct())
    state, rows = None, current.count()
    for _ in range(most_rounds):
        both = current.unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(least, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
        current = durable(small.select("e.a", "e.b").filter("a <> b").distinct(), rows)
        seen = current.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if seen == state:
            break
        state, rows = seen, seen[0]
    else:
        raise RuntimeError(f"no end after {most_rounds} rounds")
    roots = current.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return current.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
