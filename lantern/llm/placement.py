"""Placement of documents on shards by a permutation-filled lookup table.

Every shard has its own order of preference over the slots of a table of prime size (an offset and a step); shards
take turns, each claiming its next free slot, a shard of weight w taking part in w of every max(w) turns.  The table
has a fixed number of rows, so it is broadcast, and a document's shard is one lookup of its key's hash.  Adding or
removing a shard moves few other keys.

Rows of one key go to one slot, but a key of more than rows_per_part rows is cut into numbered parts, each with a slot
of its own; only the key's own rows decide, so that a key's place doesn't move with the rest of the table.  The list of
such keys is broadcast up to a checked size.  The part of a row is a hash of all its columns, plus the row's rank among equal rows,
modulo the number of parts: the same rows give the same placement, however they are partitioned and read again.

Defined results: a null id is keyed by its text, null text and null id by nothing; repeated rows of a key that isn't
cut share its shard, those of a key that is cut are spread evenly over its parts; an empty table gives no rows; other
columns keep their names and values, so a placement column whose name is taken is called `placed_` and that name.
"""

from __future__ import annotations

from collections.abc import Sequence

import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .groups import durable, set_aside

SLOTS = 65537


def filled(shards: Sequence[str], slots: int = SLOTS, weights: Sequence[int] | None = None) -> list[int]:
    """The number of the shard that holds each slot."""
    if slots < 2 or any(slots % d == 0 for d in range(2, int(slots**0.5) + 1)):
        raise ValueError("the number of slots must be prime")
    weights = list(weights or [1] * len(shards))
    if not shards or len(weights) != len(shards) or min(weights) < 0 or not max(weights):
        raise ValueError("every shard needs a weight, one of them at least 1")
    offset = [xxhash.xxh3_64_intdigest(s, seed=1) % slots for s in shards]
    step = [xxhash.xxh3_64_intdigest(s, seed=2) % (slots - 1) + 1 for s in shards]
    table, turn, left, credit = [-1] * slots, [0] * len(shards), slots, [0] * len(shards)
    while left:
        for i in range(len(shards)):
            credit[i] += weights[i]
            if credit[i] < max(weights) or not left:
                continue
            credit[i] -= max(weights)
            slot = (offset[i] + turn[i] * step[i]) % slots
            while table[slot] >= 0:
                turn[i] += 1
                slot = (offset[i] + turn[i] * step[i]) % slots
            table[slot] = i
            turn[i] += 1
            left -= 1
    return table


def _slot(key: Column, part: Column, slots: int) -> Column:
    return F.pmod(F.xxhash64(key, part), F.lit(slots)).cast("int")


def _ranked(rows: DataFrame, block: int = 10_000) -> DataFrame:
    """rows with __rank, a number from 0 on within rows that are equal in every column.

    Equal rows are counted and made again from their number, in blocks that are spread before they are unfolded, so
    that no task holds or numbers all copies of one row.
    """
    counted = rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("__copies"))
    blocks = counted.withColumn("__first", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__copies") - 1, F.lit(block).cast("long"))))
    last = F.least(F.col("__first") + block, F.col("__copies")) - 1
    spread = blocks.repartition("__first", "doc_id", "text")
    return spread.withColumn("__rank", F.explode(F.sequence(F.col("__first"), last))).drop("__copies", "__first")


def _names(columns: Sequence[str]) -> list[str]:
    taken, out = {c.lower() for c in columns}, []
    for name in ("part", "slot", "shard"):
        while name in taken:
            name = f"placed_{name}"
        out.append(name)
    return out


def placed(df: DataFrame, shards: Sequence[str], slots: int = SLOTS, weights: Sequence[int] | None = None, rows_per_part: int = 10_000, most_hot: int = 100_000) -> DataFrame:
    """The rows of df (doc_id, text and any others) with part, slot and shard.

    A key of more than rows_per_part rows is cut into parts of about so many; only its own count decides.  The keys that
    are cut are broadcast while there are at most most_hot of them, and joined beyond that.
    """
    spark, names = df.sparkSession, _names(df.columns)
    table = spark.createDataFrame([(i, shards[s]) for i, s in enumerate(filled(shards, slots, weights))], "__slot int, __shard string")
    df, back = set_aside(df, "doc_id", "text")
    key = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("text:"), F.xxhash64("text").cast("string")))
    keyed = df.withColumn("__key", key)
    sizes = keyed.groupBy("__key").agg(F.count(F.lit(1)).alias("__n"))
    hot = durable(sizes.filter(F.col("__n") > rows_per_part).select(F.col("__key").alias("__hot"), F.ceil(F.col("__n") / rows_per_part).alias("__parts")))
    hot = F.broadcast(hot) if hot.count() <= most_hot else hot
    is_hot = F.col("__key").eqNullSafe(F.col("__hot"))
    content = F.xxhash64("text", F.to_json(F.struct(*(c for c in df.columns if c != "text"))))
    cold = keyed.join(hot, is_hot, "left_anti").withColumn("__part", F.lit(0))
    cut = _ranked(keyed.join(hot, is_hot, "left_semi")).join(hot, is_hot).withColumn("__part", F.pmod(F.pmod(content, "__parts") + F.col("__rank"), F.col("__parts")).cast("int"))
    parts = cold.unionByName(cut.select(*cold.columns))
    found = parts.withColumn("__slot", _slot(F.col("__key"), F.col("__part"), slots)).join(F.broadcast(table), "__slot", "left")
    return back(found, *(F.col(f"__{k}").alias(n) for k, n in zip(("part", "slot", "shard"), names, strict=True)))


def write_shards(df: DataFrame, path: str, slot: str = "slot", shard: str = "shard") -> None:
    """The placed rows as one folder for each shard; a shard's rows come from several tasks."""
    df.repartition(shard, slot).write.partitionBy(shard).parquet(path)
