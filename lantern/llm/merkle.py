"""Merkle manifest of a table: a postorder append log, written by aligned builders, and proofs by position.

A leaf is the digest of a row.  The leaves of one source, in order, make a tree in which every run of `FAN` nodes has
one parent; the roots of all sources, in order, make the tree on top.  Builders take aligned runs of FAN ** LEVELS
nodes and append each node to their log as soon as its last child is there.  Where a node stands in such a log
follows from the sizes of the subtrees before it (`position`), so that siblings are read by position, without links
or a search.  A builder's root is a leaf for the builders of the next tier, until one node remains.

A tier shuffles one narrow row a node and is a sixteenth to the power of LEVELS of the one before; a hot source is
many builders.  Places come from a range partitioning in which equal rows are spread: no source, group of copies or
repeated id is gathered anywhere.

Defined results: a null field is `-`; a null source is a source of its own, the first; a null id comes first in its
source and isn't tampered with; rows of one source and id are ordered by their leaves, and equal rows have equal
proofs but for their place; an empty table has no root and gives no rows; other columns aren't looked at.
"""

from __future__ import annotations

import hashlib
import string
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .groups import durable, whole_groups

FAN, LEVELS = 16, 2
BUILDER = FAN**LEVELS
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(content: bytes) -> bytes:
    """Lowercase hex, as bytes."""
    return hashlib.sha256(content).hexdigest().encode()


def counts(n: int, levels: int | None = None) -> list[int]:
    """Nodes on each level of a tree over n leaves; without levels, up to the one that remains."""
    out = [n]
    while out[-1] > 1 if levels is None else len(out) <= levels:
        out.append(-(-out[-1] // FAN))
    return out


def position(level: int, i: int, sizes: list[int]) -> int:
    """Where node i of a level stands in postorder: the nodes complete by then, from 0."""
    below = sum(min((i + 1) * FAN ** (level - k), sizes[k]) for k in range(level + 1))
    return below + sum(i // FAN ** (k - level) for k in range(level + 1, len(sizes))) - 1


def children(level: int, i: int, sizes: list[int]) -> list[int]:
    """Positions of the run whose parent is node i of the level."""
    return [position(level - 1, k, sizes) for k in range(FAN * i, min(FAN * (i + 1), sizes[level - 1]))]


def appended(leaves: list[bytes], sizes: list[int]) -> list[bytes]:
    """The log over the leaves: every node directly after its last child."""
    log: list[bytes] = []
    for i, leaf in enumerate(leaves):
        log.append(leaf)
        at = i
        for level in range(1, len(sizes)):
            if (at + 1) % FAN and at + 1 < sizes[level - 1]:
                break
            at //= FAN
            log.append(digest(b"".join(log[p] for p in children(level, at, sizes))))
    return log


def siblings(log: list[bytes], sizes: list[int]) -> list[list[tuple[bytes, bytes]]]:
    """For every leaf, level by level, what stands left and right of its node in its run."""
    around: list[list[tuple[bytes, bytes]]] = []
    for level in range(1, len(sizes)):
        pairs = []
        for i in range(sizes[level]):
            run = [log[p] for p in children(level, i, sizes)]
            pairs += [(b"".join(run[:j]), b"".join(run[j + 1 :])) for j in range(len(run))]
        around.append(pairs)
    return [[pairs[i // FAN**k] for k, pairs in enumerate(around)] for i in range(sizes[0])]


def folded(leaf: bytes, path: list[tuple[bytes, bytes]]) -> bytes:
    for left, right in path:
        leaf = digest(left + leaf + right)
    return leaf


def leaf(text: Column | None = None) -> Column:
    """The digest of a row, with another text where one is given."""
    values = [F.col(c).cast("string") for c in FIELDS[:-1]] + [F.col("text") if text is None else text]
    parts = [F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-")) for v in values]
    return F.sha2(F.concat(*parts), 256)


def tampered() -> Column:
    """Whether the check tampers with a row."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))


def lowered(text: Column) -> Column:
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def numbered(rows: DataFrame, *order: str) -> DataFrame:
    """rows with i, the place in the group `g` by the order, and n, the group's rows; a checkpoint.

    Rows are dealt by range over the group, the order and a number of their own, so that neither a group nor equal
    rows meet in one task; what each partition holds of a group gives the places before it.
    """
    n_parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    own = durable(rows.withColumn("__own", F.monotonically_increasing_id()))  # the range partitioner reads its input twice
    dealt = own.repartitionByRange(n_parts, "g", *order, "__own").sortWithinPartitions("g", *order, "__own")
    placed = durable(dealt.withColumn("__at", F.monotonically_increasing_id()).withColumn("__part", F.shiftright("__at", 33)))
    before = Window.partitionBy("g").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    held = placed.groupBy("__part", "g").agg(F.min("__at").alias("__first"), F.count(F.lit(1)).alias("__n"))
    starts = held.withColumns({"__before": F.coalesce(F.sum("__n").over(before), F.lit(0)), "n": F.sum("__n").over(Window.partitionBy("g"))})
    found = placed.join(starts, ["__part", "g"]).withColumn("i", F.col("__at") - F.col("__first") + F.col("__before"))
    return found.select(*(c for c in rows.columns), "i", "n")


def builders(rows: DataFrame) -> DataFrame:
    """g, block, n, first (the block's first place), ids, others, log (digests in completion order), root: a row for each aligned builder.

    rows: g, i, n, id, leaf and other (a digest that is to be folded in place of the leaf, or null).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, cuts in whole_groups(batches, "key"):
            key, g, i, n, ids, leaves, others = batch.columns
            heads = cuts[:-1]
            totals = n.take(pa.array(heads)).to_pylist()
            logs = []
            texts = [x.encode() for x in leaves.to_pylist()]
            for lo, hi, total in zip(heads.tolist(), cuts[1:].tolist(), totals, strict=True):
                logs.append(appended(texts[lo:hi], counts(hi - lo, LEVELS if total > BUILDER else None)))
            bounds = pa.array(cuts, pa.int32())
            first = i.take(pa.array(heads))
            yield pa.RecordBatch.from_arrays(
                [
                    g.take(pa.array(heads)), pa.array([x // BUILDER for x in first.to_pylist()], pa.int64()), n.take(pa.array(heads)), pa.ListArray.from_arrays(bounds, ids), pa.ListArray.from_arrays(bounds, others),
                    pa.array([b"".join(x) for x in logs], pa.binary()), pa.array([x[-1].decode() for x in logs]),
                ],
                names=["g", "block", "n", "ids", "others", "log", "root"],
            )

    kind = rows.schema["id"].dataType.simpleString()
    keyed = rows.withColumn("key", F.concat_ws("/", F.floor(F.col("i") / BUILDER).cast("string"), "g"))
    dealt = keyed.repartition("key").sortWithinPartitions("key", "i").select("key", "g", "i", "n", "id", "leaf", "other")
    return dealt.mapInArrow(run, f"g string, block long, n long, ids array<{kind}>, others array<string>, log binary, root string")


def tree(rows: DataFrame) -> list[DataFrame]:
    """The tiers of builders over rows (see `builders`), each a checkpoint; a group ends in the tier where it has at most one builder."""
    tiers = []
    while True:
        tiers.append(durable(builders(rows)))
        if tiers[-1].filter(F.col("n") > BUILDER).isEmpty():
            return tiers
        several = tiers[-1].filter(F.col("n") > BUILDER)
        rows = several.select("g", F.col("block").alias("i"), F.ceil(F.col("n") / BUILDER).alias("n"), F.lit(None).cast("string").alias("id"), F.col("root").alias("leaf"), F.lit(None).cast("string").alias("other"))


PATH = "array<struct<left:binary,right:binary>>"


def _unpacked(batch: pa.RecordBatch) -> Iterator[tuple[dict, list[bytes], list[list[tuple[bytes, bytes]]]]]:
    """Of each builder: its row, its leaves, and for every leaf the siblings up to the top."""
    for j in range(batch.num_rows):
        row = {c: batch.column(k)[j].as_py() for k, c in enumerate(batch.schema.names)}
        log = [row["log"][k : k + 64] for k in range(0, len(row["log"]), 64)]
        sizes = counts(len(row["ids"]), LEVELS if row["n"] > BUILDER else None)
        above = [(s["left"], s["right"]) for s in row["path"]]
        yield row, [log[position(0, k, sizes)] for k in range(sizes[0])], [own + above for own in siblings(log, sizes)]


def paths(tier: DataFrame, above: DataFrame) -> DataFrame:
    """g, place, id, leaf, subroot, path (to the top) of every leaf of a tier; above has g, block, subroot, path of the tier's builders."""
    steps = pa.list_(pa.struct([("left", pa.binary()), ("right", pa.binary())]))
    kind = tier.schema["ids"].dataType.elementType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("ids")
            for j, (row, leaves, found) in enumerate(_unpacked(batch)):
                n, first = len(found), row["block"] * BUILDER
                own = pa.array([[{"left": a, "right": b} for a, b in p] for p in found], steps)
                yield pa.RecordBatch.from_arrays([pa.array([row["g"]] * n), pa.array(range(first, first + n), pa.int64()), batch.column(at)[j].values, pa.array([x.decode() for x in leaves]), pa.array([row["subroot"]] * n, pa.string()), own], names=["g", "place", "id", "leaf", "subroot", "path"])

    return tier.join(above, ["g", "block"]).mapInArrow(run, f"g string, place long, id {kind}, leaf string, subroot string, path {PATH}")


def proved(tier: DataFrame, above: DataFrame) -> DataFrame:
    """id, leaf, subroot, proof, folded of every leaf of the lowest tier."""
    kind = tier.schema["ids"].dataType.elementType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("ids")
            for j, (row, leaves, found) in enumerate(_unpacked(batch)):
                n = len(found)
                proofs = [digest(b"".join(left + right for left, right in p)).decode() for p in found]
                roots = [folded(x if y is None else y.encode(), p).decode() for x, y, p in zip(leaves, row["others"], found, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(at)[j].values, pa.array([x.decode() for x in leaves]), pa.array([row["subroot"]] * n, pa.string()), pa.array(proofs), pa.array(roots)], names=["id", "leaf", "subroot", "proof", "folded"]
                )

    return tier.join(above, ["g", "block"]).mapInArrow(run, f"id {kind}, leaf string, subroot string, proof string, folded string")


def leaves(df: DataFrame) -> DataFrame:
    """g (the source's place in order: empty for null), id, leaf, other (the digest of the tampered row, null where there is none)."""
    g = F.coalesce(F.concat(F.lit("+"), F.col("source").cast("string")), F.lit(""))
    return df.select(*FIELDS).select(g.alias("g"), F.col("doc_id").alias("id"), leaf().alias("leaf"), F.when(tampered(), leaf(lowered(F.col("text")))).alias("other"))


def _tops(tiers: list[DataFrame]) -> DataFrame:
    """g, root of every group of a tree."""
    ended = [t.filter(F.col("n") <= BUILDER).select("g", "root") for t in tiers]
    out = ended[0]
    for e in ended[1:]:
        out = out.unionByName(e)
    return out


def manifest(df: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of every row of df."""
    below = tree(numbered(leaves(df), "id", "leaf"))
    none = F.lit(None).cast("string")
    sources = _tops(below).select(F.lit("").alias("g"), F.col("g").alias("id"), F.col("root").alias("leaf"), none.alias("other"))
    upper = tree(numbered(sources, "id"))
    root = next((r["root"] for r in _tops(upper).collect()), None)  # one digest
    # from the top down: of every source, then of every builder, the siblings that all its leaves share
    over = upper[-1].select("g", "block", F.lit(None).cast("string").alias("subroot"), F.array().cast(PATH).alias("path"))
    below_of = lambda found: found.select("g", F.col("place").alias("block"), "subroot", "path")
    for tier in reversed(upper[1:]):
        over = below_of(paths(tier, over))
    of_source = durable(paths(upper[0], over).select(F.col("id").alias("g"), F.col("leaf").alias("subroot"), "path"))
    above = None
    for k in reversed(range(len(below))):
        ended = below[k].filter(F.col("n") <= BUILDER).select("g", "block").join(of_source, "g")
        above = ended if above is None else ended.unionByName(above)
        if k:
            above = durable(below_of(paths(below[k], above)))
    found = proved(below[0], above)
    return found.select(F.col("id").alias("doc_id"), "leaf", "subroot", F.lit(root).cast("string").alias("root"), F.col("proof").alias("proof_sha256"), F.col("folded").alias("folded_root"), (F.col("folded") == F.lit(root)).alias("verified"))


def append_log(df: DataFrame) -> DataFrame:
    """source, position, level, place, digest of every node of each source's tree; positions are those of one log over the whole source."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                n_leaves, tier = row["leaves"], row["tier"]
                whole = counts(n_leaves)
                log = [row["log"][k : k + 64] for k in range(0, len(row["log"]), 64)]
                sizes = counts(len(row["ids"]), LEVELS if row["n"] > BUILDER else None)
                out = []
                for level in range(1 if tier else 0, len(sizes)):  # a tier's leaves are nodes of the tier below
                    for i in range(sizes[level]):
                        place = row["block"] * FAN ** (LEVELS - level) + i
                        out.append((row["g"][1:] if row["g"] else None, position(tier * LEVELS + level, place, whole), tier * LEVELS + level, place, log[position(level, i, sizes)].decode()))
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.string()), strict=True)] if out else [pa.array([], t) for t in (pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.string())], names=["source", "position", "level", "place", "digest"])

    tiers = tree(numbered(leaves(df), "id", "leaf"))
    sizes = tiers[0].filter("block = 0").select("g", F.col("n").alias("leaves"))
    out = None
    for k, t in enumerate(tiers):
        part = t.select("g", "block", "n", F.transform("ids", lambda x: F.lit(0)).alias("ids"), "log", F.lit(k).alias("tier")).join(sizes, "g")
        out = part if out is None else out.unionByName(part)
    return out.mapInArrow(run, "source string, position long, level int, place long, digest string")


def _sql(source_levels: int = 6, top_levels: int = 4) -> str:
    """DuckDB SQL of `manifest` for sources of up to 16 ** source_levels rows."""
    upper, lower = string.ascii_uppercase, string.ascii_lowercase
    part = lambda e: f"coalesce(strlen({e})::varchar || ':' || {e}, '-')"
    row = lambda text: "sha256(" + " || ".join(part(e) for e in ("doc_id::varchar", "source", "lang", "n_chars::varchar", text)) + ")"
    sql = f"""WITH tab AS (SELECT list_transform(range(256), lambda b: list_reduce(list_prepend(b, range(8)), lambda a, r: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)) AS t),
 d AS (SELECT doc_id, source, coalesce('+' || source, '') AS g, {row("text")} AS leaf, {row(f"translate(text, '{upper}', '{lower}')")} AS other,
  xor(list_reduce(list_prepend(4294967295, list_transform(string_split(doc_id::varchar, ''), lambda c: ascii(c)::bigint)), lambda a, x: xor(a >> 8, t[xor(a & 255, x) + 1])), 4294967295) % 5 = 0 AS changed FROM documents, tab),
 x0 AS (SELECT doc_id, g, leaf, CASE WHEN changed THEN other ELSE leaf END AS y, '' AS proof, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM d),
 n0 AS (SELECT g, i, leaf AS h, count(*) OVER (PARTITION BY g) AS n FROM x0)"""

    def level(k: int, nodes: str, rows: str) -> str:
        return f""",
 r{nodes}{k} AS (SELECT g, i // 16 AS i, list(h ORDER BY i) AS hs, max(n) AS n FROM {nodes}{k} GROUP BY g, i // 16),
 {nodes}{k + 1} AS (SELECT g, i, CASE WHEN n = 1 THEN hs[1] ELSE sha256(array_to_string(hs, '')) END AS h, (n + 15) // 16 AS n FROM r{nodes}{k}),
 {rows}{k + 1} AS (SELECT x.* REPLACE (x.i // 16 AS i, CASE WHEN n = 1 THEN y ELSE sha256(array_to_string(hs[:x.i % 16], '') || y || array_to_string(hs[x.i % 16 + 2:], '')) END AS y,
  CASE WHEN n = 1 THEN proof ELSE proof || array_to_string(hs[:x.i % 16], '') || array_to_string(hs[x.i % 16 + 2:], '') END AS proof) FROM {rows}{k} x JOIN r{nodes}{k} r ON x.g = r.g AND x.i // 16 = r.i)"""

    for k in range(source_levels):
        sql += level(k, "n", "x")
    sql += f""",
 s AS (SELECT g AS source, h AS subroot, row_number() OVER (ORDER BY g) - 1 AS i FROM n{source_levels}),
 m0 AS (SELECT '' AS g, i, subroot AS h, count(*) OVER () AS n FROM s),
 z0 AS (SELECT doc_id, '' AS g, leaf, subroot, y, proof, s.i FROM x{source_levels} x JOIN s ON x.g = s.source)"""
    for k in range(top_levels):
        sql += level(k, "m", "z")
    return sql + f" SELECT doc_id, leaf, subroot, m.h AS root, sha256(proof) AS proof_sha256, y AS folded_root, y = m.h AS verified FROM z{top_levels} z, m{top_levels} m"


SQL = _sql()
