"""Removal of repeated passages by difference-cover anchors.

A window of `window` words repeats if its words also start somewhere in a document of a smaller id.  Only word
positions whose remainder modulo `period` lies in a difference cover are hashed, over window - period + 1 words:
for any two places of the same window there is a shift below the period that is a cover position at both, so they
share an aligned anchor inside the window.  Anchors met in two documents are then extended: the full windows
around them, and only those, are hashed (96 bits) and compared over all documents.  A document whose whole text
stands in one of a smaller id is settled beforehand.

Shuffles carry (hash, document, position) rows.  Each block of documents first resolves what repeats inside it and
sends one document for each hash, so a passage that a third of all documents hold reaches a task once per block.

Defined results: null text has no words; a null id is neither smaller nor larger than others, so its document
keeps its words and takes none from others; rows with the same id don't take from each other; texts shorter than
a window stay whole; other columns are carried along by `without_repeats` and not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .groups import set_aside
from .texts import MIX1, Words, blocks, mix, text_column, windows

#: A perfect difference set; every remainder modulo 31 is a difference of two of its members.
PERIOD, COVER = 31, (1, 5, 11, 24, 25, 27)


@dataclass(frozen=True)
class Anchoring:
    window: int = 50
    period: int = PERIOD
    cover: tuple[int, ...] = COVER

    def __post_init__(self) -> None:
        if {(a - b) % self.period for a in self.cover for b in self.cover} != set(range(self.period)):
            raise ValueError("the cover positions are no difference cover of the period")
        if self.window < self.period:
            raise ValueError("a window must be at least as long as the period")

    @property
    def length(self) -> int:
        return self.window - self.period + 1

    def positions(self, n_words: int) -> np.ndarray:
        """Where a document of so many words has anchors."""
        if n_words < self.window:
            return np.empty(0, np.int64)
        at = np.arange(n_words - self.length + 1)
        return at[np.isin(at % self.period, self.cover)]


ROWS = "h1 long, h2 int, id long, th int, start int, n int"


def _runs(at: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of successive numbers with the same owner: indices of their heads, and lengths."""
    if not len(at):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    heads = np.flatnonzero(np.append(True, (np.diff(at) != 1) | (np.diff(owner) != 0)))
    return heads, np.diff(np.append(heads, len(at)))


def _resolved(h1: np.ndarray, h2: np.ndarray, row: np.ndarray, at: np.ndarray, doc: np.ndarray, th: np.ndarray, later_only: bool) -> pa.RecordBatch:
    """Of hashes at places (row, at) of a block: as runs (n > 0) the places that the block itself shows to repeat,
    and as single rows (n = 0) all places of the smallest document of each hash, for comparison with other blocks.

    later_only: the smallest document's places don't count as repeating.
    """
    order = np.lexsort((doc[row], h2, h1))
    h1, h2, row, at = h1[order], h2[order], row[order], at[order]
    fresh = np.append(True, (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])) if len(h1) else np.empty(0, bool)
    group = np.cumsum(fresh) - 1
    least = doc[row[fresh]][group] if len(h1) else doc[:0]
    first = doc[row] == least
    many = np.bincount(group, ~first, minlength=int(fresh.sum())) > 0 if len(h1) else np.empty(0, bool)
    known = ~first if later_only else many[group]
    k = np.flatnonzero(known)
    k = k[np.lexsort((at[k], row[k]))]
    heads, lengths = _runs(at[k], row[k])
    k = k[heads]
    s = np.flatnonzero(first)
    zeros = np.zeros(len(s), np.int32)
    own = (mix(doc[row[k]].view(np.uint64) + at[k].astype(np.uint64) * MIX1)).view(np.int64)  # deals the runs out evenly
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.concatenate((h1[s].view(np.int64), own))),
            pa.array(np.concatenate((h2[s].view(np.int32), np.zeros(len(k), np.int32)))),
            pa.array(np.concatenate((doc[row[s]], doc[row[k]]))),
            pa.array(np.concatenate((th[row[s]], th[row[k]]))),
            pa.array(np.concatenate((at[s], at[k])).astype(np.int32)),
            pa.array(np.concatenate((zeros, lengths)).astype(np.int32)),
        ],
        names=["h1", "h2", "id", "th", "start", "n"],
    )


def _block_words(batch: pa.RecordBatch) -> Iterator[tuple[int, int, Words, np.ndarray]]:
    for lo, hi, data, offsets in blocks(text_column(batch)):
        words = Words(data, offsets)
        yield lo, hi, words, words.hashes()


def _of(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def _numbers(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    return _of(batch, "__id").to_numpy(), _of(batch, "__th").to_numpy()


def _second(h: np.ndarray) -> np.ndarray:
    return mix(h ^ np.uint64(0xD6E8FEB86659FD93))


def _keyed(df: DataFrame) -> DataFrame:
    """df with __id, __th and __copy: whether the same text stands in a document of a smaller id.

    Such a document repeats as a whole; it is neither hashed nor compared.  Texts are compared by 128 bits on narrow
    rows.  The three passes below read this one frame, whose shuffle of the texts Spark runs once and reuses.
    """
    docs = df.withColumns({"__id": F.col("doc_id").cast("long"), "__th": F.shiftright(F.xxhash64("text"), 32).cast("int")})
    narrow = docs.select("__id", "__th", F.xxhash64("text").alias("t1"), F.xxhash64(F.lit(1), "text").alias("t2")).filter("__id IS NOT NULL AND text IS NOT NULL")
    first = narrow.groupBy("t1", "t2").agg(F.min("__id").alias("first"))
    copies = narrow.join(first, ["t1", "t2"]).filter("first < __id").select("__id", "__th", F.lit(True).alias("__copy")).distinct()
    return docs.join(copies, ["__id", "__th"], "left")


def _to_hash(batch: pa.RecordBatch) -> pa.RecordBatch:
    return batch.filter(pc.and_(pc.and_(_of(batch, "__id").is_valid(), _of(batch, "text").is_valid()), _of(batch, "__copy").is_null()))


def _places(df: DataFrame, plan: Anchoring) -> DataFrame:
    """ROWS of the anchors of all documents; start counts a document's anchors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in map(_to_hash, batches):
            ids, ths = _numbers(batch)
            for lo, hi, words, hashes in _block_words(batch):
                found = windows(hashes, plan.length)
                counts = np.diff(words.first)
                rows, ordinals, at = [], [], []
                for r in np.flatnonzero(counts >= plan.window):
                    own = plan.positions(int(counts[r]))
                    rows.append(np.full(len(own), r))
                    ordinals.append(np.arange(len(own)))
                    at.append(own + words.first[r])
                if rows:
                    h = found[np.concatenate(at)]
                    yield _resolved(h, np.zeros(len(h), np.uint32), np.concatenate(rows), np.concatenate(ordinals), ids[lo:hi], ths[lo:hi], False)

    return df.mapInArrow(run, ROWS)


def _runs_by_document(rows: DataFrame, keys: list[str], later_only: bool) -> DataFrame:
    """__id, __th, __runs: what repeats in each document, from ROWS."""
    same = Window.partitionBy(*keys)
    least, most = F.min("id").over(same), F.max("id").over(same)
    repeated = (F.col("id") > F.col("least")) if later_only else (F.col("most") > F.col("least"))
    marked = rows.withColumns({"least": least, "most": most}).filter((F.col("n") > 0) | repeated)
    run = F.struct("start", F.greatest("n", F.lit(1)).alias("n"))
    return marked.groupBy(F.col("id").alias("__id"), F.col("th").alias("__th")).agg(F.collect_list(run).alias("__runs"))


def _expanded(column: pa.Array, i: int) -> tuple[np.ndarray, np.ndarray]:
    runs = column[i].values
    return (np.empty(0, np.int64),) * 2 if runs is None else tuple(runs.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (0, 1))


def _flags(size: int, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Which of `size` places the ranges cover."""
    steps = np.zeros(size + 1, np.int64)
    np.add.at(steps, np.clip(starts, 0, size), 1)
    np.add.at(steps, np.clip(starts + lengths, 0, size), -1)
    return np.cumsum(steps)[:size] > 0


def _around(df: DataFrame, plan: Anchoring) -> DataFrame:
    """ROWS of the full windows around the repeated anchors (column __runs) of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(_of(batch, "__runs").is_valid())
            ids, ths = _numbers(batch)
            runs = _of(batch, "__runs")
            for lo, hi, words, hashes in _block_words(batch):
                first, second = windows(hashes, plan.window), windows(_second(hashes), plan.window).astype(np.uint32)
                rows, at, place = [], [], []
                for r in range(hi - lo):
                    n = int(words.first[r + 1] - words.first[r])
                    own = plan.positions(n)
                    if not len(own):
                        continue
                    anchors = own[_flags(len(own), *_expanded(runs, lo + r))]
                    starts = np.flatnonzero(_flags(n - plan.window + 1, np.maximum(anchors - plan.period + 1, 0), np.minimum(plan.period, anchors + 1)))
                    rows.append(np.full(len(starts), r))
                    at.append(starts)
                    place.append(starts + words.first[r])
                if rows:
                    p = np.concatenate(place)
                    yield _resolved(first[p], second[p], np.concatenate(rows), np.concatenate(at), ids[lo:hi], ths[lo:hi], True)

    return df.mapInArrow(run, ROWS)


def _removed_windows(keyed: DataFrame, plan: Anchoring) -> DataFrame:
    """__id, __th, __runs: the starts of the windows to be removed from each document that is no copy."""
    anchors = _runs_by_document(_places(keyed, plan), ["h1", "h2"], False)
    return _runs_by_document(_around(keyed.join(anchors, ["__id", "__th"], "left"), plan), ["h1", "h2"], True)


def _kept(df: DataFrame, plan: Anchoring, schema: str, make: Callable[[pa.RecordBatch, dict], list[pa.Array]]) -> DataFrame:
    """Rows of df with the words that no removed window covers; make gets a slice of rows and what is kept of each."""
    keyed = _keyed(df)
    joined = keyed.join(_removed_windows(keyed, plan), ["__id", "__th"], "left").select(*df.columns, "__copy", "__runs")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            runs, copy = _of(batch, "__runs"), _of(batch, "__copy").is_valid().to_numpy(zero_copy_only=False)
            for lo, hi, data, offsets in blocks(text_column(batch)):
                words = Words(data, offsets)
                keep = np.ones(len(words.ids), bool)
                counts, removed = np.diff(words.first), np.zeros(hi - lo, np.int64)
                for r in np.flatnonzero(runs.is_valid().to_numpy(zero_copy_only=False)[lo:hi]):
                    starts, lengths = _expanded(runs, lo + r)
                    gone = _flags(int(counts[r]), starts, lengths + plan.window - 1)
                    keep[words.first[r] : words.first[r + 1]] = ~gone
                    removed[r] = gone.sum()
                for r in np.flatnonzero(copy[lo:hi] & (counts >= plan.window)):
                    keep[words.first[r] : words.first[r + 1]] = False
                    removed[r] = counts[r]
                gap = (data == 32) | ((data >= 9) & (data <= 13))
                begins = np.zeros(len(data), np.int64)
                begins[words.at] = 1
                of = np.cumsum(begins) - 1  # the word at or before each byte
                ends = gap.copy()
                ends[1:] &= ~gap[:-1]
                ends[:1] = False
                ends[offsets[:-1][offsets[:-1] < len(data)]] = False
                stays = (~gap | ends) & (keep[np.maximum(of, 0)] if len(keep) else False)
                out = np.where(gap, np.uint8(32), data)[stays].tobytes()
                at = np.append(0, np.cumsum(stays))[offsets]
                texts = [out[a:b].removesuffix(b" ") for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                yield make(batch.slice(lo, hi - lo), {"n_words": counts, "n_removed": removed, "kept": texts})

    return joined.mapInArrow(run, schema)


def digests(df: DataFrame, plan: Anchoring = Anchoring()) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 (of the kept words joined by one space)."""

    def make(rows: pa.RecordBatch, found: dict) -> pa.RecordBatch:
        hashed = pa.array([hashlib.sha256(t).hexdigest() for t in found["kept"]])
        return pa.RecordBatch.from_arrays([rows.column(0), pa.array(found["n_words"], pa.int64()), pa.array(found["n_removed"]), hashed], names=["doc_id", "n_words", "n_removed", "kept_sha256"])

    kind = df.schema["doc_id"].dataType.simpleString()
    return _kept(df.select("doc_id", "text"), plan, f"doc_id {kind}, n_words long, n_removed long, kept_sha256 string", make)


def without_repeats(df: DataFrame, plan: Anchoring = Anchoring()) -> DataFrame:
    """All rows and columns of df; a text that loses words becomes its kept words joined by one space, others stay as they are.

    n_chars, where there is such a column, follows the text; others are kept as they are, whatever their names.
    """
    df, back = set_aside(df, "doc_id", "text", "n_chars")
    names, at = list(df.columns), df.columns.index("text")

    def make(rows: pa.RecordBatch, found: dict) -> pa.RecordBatch:
        old = rows.column(at)
        new = pa.array([t.decode() if n else o for t, n, o in zip(found["kept"], found["n_removed"].tolist(), old.to_pylist(), strict=True)], old.type)
        columns = [new if i == at else rows.column(i) for i in range(len(names))]
        return pa.RecordBatch.from_arrays(columns, names=names)

    out = _kept(df, plan, df.schema, make)
    return back(out.withColumn("n_chars", F.char_length("text").cast(df.schema["n_chars"].dataType)) if "n_chars" in df.columns else out)
