"""Decontamination: a broadcast hash set of a benchmark's word windows, verified hits, spans or documents removed.

Terms are runs of letters, digits and whatever isn't ASCII, with A-Z in lower case.  A window is `words` consecutive
terms of one benchmark item; an item of fewer is one window as a whole.  A document's term is hit if it lies in an
occurrence of a window.  The windows are a hash set, one for each length, that is broadcast as arrays; documents are
scanned in one pass without a shuffle.  Only places where every term is one of the benchmark's are hashed, and what
the hash set finds is compared term by term.

The set is broadcast only while the benchmark's texts have at most `most_bytes`, which bounds it (about 20 bytes for
each of theirs).  A larger benchmark is matched by shuffled joins on two independent 64-bit hashes of each window,
which then decide; the windows of one document come back as its own list.

Defined results: null text has no words; items without words have no window; rows of one item id are one item; an item
without an id hits words but is not counted or named; rows with the same id are marked by their own texts; other
columns are carried along by `without_spans` and `clean_documents` and not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .groups import set_aside
from .texts import ROLL, Words, blocks, mix, terms, text_column, windows


@dataclass(frozen=True)
class Leaks:
    words: int = 10
    most_bytes: int = 4 << 20  # of benchmark text, up to which its windows are broadcast


def _hashed(ids: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each row of term numbers."""
    h = np.full(len(ids), ids.shape[1], np.uint64)
    with np.errstate(over="ignore"):
        for k in range(ids.shape[1]):
            h = mix(h * ROLL + ids[:, k].astype(np.uint64))
    return h


@dataclass(frozen=True)
class _OfLength:
    """The distinct windows of one length, by hash: their terms, and which items hold them."""

    hashes: np.ndarray
    ids: np.ndarray
    items: np.ndarray
    first: np.ndarray
    most_alike: int  # windows of one hash

    def found(self, ids: np.ndarray) -> np.ndarray:
        """The window that each row of term numbers is, or -1."""
        h = _hashed(ids)
        at = np.searchsorted(self.hashes, h)
        out = np.full(len(ids), -1)
        for k in range(self.most_alike):
            place = np.minimum(at + k, len(self.hashes) - 1)
            same = np.flatnonzero((out < 0) & (self.hashes[place] == h))
            same = same[(self.ids[place[same]] == ids[same]).all(1)]
            out[same] = place[same]
        return out


class WindowSet:
    """The windows of a bounded benchmark."""

    def __init__(self, items: list[tuple[str | None, str | None]], words: int):
        texts = pa.array([t or "" for _, t in items], pa.large_string())
        self.names = sorted({str(i) for i, _ in items if i is not None})
        place = {name: k for k, name in enumerate(self.names)}
        of = np.array([-1 if i is None else place[str(i)] for i, _ in items], np.int64)
        self.vocabulary: dict[bytes, int] = {}
        rows: dict[int, list[np.ndarray]] = {}
        holders: dict[int, list[np.ndarray]] = {}
        for lo, hi, data, offsets in blocks(texts):
            w = terms(data, offsets)
            number = np.array([self.vocabulary.setdefault(x, len(self.vocabulary)) for x in w.vocab.to_pylist()], np.int64)
            ids = number[w.ids]
            for r in range(hi - lo):
                own = ids[w.first[r] : w.first[r + 1]]
                n = min(words, len(own))
                if n:
                    found = np.lib.stride_tricks.sliding_window_view(own, n)
                    rows.setdefault(n, []).append(found)
                    holders.setdefault(n, []).append(np.full(len(found), of[lo + r]))
        self.by_length = {n: self._of_length(np.concatenate(rows[n]), np.concatenate(holders[n])) for n in sorted(rows)}

    @staticmethod
    def _of_length(ids: np.ndarray, items: np.ndarray) -> _OfLength:
        h = _hashed(ids)
        order = np.lexsort((items, *ids.T[::-1], h))
        h, ids, items = h[order], ids[order], items[order]
        fresh = np.append(True, (h[1:] != h[:-1]) | (ids[1:] != ids[:-1]).any(1))
        window = np.cumsum(fresh) - 1
        pair = np.flatnonzero(np.append(True, (window[1:] != window[:-1]) | (items[1:] != items[:-1])) & (items >= 0))
        first = np.searchsorted(window[pair], np.arange(fresh.sum() + 1))
        h = h[fresh]
        alike = np.diff(np.flatnonzero(np.append(np.append(True, h[1:] != h[:-1]), True)))
        return _OfLength(h, ids[fresh], items[pair], first, int(alike.max()))

    def hits(self, words: Words) -> tuple[np.ndarray, list[list[str]]]:
        """Which terms of a block are hit, and the items that each text holds windows of."""
        n_texts, size = len(words.first) - 1, len(words.ids)
        number = np.array([self.vocabulary.get(x, -1) for x in words.vocab.to_pylist()], np.int64)
        ids = number[words.ids] if len(number) else np.empty(0, np.int64)
        doc = np.repeat(np.arange(n_texts), np.diff(words.first))
        end = words.first[1:][doc]
        strange = np.append(0, np.cumsum(ids < 0))
        cover, held = np.zeros(size + 1, np.int64), []
        for n, own in self.by_length.items():
            at = np.arange(max(0, size - n + 1))
            at = at[(strange[at + n] == strange[at]) & (at + n <= end[at])]
            for some in np.array_split(at, 1 + len(at) // (1 << 18)):
                window = own.found(ids[some[:, None] + np.arange(n)])
                some, window = some[window >= 0], window[window >= 0]
                np.add.at(cover, some, 1)
                np.add.at(cover, some + n, -1)
                pairs = np.unique(np.stack((doc[some], window), 1), axis=0)
                lengths = own.first[pairs[:, 1] + 1] - own.first[pairs[:, 1]]
                flat = np.repeat(own.first[pairs[:, 1]] - np.append(0, np.cumsum(lengths)[:-1]), lengths) + np.arange(lengths.sum())
                held.append(np.stack((np.repeat(pairs[:, 0], lengths), own.items[flat]), 1))
        items: list[list[str]] = [[] for _ in range(n_texts)]
        for d, i in np.unique(np.concatenate(held), axis=0).tolist() if held else []:
            items[d].append(self.names[i])
        return np.cumsum(cover)[:size] > 0, items


_RUN = pa.struct([("words", pa.int32()), ("start", pa.int32()), ("stop", pa.int32())])
#: n_words; runs of hit words with their number and their bytes' place in the text; the items, sorted.
FOUND = T.StructType([
    T.StructField("__words", T.LongType()),
    T.StructField("__runs", T.ArrayType(T.StructType([T.StructField(n, T.IntegerType()) for n in ("words", "start", "stop")]))),
    T.StructField("__items", T.ArrayType(T.StringType())),
])


def _runs(words: Words, hit: np.ndarray) -> tuple[np.ndarray, list[list[dict]]]:
    """Words of each text, and its maximal runs of hit ones."""
    n_texts, counts = len(words.first) - 1, np.diff(words.first)
    doc = np.repeat(np.arange(n_texts), counts)
    lengths = np.fromiter(map(len, words.vocab.to_pylist()), np.int64, len(words.vocab))
    out: list[list[dict]] = [[] for _ in range(n_texts)]
    at = np.flatnonzero(hit)
    if len(at):
        heads = np.flatnonzero(np.append(True, (np.diff(at) != 1) | (np.diff(doc[at]) != 0)))
        lasts = np.append(heads[1:], len(at)) - 1
        for d, k, a, b in zip(doc[at[heads]].tolist(), (lasts - heads + 1).tolist(), words.at[at[heads]].tolist(), (words.at[at[lasts]] + lengths[words.ids[at[lasts]]]).tolist(), strict=True):
            out[d].append({"words": k, "start": a, "stop": b})
    return counts, out


def _relative(runs: list[list[dict]], offsets: np.ndarray) -> list[list[dict]]:
    return [[{"words": r["words"], "start": r["start"] - o, "stop": r["stop"] - o} for r in own] for own, o in zip(runs, offsets[:-1].tolist(), strict=True)]


def _with_set(docs: DataFrame, bench: DataFrame, plan: Leaks) -> DataFrame:
    rows = bench.collect()  # at most plan.most_bytes of text
    shared = docs.sparkSession.sparkContext.broadcast(WindowSet([tuple(r) for r in rows], plan.words))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in blocks(text_column(batch)):
                words = terms(data, offsets)
                hit, items = shared.value.hits(words)
                counts, runs = _runs(words, hit)
                part = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(counts, pa.int64()), pa.array(_relative(runs, offsets), pa.list_(_RUN)), pa.array(items, pa.list_(pa.string()))], names=[*part.schema.names, *FOUND.names])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *FOUND.fields]))


def _windows_of(df: DataFrame, key: str, lengths: list[int], least: int | None) -> DataFrame:
    """key, th, at, n, h1, h2 of the windows of every text: of all the lengths; or, with least, of that length or the whole shorter text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, _, data, offsets in blocks(text_column(batch)):
                words = terms(data, offsets)
                h = words.hashes()
                sizes = np.diff(words.first)
                for n in range(1, least + 1) if least else lengths:
                    first, second = windows(h, n), windows(mix(h ^ ROLL), n)
                    held = sizes - n + 1
                    if least and n < least:
                        held = np.where(sizes == n, 1, 0)
                    held = np.maximum(held, 0)
                    row = np.repeat(np.arange(len(sizes)), held)
                    at = np.arange(held.sum()) - np.repeat(np.cumsum(held) - held, held)
                    place = words.first[row] + at
                    if len(row):
                        where = pa.array(lo + row)
                        yield pa.RecordBatch.from_arrays(
                            [batch.column(0).take(where), batch.column(1).take(where), pa.array(at.astype(np.int32)), pa.array(np.full(len(at), n, np.int32)), pa.array(first[place].view(np.int64)), pa.array(second[place].view(np.int64))],
                            names=[key, "th", "at", "n", "h1", "h2"],
                        )

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, F.xxhash64("text").alias("th"), "text").mapInArrow(run, f"{key} {kind}, th long, at int, n int, h1 long, h2 long")


def _with_joins(docs: DataFrame, bench: DataFrame, plan: Leaks) -> DataFrame:
    known = _windows_of(bench, "item_id", [], plan.words).select("n", "h1", "h2", "item_id").distinct()
    lengths = sorted(r["n"] for r in known.select("n").distinct().collect())  # at most plan.words numbers
    places = _windows_of(docs, "doc_id", lengths, None)
    on, of = ["n", "h1", "h2"], ["doc_id", "th"]
    spans = places.join(known.select(*on).distinct(), on).groupBy(*of).agg(F.collect_set(F.struct("at", "n")).alias("spans"))
    named = places.select(*of, *on).distinct().join(known.filter("item_id IS NOT NULL"), on).select(*of, F.col("item_id").cast("string").alias("item")).distinct()
    items = named.groupBy(*of).agg(F.sort_array(F.collect_list("item")).alias("items"))
    keyed, names = docs.withColumn("__th", F.xxhash64("text")), list(docs.columns)
    for found, name in ((spans, "spans"), (items, "items")):
        found = found.withColumnsRenamed({"doc_id": "__id", "th": "__own", name: f"__{name}"})
        keyed = keyed.join(found, keyed["doc_id"].eqNullSafe(F.col("__id")) & (F.col("__th") == F.col("__own")), "left").drop("__id", "__own")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans, items = (batch.column(batch.schema.get_field_index(n)) for n in ("__spans", "__items"))
            own = batch.select(names)
            for lo, hi, data, offsets in blocks(text_column(batch)):
                words = terms(data, offsets)
                cover = np.zeros(len(words.ids) + 1, np.int64)
                for r in range(lo, hi):
                    for s in spans[r].as_py() or []:
                        cover[words.first[r - lo] + s["at"]] += 1
                        cover[words.first[r - lo] + s["at"] + s["n"]] -= 1
                counts, runs = _runs(words, np.cumsum(cover)[:-1] > 0)
                part = own.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(counts, pa.int64()), pa.array(_relative(runs, offsets), pa.list_(_RUN)), pa.array([items[r].as_py() or [] for r in range(lo, hi)], pa.list_(pa.string()))], names=[*names, *FOUND.names]
                )

    return keyed.select(*names, "__spans", "__items").mapInArrow(run, T.StructType([*docs.schema.fields, *FOUND.fields]))


def found(docs: DataFrame, bench: DataFrame, plan: Leaks = Leaks()) -> DataFrame:
    """docs (doc_id, text and columns of neutral names) with FOUND."""
    bench = bench.select("item_id", "text").filter("text IS NOT NULL")
    size = bench.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    return (_with_set if size <= plan.most_bytes else _with_joins)(docs, bench, plan)


def digests(docs: DataFrame, bench: DataFrame, plan: Leaks = Leaks()) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of every row of docs."""
    n_hit = F.aggregate("__runs", F.lit(0).cast("long"), lambda s, r: s + r["words"])
    return found(docs.select("doc_id", "text"), bench, plan).select(
        "doc_id", F.col("__words").alias("n_words"), n_hit.alias("n_hit"), F.size("__items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "__items"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated")
    )


def clean_documents(docs: DataFrame, bench: DataFrame, plan: Leaks = Leaks()) -> DataFrame:
    """The rows of docs without any hit word, with all their columns."""
    docs, back = set_aside(docs, "doc_id", "text")
    return back(found(docs, bench, plan).filter(F.size("__runs") == 0))


def without_spans(docs: DataFrame, bench: DataFrame, plan: Leaks = Leaks()) -> DataFrame:
    """All rows of docs; of a text with hits, each run of hit words goes, from its first letter to its last, and the rest stays."""
    docs, back = set_aside(docs, "doc_id", "text")
    names, at = list(docs.columns), docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, runs = batch.column(at), batch.column(batch.schema.get_field_index("__runs"))
            cut = []
            for text, own in zip(texts.to_pylist(), runs.to_pylist(), strict=True):
                if own:
                    raw, begin, kept = text.encode(), 0, []
                    for r in own:
                        kept.append(raw[begin : r["start"]])
                        begin = r["stop"]
                    text = b"".join([*kept, raw[begin:]]).decode()
                cut.append(text)
            columns = [pa.array(cut, texts.type) if i == at else batch.column(i) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return back(found(docs, bench, plan).mapInArrow(run, docs.schema))


_WORDS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
SQL = rf"""WITH b AS (SELECT item_id, {_WORDS} AS w FROM benchmark WHERE text IS NOT NULL),
 k AS (SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[p:p + least(10, len(w)) - 1], ' ') AS win FROM (SELECT *, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS p FROM b WHERE len(w) > 0)),
 d AS (SELECT row_number() OVER () AS r, doc_id, coalesce({_WORDS}, []) AS w FROM documents),
 p AS (SELECT r, n, p, array_to_string(w[p:p + n - 1], ' ') AS win FROM (SELECT r, n, w, unnest(range(1, len(w) - n + 2)) AS p FROM d, (SELECT DISTINCT n FROM k))),
 hit AS (SELECT DISTINCT r, n, p FROM p SEMI JOIN k USING (n, win)),
 cov AS (SELECT r, count(DISTINCT q) AS n_hit FROM (SELECT r, unnest(range(p, p + n)) AS q FROM hit) GROUP BY r),
 its AS (SELECT r, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS items FROM (SELECT DISTINCT r, item_id::varchar AS i FROM p JOIN k USING (n, win) WHERE item_id IS NOT NULL) GROUP BY r)
 SELECT doc_id, len(w)::bigint AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
 FROM d LEFT JOIN cov USING (r) LEFT JOIN its USING (r)"""
