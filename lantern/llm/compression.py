"""Toxicity by compression distance between two zstandard dictionaries.

A window is one word with a space on either side, spelled as its overlapping letter triples: zstandard pays six to
seven bytes for any match, so that the plain spelling of a short word is no longer than a reference to it.  Each
window is compressed with a dictionary trained on toxic text and with one trained on ordinary text; its distance is
the number of bytes that the toxic dictionary saves, over the bytes of the spelled window.  A document's features
are the numbers of windows beyond each of a few distances and its number of windows; their weights, and so the
thresholds, are calibrated by a logistic fit on labelled documents that trained neither dictionary.

Each dictionary is trained on all windows of its own kind of text, and knows nothing of the other: it holds the windows
that most documents of its kind have, the most frequent ones last, where references are shortest.  zstandard's own
trainer takes segments of neighbouring words in place of these and finds about half as much (README).

The fit uses a bounded sample of labelled rows (`Training.toxic` and `Training.ordinary` documents, those of the
smallest hashes), whose windows stay on Spark: the driver gets the dictionaries' windows, bounded by their sizes, and
one row of counts for each document that calibrates.  Every whole text is scored.

Defined results: null and empty texts have no windows and get the score of a text without any; without labels of
both kinds every score is 0; a null id isn't held out; label rows of one id count as toxic if any of them is; repeated
texts of one label count once in the fit; other columns aren't looked at: `not_toxic` keeps them whatever their names,
`scored` puts its own in place of a `score` or `predicted` of the caller's.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .groups import durable, set_aside
from .texts import Words, blocks, text_column

EDGES = ".,;:!?\"'()[]{}<>*#$%&|/\\-_=+~^`@0123456789"


@dataclass(frozen=True)
class Training:
    toxic: int = 2500  # most labelled documents of each kind in the fit
    ordinary: int = 6000
    calibration: int = 3  # one in so many of them only calibrates
    toxic_bytes: int = 100_000
    ordinary_bytes: int = 400_000
    toxic_support: float = 0.02  # share of its kind's documents that must hold a dictionary's window
    ordinary_support: float = 0.002
    longest: int = 60  # letters of a dictionary's window
    distances: tuple[float, ...] = (0.05, 0.15, 0.25, 0.33, 0.41, 0.5)


def window(word: bytes) -> str:
    """The word in lower case, without the signs around it."""
    return word.decode("utf-8", "replace").lower().strip(EDGES)


def spelled(word: str) -> bytes:
    x = f" {word} ".encode()
    return b"".join([x[i : i + 3] for i in range(len(x) - 2)])


class Distances:
    """Compression distances of windows, kept for the words that a worker meets again."""

    def __init__(self, toxic: bytes, ordinary: bytes, most_known: int = 500_000):
        self.pair = tuple(self._compressor(x) for x in (toxic, ordinary))
        self.known: dict[bytes, float] = {}
        self.most_known = most_known

    @staticmethod
    def _compressor(content: bytes):
        own = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        how = zstandard.ZstdCompressionParameters(
            strategy=zstandard.STRATEGY_BTOPT, target_length=16, min_match=3, window_log=19, hash_log=18, chain_log=18, search_log=6, write_content_size=0, write_checksum=0, write_dict_id=0
        )
        return zstandard.ZstdCompressor(dict_data=own, compression_params=how).compress

    def of(self, words: list[bytes]) -> np.ndarray:
        """One distance for each word; words of fewer than three letters have none (0)."""
        if len(self.known) > self.most_known:
            self.known.clear()
        toxic, ordinary = self.pair
        out = np.zeros(len(words))
        for i, word in enumerate(words):
            found = self.known.get(word)
            if found is None:
                core, found = window(word), 0.0
                if len(core) > 2:
                    text = spelled(core)
                    found = (len(ordinary(text)) - len(toxic(text))) / (len(text) + 4)
                self.known[word] = found
            out[i] = found
        return out


@dataclass(frozen=True)
class Model:
    toxic: bytes
    ordinary: bytes
    distances: tuple[float, ...]
    weights: tuple[float, ...]

    def scores(self, counts: np.ndarray, n_windows: np.ndarray) -> np.ndarray:
        if not self.weights:
            return np.zeros(len(n_windows))
        return 1 / (1 + np.exp(-np.clip(_features(counts, n_windows) @ np.array(self.weights), -30, 30)))


def _features(counts: np.ndarray, n_windows: np.ndarray) -> np.ndarray:
    return np.column_stack([np.ones(len(n_windows)), np.log1p(counts), np.log1p(n_windows)])


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.5) -> np.ndarray:
    weights = np.zeros(x.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
        w = p * (1 - p) + 1e-6
        weights += np.linalg.solve((x * w[:, None]).T @ x + ridge * np.eye(len(weights)), x.T @ (y - p) - ridge * weights)
    return weights


def held_out(doc_id) -> F.Column:
    """Whether a row's label must not be learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, how: Training) -> DataFrame:
    """toxic, windows (distinct, a space between them), apart (only calibrates) of each distinct sampled text; a checkpoint."""
    usable = labels.filter("doc_id IS NOT NULL AND toxic IS NOT NULL").filter(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    parts = [usable.filter(F.col("toxic") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n) for k, n in ((1, how.toxic), (0, how.ordinary))]
    chosen = F.broadcast(parts[0].unionByName(parts[1]))  # at most toxic + ordinary rows of two numbers
    texts = docs.select("doc_id", "text").join(chosen, "doc_id").select("toxic", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in blocks(text_column(batch)):
                words = Words(data, offsets)
                cores = [window(w) for w in words.vocab.to_pylist()]
                lists = [" ".join(c for c in dict.fromkeys(cores[i] for i in words.ids[a:b]) if len(c) > 2) for a, b in zip(words.first[:-1], words.first[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo).cast(pa.int64()), pa.array(lists, pa.string())], names=["toxic", "windows"])

    distinct = texts.mapInArrow(run, "toxic long, windows string").dropDuplicates(["toxic", "windows"])
    of_kind = Window.partitionBy("toxic").orderBy(F.xxhash64("windows"), "windows")  # at most toxic + ordinary rows: the same share of both kinds is apart
    return durable(distinct.withColumn("apart", F.row_number().over(of_kind) % how.calibration == 0))


def _dictionary(trains: DataFrame, n_texts: int, size: int, support: float, longest: int) -> bytes:
    """The windows that most texts have, spelled, up to `size` bytes, the most frequent ones last."""
    each = trains.select(F.explode(F.split("windows", " ")).alias("w")).filter(F.char_length("w").between(3, longest)).groupBy("w").agg(F.count(F.lit(1)).alias("n"))
    often = each.filter(F.col("n") >= max(2, support * n_texts)).orderBy(F.desc("n"), "w").limit(size // 9)  # a spelled window has nine bytes or more
    taken, left = [], size
    for row in often.collect():
        spelling = spelled(row["w"])
        if len(spelling) > left:
            break
        taken.append(spelling)
        left -= len(spelling)
    return b"".join(reversed(taken)) or b" "


def fit(rows: DataFrame, how: Training = Training()) -> Model:
    """Dictionaries from one part of the sampled documents (`sample`), thresholds from the rest."""
    n = {r["toxic"]: r["n"] for r in rows.filter("NOT apart").groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not n.get(1) or not n.get(0):
        return Model(b" ", b" ", how.distances, ())
    trains = [rows.filter((F.col("toxic") == k) & ~F.col("apart")) for k in (1, 0)]
    toxic = _dictionary(trains[0], n[1], how.toxic_bytes, how.toxic_support, how.longest)
    ordinary = _dictionary(trains[1], n[0], how.ordinary_bytes, how.ordinary_support, how.longest)
    return calibrated(rows.filter("apart"), Model(toxic, ordinary, how.distances, ()))


def calibrated(rest: DataFrame, model: Model) -> Model:
    """The model with weights from the counts of documents (toxic, windows) that trained neither dictionary."""
    shared = rest.sparkSession.sparkContext.broadcast(model)  # two dictionaries of fixed sizes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        gauge = Distances(own.toxic, own.ordinary)
        for batch in batches:
            for lo, hi, data, offsets in blocks(text_column(batch, "windows")):
                counts, total = _counts(gauge, own.distances, Words(data, offsets))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(list(counts), pa.list_(pa.float64())), pa.array(total)], names=["toxic", "counts", "total"])

    found = rest.select("toxic", "windows").mapInArrow(run, "toxic long, counts array<double>, total double").orderBy("toxic", "total", "counts").collect()  # one short row for each calibrating document
    y = np.array([r["toxic"] for r in found])
    if len(set(y.tolist())) < 2:
        return model
    x = _features(np.array([r["counts"] for r in found]), np.array([r["total"] for r in found]))
    # three more ordinary documents of usual features: with hardly any labels, and none that tell, documents are clean
    weights = _logistic(np.vstack([x, np.repeat(x.mean(axis=0)[None], 3, axis=0)]), np.concatenate([y, np.zeros(3, y.dtype)]))
    return Model(model.toxic, model.ordinary, model.distances, tuple(weights.tolist()))


def _counts(gauge: Distances, distances: tuple[float, ...], words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Of each text: its distinct windows beyond every distance, and all of them."""
    n, vocab = len(words.first) - 1, words.vocab.to_pylist()
    each = gauge.of(vocab)
    long_enough = np.array([len(window(w)) > 2 for w in vocab], bool)
    doc = np.repeat(np.arange(n), np.diff(words.first))
    once = np.unique(doc * (len(vocab) + 1) + words.ids) if len(doc) else np.empty(0, np.int64)
    doc, word = once // (len(vocab) + 1), once % (len(vocab) + 1)
    counts = np.column_stack([np.bincount(doc[each[word] >= limit], minlength=n) for limit in distances]).astype(float)
    return counts, np.bincount(doc[long_enough[word]], minlength=n).astype(float)


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """The rows and columns of docs, with score (0 to 1) and predicted (1 from 0.5 on); one pass, no shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # two dictionaries of fixed sizes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        gauge = Distances(own.toxic, own.ordinary)
        for batch in batches:
            for lo, hi, data, offsets in blocks(text_column(batch)):
                counts, total = _counts(gauge, own.distances, Words(data, offsets))
                score = own.scores(counts, total)
                rows = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(score), pa.array((score >= 0.5).astype(np.int32))], names=[*rows.schema.names, "score", "predicted"])

    plain = docs.drop("score", "predicted")
    return plain.mapInArrow(run, T.StructType([*plain.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]))


def toxicity(docs: DataFrame, labels: DataFrame, how: Training = Training()) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of docs."""
    model = fit(sample(docs, labels, how), how)
    found = scored(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def not_toxic(docs: DataFrame, labels: DataFrame, how: Training = Training()) -> DataFrame:
    """The rows of docs that aren't predicted to be toxic, with all their columns."""
    model = fit(sample(docs, labels, how), how)
    docs, back = set_aside(docs, "doc_id", "text")
    return back(scored(docs, model).filter("predicted = 0"))
