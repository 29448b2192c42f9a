"""Quality rules on tokeniser fertility.

Two public vocabularies measure each whole text: a byte-level BPE gives characters per token and the entropy of
the text's token distribution (over its upper bound, the logarithm of the number of tokens), and a BPE with byte
fallback gives characters per piece and the share of pieces that are bytes.  A text outside any bound is rejected.

Bounds come from two places.  `scripts` (and `languages`, where given) holds fixed outer bands.  Inside them, a Spark
aggregate over all distinct documents that meet the base rules gives the usual value of each measure (the median and
half the distance between the quartiles) by language and length, as shorter texts vary more: a text of `spreads`
spreads or more below the median in characters per token, characters per piece or entropy is rejected, and so is
one that far above it in its share of bytes.  A length that is rare in a language takes the language's bounds at all
lengths; a language that is null or rare takes the loosest bounds of its script's languages and of the script as a whole;
a group is rare with fewer than `least_documents` documents, and a rare script has only its fixed band.  Texts of
fewer than `least_tokens` tokens meet fixed bands half as wide again, and of the corpus's bounds only those of their
own length.

Base rules: at least 10 words, and at most a fifth of them in 5-word windows that the text repeats.

Defined results: a null or empty text has no words and fails the base rules; the script of a text without letters
is "none", which has the widest band; repeated rows are judged alike; of other columns only `lang` is read, and all are
kept as they are, whatever their names.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Mapping
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .byte_pairs import codec, shared_file
from .groups import set_aside, shared_folder
from .texts import Words, blocks, mix, text_column, windows

SCRIPTS = ("none", "latin", "greek", "cyrillic", "hebrew", "arabic", "indic", "cjk", "hangul")
#: The first bytes in UTF-8 of each script's letters.
FIRST_BYTES = {
    "latin": [*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0xC3, 0xCA)],
    "greek": [0xCE, 0xCF],
    "cyrillic": [*range(0xD0, 0xD5)],
    "hebrew": [0xD6, 0xD7],
    "arabic": [*range(0xD8, 0xDC)],
    "indic": [0xE0],
    "cjk": [*range(0xE3, 0xEA)],
    "hangul": [*range(0xEA, 0xEE)],
}


@dataclass(frozen=True)
class Band:
    chars_per_token: tuple[float, float]
    chars_per_piece: tuple[float, float]
    most_fallback: float
    entropy: tuple[float, float]


@dataclass(frozen=True)
class Rules:
    least_words: int = 10
    most_repeated: int = 20  # percent of words in repeated windows
    run: int = 5
    least_tokens: int = 40
    spreads: float = 4.0
    least_documents: int = 100
    scripts: Mapping[str, Band] = field(
        default_factory=lambda: {
            "none": Band((0.3, 12.0), (0.3, 12.0), 1.0, (0.0, 1.0)),
            "latin": Band((1.7, 6.5), (1.4, 6.5), 0.1, (0.42, 1.0)),
            "greek": Band((0.6, 6.5), (0.8, 6.5), 0.5, (0.4, 1.0)),
            "cyrillic": Band((0.6, 6.5), (0.8, 6.5), 0.5, (0.4, 1.0)),
            "hebrew": Band((0.5, 6.5), (0.5, 6.5), 1.0, (0.3, 1.0)),
            "arabic": Band((0.5, 6.5), (0.5, 6.5), 1.0, (0.3, 1.0)),
            "indic": Band((0.3, 6.5), (0.3, 6.5), 1.0, (0.3, 1.0)),
            "cjk": Band((0.3, 4.0), (0.3, 4.0), 1.0, (0.3, 1.0)),
            "hangul": Band((0.3, 4.0), (0.3, 4.0), 1.0, (0.3, 1.0)),
        }
    )
    languages: Mapping[str, Band] = field(default_factory=dict)


MEASURES = {
    "n_words": "long", "word_chars": "long", "n_symbols": "long", "n_dup_lines": "long", "n_repeat_words": "long", "script": "string", "n_chars_text": "long",
    "n_tokens": "long", "n_pieces": "long", "n_fallback": "long", "token_entropy": "double",
}


def _repeated_words(ids: np.ndarray, first: np.ndarray, run: int) -> np.ndarray:
    """Words of each text in windows of `run` words that the text holds twice or more; ids numbers equal words alike."""
    if len(ids) < run:
        return np.zeros(len(first) - 1, np.int64)
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    starts = np.flatnonzero(doc[: len(doc) - run + 1] == doc[run - 1 :])
    keys = windows(mix(ids.astype(np.uint64) + np.uint64(1)), run)[starts] ^ mix(doc[starts].astype(np.uint64) + np.uint64(1))
    order = np.argsort(keys)
    keys = keys[order]
    same = np.zeros(len(keys), bool)
    same[1:] = keys[1:] == keys[:-1]
    same[:-1] |= same[1:].copy()
    hit = np.zeros(len(ids), bool)
    for i in range(run):
        hit[starts[order[same]] + i] = True
    return np.diff(np.searchsorted(np.flatnonzero(hit), first))


def _repeated_lines(data: np.ndarray, offsets: np.ndarray, word_at: np.ndarray) -> np.ndarray:
    """Lines of each text with a word, equal to an earlier line; word_at: where the words begin."""
    newline = data == 10
    ends = np.flatnonzero(newline)
    bounds = np.unique(np.concatenate((offsets, ends + 1)))
    kept_before = bounds - np.searchsorted(ends, bounds)
    lines = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(kept_before), pa.py_buffer(data[~newline])])
    ids = lines.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    doc = np.searchsorted(offsets, bounds[:-1], side="right") - 1
    full = np.diff(np.searchsorted(word_at, bounds)) > 0
    doc, ids = doc[full], ids[full]
    distinct = np.unique(doc * (len(lines) + 1) + ids) // (len(lines) + 1)
    size = len(offsets) - 1
    return np.bincount(doc, minlength=size) - np.bincount(distinct, minlength=size)


#: What a byte counts as: nothing (0), the first byte of a letter of SCRIPTS[k], white space, a symbol, a later byte of a character.
WHITE, SYMBOL, LATER = len(SCRIPTS), len(SCRIPTS) + 1, len(SCRIPTS) + 2
KINDS = np.zeros(256, np.uint8)
for _script, _firsts in FIRST_BYTES.items():
    KINDS[_firsts] = SCRIPTS.index(_script)
KINDS[[9, 10, 11, 12, 13, 32]], KINDS[list(b"#*$%&|<>")], KINDS[0x80:0xC0] = WHITE, SYMBOL, LATER


def _kinds(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many bytes of each kind each text has: a row for each text."""
    n, size = LATER + 1, len(offsets) - 1
    cells = np.repeat(np.arange(0, n * size, n), np.diff(offsets))
    cells += KINDS[data]
    return np.bincount(cells, minlength=n * size).reshape(size, n)


def _entropies(ids: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """Entropy of each text's ids in bits over log2 of their number (0 for fewer than two)."""
    counts = np.diff(at)
    doc = np.repeat(np.arange(len(counts)), counts)
    keys = np.sort(doc * size + ids)
    heads = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.empty(0, np.int64)
    n = np.diff(np.append(heads, len(keys)))
    of = keys[heads] // size
    plogp = np.bincount(of, n * np.log2(n), minlength=len(counts)) if len(n) else np.zeros(len(counts))
    total = np.maximum(counts, 2)
    return np.where(counts > 1, (np.log2(total) - plogp / total) / np.log2(total), 0.0)


class Pieces:
    """Number of pieces and of byte pieces of words; beyond most_known words, those that a worker has met again are kept."""

    def __init__(self, model: bytes, most_known: int = 400_000):
        self.model = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.is_byte = np.array([self.model.is_byte(i) for i in range(self.model.vocab_size())])
        self.most_known = most_known
        self.known, self.counts, self.again = pa.array([], pa.large_binary()), np.empty((0, 2), np.int64), np.empty(0, bool)

    def of(self, words: pa.Array) -> np.ndarray:
        """Both numbers for each of these distinct words."""
        if len(self.known) > self.most_known:
            kept = np.flatnonzero(self.again)[: self.most_known // 2]
            self.known, self.counts, self.again = self.known.take(pa.array(kept)), self.counts[kept], np.zeros(len(kept), bool)
        place = pc.index_in(words, value_set=self.known).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        fresh = np.flatnonzero(place < 0)
        self.again[place[place >= 0]] = True
        if len(fresh):
            place[fresh] = len(self.known) + np.arange(len(fresh))
            added = words.take(pa.array(fresh))
            self.known, self.again = pa.concat_arrays([self.known, added]), np.append(self.again, np.zeros(len(fresh), bool))
            self.counts = np.concatenate([self.counts, *(self._counted(added[lo : lo + 20_000].to_pylist()) for lo in range(0, len(fresh), 20_000))])
        return self.counts[place]

    def _counted(self, words: list[bytes]) -> np.ndarray:
        coded = self.model.encode(words, num_threads=1)
        counts = np.fromiter(map(len, coded), np.int64, len(coded))
        word = np.repeat(np.arange(len(coded)), counts)
        ids = np.fromiter(chain.from_iterable(coded), np.int64, len(word))
        return np.stack((counts, np.bincount(word[self.is_byte[ids]], minlength=len(coded))), 1)


_pieces: dict[int, Pieces] = {}


def measured(df: DataFrame, byte_vocabulary: str, piece_model: str) -> DataFrame:
    """The rows of df with a struct column __m of all measures; one pass without a shuffle."""
    content, model = shared_file(df, byte_vocabulary), shared_file(df, piece_model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(content.value)
        key = hash(model.value)
        if key not in _pieces:
            _pieces[key] = Pieces(model.value)
        for batch in batches:
            for lo, hi, data, offsets in blocks(text_column(batch), 6 << 20):
                words = Words(data, offsets)
                each = np.append([[0, 0]], np.cumsum(_pieces[key].of(words.vocab)[words.ids], 0), 0)[words.first]
                ids, at = own.encode(data, offsets)
                kinds = _kinds(data, offsets)
                chars = np.diff(offsets) - kinds[:, LATER]
                letters = kinds[:, 1 : len(SCRIPTS)]
                script = np.where(letters.max(1) > 0, letters.argmax(1) + 1, 0)
                fields = [
                    np.diff(words.first),
                    chars - kinds[:, WHITE],
                    kinds[:, SYMBOL],
                    _repeated_lines(data, offsets, words.at),
                    _repeated_words(words.ids, words.first, 5),
                    np.array(SCRIPTS)[script],
                    chars,
                    np.diff(at),
                    *np.diff(each, axis=0).T,
                    _entropies(ids, at, own.size),
                ]
                found = pa.StructArray.from_arrays([pa.array(f) if f.dtype.kind in "fU" else pa.array(f, pa.int64()) for f in fields], names=list(MEASURES))
                rows = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([*rows.columns, found], names=[*rows.schema.names, "__m"])

    found = T.StructType.fromDDL(f"__m struct<{', '.join(f'{k}:{v}' for k, v in MEASURES.items())}>")
    return df.mapInArrow(run, T.StructType([*df.schema.fields, *found.fields]))


#: The measures with a lower bound from the corpus, then the one with an upper bound; their decimals in the aggregate.
FLOORS, CEILING, DECIMALS = ("chars_per_token", "chars_per_piece", "token_entropy"), "fallback_share", 4


def _bounds(rows: DataFrame, keys: list[str], rules: Rules, least: int) -> DataFrame:
    """keys and, for each measure, its bound in the groups of `least` rows or more; values are rounded, so that the percentiles are exact over few values."""
    middle = lambda k: F.percentile(F.round(k, DECIMALS), F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias(k)
    found = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *(middle(k) for k in (*FLOORS, CEILING))).filter(F.col("n") >= least)
    spread = lambda k: F.greatest((F.col(k)[2] - F.col(k)[0]) / 2, 0.005 * F.col(k)[1])
    low = [(F.col(k)[1] - rules.spreads * spread(k)).alias(k) for k in FLOORS]
    return found.select(*keys, *low, (F.col(CEILING)[1] + F.greatest(rules.spreads * spread(CEILING), F.lit(0.1))).alias(CEILING))


def _with_bounds(rows: DataFrame, rules: Rules) -> DataFrame:
    """rows with a struct __b of the bounds that hold for them, null where only the fixed band does."""
    rows = rows.withColumn("__length", F.least(F.greatest(F.floor(F.log2("__q.n_tokens")), F.lit(3)), F.lit(12)).cast("int"))
    lang = F.col("lang") if "lang" in rows.columns else F.lit(None).cast("string")
    rows = rows.withColumn("__lang", lang).withColumn("__script", F.col("__q.script"))
    measured_rows = rows.filter(~F.col("__q.base_failed"))
    seen = ["__lang", "__script", "__length", *(f"__q.{k}" for k in ("n_chars_text", "n_tokens", "n_pieces", *FLOORS, CEILING))]
    distinct = measured_rows.select(*seen).distinct()  # copies count once
    known = distinct.filter("__lang IS NOT NULL")
    bound = lambda keys, source=known: _bounds(source, keys, rules, rules.least_documents)
    by_script = []
    for keys in (["__script", "__length"], ["__script"]):
        # the language isn't known, so the loosest bound of any of the script's languages holds
        either = bound(keys, distinct).unionByName(bound(["__lang", *keys]).drop("__lang"))
        by_script.append((keys, either.groupBy(*keys).agg(*(F.min(k).alias(k) for k in FLOORS), F.max(CEILING).alias(CEILING))))
    levels = [(k, bound(k)) for k in (["__lang", "__length"], ["__lang"])] + by_script
    for i, (keys, found) in enumerate(levels):
        rows = rows.join(F.broadcast(found.select(*keys, F.struct(*FLOORS, CEILING).alias(f"__b{i}"))), keys, "left")
    # measures of short texts spread more: only bounds of their own length hold for them
    alike = [F.when((F.col("__q.n_tokens") >= rules.least_tokens) | ("__length" in keys), F.col(f"__b{i}")) for i, (keys, _) in enumerate(levels)]
    return rows.withColumn("__b", F.coalesce(*alike))


def judged(df: DataFrame, byte_vocabulary: str, piece_model: str, rules: Rules = Rules(), columns: list[str] | None = None) -> DataFrame:
    """`columns` of df (all of them) with a struct __q: measures, ratios, base_failed and kept.

    The measures are written once to the shared folder, with these columns, and read for the bounds and for the verdict.
    """
    columns = df.columns if columns is None else columns
    m = measured(df, byte_vocabulary, piece_model)
    c = lambda name: F.col(f"__m.{name}")
    base = (c("n_words") < rules.least_words) | (100 * c("n_repeat_words") > rules.most_repeated * c("n_words"))
    ratios = {
        "chars_per_token": F.try_divide(c("n_chars_text"), c("n_tokens")),
        "chars_per_piece": F.try_divide(c("word_chars"), c("n_pieces")),
        "fallback_share": F.try_divide(c("n_fallback"), c("n_pieces")),
        "token_entropy": c("token_entropy"),
    }
    parts = [*(c(k).alias(k) for k in MEASURES if k != "token_entropy"), *(r.alias(k) for k, r in ratios.items()), base.alias("base_failed")]
    path = f"{shared_folder(df.sparkSession)}/fertility-{uuid.uuid4().hex}"
    m.select(*columns, F.struct(*parts).alias("__q")).write.parquet(path)
    rows = _with_bounds(df.sparkSession.read.parquet(path), rules)
    q = lambda name: F.coalesce(F.col(f"__q.{name}"), F.lit(0.0))
    short = F.col("__q.n_tokens") < rules.least_tokens

    def within(k: str, low: float, high: float):
        return q(k).between(low, high) | (short & q(k).between(low / 1.5, high * 1.5))

    def inside(band: Band):
        measures = within("chars_per_token", *band.chars_per_token) & within("chars_per_piece", *band.chars_per_piece) & within("token_entropy", *band.entropy)
        return (q("fallback_share") <= band.most_fallback) & measures

    verdict = F.lit(True)
    for script, band in rules.scripts.items():
        verdict = F.when(F.col("__q.script") == script, inside(band)).otherwise(verdict)
    if rules.languages and "lang" in columns:
        for language, band in rules.languages.items():
            verdict = F.when(F.coalesce(F.col("lang"), F.lit("")) == language, inside(band)).otherwise(verdict)
    usual = F.coalesce(q(CEILING) <= F.col(f"__b.{CEILING}"), F.lit(True))
    for k in FLOORS:
        usual &= F.coalesce(q(k) > F.col(f"__b.{k}"), F.lit(True))
    kept = (~F.col("__q.base_failed") & verdict & usual).alias("kept")
    return rows.select(*columns, F.struct("__q.*", kept).alias("__q"))


def quality(df: DataFrame, byte_vocabulary: str, piece_model: str, rules: Rules = Rules()) -> DataFrame:
    """doc_id, the base counts, base_failed, kept, then the measures."""
    columns = ["doc_id", *(["lang"] if "lang" in df.columns else [])]
    first = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    rest = ["script", "chars_per_token", "chars_per_piece", "fallback_share", "token_entropy"]
    return judged(df.select(*columns, "text"), byte_vocabulary, piece_model, rules, columns).select("doc_id", *(F.col(f"__q.{k}").alias(k) for k in [*first, *rest]))


def good(df: DataFrame, byte_vocabulary: str, piece_model: str, rules: Rules = Rules()) -> DataFrame:
    """The rows of df that pass, with all their columns."""
    df, back = set_aside(df, "doc_id", "text", "lang")
    return back(judged(df, byte_vocabulary, piece_model, rules).filter("__q.kept"))
