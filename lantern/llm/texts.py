"""Arrow-side helpers shared by the text operators: blocks, words and word hashes.

Everything here works on one Arrow batch inside a Spark task.  A batch is cut into blocks of whole
documents so that the numpy work arrays stay bounded whatever the batch size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

BLOCK_BYTES = 4 << 20
_U = np.uint64
#: Odd multipliers of the rolling and mixing steps (64-bit golden ratio and the splitmix64 finaliser).
ROLL, MIX1, MIX2 = _U(0x9E3779B97F4A7C15), _U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB)


def text_column(batch: pa.RecordBatch, name: str = "text") -> pa.Array:
    """The column as a string array without nulls (null: empty)."""
    col = batch.column(batch.schema.get_field_index(name)).cast(pa.large_string())
    return col.fill_null("") if col.null_count else col


def blocks(texts: pa.Array, most: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, UTF-8 bytes, offsets from 0) of runs of whole texts, about `most` bytes each."""
    if not len(texts):
        return
    base = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] is not None and base[-1] else np.empty(0, np.uint8)
    lo = 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(base, base[lo] + most, side="right")) - 1)
        hi = min(hi, len(texts))
        yield lo, hi, data[base[lo] : base[hi]], base[lo : hi + 1] - base[lo]
        lo = hi


class Words:
    """The words `[^\\x20\\x09-\\x0D]+` of a block of texts.

    `ids` numbers the words of all texts in order by the distinct words in `vocab`; the words of text i are
    `ids[first[i]:first[i + 1]]`.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, gap: np.ndarray | None = None):
        """gap: which bytes stand between words; white space, where it isn't given."""
        if gap is None:
            gap = (data == 32) | ((data >= 9) & (data <= 13))
        solid = ~gap
        begins = solid.copy()
        begins[1:] &= gap[:-1]
        inner = offsets[:-1][offsets[:-1] < len(data)]
        begins[inner] = solid[inner]
        self.at = np.flatnonzero(begins)
        packed = data[solid]
        starts = np.cumsum(solid)[self.at] - 1
        bounds = np.append(starts, len(packed)).astype(np.int64)
        words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(packed)])
        coded = words.dictionary_encode()
        self.ids = coded.indices.to_numpy(zero_copy_only=False)
        self.vocab = coded.dictionary
        self.first = np.searchsorted(self.at, offsets)

    def words(self, lo: int, hi: int) -> list[bytes]:
        return self.vocab.take(pa.array(self.ids[lo:hi])).to_pylist()

    def hashes(self) -> np.ndarray:
        """A 64-bit hash for each word."""
        each = np.fromiter(map(xxhash.xxh3_64_intdigest, self.vocab.to_pylist()), np.uint64, len(self.vocab))
        return each[self.ids]


#: A-Z lower-cased, and which bytes then stand between terms: ASCII but letters and digits.
_LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)
_GAP = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])


def terms(data: np.ndarray, offsets: np.ndarray) -> Words:
    """The terms of a block of texts: runs of letters, digits and whatever isn't ASCII, with A-Z in lower case."""
    low = _LOWER[data]
    return Words(low, offsets, _GAP[low])


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = (x ^ (x >> _U(30))) * MIX1
    x = (x ^ (x >> _U(27))) * MIX2
    return x ^ (x >> _U(31))


def windows(hashes: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit hash of every n consecutive entries (len - n + 1 of them); doubling, so log n passes."""
    if len(hashes) < n:
        return np.empty(0, np.uint64)
    out, done, power, width = None, 0, hashes, 1
    rest = n
    with np.errstate(over="ignore"):
        while rest:
            if rest & 1:
                size = len(hashes) - done - width + 1
                piece = power[done : done + size]
                out = piece.copy() if out is None else mix(out[:size] * ROLL + piece)
                done += width
            rest >>= 1
            if rest:
                power = mix(power[:-width] * ROLL + power[width:])
                width *= 2
    return out
