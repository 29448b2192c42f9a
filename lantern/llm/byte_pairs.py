"""BPE encoding and decoding by a pair occurrence index.

For the distinct pieces of a partition's batch, an index maps every adjacent pair that has a rank to all of its
positions.  Ranks are applied in ascending order, each to all of its positions at once; the pairs that arise next
to a merged position have higher ranks and are added to their lists.  Texts are then lists of piece numbers, so
encoding them is one gather, and decoding one gather from a table of token bytes.

Defined results: null text as the empty text (no ids); the special strings of the vocabulary file become their
ids, as in the tokenizers library by default; repeated rows give repeated rows; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .texts import blocks, text_column

LETTER, NUMBER, SPACE, OTHER = 0, 1, 2, 3
#: The code points of Unicode's White_Space property.
WHITE_SPACE = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
#: The contractions of the byte-level pattern.
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")
CODE_BYTES = 12 << 20  # of text that are encoded at a time: larger blocks share more pieces
NEVER = np.iinfo(np.int32).max


def _classes() -> np.ndarray:
    kinds = np.fromiter(({"L": LETTER, "N": NUMBER}.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)), np.uint8, 0x110000)
    kinds[WHITE_SPACE] = SPACE
    return kinds


def _byte_characters() -> dict[str, int]:
    """The printable stand-ins of bytes in byte-level vocabularies: printable Latin-1 as is, the rest from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The numbers of all ranges [start, start + length), one after the other."""
    ends = np.cumsum(lengths)
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)


class PairIndexCodec:
    """Encoder and decoder of a byte-level BPE vocabulary in the JSON format of the tokenizers library."""

    def __init__(self, content: bytes, most_known: int = 400_000):
        self.most_known = most_known  # pieces whose ids a worker keeps from batch to batch
        self._forget()
        spec = json.loads(content)
        vocab, stand_in = spec["model"]["vocab"], _byte_characters()
        self.special = {a["content"].encode(): a["id"] for a in spec["added_tokens"]}
        size = 1 + max([*vocab.values(), *self.special.values()])
        token_bytes = [b""] * size
        for token, i in vocab.items():
            token_bytes[i] = bytes(stand_in[c] for c in token) if all(c in stand_in for c in token) else token.encode()
        for token, i in self.special.items():
            token_bytes[i] = token
        self.size = size
        self.first = np.zeros(256, np.int32)
        for char, b in stand_in.items():
            self.first[b] = vocab[char]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        left, right = (np.array([vocab[p[i]] for p in pairs], np.int64) for i in (0, 1))
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int32)
        keys = left * size + right
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int32)
        self.equal = left == right
        self.left, self.right = left.astype(np.int32), right.astype(np.int32)
        self.of_bytes = self._rank(np.repeat(self.first, 256), np.tile(self.first, 256))
        self.pieces = pa.array(token_bytes, pa.large_binary())
        self.decimals = pa.array([b"%d," % i for i in range(size)], pa.large_binary())
        self.kinds = _classes()

    # -- cutting texts into pieces

    def cut(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Byte offsets of all pieces of a block, and the special id of each piece (-1: none)."""
        raw = data.tobytes()
        edges, marked = [offsets], {}
        for token, i in self.special.items():
            at = raw.find(token)
            while at >= 0:
                row = int(np.searchsorted(offsets, at, side="right"))
                if at + len(token) <= offsets[row]:  # not across two texts
                    marked[at] = i
                    edges.append(np.array([at, at + len(token)]))
                    at = raw.find(token, at + len(token))
                else:
                    at = raw.find(token, at + 1)
        points = np.frombuffer(raw.decode("utf-8").encode("utf-32-le"), np.uint32)
        n = len(points)
        byte_at = np.zeros(n + 1, np.int64)
        np.cumsum(1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000), out=byte_at[1:])
        opens = np.zeros(n + 1, bool)
        opens[np.searchsorted(byte_at, np.unique(np.concatenate(edges)))] = True
        opens[n] = True
        kind = self.kinds[np.minimum(points, 0x10FFFF)]
        begins = opens[:n].copy()
        begins[1:] |= kind[1:] != kind[:-1]
        # white space before another character gives its last character away; a plain space joins what follows
        last = np.flatnonzero((kind[:-1] == SPACE) & (kind[1:] != SPACE) & ~opens[1:n])
        begins[last] = True
        begins[last[points[last] == 32] + 1] = False
        for i in np.flatnonzero((points == 39) & begins):
            tail = ""
            for j in range(i + 1, min(i + 3, n)):
                if opens[j]:
                    break
                tail += chr(points[j])
            found = next((c for c in CONTRACTIONS if tail.startswith(c)), None)
            if found:
                begins[i + 1] = False
                j = i + 1 + len(found)
                if j < n and kind[j] == LETTER:
                    begins[j] = True
        starts = byte_at[:n][begins]
        ids = np.full(len(starts), -1, np.int32)
        if marked:
            keep = np.ones(len(starts), bool)  # a special string is one piece
            for at, i in marked.items():
                lo = np.searchsorted(starts, at)
                hi = np.searchsorted(starts, at + len(self.pieces[i].as_py()))
                keep[lo + 1 : hi] = False
                ids[lo] = i
            starts, ids = starts[keep], ids[keep]
        return np.append(starts, len(raw)), ids

    # -- merging

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left.astype(np.int64) * self.size + right
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.ranks[at], NEVER)

    def merge(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of the pieces data[offsets[i]:offsets[i + 1]], and their offsets."""
        n = len(data)
        if not n:
            return np.empty(0, np.int32), np.zeros(len(offsets), np.int64)
        symbol = self.first[data]
        following = np.arange(1, n + 1, dtype=np.int32)
        before = np.arange(-1, n - 1, dtype=np.int32)
        filled = offsets[:-1][offsets[1:] > offsets[:-1]]
        before[filled] = -1
        following[filled[1:] - 1] = -1
        following[n - 1] = -1
        at = np.flatnonzero(following >= 0).astype(np.int32)
        index: dict[int, list[np.ndarray]] = {}
        active: list[int] = []

        def add(positions: np.ndarray, ranks: np.ndarray) -> None:
            known = ranks < NEVER
            positions, ranks = positions[known], ranks[known]
            order = np.argsort(ranks, kind="stable")
            positions, ranks = positions[order], ranks[order]
            cuts = np.flatnonzero(np.diff(ranks)) + 1
            if len(ranks):
                for rank, part in zip(ranks[np.append(0, cuts)].tolist(), np.split(positions, cuts), strict=True):
                    if rank in index:
                        index[rank].append(part)
                    else:
                        index[rank] = [part]
                        heapq.heappush(active, rank)

        add(at, self.of_bytes[data[at].astype(np.int32) * 256 + data[at + 1]])
        while active:
            rank = heapq.heappop(active)
            lists = index.pop(rank)
            p = lists[0] if len(lists) == 1 else np.unique(np.concatenate(lists))
            q = following[p]
            live = (symbol[p] == self.left[rank]) & (q >= 0)
            p, q = p[live], q[live]
            same = symbol[q] == self.right[rank]
            p, q = p[same], q[same]
            if self.equal[rank] and len(p) > 1:  # a a a: the left pair first, every second one in a run
                chained = np.append(False, q[:-1] == p[1:])
                number = np.arange(len(p))
                head = np.maximum.accumulate(np.where(chained, 0, number))
                take = (number - head) % 2 == 0
                p, q = p[take], q[take]
            if not len(p):
                continue
            symbol[p] = self.made[rank]
            symbol[q] = -1
            after = following[q]
            following[p] = after
            before[after[after >= 0]] = p[after >= 0]
            prior = before[p]
            near = np.concatenate((prior[prior >= 0], p[after >= 0]))
            if len(near):
                add(near, self._rank(symbol[near], symbol[following[near]]))
        left = symbol >= 0
        counts = np.zeros(n + 1, np.int64)
        np.cumsum(left, out=counts[1:])
        return symbol[left], counts[offsets]

    def _places(self, distinct: pa.Array) -> np.ndarray:
        """Where the ids of each piece stand in `flat`; pieces that this worker hasn't met are merged now."""
        if len(self.known) > self.most_known:
            self._forget()
        place = pc.index_in(distinct, value_set=self.known).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        fresh = np.flatnonzero(place < 0)
        if len(fresh):
            added = pa.concat_arrays([distinct.take(pa.array(fresh))])
            bounds = np.frombuffer(added.buffers()[1], np.int64)[: len(added) + 1]
            flat, at = self.merge(np.frombuffer(added.buffers()[2] or b"", np.uint8)[: bounds[-1]], bounds)
            place[fresh] = len(self.known) + np.arange(len(fresh))
            self.known = pa.concat_arrays([self.known, added])
            self.flat, self.at = np.append(self.flat, flat), np.append(self.at, self.at[-1] + at[1:])
        return place

    def _forget(self) -> None:
        self.known, self.flat, self.at = pa.array([], pa.large_binary()), np.empty(0, np.int32), np.zeros(1, np.int64)

    # -- blocks of texts

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a block of texts (UTF-8 bytes and offsets), and the offsets of each text's ids."""
        if not len(data):
            return np.empty(0, np.int32), np.zeros(len(offsets), np.int64)
        cuts, special = self.cut(data, offsets)
        pieces = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(cuts) - 1, [None, pa.py_buffer(cuts), pa.py_buffer(data)])
        coded = pieces.dictionary_encode()
        place = self._places(coded.dictionary)
        number = place[coded.indices.to_numpy(zero_copy_only=False)]
        flat, at = self.flat, self.at
        if (special >= 0).any():
            number = np.where(special >= 0, len(at) - 1 + special, number)
            flat, at = np.append(flat, np.arange(self.size, dtype=np.int32)), np.append(at, at[-1] + 1 + np.arange(self.size))
        lengths = np.diff(at)[number]
        ids = flat[ranges(at[:-1][number], lengths)]
        ends = np.append(0, np.cumsum(lengths))
        return ids, ends[np.searchsorted(cuts, offsets)]

    def decode(self, ids: np.ndarray) -> tuple[memoryview, np.ndarray]:
        """The bytes of all ids, and the offset of each id's bytes (one more at the end)."""
        return _bytes_of(self.pieces, ids)

    def digits(self, ids: np.ndarray) -> tuple[memoryview, np.ndarray]:
        """The ids in decimal, each with a comma behind it, and their offsets."""
        return _bytes_of(self.decimals, ids)


def _bytes_of(table: pa.Array, ids: np.ndarray) -> tuple[memoryview, np.ndarray]:
    taken = table.take(pa.array(ids))
    at = np.frombuffer(taken.buffers()[1], np.int64)[: len(taken) + 1] if len(taken) else np.zeros(1, np.int64)
    return memoryview(taken.buffers()[2] or b""), at


_codecs: dict[int, PairIndexCodec] = {}


def codec(content: bytes) -> PairIndexCodec:
    """One codec for each vocabulary and Python worker."""
    key = hash(content)
    if key not in _codecs:
        _codecs[key] = PairIndexCodec(content)
    return _codecs[key]


def shared_file(df: DataFrame, path: str):
    """A vocabulary file (of fixed size, a few MB) as a broadcast, so that executors need no copy of their own."""
    with open(path, "rb") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())


def encoded(df: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, ids array<int>, decoded string for every row; the round trip of each text."""
    content = shared_file(df, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(content.value)
        for batch in batches:
            texts = text_column(batch, "text")
            for lo, hi, data, offsets in blocks(texts, CODE_BYTES):
                ids, at = own.encode(data, offsets)
                flat, byte_at = own.decode(ids)
                decoded = [bytes(flat[byte_at[a] : byte_at[b]]).decode("utf-8", "replace") for a, b in zip(at[:-1], at[1:], strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids)), pa.array(decoded)], names=[key, "ids", "decoded"]
                )

    source = df.select(df[key].alias("key"), df[text].alias("text"))
    return source.mapInArrow(run, f"{key} {df.schema[key].dataType.simpleString()}, ids array<int>, decoded string")


def digests(df: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (decimal ids joined by commas) and decoded_sha256 (text decoded from the ids).

    One pass without a shuffle; the ids and the decoded texts are hashed in the task and never stored.
    """
    content = shared_file(df, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(content.value)
        for batch in batches:
            texts = text_column(batch, "text")
            for lo, hi, data, offsets in blocks(texts, CODE_BYTES):
                ids, at = own.encode(data, offsets)
                (words, word_at), (flat, byte_at) = own.digits(ids), own.decode(ids)
                spans = list(zip(at[:-1].tolist(), at[1:].tolist(), strict=True))
                of_ids = [hashlib.sha256(words[word_at[a] : max(word_at[a], word_at[b] - 1)]).hexdigest() for a, b in spans]
                of_text = [hashlib.sha256(str(flat[byte_at[a] : byte_at[b]], "utf-8", "replace").encode()).hexdigest() for a, b in spans]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), pa.array(np.diff(at), pa.int64()), pa.array(of_ids), pa.array(of_text)],
                    names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    source = df.select("doc_id", "text")
    return source.mapInArrow(run, f"doc_id {df.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")
