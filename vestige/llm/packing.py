"""Order-preserving packing of token streams into windows.

Documents follow one another as they are read. A dynamic programme over the places where the stream may be cut -
ends of documents, ends of sentences, and every STRIDE tokens where a sentence is longer - minimises padding plus
a penalty for each cut inside a document. Windows of any length come from a queue that is monotone in the cost so
far plus the position; windows that need no padding, as their length is a power of two, from a look-up.
"""

from __future__ import annotations

import zlib
from collections import deque
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame

from vestige.llm.bpe import SPLIT, ByteBpe
from vestige.llm.common import texts_of, tidy

WINDOW = 2048
END = 1
STRIDE = 128
#: What a cut costs, in tokens of padding: at a document's end, a sentence's, elsewhere; and a window itself, so that
#: short windows aren't a cheap way round padding.
AT_DOCUMENT, AT_SENTENCE, ELSEWHERE, A_WINDOW = 0, 6, 24, 64
#: Tokens that are cut up at once; the last two windows of a block go to the next one.
BLOCK = 1 << 18
_POWERS = [1 << k for k in range(8, 12)]


class Encoder:
    """The ids that the tokenizers library gives, special tokens included, by tiktoken's core."""

    def __init__(self, path: str):
        bpe = ByteBpe(path)
        self.special, self.bytes_of = bpe.special, bpe.bytes_of
        # The pattern's runs never give back what they took, so they needn't remember it.
        pattern = SPLIT.pattern.replace("L}+", "L}++").replace("N}+", "N}++").replace("N}]+", "N}]++")
        self._core = tiktoken.Encoding("vocabulary", pat_str=pattern, mergeable_ranks=bpe.ids, special_tokens=bpe.special)

    def encode(self, text: str) -> list[int]:
        if any(t in text for t in self.special):
            return self._core.encode(text, allowed_special="all")
        return self._core.encode_ordinary(text)


@lru_cache(2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


@lru_cache(2)
def sentence_ends(path: str) -> np.ndarray:
    """By id: whether a sentence ends with this token."""
    bytes_of = encoder(path).bytes_of
    out = np.zeros(max(bytes_of) + 1, bool)
    for i, b in bytes_of.items():
        out[i] = b.rstrip(b"\"')]").endswith((b".", b"!", b"?")) or b"\n" in b
    return out


def _whole(places: list[int]) -> dict[int, list[int]]:
    """By index of a place, the places that lie a window's length without padding before it."""
    at = np.array(places)
    index = np.full(places[-1] + 1, -1, np.int64)
    index[at] = np.arange(len(at))
    out: dict[int, list[int]] = {}
    for power in _POWERS:
        j = np.flatnonzero(at >= power)
        i = index[at[j] - power]
        for a, b in zip(j[i >= 0].tolist(), i[i >= 0].tolist()):
            out.setdefault(a, []).append(b)
    return out


def cuts(places: list[int], penalties: list[int], window: int = WINDOW) -> list[int]:
    """Where to cut, ascending and without 0; places ascend from 0 to the stream's end, at most window apart."""
    n = len(places)
    cost, came, whole = [0] * n, [0] * n, _whole(places)
    queue: deque[tuple[int, int, int]] = deque([(0, 0, 0)])  # cost + place, place, index: ascending in both
    for j in range(1, n):
        here = places[j]
        while queue[0][1] < here - window:
            queue.popleft()
        best, i = queue[0][0] + window - here, queue[0][2]
        if j in whole:
            for k in whole[j]:
                if cost[k] < best:
                    best, i = cost[k], k
        cost[j] = total = best + penalties[j] + A_WINDOW
        came[j] = i
        entry = total + here
        while queue and queue[-1][0] >= entry:
            queue.pop()
        queue.append((entry, here, j))
    out, j = [], n - 1
    while j:
        out.append(places[j])
        j = came[j]
    return out[::-1]


def _places(ids: np.ndarray, ends: np.ndarray, ends_sentence: np.ndarray) -> tuple[list[int], list[int]]:
    """Places and penalties of a block; ends: where its documents end, the last at its end."""
    price = np.full(len(ids) + 1, -1, np.int16)
    price[1:][ends_sentence[ids]] = AT_SENTENCE
    price[ends] = AT_DOCUMENT
    price[0] = 0
    places = np.flatnonzero(price >= 0)
    wide = np.flatnonzero(np.diff(places) > STRIDE)
    for k in wide:
        price[places[k] + STRIDE : places[k + 1] : STRIDE] = ELSEWHERE
    places = np.flatnonzero(price >= 0)
    return places.tolist(), price[places].tolist()


class Packer:
    """Takes documents in order, gives pieces: (document, start, length, ids_crc32, doc_tokens, window, offset)."""

    def __init__(self, ends_sentence: np.ndarray):
        self.ends_sentence = ends_sentence
        self.waiting: list[tuple[object, int, np.ndarray, int]] = []  # document, ids before these, ids, all its ids
        self.tokens = self.window = 0

    def add(self, doc_id, ids: np.ndarray):
        self.waiting.append((doc_id, 0, ids, len(ids)))
        self.tokens += len(ids)
        return self._cut(last=False) if self.tokens >= BLOCK else []

    def finish(self):
        return self._cut(last=True) if self.waiting else []

    def _cut(self, last: bool):
        ids = np.concatenate([w[2] for w in self.waiting])
        ends = np.cumsum([len(w[2]) for w in self.waiting])
        at = cuts(*_places(ids, ends, self.ends_sentence))
        if not last:
            at = [c for c in at if c <= len(ids) - 2 * WINDOW]
        out, k, used, begin = [], 0, 0, 0
        for cut in at:
            offset = 0
            while begin < cut:
                doc_id, before, own, total = self.waiting[k]
                size = min(cut - begin, len(own) - used)
                piece = own[used : used + size]
                out.append((doc_id, before + used, size, zlib.crc32(piece), total, self.window, offset))
                offset, used, begin = offset + size, used + size, begin + size
                if used == len(own):
                    k, used = k + 1, 0
            self.window += 1
        rest = self.waiting[k:]
        if rest and used:
            doc_id, before, own, total = rest[0]
            rest[0] = (doc_id, before + used, own[used:], total)
        self.waiting, self.tokens = rest, len(ids) - begin
        return out


def packed(docs: DataFrame, path: str) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Each task packs the rows that it reads, in their order, so nothing is shuffled and a lost task gives the same
    pieces again; a task's last window is the only one whose end isn't chosen. So where the cuts fall depends on how
    the input is split, but not what the pieces hold. Null text counts as empty, which is the end token alone. Rows that share a doc_id are packed each for itself. A window's sequence_id is the task's
    number times 2^33 plus the window's place in the task."""

    def pack(batches):
        first = TaskContext.get().partitionId() << 33
        encode, packer = encoder(path).encode, Packer(sentence_ends(path))
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
        kind = None

        def rows(pieces):
            columns = list(zip(*pieces))
            columns[5] = [first + w for w in columns[5]]
            return pa.RecordBatch.from_arrays([pa.array(c, kind if k == 0 else pa.int64()) for k, c in enumerate(columns)], names)

        for b in batches:
            kind = b.schema.field(0).type
            for doc_id, text in zip(b.column(0).to_pylist(), texts_of(b.column(1))):
                ids = encode(text)
                ids.append(END)
                if pieces := packer.add(doc_id, np.array(ids, "<u4")):
                    yield rows(pieces)
        if pieces := packer.finish():
            yield rows(pieces)

    return docs.select("doc_id", "text").mapInArrow(tidy(pack), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
