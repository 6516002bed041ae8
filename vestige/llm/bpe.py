"""Byte-level BPE encoding and decoding with a contiguous rank array.

A word's part boundaries and the ranks of its adjacent part pairs stand in two parallel arrays; the encoder scans
for the smallest rank, deletes that boundary and refreshes the two neighbouring ranks. Words over SHORT bytes, where
repeated scans would cost their square, take the same merges in the same order from a heap.
"""

from __future__ import annotations

import gc
import hashlib
import heapq
import json
import re
from collections.abc import Callable, Iterable, Iterator, Sequence
from functools import lru_cache
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from vestige.llm.common import texts_of, tidy

#: Bytes of a word that goes through the arrays; words at once; characters of text at once.
SHORT, ROWS, BATCH = 64, 20_000, 1 << 21
#: Chunks of up to SHORT characters that a task keeps; beyond that the half that was learnt first goes.
CACHED = 300_000

# The split pattern of byte-level BPE vocabularies, with white space spelled out.
_S = r"\t-\r \x85\xa0  -     　"
SPLIT = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_S}\p{{L}}\p{{N}}]+|[{_S}]+(?![^{_S}])|[{_S}]+")
#: White space beside a space: such texts are split by the pattern as a whole.
_ODD_SPACE = re.compile(rf" [{_S}]|[{_S}] ")


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in vocabulary files: itself where printable, else from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class ByteBpe:
    """encode() gives the ids that the tokenizers library gives for the same file, special tokens in the text
    included; decode() gives its text."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        letter = byte_letters()
        to_bytes = lambda s: bytes(letter[c] for c in s)
        self.ids = {to_bytes(token): i for token, i in model["model"]["vocab"].items() if all(c in letter for c in token)}
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["model"]["merges"]]
        parts = [(to_bytes(a), to_bytes(b)) for a, b in pairs]
        self.special = {t["content"]: t["id"] for t in model["added_tokens"]}
        self.bytes_of = {i: b for b, i in self.ids.items()} | {i: s.encode() for s, i in self.special.items()}
        self._special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.shown = [str(i) for i in range(max(self.bytes_of) + 1)]
        self.rank_of = {(self.ids[a], self.ids[b]): rank for rank, (a, b) in enumerate(parts)}
        self.none = len(parts)
        self._joined = np.array([self.ids[a + b] for a, b in parts] + [-1], np.int32)  # by rank
        keys = np.array([self.ids[a] << 20 | self.ids[b] for a, b in parts], np.int64)
        order = np.argsort(keys)
        self._keys = np.append(keys[order], np.iinfo(np.int64).max)
        self._key_ranks = np.append(order, self.none).astype(np.int32)
        self._byte_ids = np.array([self.ids[bytes([i])] for i in range(256)], np.int32)

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs of ids; an id of -1 joins with nothing."""
        keys = left.astype(np.int64) << 20 | right
        at = np.searchsorted(self._keys, keys)
        return np.where((self._keys[at] == keys) & (left >= 0) & (right >= 0), self._key_ranks[at], self.none)

    def merged(self, words: list[bytes]) -> list[Sequence[int]]:
        """The ids of each word. Words of like length go through the arrays together, a row each."""
        out: list[Sequence[int]] = [()] * len(words)
        order = sorted(range(len(words)), key=lambda k: len(words[k]))
        at = 0
        while at < len(order):
            size = max(4, len(words[order[at]]))
            if size > SHORT:
                out[order[at]] = self._heaped(words[order[at]])
                at += 1
                continue
            size += size // 4
            end = at
            while end < len(order) and end - at < ROWS and len(words[order[end]]) <= size:
                end += 1
            for k, ids in zip(order[at:end], self._scanned([words[k] for k in order[at:end]]), strict=True):
                out[k] = ids
            at = end
        return out

    def _scanned(self, words: list[bytes]) -> list[Sequence[int]]:
        """The parts of a row lie side by side with the ranks of neighbours below them. In each round every row that
        can still merge finds its least rank, deletes that boundary and refreshes the ranks left and right of it."""
        width = len(words[-1])
        lengths = np.array([len(w) for w in words])
        column = np.arange(width)
        inside = column < lengths[:, None]
        parts = np.full((len(words), width), -1, np.int32)
        parts[inside] = self._byte_ids[np.frombuffer(b"".join(words), np.uint8)]
        ranks = np.full((len(words), width), self.none, np.int32)
        ranks[:, :-1] = self._ranks(parts[:, :-1], parts[:, 1:])
        rows, done = np.arange(len(words)), [()] * len(words)
        while len(rows):
            least = ranks.argmin(axis=1)
            own = np.arange(len(rows))
            rank = ranks[own, least]
            open_ = rank < self.none
            if not open_.all():
                for k, row in zip(rows[~open_], parts[~open_].tolist(), strict=True):
                    done[k] = tuple(row[: row.index(-1)] if row[-1] < 0 else row)
                rows, parts, ranks, least, rank = rows[open_], parts[open_], ranks[open_], least[open_], rank[open_]
                own = own[: len(rows)]
                if not len(rows):
                    break
            moved = column[:-1] + (column[:-1] > least[:, None])
            parts[:, :-1] = np.take_along_axis(parts, moved, axis=1)
            ranks[:, :-1] = np.take_along_axis(ranks, moved, axis=1)
            parts[:, -1], ranks[:, -1] = -1, self.none
            parts[own, least] = self._joined[rank]
            after = np.minimum(least + 1, width - 1)
            ranks[own, least] = np.where(least + 1 < width, self._ranks(parts[own, least], parts[own, after]), self.none)
            left = np.flatnonzero(least)
            ranks[left, least[left] - 1] = self._ranks(parts[left, least[left] - 1], parts[left, least[left]])
        return done

    def _heaped(self, word: bytes) -> list[int]:
        n, rank_of = len(word), self.rank_of
        part = self._byte_ids[np.frombuffer(word, np.uint8)].tolist()  # that begins at i
        ends, before = list(range(1, n + 1)), list(range(-1, n - 1))  # 0: no part begins here
        heap: list[tuple[int, int, int, int]] = []  # rank, where the pair begins, its two ids

        def push(i: int) -> None:
            if i >= 0 and (j := ends[i]) < n and (rank := rank_of.get((part[i], part[j]))) is not None:
                heapq.heappush(heap, (rank, i, part[i], part[j]))

        for i in range(n - 1):
            push(i)
        while heap:
            rank, i, left, right = heapq.heappop(heap)
            j = ends[i]
            if not j or j >= n or part[i] != left or part[j] != right:
                continue  # one of its parts has merged with another since
            part[i], ends[i], ends[j] = int(self._joined[rank]), ends[j], 0
            if ends[i] < n:
                before[ends[i]] = i
            push(before[i])
            push(i)
        out, i = [], 0
        while i < n:
            out.append(part[i])
            i = ends[i]
        return out

    def pieces(self, text: str) -> list[str]:
        """The text around its special tokens, these at odd places."""
        return self._special.split(text) if self._special and any(t in text for t in self.special) else [text]

    def encode_batch(self, texts: list[str]) -> Iterator[list[int]]:
        for row in Chunks(self, tuple).rows(texts):
            yield list(chain.from_iterable(row))

    def encode(self, text: str) -> list[int]:
        return next(self.encode_batch([text]))

    def decode(self, ids: Iterable[int]) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


class Chunks:
    """What the ids of texts' chunks become, kept for the chunks that come again.

    Where each space of a text stands alone between other characters, a word begins at it, so what lies between two
    spaces is encoded by itself, with the space before it."""

    def __init__(self, bpe: ByteBpe, become: Callable[[Sequence[int]], object], both: Callable = lambda a, b: a + b):
        """become: of a word's ids; both: what two neighbours become together."""
        self.bpe, self.become, self.both = bpe, become, both
        self.known: dict[str, object] = {}  # by chunk, without the space before it
        self.words: dict[str, object] = {}  # by word, for words that aren't such chunks

    def _merged(self, words: list[str]) -> list[object]:
        return list(map(self.become, self.bpe.merged([w.encode("utf-8", "surrogatepass") for w in words])))

    def _of(self, words: Sequence[str]) -> object:
        """words: known ones."""
        out = self.words[words[0]]
        for w in words[1:]:
            out = self.both(out, self.words[w])
        return out

    def _learn(self, chunks: set[str], words_too: set[str]) -> None:
        known, words = self.known, self.words
        plain, ended, split = [], [], {}
        for c in chunks:
            if c.isalpha():
                plain.append(c)
            elif c[:-1].isalpha():
                ended.append(c)
            else:
                split[c] = SPLIT.findall(" " + c)
        plain += {c[:-1] for c in ended}.difference(known, plain)
        new = list(words_too.union((c[-1] for c in ended), *split.values()).difference(words))
        merged = self._merged([*(" " + c for c in plain), *new])
        known.update(zip(plain, merged))
        words.update(zip(new, merged[len(plain) :], strict=True))
        for c in ended:
            known[c] = self.both(known[c[:-1]], words[c[-1]])
        for c, w in split.items():
            known[c] = self._of(w)
        self._new, self._new_words = [*plain, *split], new

    def _forget(self) -> None:
        """Long chunks, which hardly come again, and the oldest ones where there are too many."""
        for kept, new in ((self.known, self._new), (self.words, self._new_words)):
            for c in new:
                if len(c) > SHORT:
                    kept.pop(c, None)
            if len(kept) > CACHED:
                for c in list(islice(kept, len(kept) // 2)):
                    del kept[c]

    def _rows(self, texts: list[str]) -> list[list[object]]:
        """Of texts without special tokens."""
        starts, rows, known = [], [], self.known
        for t in texts:
            # What precedes the first space has none before it, so it isn't a chunk.
            start, space, rest = (t, "", "") if _ODD_SPACE.search(t) else t.partition(" ")
            starts.append(SPLIT.findall(start))
            rows.append(rest.split(" ") if space else ())
        self._learn(set().union(*rows).difference(known), set(chain.from_iterable(starts)))
        out = [[*map(self.words.__getitem__, start), *map(known.__getitem__, row)] for start, row in zip(starts, rows, strict=True)]
        self._forget()
        return out

    def rows(self, texts: list[str]) -> Iterator[list[object]]:
        """Per text, what its words and chunks become, in order."""
        bpe, at = self.bpe, 0
        while at < len(texts):
            pieces, counts, size = [], [], 0
            while at + len(counts) < len(texts) and size < BATCH:
                found = bpe.pieces(texts[at + len(counts)])
                pieces += found
                counts.append(len(found))
                size += sum(map(len, found)) + 1
            # Values by the hundred thousand, none of them in a cycle, would set the collector off again and again.
            collecting = gc.isenabled()
            gc.disable()
            try:
                plain = iter(self._rows([p for p in pieces if p not in bpe.special]))
            finally:
                if collecting:
                    gc.enable()
            of = iter(pieces)
            for n in counts:
                if n == 1 and pieces:
                    p = next(of)
                    yield next(plain) if p not in bpe.special else [self.become((bpe.special[p],))]
                else:
                    yield list(chain.from_iterable([self.become((bpe.special[p],))] if p in bpe.special else next(plain) for p in islice(of, n)))
            at += len(counts)


@lru_cache(2)
def encoder(path: str) -> ByteBpe:
    return ByteBpe(path)


def digests(docs: DataFrame, path: str) -> DataFrame:
    """One row per document: doc_id, n_tokens, ids_sha256, decoded_sha256. Null text counts as empty (no ids);
    repeated rows give repeated rows."""

    def encode(batches):
        bpe = encoder(path)
        shown, bytes_of = bpe.shown.__getitem__, bpe.bytes_of.__getitem__
        # A chunk's ids become their decimals and, decoded, their bytes.
        chunks = Chunks(bpe, lambda ids: (",".join(map(shown, ids)), b"".join(map(bytes_of, ids))), lambda a, b: (a[0] + "," + b[0], a[1] + b[1]))
        for batch in batches:
            n, ids_sha, text_sha = [], [], []
            for row in chunks.rows(texts_of(batch.column(1))):
                ids = ",".join([c[0] for c in row]).encode()
                n.append(ids.count(b",") + 1 if ids else 0)
                ids_sha.append(hashlib.sha256(ids).hexdigest())
                text_sha.append(hashlib.sha256(b"".join([c[1] for c in row]).decode("utf-8", "replace").encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInArrow(tidy(encode), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encoded(docs: DataFrame, path: str) -> DataFrame:
    """doc_id and ids, an array of integers."""

    def encode(batches):
        chunks = Chunks(encoder(path), tuple)
        for batch in batches:
            ids = [list(chain.from_iterable(row)) for row in chunks.rows(texts_of(batch.column(1)))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(tidy(encode), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, ids array<int>")


def decoded(ids: DataFrame, path: str) -> DataFrame:
    """doc_id and text of what encoded() returns."""

    def decode(batches):
        bpe = encoder(path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([bpe.decode(x or ()) for x in batch.column(1).to_pylist()], pa.string())], ["doc_id", "text"])

    return ids.select("doc_id", "ids").mapInArrow(tidy(decode), f"doc_id {ids.schema['doc_id'].dataType.simpleString()}, text string")
