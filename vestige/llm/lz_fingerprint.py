"""Document fingerprints from Lempel-Ziv phrases.

A text is parsed, LZ78 fashion, into phrases of words (a word over 16 bytes counts as several symbols): each phrase
is the longest one known so far and one symbol more. The phrases' hashes form the document's set; the smallest
value of each of SLOTS hash functions over it is the signature. Texts that share long passages share phrases, as
they would share a compressor's dictionary.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vestige.llm.common import mix, shuffle_partitions, text_of, tidy

SLOTS = 64
_SYMBOLS = re.compile(rb"[^\x20\x09-\x0d]{1,16}")
_FACTORS = mix(np.arange(1, SLOTS + 1, dtype=np.uint64)) | np.uint64(1)
_SHIFTS = mix(np.arange(1001, SLOTS + 1001, dtype=np.uint64))
_MASK = (1 << 64) - 1
_CHAIN = 0x9E3779B97F4A7C15


def phrases(text: str) -> set[int]:
    """Hashes of the phrases of a text."""
    digest, known, at = xxhash.xxh3_64_intdigest, set(), 0
    for symbol in _SYMBOLS.findall(text.encode("utf-8", "surrogatepass")):
        longer = (at * _CHAIN + digest(symbol)) & _MASK
        if longer in known:
            at = longer
        else:
            known.add(longer)
            at = 0
    return known


def signature(text: str) -> np.ndarray | None:
    """SLOTS minima of 32 bits; None for a text without words."""
    found = phrases(text)
    if not found:
        return None
    hashes, least = np.fromiter(found, np.uint64, len(found)), None
    for at in range(0, len(hashes), 2048):
        block = (((hashes[at : at + 2048, None] ^ (hashes[at : at + 2048, None] >> np.uint64(31))) * _FACTORS + _SHIFTS) >> np.uint64(32)).min(axis=0)
        least = block if least is None else np.minimum(least, block)
    return least


def likeness(a: np.ndarray | None, b: np.ndarray | None) -> float:
    """Share of equal minima; two texts without words are alike, one such text is unlike all others."""
    if a is None or b is None:
        return float(a is b)
    return float((a == b).mean())


def shown(minima: np.ndarray | None) -> str:
    return "" if minima is None else minima.astype(">u4").tobytes().hex()


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fingerprint of each row."""

    def each(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([shown(signature(t or "")) for t in b.column(1).to_pylist()], pa.string())], ["doc_id", "fingerprint"])

    return docs.select("doc_id", "text").mapInArrow(tidy(each), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, fingerprint string")


_FIRST = -(1 << 63)


def edited_and_next(docs: DataFrame) -> DataFrame:
    """Fingerprints of each document and of its edited text, and their likeness to each other and to the next
    document's: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text ends in the beginning of the next document by doc_id (nulls first; rows of one doc_id by text;
    after the last row the first). Null text counts as empty. Texts move once: ranges of doc_id whose lower bounds
    are ids that occur go to a task each, and a range's first row goes to the range before as well."""
    spark = docs.sparkSession
    ids = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_FIRST)).alias("i"))
    wanted = 8 * shuffle_partitions(spark)
    low = ids.agg(F.min("i"), F.percentile_approx("i", [k / wanted for k in range(1, wanted)], 100 * wanted)).first()
    bounds = np.unique(np.array([low[0], *(low[1] or [])] if low[0] is not None else [_FIRST], np.int64))

    def deal(batches):
        for b in batches:
            i = b.column(0).to_numpy(zero_copy_only=False)
            part = np.searchsorted(bounds, i, "right") - 1
            ends = np.flatnonzero(bounds[np.maximum(part, 0)] == i)
            rows = np.concatenate((np.arange(len(i)), ends))
            tail = np.arange(len(rows)) >= len(i)
            part = np.where(tail, (part[rows] - 1) % len(bounds), part[rows])
            took = b.take(pa.array(rows))
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(tail), took.column(0), took.column(1), took.column(2)], ["part", "tail", "i", "doc_id", "text"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    dealt = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_FIRST)).alias("i"), "doc_id", text_of().alias("text")).mapInArrow(tidy(deal), f"part int, tail boolean, i long, doc_id {kind}, text string")
    ordered = dealt.repartition(shuffle_partitions(spark), "part").sortWithinPartitions("part", "tail", "i", "text")

    def compare(batches):
        before = None  # part, doc_id, text, signature of the row that waits for its next
        out = []
        names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
        types = [None, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        for b in batches:
            types[0] = b.schema.field("doc_id").type
            for part, tail, doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(3).to_pylist(), b.column(4).to_pylist()):
                if tail and before is None:
                    continue
                own = signature(text)
                if before is not None and before[0] == part:
                    _, was_id, was, was_sig = before
                    cut = len(was) // 4
                    edited = was[: len(was) - cut] + text[:cut]
                    edited_sig = signature(edited)
                    out.append((was_id, len(was), hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), shown(was_sig), shown(edited_sig), likeness(was_sig, edited_sig), likeness(was_sig, own)))
                before = None if tail else (part, doc_id, text, own)
                if len(out) >= 2000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)
                    out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)

    return ordered.mapInArrow(tidy(compare), f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
