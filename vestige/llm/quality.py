"""Quality classifier by importance resampling.

Two generative models of hashed n-grams, one of target documents (a bounded sample of those labelled good) and one
of the raw corpus (all documents), give each document a log importance weight from its n-grams' ratios of the
models' log-probabilities: their sum divided by their number to the power `normalise`. Gumbel noise, times
`temperature`, makes the largest `keep` keys a sample without replacement in proportion to exp(weight /
temperature).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vestige.llm.common import free_names, mix, nth_largest, staged, text_of, texts_of, tidy, word_hashes

BUCKETS = 1 << 16
#: Labelled documents that the target model and the cut are fitted on, at most; of each label.
LABELLED = 4000
#: The cut: this quantile of the labelled good documents' weights, less SLACK nats a n-gram, so that good documents
#: of a few words, whose means scatter, stay too.
LOST, SLACK = 0.002, 0.08
#: In production weights are means (NORMALISE 1; sums have 0), which compares short documents with long ones, and the
#: noise is small beside the gap between good and bad documents: 1 would drown means, and sums would keep long ones.
NORMALISE, TEMPERATURE = 1.0, 0.01
#: Counts that each bucket has at least, in both models.
SMOOTH = 20.0
_REPEAT = np.uint64(0x5EED)
#: Bytes of text whose n-grams are held at once.
_BLOCK = 1 << 19


def grams(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(buckets, index of the text of each) of the texts' n-grams, block by block: words, pairs of neighbouring words
    (one bucket for a repeated word) and runs of three bytes."""
    bucket = lambda hashes: (hashes % np.uint64(BUCKETS)).astype(np.int64)
    at = 0
    while at < len(texts):
        run, size = [], 0
        while at + len(run) < len(texts) and (not run or size < _BLOCK):
            run.append(texts[at + len(run)].encode("utf-8", "surrogatepass"))
            size += len(run[-1]) + 1
        data, ends = b"\n".join(run), np.cumsum([len(x) + 1 for x in run])
        words, starts = word_hashes(data, fold=False)
        owner = np.searchsorted(ends, starts, "right")
        yield bucket(words), at + owner
        beside = np.flatnonzero(owner[1:] == owner[:-1])
        first, second = words[beside], words[beside + 1]
        yield bucket(mix(np.where(first == second, _REPEAT, second * np.uint64(3) + first) + np.uint64(1))), at + owner[beside]
        del words, starts, owner, beside, first, second
        codes = np.frombuffer(data, np.uint8)
        for low in range(0, max(0, len(codes) - 2), _BLOCK):
            part = codes[low : low + _BLOCK + 2].astype(np.uint64)
            owner = np.searchsorted(ends, np.arange(low, low + len(part) - 2), "right")
            whole = np.arange(low, low + len(part) - 2) + 3 < ends[owner]  # ends count the separator
            runs = part[:-2] << np.uint64(16) | part[1:-1] << np.uint64(8) | part[2:]
            yield bucket(mix(runs[whole] + (np.uint64(1) << np.uint64(40)))), at + owner[whole]
        at += len(run)


def _counts(docs: DataFrame) -> np.ndarray:
    """Sum over all rows of their n-gram counts by bucket; each task sends at most BUCKETS rows to the sum."""

    def count(batches):
        total = np.zeros(BUCKETS, np.int64)
        for b in batches:
            for buckets, _ in grams(b.column(0).to_pylist()):
                total += np.bincount(buckets, minlength=BUCKETS)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["bucket", "n"])

    out = np.zeros(BUCKETS, np.int64)
    for r in docs.select(text_of().alias("text")).mapInArrow(tidy(count), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r.bucket] = r.n
    return out


def log_ratios(docs: DataFrame, target: DataFrame) -> np.ndarray:
    """Per bucket, log-probability in the target less that in the raw corpus. The raw counts are scaled to the
    target's size, then both get SMOOTH counts a bucket."""
    raw, good = _counts(docs).astype(float), _counts(target).astype(float)
    raw *= min(1.0, (good.sum() + 1) / (raw.sum() + 1))
    return np.log((good + SMOOTH) / (good + SMOOTH).sum()) - np.log((raw + SMOOTH) / (raw + SMOOTH).sum())


def weights(texts: list[str], ratios: np.ndarray, normalise: float = NORMALISE) -> np.ndarray:
    """Log importance weights; 0 for a text without n-grams."""
    total, n = np.zeros(len(texts)), np.zeros(len(texts))
    for buckets, owner in grams(texts):
        total += np.bincount(owner, ratios[buckets], minlength=len(texts))
        n += np.bincount(owner, minlength=len(texts))
    return total / np.maximum(n, 1) ** normalise


def _gumbel(doc_ids: np.ndarray, seed: int) -> np.ndarray:
    u = (mix(doc_ids.astype(np.uint64) * np.uint64(2) + np.uint64(2 * seed + 1)) >> np.uint64(11)).astype(float) + 0.5
    return -np.log(-np.log(u / 2.0**53))


_ADDED = ("log_weight", "key", "kept")


def _scored(docs: DataFrame, ratios: np.ndarray, seed: int, normalise: float, temperature: float) -> tuple[DataFrame, F.Column, F.Column]:
    """docs with two columns more, and those: log weight and key. A null doc_id draws the noise of 0."""
    names = docs.columns
    more = free_names(names, "log_weight", "key")

    def score(batches):
        for b in batches:
            w = weights(texts_of(b.column(names.index("text"))), ratios, normalise)
            ids = np.array([0 if i is None else i for i in b.column(names.index("doc_id")).to_pylist()], np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(w), pa.array(w + temperature * _gumbel(ids, seed))], [*names, *more])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(tidy(score), f"{fields}, `{more[0]}` double, `{more[1]}` double"), F.col(f"`{more[0]}`"), F.col(f"`{more[1]}`")


def labelled(docs: DataFrame, labels: DataFrame, quality: int) -> DataFrame:
    """doc_id and text of at most LABELLED documents with this label, chosen by a hash of their ids."""
    chosen = labels.where(F.col("quality") == quality).select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(LABELLED)
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")


class Resampler:
    """Fitted on docs and labels. keep: how many documents stay; without it, as many as reach the cut under the
    labelled good documents' weights, and all where there are none. Null text counts as empty; it weighs 0, like any
    text without n-grams. Rows that tie with the last one that stays, stay too, so repeated rows share one fate."""

    def __init__(self, docs: DataFrame, labels: DataFrame, seed: int = 7, keep: int | None = None, normalise: float = NORMALISE, temperature: float = TEMPERATURE):
        docs, self.how = docs.select("doc_id", "text"), (seed, normalise, temperature)
        good = staged(labelled(docs, labels, 1))
        self.ratios = log_ratios(docs, good)
        scored, weight, _ = _scored(good, self.ratios, *self.how)
        cut = scored.select(weight.alias("w")).agg(F.percentile_approx("w", LOST, 100_000)).first()[0]
        scored, weight, key = _scored(docs, self.ratios, *self.how)
        keys = staged(scored.select(weight.alias("log_weight"), key.alias("key")))
        self.keep = keys.where(F.col("log_weight") >= (-math.inf if cut is None else cut - SLACK)).count() if keep is None else min(keep, keys.count())
        self.least = nth_largest(keys, self.keep) if self.keep else math.inf

    def apply(self, docs: DataFrame) -> DataFrame:
        """docs with log_weight, key and kept added; columns of docs that are named so give way."""
        scored, weight, key = _scored(docs, self.ratios, *self.how)
        own = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in _ADDED]
        return scored.select(*own, weight.alias("log_weight"), key.alias("key"), (key >= self.least).alias("kept"))

    def kept(self, docs: DataFrame) -> DataFrame:
        """The rows of docs that stay, with all their columns."""
        scored, _, key = _scored(docs, self.ratios, *self.how)
        return scored.where(key >= self.least).select(*[F.col(f"`{c}`") for c in docs.columns])
