"""Shared plumbing: tables, staging in the shared checkpoint folder, vectorised word hashing."""

from __future__ import annotations

import ctypes
import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vestige.operators.staging import table_in_shared_folder

#: The characters `[\x20\x09-\x0D]` that separate words.
SPACES = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str = "text"):
    """The text column with null as the empty string."""
    return F.coalesce(F.col(column), F.lit(""))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def staged(df: DataFrame) -> DataFrame:
    """df written in the shared folder and read back: lineage ends here, and lost executors cost only the reading."""
    return table_in_shared_folder(df)


def free_names(taken: list[str], *wanted: str) -> list[str]:
    """wanted, with underscores where such a column is there already."""
    lower, out = {c.lower() for c in taken}, []
    for name in wanted:
        while name.lower() in lower:
            name += "_"
        lower.add(name.lower())
        out.append(name)
    return out


def nth_largest(keys: DataFrame, n: int) -> float:
    """The n-th largest of the column `key`, exactly: quantiles narrow the bracket, and only a bracket of at most
    10,000 rows is sorted."""
    low, high, need = -math.inf, math.inf, n
    while True:
        inside = keys.where((F.col("key") > low) & (F.col("key") <= high))
        size = inside.count()
        if size <= 10_000:
            return inside.orderBy(F.desc("key")).limit(need).agg(F.min("key")).first()[0]
        a, b = inside.agg(F.percentile_approx("key", [max(0.0, 1 - need / size - 0.001), min(1.0, 1 - need / size + 0.001)], 10_000)).first()[0]
        above, from_a = inside.agg(F.count_if(F.col("key") > b), F.count_if(F.col("key") > a)).first()
        if above >= need and b > low:
            low = b
        elif from_a >= need and (a, b) != (low, high):
            low, high, need = a, b, need - above
        elif a < high:
            high, need = a, need - from_a
        else:  # all keys of the bracket are equal
            return high


def most_frequent(counted: DataFrame, count: str, most: int) -> list:
    """The rows with the largest counts, at most `most`. Rows that tie with the first one left out stay out as well, so
    no task sends the driver more than what stays."""
    keys = counted.select(F.col(count).cast("double").alias("key"))
    if keys.count() > most:
        counted = counted.where(F.col(count) > nth_largest(keys, most + 1))
    return counted.collect()


def tidy(each: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """each, after which the worker gives its free memory back: workers are kept for later tasks, and Spark may keep
    more of them than there are cores."""

    def run(batches):
        try:
            yield from each(batches)
        finally:
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except (OSError, AttributeError):  # another C library
                pass

    return run


# ---------------------------------------------------------------- word hashing

_BASE = np.uint64(0x9E3779B97F4A7C15)
_SEGMENT = 1 << 20
_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: each input bit reaches every output bit."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def _byte_values(fold: bool) -> np.ndarray:
    codes = np.arange(256)
    if fold:
        codes = np.where((codes >= 65) & (codes <= 90), codes + 32, codes)
    return mix(codes.astype(np.uint64) + np.uint64(0x51ED27))


_VALUES = {fold: _byte_values(fold) for fold in (False, True)}
_powers: list[np.ndarray] = []


def _power_tables() -> list[np.ndarray]:
    if not _powers:
        inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
        for base in (_BASE, inverse):
            steps = np.full(_SEGMENT + 1, base, dtype=np.uint64)
            steps[0] = 1
            _powers.append(np.cumprod(steps, dtype=np.uint64))
    return _powers


def _segment_hashes(codes: np.ndarray, fold: bool) -> tuple[np.ndarray, np.ndarray]:
    """Hash and start of each word of a segment of at most _SEGMENT bytes that cuts no word."""
    inside = ~_IS_SPACE[codes]
    edges = np.diff(inside.astype(np.int8), prepend=0, append=0)
    starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    if not len(starts):
        return np.empty(0, np.uint64), starts
    power, inverse = _power_tables()
    sums = np.empty(len(codes) + 1, np.uint64)
    sums[0] = 0
    np.cumsum(_VALUES[fold][codes] * power[: len(codes)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64)), starts


def word_hashes(data: bytes, fold: bool) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hash and byte offset of each maximal run of non-space bytes; fold lower-cases A-Z first.
    Works in segments of 1 MiB, so memory doesn't follow the text's length; a longer word is digested."""
    codes, at, hashes, starts = np.frombuffer(data, np.uint8), 0, [], []
    while at < len(codes):
        end = min(at + _SEGMENT, len(codes))
        if end < len(codes):
            gaps = np.flatnonzero(_IS_SPACE[codes[at:end]])
            if len(gaps):
                end = at + int(gaps[-1]) + 1
            else:
                while end < len(codes) and not _IS_SPACE[codes[end]]:
                    end += 1
                word = data[at:end].lower() if fold else data[at:end]
                hashes.append(np.frombuffer(hashlib.blake2b(word, digest_size=8).digest(), np.uint64))
                starts.append(np.array([at]))
                at = end
                continue
        h, s = _segment_hashes(codes[at:end], fold)
        hashes.append(h)
        starts.append(s + at)
        at = end
    if not hashes:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    return np.concatenate(hashes), np.concatenate(starts)


def grouped_words(texts: list[str], fold: bool, size: int = 1 << 19) -> Iterator[tuple[int, list[np.ndarray]]]:
    """(first index, word hashes of each text) for runs of texts of about `size` bytes."""
    at = 0
    while at < len(texts):
        run, total = [], 0
        while at + len(run) < len(texts) and (not run or total < size):
            run.append(texts[at + len(run)].encode("utf-8", "surrogatepass"))
            total += len(run[-1]) + 1
        hashes, starts = word_hashes(b"\n".join(run), fold)
        ends = np.cumsum([len(x) + 1 for x in run])
        yield at, np.split(hashes, np.searchsorted(starts, ends[:-1]))
        at += len(run)


_PLACES = mix(np.arange(1, 6, dtype=np.uint64))


def shingles(words: np.ndarray) -> np.ndarray:
    """Sorted distinct hashes of the runs of five words; of the whole sequence where there are fewer."""
    n = len(words)
    if n == 0:
        return words
    if n < 5:
        return mix(np.array([(words * _PLACES[:n]).sum(dtype=np.uint64) + np.uint64(n)]))
    total = words[: n - 4] * _PLACES[0]
    for i in range(1, 5):
        total = total + words[i : n - 4 + i] * _PLACES[i]
    return np.unique(mix(total))


def texts_of(column) -> list[str]:
    """The values of an Arrow string column with null as the empty string."""
    return ["" if x is None else x for x in column.to_pylist()]
