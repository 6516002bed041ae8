"""URL filters by a Bloom filter cascade.

The key universe is all keys that the corpus's URLs have: each host, and each host with its path. Level 0 holds the
listed keys; level 1 the universe's keys that level 0 takes for listed though they aren't; level 2 the listed ones
that level 1 takes for such, and so on until none is left. So for every key of the universe the number of levels
that it passes tells exactly whether it is listed, by look-ups in a few bit arrays and no join. Level 0 lets so few
unlisted keys pass that level 1 holds about as many keys as level 0; from then on half of the keys pass. DataFrame
operations only.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vestige.llm.common import staged

# The rules that come before the list, (host, path, verdict), and the production block list.
RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]
_FIRST, _SECOND = ["ads", "adult", "casino", "cheap", "free", "spam"], ["track", "x", "win", "pills", "bets", "farm"]
_FRONTS, _ENDS = ["", "www.", "m.", "blog."], ["com", "net", "org"]
LISTED = [f"{front}{a}-{b}.example.{end}" for a in _FIRST for b in _SECOND for front in _FRONTS for end in _ENDS]

#: The beginning of noted keys' MD5: one in sixteen.
NOTED = "0"

#: Bits of an array, at most: each array is a scalar of the plan. A level of more bits is dealt over several arrays.
MOST_BITS = 1 << 24
#: The least share of unlisted keys that level 0 lets pass.
LEAST_PASS = 2.0**-20
_WORD = 64


def with_host_and_path(pages: DataFrame) -> DataFrame:
    """pages with host and path of url; both empty where it is null or has no `://`."""
    url = F.coalesce(F.col("url"), F.lit(""))
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.expr("substring(coalesce(url, ''), instr(coalesce(url, ''), '://') + 3)")).otherwise("")
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return pages.withColumn("host", F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).withColumn("path", path)


def ruled(rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits host and path, as `host` and `path` joined, and its verdict."""
    rule = verdict = F.lit(None).cast("string")
    for host, path, says in sorted(rules, key=lambda r: len(r[0]) + len(r[1])):
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        rule, verdict = F.when(fits, host + path).otherwise(rule), F.when(fits, says).otherwise(verdict)
    return rule, verdict


def _level(n: int, share: float) -> tuple[int, int, int]:
    """(arrays, bits of each, hash functions) for n keys of which this share of others passes."""
    bits = max(_WORD, math.ceil(-n * math.log(share) / math.log(2) ** 2))
    arrays = -(-bits // MOST_BITS)
    return arrays, -(-bits // (arrays * _WORD)) * _WORD, max(1, round(-math.log2(share)))


class Cascade:
    """Exact for the keys of the universe."""

    def __init__(self, listed: DataFrame, universe: DataFrame):
        """listed and universe: a column `key`; listed keys outside of the universe are of no account."""
        self.spark = universe.sparkSession
        universe = universe.where("key is not null").select("key").distinct()
        marked = staged(universe.join(listed.select("key").distinct().withColumn("listed", F.lit(True)), "key", "left").select("key", F.coalesce("listed", F.lit(False)).alias("listed")))
        inside, outside = marked.where("listed").select("key"), marked.where("not listed").select("key")
        n, others = inside.count(), outside.count()
        #: Of each level its arrays (tables of one row, the words in order), their bits and the hash functions.
        self.levels: list[tuple[list[DataFrame], int, int]] = []
        while n:
            share = min(0.5, max(LEAST_PASS, n / (others + 1) / 2**0.5)) if not self.levels else 0.5
            arrays, bits, hashes = _level(n, share)
            level = len(self.levels)
            self.levels.append(([self._array(inside, level, k, arrays, bits, hashes) for k in range(arrays)], bits, hashes))
            inside, outside = staged(outside.where(self._in_level(F.col("key"), level))), inside
            n = inside.count()

    def _places(self, key: Column, level: int, bits: int, hashes: int) -> list[Column]:
        return [F.pmod(F.xxhash64(key, F.lit(level), F.lit(k)), F.lit(bits)) for k in range(hashes)]

    def _dealt(self, key: Column, level: int, arrays: int) -> Column:
        return F.pmod(F.xxhash64(key, F.lit(level), F.lit(-1)), F.lit(arrays))

    def _array(self, keys: DataFrame, level: int, nth: int, arrays: int, bits: int, hashes: int) -> DataFrame:
        places = keys.where(self._dealt(F.col("key"), level, arrays) == nth).select(F.explode(F.array(*self._places(F.col("key"), level, bits, hashes))).alias("p"))
        words = places.select((F.col("p") / _WORD).cast("int").alias("w"), F.expr(f"shiftleft(1L, cast(p % {_WORD} as int))").alias("b"))
        none = self.spark.range(bits // _WORD).select(F.col("id").cast("int").alias("w"), F.lit(0).cast("long").alias("b"))
        full = words.union(none).groupBy("w").agg(F.bit_or("b").alias("b"))
        return staged(full.agg(F.transform(F.array_sort(F.collect_list(F.struct("w", "b"))), lambda x: x.b).alias("words")))

    def _in_level(self, key: Column, level: int) -> Column:
        arrays, bits, hashes = self.levels[level]

        def within(array: DataFrame) -> Column:
            words, out = array.scalar(), F.lit(True)
            for place in self._places(key, level, bits, hashes):
                out = out & (F.getbit(F.element_at(words, (place / _WORD).cast("int") + 1), (place % _WORD).cast("int")) == 1)
            return out

        out = within(arrays[0])
        for k in range(1, len(arrays)):
            out = F.when(self._dealt(key, level, len(arrays)) == k, within(arrays[k])).otherwise(out)
        return out

    def holds(self, key: Column) -> Column:
        """Whether a key of the universe is listed: the first level that it doesn't pass is an odd one."""
        out = F.lit(len(self.levels) % 2 == 1)
        for level in reversed(range(len(self.levels))):
            out = F.when(~self._in_level(key, level), F.lit(level % 2 == 1)).otherwise(out)
        return F.coalesce(out, F.lit(False))


def keys_of(parts: DataFrame) -> DataFrame:
    """The key universe of pages with host and path: each host, and each host with its path."""
    return parts.select(F.explode(F.array("host", F.concat("host", "path"))).alias("key")).distinct()


def judged(pages: DataFrame, listed: DataFrame, rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict. The longest rule decides; where none fits, a page is
    blocked if the list has its host or its host with its path. Null urls have empty host and path, and no rule."""
    parts = with_host_and_path(pages.select("page_id", "url"))
    rule, verdict = ruled(rules)
    cascade = Cascade(listed, keys_of(parts))
    is_listed = cascade.holds(F.col("host")) | cascade.holds(F.concat("host", "path"))
    by_list = F.when(is_listed, "block").otherwise("allow")
    return parts.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, by_list).alias("verdict"))


def listed_keys(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k,) for k in LISTED], "key string")


def noted_keys(pages: DataFrame, beginning: str = NOTED) -> DataFrame:
    """The corpus's own part of the block list: the keys of its pages whose MD5 begins so. No list of real hosts comes
    with the tables; this one grows with them, as a list that reviewers keep would."""
    return keys_of(with_host_and_path(pages.select("url"))).where(F.md5("key").startswith(beginning))
