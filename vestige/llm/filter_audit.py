"""Filter interaction audit by a relational word pipeline.

Every document is exploded into its words; words are counted by (document, word), then by document, for totals and
distinct words. The flags of the other filters are outer-joined to those counts, so that each document has a mask of
the filters that it fails. 32 conditional counts a part, one for each mask (and as many of good and of toxic
documents), hold all that any order of the five filters can do: what each step keeps, removes and would have removed
is a sum over masks.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vestige.llm.common import SPACES, shuffle_partitions, staged, text_of

#: A: fewer words; B: a smaller share (in percent) of distinct words; C: a larger share (in percent) of A-Z; D: one of
#: these; E: the text of a document of smaller id.
WORDS, DISTINCT, UPPER, MARKS = 200, 50, 2, "[#$%&*|]"
FILTERS = "ABCDE"
_MASKS = range(1 << len(FILTERS))
ORDERS = ["".join(p) for p in permutations(FILTERS)]


def word_counts(numbered: DataFrame) -> DataFrame:
    """(row, words, distinct_words) of the rows that have words. The texts move once, by row: both groupings are of
    one task's own rows then, so no pair of document and word is shuffled."""
    dealt = numbered.select("row", "text").repartition(shuffle_partitions(numbered.sparkSession), "row")
    words = dealt.select("row", F.explode(F.split("text", f"[{SPACES}]+")).alias("word")).where("word <> ''")
    by_word = words.groupBy("row", "word").agg(F.count(F.lit(1)).alias("n"))
    return by_word.groupBy("row").agg(F.sum("n").alias("words"), F.count(F.lit(1)).alias("distinct_words"))


def masked(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, good, toxic) of each row of docs; bit k of mask: the row fails the k-th filter.

    Null text counts as empty, a null source as the empty string. Rows that share a doc_id are judged one by one, and
    none of them is a copy of another (no id is smaller). A null doc_id is smaller than none and greater than none.
    A document is good (toxic) if any of its labels says so. Columns other than doc_id, text and source aren't read."""
    text = text_of()
    numbered = staged(
        docs.select(
            F.monotonically_increasing_id().alias("row"),
            "doc_id",
            F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"),
            text.alias("text"),
            F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"),
            (100 * F.length(F.regexp_replace(text, "[^A-Z]+", "")) > UPPER * F.length(text)).alias("c"),
            text.rlike(MARKS).alias("d"),
        )
    )
    copied = numbered.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("rows")).where("rows > 1").select("digest", "first")
    flags = numbered.select("row", "doc_id", "part", "digest", "c", "d").join(copied, "digest", "left").select("row", "doc_id", "part", "c", "d", F.coalesce(F.col("first") < F.col("doc_id"), F.lit(False)).alias("e"))
    marked = labels.groupBy("doc_id").agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    flags = flags.join(marked, "doc_id", "left")
    words, distinct = F.coalesce("words", F.lit(0)), F.coalesce("distinct_words", F.lit(0))
    fails = [words < WORDS, 100 * distinct < DISTINCT * words, F.col("c"), F.col("d"), F.col("e")]
    mask = sum((F.when(f, 1 << k).otherwise(0) for k, f in enumerate(fails)), F.lit(0))
    of = lambda c: F.coalesce(c, F.lit(False)).alias(c)
    return flags.join(word_counts(numbered), "row", "left").select("part", mask.alias("mask"), of("good"), of("toxic"))


def mask_counts(rows: DataFrame) -> DataFrame:
    """part and 32 conditional counts each of all, good and toxic documents, as arrays by mask."""
    columns = {f"{kind}_{m}": F.count_if((F.col("mask") == m) & of) for kind, of in (("n", F.lit(True)), ("good", F.col("good")), ("toxic", F.col("toxic"))) for m in _MASKS}
    counts = rows.groupBy("part").agg(*[c.alias(name) for name, c in columns.items()])
    return counts.select("part", *[F.array(*[F.col(f"{kind}_{m}") for m in _MASKS]).alias(kind) for kind in ("n", "good", "toxic")])


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row a part, order of the filters and step: part, filter_order, step, kept, removed, redundant,
    unique_fails, good_lost, toxic_lost, shapley. A table without rows has no parts."""
    counts = mask_counts(masked(docs, labels))
    steps = counts.select("*", F.explode(F.array(*map(F.lit, ORDERS))).alias("filter_order")).select("*", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))).alias("step"))
    bits = "transform(sequence(1, {0}), k -> shiftleft(1, ascii(substring(filter_order, k, 1)) - ascii('A')))"
    steps = steps.withColumn("bit", F.expr("shiftleft(1, ascii(substring(filter_order, step, 1)) - ascii('A'))")).withColumn("upto", F.expr(f"aggregate({bits.format('step')}, 0, (a, b) -> a | b)"))

    def total(kind: str, which: str) -> F.Column:
        """Sum of the counts of the masks m for which the condition holds."""
        return F.expr(f"aggregate(sequence(0, {len(_MASKS) - 1}), 0L, (total, m) -> total + if({which}, {kind}[m], 0L))")

    now, before = "(m & bit) <> 0", "(m & upto & ~bit)"
    removed = f"{now} and {before} = 0"
    return steps.select(
        "part",
        "filter_order",
        "step",
        total("n", "(m & upto) = 0").alias("kept"),
        total("n", removed).alias("removed"),
        total("n", f"{now} and {before} <> 0").alias("redundant"),
        total("n", "m = bit").alias("unique_fails"),
        total("good", removed).alias("good_lost"),
        total("toxic", removed).alias("toxic_lost"),
        # Of all orders, a share of 1 / bit_count(m) has this filter before the others that the document fails.
        F.expr(f"aggregate(sequence(0, {len(_MASKS) - 1}), 0L, (total, m) -> total + if({now}, n[m] * ({len(ORDERS)} div greatest(bit_count(m), 1)), 0L))").alias("shapley"),
    )
