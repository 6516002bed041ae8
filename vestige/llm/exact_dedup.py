"""Exact dedup by a heavy-hitter split.

Misra-Gries summaries of the digests name at most `counters` digests that can be frequent; a second pass counts
them exactly and picks their winners (verified), which are few by construction and so are broadcast: rows of a
frequent digest are decided on the map side. All other digests go through one shuffle; by the summaries' bound
none of them holds more than 2 / (counters + 1) of all rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vestige.llm.common import SPACES, staged, text_of, tidy

COUNTERS = 1024


def normalised(column: str = "text"):
    return F.translate(text_of(column), SPACES, "")


def misra_gries(values: Iterator[bytes], counters: int) -> dict[bytes, int]:
    """At most `counters` values; each true count exceeds the kept one by at most n / (counters + 1)."""
    kept: dict[bytes, int] = {}
    for value in values:
        if value in kept:
            kept[value] += 1
        elif len(kept) < counters:
            kept[value] = 1
        else:
            kept = {k: n - 1 for k, n in kept.items() if n > 1}
    return kept


def frequent(digests: DataFrame, counters: int) -> DataFrame:
    """(digest, rows): at most `counters` digests, all of those over 2 n / (counters + 1) rows among them."""

    def summarise(batches):
        kept = misra_gries((x for b in batches for x in b.column(0).to_pylist()), counters)
        yield pa.RecordBatch.from_pydict({"digest": pa.array(list(kept), pa.binary()), "n": pa.array(list(kept.values()), pa.int64())})

    parts = digests.select("digest").mapInArrow(tidy(summarise), "digest binary, n long")
    return parts.groupBy("digest").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "digest").limit(counters).select("digest")


def _rank(*ties: str):
    """Larger first, then the smaller doc_id (null last), then by `ties`."""
    return F.struct((-F.col("n_cp")).alias("m"), F.col("doc_id").isNull().alias("z"), F.col("doc_id").alias("i"), *map(F.col, ties))


def exact_groups(docs: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when they are without the six white-space characters; null counts as empty. The row with the
    most code points stays, then the smallest doc_id (a null one last), then one of the repeated rows. Columns
    other than doc_id and text aren't read."""
    digests = staged(
        docs.select(
            "doc_id",
            F.unhex(F.sha2(normalised().cast("binary"), 256)).alias("digest"),
            F.length(text_of()).cast("long").alias("n_cp"),
            F.monotonically_increasing_id().alias("row"),
        )
    )
    groups = lambda of: of.groupBy("digest").agg(F.count(F.lit(1)).alias("group_size"), F.min(_rank("row")).alias("best")).where("group_size > 1")
    winners = staged(groups(digests.join(F.broadcast(frequent(digests, counters)), "digest")))
    hot = digests.join(F.broadcast(winners), "digest")
    cold = digests.join(F.broadcast(winners.select("digest")), "digest", "left_anti")
    cold = cold.join(groups(cold), "digest", "left")
    several = F.col("best").isNotNull()
    return hot.unionByName(cold).select(
        "doc_id",
        F.when(several, F.col("best.i")).otherwise(F.col("doc_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).alias("group_size"),
        (~several | (F.col("row") == F.col("best.row"))).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def drop_exact_copies(docs: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """The rows of docs that stay, with all their columns, whatever they are called; of rows with one doc_id and one
    text, one stays.

    Winners are found without the texts, with how many rows tie for them. Of a frequent digest only the winner's rows
    pass the map side; the others' rows meet their winner in one shuffle. Ties end in a grouping that adds up per
    task."""
    keyed = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("all"),
        F.col("doc_id").alias("doc_id"),
        F.unhex(F.sha2(normalised().cast("binary"), 256)).alias("digest"),
        F.length(text_of()).cast("long").alias("n_cp"),
    )
    digests = staged(keyed.drop("all"))

    def winners(of: DataFrame) -> DataFrame:
        once = of.groupBy("digest", "doc_id", "n_cp").agg(F.count(F.lit(1)).alias("ties"))
        best = once.groupBy("digest").agg(F.min(_rank("ties")).alias("best"))
        return best.select("digest", F.col("best.i").alias("keep"), (-F.col("best.m")).alias("most"), F.col("best.ties").alias("ties"))

    hot = staged(winners(digests.join(F.broadcast(frequent(digests, counters)), "digest")))
    cold = winners(digests.join(F.broadcast(hot), "digest", "left_anti"))
    wins = F.col("doc_id").eqNullSafe(F.col("keep")) & (F.col("n_cp") == F.col("most"))
    names = ["digest", "all", "ties"]
    of_hot = keyed.join(F.broadcast(hot), "digest").where(wins).select(*names)
    rest = keyed.join(F.broadcast(hot.select("digest")), "digest", "left_anti").alias("k")
    won = cold.withColumnRenamed("digest", "of").hint("shuffle_hash")
    of_cold = rest.join(won, (F.col("digest") == F.col("of")) & (F.col("n_cp") == F.col("most")) & F.col("doc_id").eqNullSafe(F.col("keep"))).select(*names)
    kept = of_hot.union(of_cold)
    tied = kept.where("ties > 1").groupBy("digest").agg(F.first("all").alias("all"))
    return kept.where("ties = 1").select("all").union(tied.select("all")).select("all.*")
