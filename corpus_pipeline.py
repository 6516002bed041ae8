"""Corpus pipeline: documents to packed token sequences in five stages.

Each stage works on all that the one before kept; all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vestige.llm import exact_dedup, jaccard_join, packing, quality, secrets
from vestige.llm.common import staged, table
from vestige.llm.queries import tokenizer_path


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the importance resampler keeps. Null and empty texts weigh 0 and so stay where clean documents
    of that weight would; repeated rows and ties share one fate; an empty table stays empty."""
    return quality.Resampler(docs, table(spark, sf_dir, "labels")).kept(docs)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text: the one with the most code points, then the smallest doc_id (null last). Null and
    empty texts are one text."""
    return exact_dedup.drop_exact_copies(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest doc_id of each component of near copies. Texts without words (null ones too) are
    near none, and rows without doc_id stay."""
    return jaccard_join.drop_near_copies(docs)


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, each secret replaced by `[secret]`; null and empty texts stay as they are."""
    return secrets.redacted(docs, secrets.train(docs, table(spark, sf_dir, "labels")))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences; a null or empty text is its end token alone. Where sequences are cut
    depends on the order in which tasks read the documents, what they hold doesn't."""
    return packing.packed(docs, tokenizer_path())


STAGES = [("quality classifier", quality_stage), ("exact dedup", exact_stage), ("n-gram Jaccard join", near_stage), ("secret scans", secrets_stage), ("packing", packing_stage)]

#: SQL can't express the stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = staged(docs)
    return docs
