"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vestige.llm import bpe, chat, exact_dedup, filter_audit, hmm_scoring, jaccard_join, licenses, lz_fingerprint, packing, quality, secrets, url_filter, whitening
from vestige.llm.common import table


def tokenizer_path() -> str:
    """Where the public vocabulary lies; the operators take any path."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


def op2_lz_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lz_fingerprint.edited_and_next(table(spark, sf_dir, "documents"))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), tokenizer_path())


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.licenses(licenses.path_of(table(spark, sf_dir, "documents")))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return url_filter.judged(pages, url_filter.listed_keys(spark).union(url_filter.noted_keys(pages)))


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.formatted(table(spark, sf_dir, "conversations"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    chosen = quality.Resampler(docs, table(spark, sf_dir, "labels")).apply(docs)
    return chosen.select("doc_id", F.round("log_weight", 6).alias("log_weight"), F.round("key", 6).alias("key"), "kept")


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return secrets.scan(docs, secrets.train(docs, table(spark, sf_dir, "labels")))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"), tokenizer_path())


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(table(spark, sf_dir, "documents"))


def op11_hmm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm_scoring.Scorer(table(spark, sf_dir, "documents")).scored()


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened(table(spark, sf_dir, "embeddings"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_exact_dedup,
        op2_lz_fingerprints,
        op3_bpe,
        op4_licenses,
        op5_url_filter,
        op6_chat_format,
        op7_quality,
        op8_secrets,
        op9_packing,
        op10_jaccard_join,
        op11_hmm_scoring,
        op12_filter_audit,
        op13_whitening,
    )
}

_SPACE = r"[\x20\x09-\x0D]"

_OP1 = rf"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n, sha256(regexp_replace(coalesce(text, ''), '{_SPACE}', '', 'g')) AS h FROM documents),
g AS (SELECT h, count(*) AS group_size, arg_min(doc_id, (-n, doc_id)) AS keep_id FROM d GROUP BY h)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, d.h AS text_sha256 FROM d JOIN g USING (h)
"""


def _op5() -> str:
    rules = sorted(url_filter.RULES, key=lambda r: -len(r[0]) - len(r[1]))
    fits = lambda h, p: f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')"
    rule = " ".join(f"WHEN {fits(h, p)} THEN '{h}{p}'" for h, p, _ in rules)
    verdict = " ".join(f"WHEN {fits(h, p)} THEN '{v}'" for h, p, v in rules)
    of = lambda names: f"(SELECT unnest({names!r}) AS x)"
    return rf"""
WITH named AS (SELECT f.x || a.x || '-' || b.x || '.example.' || e.x AS key FROM {of(url_filter._FRONTS)} f, {of(url_filter._FIRST)} a, {of(url_filter._SECOND)} b, {of(url_filter._ENDS)} e),
r AS (SELECT page_id, CASE WHEN instr(coalesce(url, ''), '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM r),
listed AS (SELECT key FROM named UNION SELECT k FROM (SELECT host AS k FROM p UNION SELECT host || path FROM p) WHERE starts_with(md5(k), '{url_filter.NOTED}'))
SELECT page_id, host, path, CASE {rule} END AS rule, CASE {verdict} WHEN host IN (SELECT key FROM listed) OR host || path IN (SELECT key FROM listed) THEN 'block' ELSE 'allow' END AS verdict FROM p
"""


_OP12 = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, count(*) AS words, count(DISTINCT w) AS kinds FROM (SELECT r, unnest(string_split_regex(t, '{_SPACE}+')) AS w FROM d) WHERE w <> '' GROUP BY r),
first AS (SELECT t, min(doc_id) AS m FROM d GROUP BY t),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT part, coalesce(good, 0) AS good, coalesce(l.toxic, 0) AS toxic,
  CASE WHEN coalesce(words, 0) < 200 THEN 'A' ELSE '' END || CASE WHEN 100 * coalesce(kinds, 0) < 50 * coalesce(words, 0) THEN 'B' ELSE '' END
  || CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t) THEN 'C' ELSE '' END || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END || CASE WHEN doc_id > m THEN 'E' ELSE '' END AS failed
  FROM d LEFT JOIN w USING (r) LEFT JOIN first USING (t) LEFT JOIN l USING (doc_id)),
g AS (SELECT part, failed, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY part, failed),
letter AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (SELECT filter_order, step FROM (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM letter a, letter b, letter c, letter d, letter e) CROSS JOIN (SELECT unnest(range(1, 6)) AS step) WHERE contains(filter_order, 'A') AND contains(filter_order, 'B') AND contains(filter_order, 'C') AND contains(filter_order, 'D') AND contains(filter_order, 'E')),
s AS (SELECT part, filter_order, step, substr(filter_order, step, 1) AS own, n, good, toxic, failed, contains(failed, substr(filter_order, step, 1)) AS fails, failed <> '' AND length(translate(left(filter_order, step - 1), failed, '')) < step - 1 AS gone FROM g CROSS JOIN o),
a AS (SELECT part, filter_order, step, own, coalesce(sum(n) FILTER (NOT fails AND NOT gone), 0) AS kept, coalesce(sum(n) FILTER (fails AND NOT gone), 0) AS removed, coalesce(sum(n) FILTER (fails AND gone), 0) AS redundant,
  coalesce(sum(n) FILTER (failed = own), 0) AS unique_fails, coalesce(sum(good) FILTER (fails AND NOT gone), 0) AS good_lost, coalesce(sum(toxic) FILTER (fails AND NOT gone), 0) AS toxic_lost FROM s GROUP BY part, filter_order, step, own)
SELECT part, filter_order, CAST(step AS INT) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley FROM a
"""

ORACLE_SQL = {"op1_exact_dedup": _OP1, "op5_url_filter": _op5(), "op12_filter_audit": _OP12}
