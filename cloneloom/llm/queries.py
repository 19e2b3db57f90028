"""Queries of the training-data operators over ``documents``, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import exact_dedup, langid, license_scan, mixing, ngram_join, packing, pii, quality, sharding, token_io


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_documents(spark, sf_dir))


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(_documents(spark, sf_dir))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(_documents(spark, sf_dir))


def op4_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_documents(spark, sf_dir))


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_io.round_trip(_documents(spark, sf_dir))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(_documents(spark, sf_dir))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(_documents(spark, sf_dir))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(_documents(spark, sf_dir))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(_documents(spark, sf_dir))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(_documents(spark, sf_dir))


def quality_base_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What of op7's result SQL can express."""
    return op7_quality_rules(spark, sf_dir).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def mixing_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What of op4's result SQL can express: sizes and targets."""
    return op4_source_mixing(spark, sf_dir).select("doc_id", "size", "source_size", F.round("target", 3).alias("target"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_best_fit_packing, op2_ngram_jaccard_join, op3_language_id, op4_source_mixing, op5_token_files,
        op6_license_scan, op7_quality_rules, op8_exact_dedup, op9_sharding, op10_pii,
        quality_base_counts, mixing_targets,
    )
}

_WORD = r"[^\x20\x09-\x0D]+"

ORACLE_SQL: dict[str, str] = {
    "quality_base_counts": rf"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
        w AS (SELECT doc_id, text, regexp_extract_all(text, '{_WORD}') AS words, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{_WORD}')) AS lines FROM d),
        g AS (SELECT doc_id, k, array_to_string(words[k:k + 4], ' ') AS five FROM (SELECT doc_id, words, unnest(range(1, len(words) - 3)) AS k FROM w WHERE len(words) >= 5)),
        t AS (SELECT doc_id, k FROM (SELECT doc_id, k, count(*) OVER (PARTITION BY doc_id, five) AS times FROM g) WHERE times > 1),
        r AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(k, k + 5)) AS p FROM t) GROUP BY 1)
        SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words,
               CAST(length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
               CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
               CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
               CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words,
               len(words) < 10 OR 100 * coalesce(r.n, 0) > 20 * len(words) AS base_failed
        FROM w LEFT JOIN r ON r.doc_id = w.doc_id
    """,
    "mixing_targets": rf"""
        WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '{_WORD}')) AS BIGINT) AS size FROM documents),
        s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY 1),
        w AS (SELECT *, CAST(([5, 2, 1])[CAST((row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1 AS INTEGER)] AS DOUBLE) AS w, 3.0 * source_size AS cap, sum(source_size) OVER () AS total FROM s),
        l AS (SELECT a.cap / a.w AS level, sum(least(b.cap, a.cap / a.w * b.w)) AS filled, sum(CASE WHEN b.cap / b.w < a.cap / a.w THEN b.cap ELSE 0 END) AS capped, sum(CASE WHEN b.cap / b.w >= a.cap / a.w THEN b.w ELSE 0 END) AS free
              FROM w a CROSS JOIN w b GROUP BY a.source, a.cap, a.w),
        f AS (SELECT arg_min(capped, level) AS capped, arg_min(free, level) AS free FROM l WHERE filled >= (SELECT any_value(total) FROM w))
        SELECT doc_id, size, source_size, round(least(cap, (w.total - f.capped) / f.free * w.w), 3) AS target
        FROM d JOIN w ON w.source IS NOT DISTINCT FROM d.source CROSS JOIN f
    """,
    "op8_exact_dedup": """
        SELECT doc_id,
               max(doc_id) OVER g AS keep_id,
               count(*) OVER g AS group_size,
               doc_id IS NOT DISTINCT FROM max(doc_id) OVER g AS kept,
               sha256(coalesce(text, '')) AS text_sha256
        FROM documents
        WINDOW g AS (PARTITION BY coalesce(text, ''))
    """,
}
