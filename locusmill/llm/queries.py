"""Registered queries of the text operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import (
    html_paths, id_files, line_dedup, log_bilinear, mpeg, ngram_join, packing, pieces, prefix_trie, rules, secret_scan, spelling, sql, substring,
)

Query = Callable[[SparkSession, str], DataFrame]


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_tag_path_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_paths.extract_pages(_read(spark, sf_dir, "pages"))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.secrets_digest(_read(spark, sf_dir, "documents"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.substring_digest(_read(spark, sf_dir, "documents"))


def op4_pattern_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed_documents(_read(spark, sf_dir, "documents"))


def op5_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log_bilinear.lbl_scores(_read(spark, sf_dir, "documents"))


def op6_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mpeg.media_columns(_read(spark, sf_dir, "documents"))


def op7_piece_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.piece_digest(_read(spark, sf_dir, "documents"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_dedup(_read(spark, sf_dir, "documents"), min_words=line_dedup.MIN_WORDS)


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.quality_digest(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_components(_read(spark, sf_dir, "documents"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(_read(spark, sf_dir, "conversations"))


def op12_spelling_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_groups(_read(spark, sf_dir, "documents"))


def op13_mixing_coder(spark: SparkSession, sf_dir: str) -> DataFrame:
    return id_files.coded_ids(_read(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_tag_path_text, op2_secret_scan, op3_substring_dedup, op4_pattern_packing, op5_lm_scores, op6_media_columns,
        op7_piece_ids, op8_line_dedup, op9_quality_rules, op10_ngram_join, op11_prefix_trie,
        op12_spelling_groups, op13_mixing_coder,
    )
}
ORACLES: dict[str, str] = {"op11_prefix_trie": sql.PREFIX_TRIE, "op12_spelling_groups": sql.SPELLING_GROUPS}
"""The others have none: models, hashes of kept words, packings and iterations are tested against plain Python in tests/llm."""
