"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
as Parquet and read again as the next one's ``docs``.  All but the last return
the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from locusmill.llm import line_dedup, ngram_join, packing, rules, secret_scan
from locusmill.llm.tables import without
from locusmill.plans.session import stable

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")

SHINGLE, SHARE = 5, 80
"""Near duplicates of the pipeline share 80 % of their 5-word shingles; op10's own 3 words and 90 % hold for that query only."""

LEAST_WORDS = 50
"""What the base rules ask of a document, asked again of what the line stage leaves of one."""

ORACLE_SQL = None
"""Learned rules, a learned field and a packing have no SQL; tests/llm runs the stages against plain Python."""


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the learned decision list keep; empty and NULL texts go."""
    learned = rules.fit_rules(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return rules.quality(docs, learned, keep=COLUMNS).where("kept").select(*COLUMNS)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of line runs and of long lines go from the texts.

    A document that loses all its lines goes; so does one of which less than
    half its characters and fewer than ``LEAST_WORDS`` words are left, the rest
    of a copy.
    """
    docs = docs.withColumn("_whole", F.length("text"))
    out = line_dedup.line_dedup(docs, keep=("lang", "source", "_whole"), min_words=line_dedup.MIN_WORDS)
    less = (F.col("n_removed") > 0) & (2 * F.length("kept") < F.col("row._whole"))
    rest = less & (F.regexp_count("kept", F.lit(r"[^\x20\x09-\x0D]+")) < LEAST_WORDS)
    out = out.where((F.col("n_lines") == 0) | ((F.col("n_removed") < F.col("n_lines")) & ~rest))
    return out.select("doc_id", F.col("kept").alias("text"), "row.lang", "row.source", F.length("kept").cast("long").alias("n_chars"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: the one with the smallest id.

    Documents without a word and rows without an id belong to no group.  Rows
    equal in id and text count as one document.
    """
    docs, keys = docs.select(*COLUMNS), ["doc_id", "fp"]
    rows = stable(ngram_join.jaccard_components(docs, n=SHINGLE, percent=SHARE, with_keys=True).where("doc_id IS NOT NULL"))
    grouped = rows.where("component IS NOT NULL").withColumn("row", F.struct(*keys))
    first = stable(grouped.groupBy("component").agg(F.min("row").alias("first")))
    gone = stable(grouped.join(first, "component").where("row <> first").select(*keys).distinct())
    again = stable(rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1").select(*keys))
    kept = without(docs.withColumn("fp", F.xxhash64(F.coalesce("text", F.lit("")))), gone, keys)
    once = without(kept, again, keys).select(*COLUMNS)
    if again.isEmpty():
        return once
    return once.union(kept.join(again, keys).dropDuplicates(keys).select(*COLUMNS))


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every secret found is replaced by a mark."""
    field = secret_scan.train_field(docs.select("doc_id", "text"))
    out = secret_scan.find_secrets(docs, field, keep=("doc_id", "lang", "source"), redact=secret_scan.MARK)
    return out.select("doc_id", F.col("redacted").alias("text"), "lang", "source", F.length("redacted").cast("long").alias("n_chars"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their places in sequences."""
    return packing.packed_documents(docs)


STAGES = [
    ("quality_rules", quality_stage),
    ("line_dedup", line_stage),
    ("ngram_join", near_duplicate_stage),
    ("secret_scan", secret_stage),
    ("best_fit_packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; between them each result is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = stable(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
