"""Genotype-shaped views over the given star-schema tables.

Each view reads its whole source table.  The expressions are plain SQL that
Spark and the checking engine both accept, so one text serves both sides.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.intervals import gap_fill_intervals
from ..plans.session import stable

#: view -> (source table, select expressions)
SIMPLE = {
    "samples": (
        "customer",
        [
            "c_custkey AS sample_id",
            "c_acctbal / 1000 AS bw",
            "c_acctbal / 2000 + cast(c_nationkey AS double) / 10 AS le",
            "CASE WHEN c_mktsegment = 'MACHINERY' THEN 1 ELSE 0 END AS surv",
        ],
    ),
    "phenotypes": (
        "customer",
        [
            "c_custkey AS sample_id",
            "CASE WHEN c_custkey % 7 = 3 THEN NULL ELSE c_acctbal / 1000 END AS bw",
            "CASE WHEN c_custkey % 11 = 5 THEN NULL ELSE cast(c_nationkey AS double) / 10 + c_acctbal / 3000 END AS le",
            "CASE WHEN c_mktsegment = 'MACHINERY' THEN 1 ELSE 0 END AS surv",
        ],
    ),
    "markers": (
        "part",
        [
            "p_partkey AS marker_idx",
            "cast(p_partkey % 5 + 1 AS string) AS chrom",
            "p_partkey * 100 + p_size AS pos",
            "CASE p_partkey % 4 WHEN 0 THEN 'A' WHEN 1 THEN 'C' WHEN 2 THEN 'G' ELSE 'T' END AS a1",
            "CASE p_partkey % 4 WHEN 0 THEN 'G' WHEN 1 THEN 'T' WHEN 2 THEN 'C' ELSE 'A' END AS a2",
            "p_retailprice / 5000 AS maf_ref",
        ],
    ),
    "genes": (
        "supplier",
        [
            "cast(s_suppkey % 5 + 1 AS string) AS chrom",
            "s_suppkey * 900 AS g_start",
            "s_suppkey * 900 + 400 + s_nationkey AS g_end",
        ],
    ),
    "fits_bw": (
        "customer",
        [
            "c_custkey AS sample_id",
            "'bw' AS trait",
            "c_acctbal / 1100 AS y_true",
            "c_acctbal / 1300 + cast(c_nationkey AS double) / 39 AS base",
        ],
    ),
    "fits_le": (
        "customer",
        [
            "c_custkey AS sample_id",
            "'le' AS trait",
            "c_acctbal / 2100 + cast(c_nationkey AS double) / 10 AS y_true",
            "c_acctbal / 1700 + cast(c_custkey % 13 AS double) / 7 AS base",
        ],
    ),
    "epochs": (
        "orders",
        [
            "o_custkey AS run",
            "'bw' AS trait",
            "o_orderkey AS epoch",
            "o_totalprice / 100000 AS score",
        ],
    ),
    "features": (
        "lineitem",
        [
            "cast(l_linenumber AS string) AS chrom",
            "l_quantity AS quantity",
            "l_extendedprice / 1000 AS price",
            "l_discount AS discount",
            "l_tax AS tax",
            "cast(1 AS double) AS flat",
        ],
    ),
}

#: one genotype code per order line: 0/1/2, or 3 where the call is missing
CALL_CODE = (
    "CASE WHEN (l_orderkey * 7 + l_partkey * 13 + l_linenumber) % 17 = 0 THEN 3"
    " WHEN (l_orderkey * 37 + l_partkey * 101 + l_linenumber * 11) % 100 < l_partkey % 45 + 5 THEN 2"
    " WHEN (l_orderkey * 37 + l_partkey * 101 + l_linenumber * 11) % 100 < (l_partkey % 45 + 5) * 2 THEN 1"
    " ELSE 0 END"
)
#: a dense panel from the vectors: sign and size of a component give the dosage
PANEL_DOSAGE = (
    "CASE WHEN (sample_id * 7 + marker_idx * 13) % 17 = 0 THEN NULL"
    " WHEN value < -6e-2 THEN 0 WHEN value < 5e-2 THEN 1 ELSE 2 END"
)
PANEL_TRAIT = "sum(value * ((marker_idx % 7) - 3)) AS y"
SEEDS = (1, 2, 3)
MODELS = ("ridge", "trees")
PREDICTED = (
    "CASE WHEN model = 'ridge' THEN base ELSE base * cast(0.9 AS double) + cast(sample_id % 7 AS double) / 10 END"
    " + cast(seed AS double) / 8"
)
N_FOLDS = 5
VAL_FOLD = "cast((sample_id * seed + cast(floor(sample_id / 5) AS bigint)) % 5 AS int)"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    source, expressions = SIMPLE[name]
    return table(spark, sf_dir, source).selectExpr(*expressions)


def expand_fits(fits: DataFrame, more: Sequence[str] = ()) -> DataFrame:
    """Every sample predicted once per model and seed, in its validation fold; ``more`` columns are kept."""
    out = fits.withColumn("seed", F.explode(F.array(*[F.lit(s) for s in SEEDS]))).withColumn(
        "model", F.explode(F.array(*[F.lit(m) for m in MODELS])))
    return out.selectExpr(
        "model", "trait", "seed", f"{VAL_FOLD} AS fold", "sample_id", "y_true", f"{PREDICTED} AS y_pred", *more)


def preds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions of two traits by model, seed and fold."""
    return expand_fits(view(spark, sf_dir, "fits_bw").unionByName(view(spark, sf_dir, "fits_le")))


def genes_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gene and non-gene intervals; a chromosome ends 1000 past its last marker."""
    lengths = view(spark, sf_dir, "markers").groupBy("chrom").agg((F.max("pos") + 1000).alias("length"))
    return stable(gap_fill_intervals(view(spark, sf_dir, "genes"), stable(lengths)))


def raw_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sparse calls ``(sample_id, marker_idx, code)``, one per sample and marker."""
    lines = table(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey", "l_partkey AS marker_idx", f"{CALL_CODE} AS code"
    )
    orders = table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey AS l_orderkey", "o_custkey AS sample_id"
    )
    return (
        lines.join(orders, "l_orderkey")
        .groupBy("sample_id", "marker_idx")
        .agg(F.min("code").cast("int").alias("code"))
    )


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw_calls(spark, sf_dir).selectExpr(
        "sample_id", "marker_idx", "nullif(code, 3) AS dosage"
    )


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        table(spark, sf_dir, "embeddings")
        .select(F.col("vec_id").alias("sample_id"), F.posexplode("embedding"))
        .selectExpr("sample_id", "cast(pos AS bigint) AS marker_idx", "cast(col AS double) AS value")
    )


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors(spark, sf_dir).selectExpr(
        "sample_id", "marker_idx", f"{PANEL_DOSAGE} AS dosage"
    )


def panel_trait(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors(spark, sf_dir).groupBy("sample_id").agg(
        F.expr(PANEL_TRAIT.replace(" AS y", "")).alias("y")
    )


def val_folds(ids: DataFrame, seeds=SEEDS) -> DataFrame:
    """``(seed, sample_id, val_fold)``: one row per sample and seed."""
    return ids.select(
        "sample_id", F.explode(F.array(*[F.lit(s) for s in seeds])).alias("seed")
    ).selectExpr("seed", "sample_id", f"{VAL_FOLD} AS val_fold")


SQL = {
    name: f"SELECT {', '.join(exprs).replace('AS string', 'AS varchar')} FROM {source}"
    for name, (source, exprs) in SIMPLE.items()
}
SQL["preds"] = (
    f"SELECT model, trait, seed, {VAL_FOLD} AS fold, sample_id, y_true, {PREDICTED} AS y_pred FROM"
    f" (SELECT *, unnest({list(MODELS)}) AS model FROM (SELECT *, unnest({list(SEEDS)}) AS seed FROM"
    f" ({SQL['fits_bw']} UNION ALL {SQL['fits_le']})))"
)
SQL["raw_calls"] = (
    f"SELECT o_custkey AS sample_id, l_partkey AS marker_idx, min({CALL_CODE}) AS code"
    " FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL"
)
SQL["calls"] = (
    f"SELECT sample_id, marker_idx, nullif(code, 3) AS dosage FROM ({SQL['raw_calls']})"
)
SQL["vectors"] = (
    "SELECT vec_id AS sample_id, dim - 1 AS marker_idx, cast(embedding[dim] AS double) AS value"
    " FROM (SELECT vec_id, embedding, unnest(range(1, len(embedding) + 1)) AS dim FROM embeddings)"
)
SQL["panel"] = f"SELECT sample_id, marker_idx, {PANEL_DOSAGE} AS dosage FROM ({SQL['vectors']})"
SQL["panel_trait"] = f"SELECT sample_id, {PANEL_TRAIT} FROM ({SQL['vectors']}) GROUP BY sample_id"
SQL["panel_folds"] = (
    f"SELECT seed, sample_id, {VAL_FOLD} AS val_fold FROM"
    " (SELECT vec_id AS sample_id, unnest([1, 2, 3]) AS seed FROM embeddings)"
)
SQL["sample_folds"] = (
    f"SELECT seed, sample_id, {VAL_FOLD} AS val_fold FROM"
    " (SELECT c_custkey AS sample_id, unnest([1, 2, 3]) AS seed FROM customer)"
)


def with_views(sql: str, *names: str) -> str:
    """Prefix ``sql`` with the named views as common table expressions."""
    ctes = ", ".join(f"v_{n} AS ({SQL[n]})" for n in names)
    return f"WITH {ctes} {sql}" if not sql.lstrip().startswith(",") else f"WITH {ctes}{sql}"
