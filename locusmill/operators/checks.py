"""Validation.  A check returns its offenders (or their counts) as rows;
``require_empty`` turns any offender into an error."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.codes import ALLELES

MEMBERS = 1 << 18
"""Fold members that one task counts."""


class CheckFailed(ValueError):
    pass


def require_empty(offenders: DataFrame, message: str) -> None:
    found = offenders.limit(5).collect()
    if found:
        raise CheckFailed(f"{message}: {found}")


def bad_dosages(calls: DataFrame, dosage: str = "dosage") -> DataFrame:
    """Calls outside 0/1/2/NULL."""
    return calls.where(F.col(dosage).isNotNull() & ~F.col(dosage).isin(0, 1, 2))


def bad_alleles(markers: DataFrame, a1: str = "a1", a2: str = "a2") -> DataFrame:
    """Markers whose alleles are not two different letters of ACGT."""
    left, right = F.upper(F.col(a1)), F.upper(F.col(a2))
    fine = left.isin(ALLELES) & right.isin(ALLELES) & (left != right)
    return markers.where(~F.coalesce(fine, F.lit(False)))


def complete_cases(df: DataFrame, traits: Sequence[str]) -> DataFrame:
    return df.dropna(subset=list(traits))


def missing_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row per column: rows, missing and share missing."""
    stats = df.agg(
        F.count(F.lit(1)).alias("n"),
        *[F.count_if(F.col(c).isNull()).alias(c) for c in columns],
    )
    return stats.unpivot(["n"], list(columns), "trait", "n_missing").select(
        "trait", "n", "n_missing",
        F.when(F.col("n") > 0, F.col("n_missing") / F.col("n")).alias("na_ratio"),
    )


def bad_binary(df: DataFrame, traits: Sequence[str]) -> DataFrame:
    """Per trait, the values other than 0 and 1 (NULL is left to other checks)."""
    stats = df.agg(*[
        F.count_if(F.col(t).isNotNull() & ~F.col(t).isin(0, 1)).alias(t) for t in traits
    ])
    return stats.unpivot([], list(traits), "trait", "n_bad")


def is_finite(c: str | Column) -> Column:
    x = (F.col(c) if isinstance(c, str) else c).cast("double")
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))


def nonfinite_counts(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*keys).agg(*[F.count_if(~is_finite(c)).alias(f"bad_{c}") for c in columns])


def duplicates(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once; partial counts are merged before the shuffle."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def exportable(df: DataFrame, stages: Sequence[str], split: str = "split") -> DataFrame:
    """Rows of the splits that may be exported; only train and val can be named."""
    if len(set(stages)) != len(stages) or any(s not in ("train", "val") for s in stages):
        raise ValueError("export stages must be unique names out of train and val")
    return df.where(F.col(split).isin(list(stages)))


def same_rows(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows found on one side only, with multiplicity."""
    return (
        left.exceptAll(right).withColumn("side", F.lit("left"))
        .unionByName(right.exceptAll(left).withColumn("side", F.lit("right")))
    )


def fold_membership(
    folds: DataFrame, ids: DataFrame, seeds: Sequence[int] | None = None, fold_ids: Sequence[int] | None = None
) -> DataFrame:
    """Per seed and fold: sizes, duplicates, overlap, samples outside or missing, and whether the fold is expected.

    ``folds`` has (seed, fold, sample_id, split).  With ``seeds`` and ``fold_ids``
    every expected fold is listed, an absent one with all samples missing; one
    beyond them is not ``expected``.  Every sample is reduced to one row per fold
    before any comparison, so no fold is gathered.
    """
    parts = folds.count() // MEMBERS + 1  # hardly two rows are of one key, so nothing is gained by counting before the shuffle
    dealt = folds.select("seed", "fold", "sample_id", "split").repartition(parts, "seed", "fold", "sample_id")
    per = dealt.groupBy("seed", "fold", "sample_id").agg(
        F.count_if(F.col("split") == "train").alias("t"),
        F.count_if(F.col("split") == "val").alias("v"),
    )
    known = per.join(ids.select("sample_id").distinct().withColumn("_known", F.lit(1)), "sample_id", "left")
    n_ids = ids.select("sample_id").distinct().count()
    found = known.groupBy("seed", "fold").agg(
        F.sum("t").alias("n_train"),
        F.sum("v").alias("n_val"),
        F.count_if((F.col("t") > 1) | (F.col("v") > 1)).alias("n_duplicate"),
        F.count_if((F.col("t") > 0) & (F.col("v") > 0)).alias("n_overlap"),
        F.count_if(F.col("_known").isNull()).alias("n_unknown"),
        (F.lit(n_ids) - F.count_if(F.col("_known").isNotNull())).alias("n_absent"),
    )
    if seeds is None or fold_ids is None:
        return found.withColumn("expected", F.lit(True))
    wanted = ids.sparkSession.createDataFrame([(int(s), int(f)) for s in seeds for f in fold_ids], "seed int, fold int")
    both = found.join(F.broadcast(wanted.withColumn("_w", F.lit(True))), ["seed", "fold"], "full")  # seeds x folds rows
    counts = [F.coalesce(c, F.lit(0)).alias(c) for c in ("n_train", "n_val", "n_duplicate", "n_overlap", "n_unknown")]
    return both.select("seed", "fold", *counts, F.coalesce("n_absent", F.lit(n_ids)).alias("n_absent"),
                       F.col("_w").isNotNull().alias("expected"))


def validation_coverage(folds: DataFrame, ids: DataFrame, seeds: Sequence[int] | None = None) -> DataFrame:
    """Per seed and number of validations: how many samples (all must be at 1).

    A sample that a seed never validates is counted at 0; seeds are those of
    ``folds`` and of ``seeds``, so one without any validation row is listed too.
    """
    named = folds.select("seed").distinct()
    if seeds is not None:
        named = named.union(ids.sparkSession.createDataFrame([(int(s),) for s in seeds], "seed int")).distinct()
    per = folds.where(F.col("split") == "val").groupBy("seed", "sample_id").agg(
        F.count(F.lit(1)).alias("times")
    )
    seen = per.join(ids.select("sample_id").distinct(), "sample_id", "left_semi")
    found = seen.groupBy("seed", "times").agg(F.count(F.lit(1)).alias("n_samples"))
    n_ids = ids.select("sample_id").distinct().count()
    counted = named.join(found.groupBy("seed").agg(F.sum("n_samples").alias("n")), "seed", "left")
    never = counted.select(
        "seed", F.lit(0).cast("long").alias("times"), (F.lit(n_ids) - F.coalesce("n", F.lit(0))).alias("n_samples")
    ).where("n_samples > 0")
    return found.unionByName(never)


def overlap(left: DataFrame, right: DataFrame, key: str = "sample_id") -> DataFrame:
    """Keys present on both sides."""
    return left.select(key).intersect(right.select(key))


def incomplete_grid(
    metrics: DataFrame, keys: Sequence[str], seeds: Sequence[int], folds: Sequence[int]
) -> DataFrame:
    """Cells of the seed x fold grid that are missing or repeated, per key.

    The expected cells come from two literal arrays, so the expansion is a
    fixed factor per key and no table is crossed with another.
    """
    wanted = (
        metrics.select(*keys).distinct()
        .withColumn("seed", F.explode(F.array(*[F.lit(int(s)) for s in seeds])))
        .withColumn("fold", F.explode(F.array(*[F.lit(int(f)) for f in folds])))
    )
    have = metrics.groupBy(*keys, "seed", "fold").agg(F.count(F.lit(1)).alias("n_rows"))
    both = wanted.withColumn("_w", F.lit(1)).join(have, [*keys, "seed", "fold"], "full")
    n = F.coalesce(F.col("n_rows"), F.lit(0)).cast("long")
    return both.where(F.col("_w").isNull() | (n != 1)).select(
        *keys, "seed", "fold", n.alias("n_rows"), F.col("_w").isNotNull().alias("expected")
    )


def store_shapes(stores: dict[str, DataFrame]) -> DataFrame:
    """Rows, samples and markers per call store; distinct keys are counted after
    they were reduced to one row each, not in one task."""
    out = None
    for name, df in stores.items():
        rows = df.agg(F.count(F.lit(1)).alias("n"))
        parts = rows.select(F.lit("calls").alias("what"), "n")
        for what, key in (("samples", "sample_id"), ("markers", "marker_idx")):
            n = df.select(key).distinct().agg(F.count(F.lit(1)).alias("n"))
            parts = parts.unionByName(n.select(F.lit(what).alias("what"), "n"))
        shaped = parts.withColumn("store", F.lit(name))
        out = shaped if out is None else out.unionByName(shaped)
    return out.select("store", "what", "n")
