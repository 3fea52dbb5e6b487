"""Key-based alignment of samples, markers, phenotypes, folds and covariates.

No side is forced to broadcast: Spark broadcasts a side it has measured below
its threshold and splits skewed shuffle partitions otherwise.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.codes import id_aliases
from ..plans.joins import attach_measured
from ..plans.session import stable
from .checks import CheckFailed, duplicates, is_finite, require_empty

DIRECT_MATCH_SHARE = 0.1
OUTER_IDS = 1 << 15
"""IDs whose substrings one task matches."""


def align_phenotypes(samples: DataFrame, phenotypes: DataFrame) -> DataFrame:
    """Every genotyped sample, with NULL traits where no phenotype row exists."""
    return samples.join(
        phenotypes.withColumn("matched", F.lit(True)), "sample_id", "left"
    ).fillna(False, ["matched"])


def match_report(aligned: DataFrame) -> DataFrame:
    return aligned.agg(
        F.count(F.lit(1)).alias("n_samples"),
        F.count_if(F.col("matched")).alias("n_matched"),
        F.count_if(~F.col("matched")).alias("n_missing"),
    )


def contains_match(
    outer: DataFrame, inner: DataFrame, outer_id: str, inner_id: str, inner_ord: str
) -> DataFrame:
    """For every outer ID the first listed inner ID that is a substring of it.

    Instead of comparing all pairs, each outer ID is cut into its substrings of
    the lengths that inner IDs have, and these meet the inner IDs by equality.
    The matches of an outer ID stay in its task, which has so many outer IDs that
    they can be sorted there.
    """
    parts = outer.count() // OUTER_IDS + 1
    outer = outer.select(outer_id).repartition(parts, outer_id)
    lengths = [r[0] for r in inner.select(F.length(inner_id).alias("n")).distinct().collect()]

    def pieces_of(n: int):
        starts = F.sequence(F.lit(1), F.greatest(F.length(outer_id) - n + 1, F.lit(1)))
        cut = F.transform(starts, lambda at: F.substring(F.col(outer_id), at, F.lit(n)))
        return F.when(F.length(outer_id) >= n, cut).otherwise(F.array().cast("array<string>"))

    cuts = F.array_distinct(F.flatten(F.array(*[pieces_of(n) for n in sorted(lengths)])))
    pieces = outer.select(outer_id, F.explode(cuts).alias(inner_id))
    hits = pieces.join(inner.select(inner_id, inner_ord), inner_id)
    return hits.groupBy(outer_id).agg(F.min_by(inner_id, inner_ord).alias(inner_id))


def align_by_any_id(
    samples: DataFrame, phenotypes: DataFrame, sample_ord: str = "ord", pheno_ord: str = "ord"
) -> tuple[str, DataFrame]:
    """Direct match, else substring match, else individual ID.

    ``samples`` has (sample_id, fid, iid, ord), ``phenotypes`` (pheno_id, ord).
    Fallbacks apply only where under 10 % of the samples match directly; the
    direction of the substring test is the one that matches more IDs, counted
    over all of them; without a match, or as many either way, individual IDs
    decide.  Returns the method and the pairs (sample_id, pheno_id).
    """
    direct = samples.join(
        phenotypes.select("pheno_id"), F.col("sample_id") == F.col("pheno_id")
    ).select("sample_id", "pheno_id")
    n, hits = samples.count(), direct.count()
    if hits >= DIRECT_MATCH_SHARE * n or phenotypes.isEmpty():
        return "direct", direct
    inside_samples = stable(contains_match(samples, phenotypes, "sample_id", "pheno_id", pheno_ord))
    inside_phenotypes = stable(contains_match(phenotypes, samples, "pheno_id", "sample_id", sample_ord))
    one, other = inside_samples.count(), inside_phenotypes.count()
    if one > other:
        return "pheno_subset", inside_samples.select("sample_id", "pheno_id")
    if other > one:
        # several phenotype rows may name one sample: the last listed one stays
        listed = inside_phenotypes.join(phenotypes.select("pheno_id", F.col(pheno_ord).alias("_o")), "pheno_id")
        kept = listed.groupBy("sample_id").agg(F.max_by("pheno_id", "_o").alias("pheno_id"))
        return "geno_subset", kept.select("sample_id", "pheno_id")
    return "iid_only", iid_match(samples, phenotypes)


def iid_match(samples: DataFrame, phenotypes: DataFrame) -> DataFrame:
    """Pairs whose individual ID equals the phenotype ID."""
    return samples.join(
        phenotypes.select("pheno_id"), F.col("iid") == F.col("pheno_id")
    ).select("sample_id", "pheno_id")


def align_alias(wanted: DataFrame, fam: DataFrame) -> DataFrame:
    """Requested IDs against the four alias spellings, with the number of hits.

    Exactly one hit is right; ``sample_idx`` is NULL for any other count.
    """
    spelled = fam.select("sample_idx", F.explode(id_aliases("fid", "iid")).alias("sample_id"))
    hits = wanted.join(spelled, "sample_id", "left").groupBy("sample_id").agg(
        F.count("sample_idx").alias("n_hits"), F.min("sample_idx").alias("sample_idx")
    )
    return hits.withColumn("sample_idx", F.when(F.col("n_hits") == 1, F.col("sample_idx")))


def annotate_markers(listed: DataFrame, annotation: DataFrame, key: str = "marker_id") -> DataFrame:
    """Inner join of the called markers with their annotation."""
    return listed.join(annotation, key)


def annotation_gaps(listed: DataFrame, annotation: DataFrame, key: str = "marker_id") -> DataFrame:
    """Markers on one side only; both sides must be empty."""
    left = listed.join(annotation, key, "left_anti").select(key, F.lit("calls").alias("only_in"))
    right = annotation.join(listed, key, "left_anti").select(key, F.lit("annotation").alias("only_in"))
    return left.unionByName(right)


def restrict_candidates(markers: DataFrame, candidates: DataFrame, key: str) -> DataFrame:
    return markers.join(candidates, key, "left_semi")


def missing_candidates(markers: DataFrame, candidates: DataFrame, key: str) -> DataFrame:
    return candidates.join(markers, key, "left_anti").select(key).distinct()


def select_samples(df: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of the listed samples, carrying the requested order in ``ord``."""
    return df.join(ids.select("sample_id", "ord"), "sample_id")


def ordered_export(df: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows in requested ID order; a listed sample without a row is an error."""
    require_empty(ids.join(df, "sample_id", "left_anti"), "listed samples without a row")
    return select_samples(df, ids).orderBy("ord")


def select_markers(df: DataFrame, kept: DataFrame, key: str = "marker_idx") -> DataFrame:
    """Rows of the listed markers; unknown indexes are ignored, none left is an error."""
    out = df.join(kept.select(key).distinct(), key, "left_semi")
    if out.isEmpty():
        raise CheckFailed("no marker left after selection")
    return out


def select_traits(df: DataFrame, wanted: Sequence[str], key: str = "sample_id") -> DataFrame:
    """Requested traits in order: exact name first, then without regard to case."""
    chosen = []
    for name in wanted:
        exact = [c for c in df.columns if c == name]
        loose = [c for c in df.columns if c.lower() == name.lower()]
        if not exact and not loose:
            raise CheckFailed(f"trait {name!r} is not in {df.columns}")
        chosen.append((exact or loose)[0])
    if len(set(chosen)) != len(chosen):
        raise CheckFailed("a trait was requested twice")
    return df.select(key, *[F.col(f"`{c}`") for c in chosen])


def attach_fold(df: DataFrame, folds: DataFrame, split: str | None = None) -> DataFrame:
    """Rows by (seed, fold, split); ``folds`` is (seed, fold, sample_id, split)."""
    wanted = folds if split is None else folds.where(F.col("split") == split)
    return df.join(wanted, "sample_id")


def expand_folds(val_folds: DataFrame, n_folds: int) -> DataFrame:
    """(seed, sample_id, val_fold) -> one row per fold with its split."""
    out = val_folds.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(n_folds - 1))))
    split = F.when(F.col("fold") == F.col("val_fold"), "val").otherwise("train")
    return out.select("seed", "fold", "sample_id", split.alias("split"))


def attach_context(folds: DataFrame, sources: dict[str, DataFrame]) -> DataFrame:
    """Join covariate arrays of one or several sources into one ``context`` array.

    Each source has (seed, fold, sample_id, split, pcs).  A sample without
    covariates, listed under another split, or with a covariate that is missing
    or not finite, is an error.
    """
    keys = ["seed", "fold", "sample_id"]
    out, arrays = folds, []
    for i, (name, source) in enumerate(sources.items()):
        out = out.join(
            source.select(*keys, F.col("split").alias(f"_s{i}"), F.col("pcs").alias(f"_p{i}")),
            keys, "left",
        )
        arrays.append(
            F.when(F.col(f"_p{i}").isNull(), F.raise_error(F.concat(
                F.lit(f"{name}: no covariates for sample "), F.col("sample_id").cast("string"))))
            .when(F.col(f"_s{i}") != F.col("split"), F.raise_error(F.concat(
                F.lit(f"{name}: split differs for sample "), F.col("sample_id").cast("string"))))
            .when(F.exists(f"_p{i}", lambda x: ~is_finite(x)), F.raise_error(F.concat(
                F.lit(f"{name}: covariate not finite for sample "), F.col("sample_id").cast("string"))))
            .otherwise(F.col(f"_p{i}"))
        )
    return out.select(*keys, "split", F.concat(*arrays).alias("context"))


def context_problems(folds: DataFrame, source: DataFrame) -> DataFrame:
    """Samples of the folds without covariates, under another split, or with covariates that are not finite."""
    keys = ["seed", "fold", "sample_id"]
    bad = F.coalesce(F.exists("pcs", lambda x: ~is_finite(x)), F.lit(True))
    both = folds.join(source.select(*keys, F.col("split").alias("source_split"), bad.alias("_bad")), keys, "left")
    wrong = F.col("source_split").isNull() | (F.col("source_split") != F.col("split")) | F.col("_bad")
    return both.where(wrong).drop("_bad")


def pair_truth_prediction(
    truth: DataFrame, predicted: DataFrame, ids: DataFrame, keys: Sequence[str] = ("sample_id",)
) -> DataFrame:
    """Observed and predicted values of the evaluation samples with their errors, one row per ``keys``."""
    error = F.col("y_pred") - F.col("y_true")
    return (
        truth.join(predicted, list(keys))
        .join(ids.select("sample_id"), "sample_id", "left_semi")
        .select(*keys, "y_true", "y_pred", error.alias("residual"),
                F.abs(error).alias("abs_error"), (error * error).alias("sq_error"))
    )


def assemble_features(
    calls: DataFrame, marker_features: DataFrame, columns: Sequence[str], drop_density: bool = False
) -> DataFrame:
    """One feature row per (sample, marker); one loader leaves the density out."""
    kept = [c for c in columns if not (drop_density and c == "density")]
    return attach_measured(calls, marker_features.select("marker_idx", *kept), ["marker_idx"])


def assert_unique(df: DataFrame, keys: Sequence[str], what: str) -> None:
    require_empty(duplicates(df, keys), f"duplicate {what}")
