"""Regression metrics in original units and their roll-ups.

All moments are mergeable aggregates (Spark's central moments), so groups of
any size are reduced before the shuffle and no second pass is needed.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.codes import sigmoid
from ..plans.session import stable
from .checks import incomplete_grid, is_finite, require_empty

METRICS = ["pearson", "mse", "rmse", "mae", "r2", "sd_ratio"]
NAN = float("nan")


def _pearson(a: str, b: str) -> Column:
    va, vb = F.var_pop(a), F.var_pop(b)
    return F.when((va > 0) & (vb > 0), F.covar_pop(a, b) / F.sqrt(va * vb))


def regression_metrics(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """n, Pearson, MSE, RMSE, MAE, R2 and SD ratio per key.

    Undefined values are NaN, never 0.  A non-finite label or prediction is an
    error; rows are never dropped.
    """
    e = F.col("y_pred") - F.col("y_true")
    bad = F.count_if(~is_finite("y_true") | ~is_finite("y_pred"))
    n, mse = F.count(F.lit(1)), F.avg(e * e)
    vt, vp = F.var_pop("y_true"), F.var_pop("y_pred")
    checked = F.when(bad > 0, F.raise_error(F.lit("non-finite prediction or label"))).otherwise(n)
    return df.groupBy(*keys).agg(
        checked.cast("long").alias("n"),
        F.coalesce(_pearson("y_true", "y_pred"), F.lit(NAN)).alias("pearson"),
        mse.alias("mse"),
        F.sqrt(mse).alias("rmse"),
        F.avg(F.abs(e)).alias("mae"),
        F.when(vt > 0, 1 - mse / vt).otherwise(NAN).alias("r2"),
        F.when((vt > 0) & (n > 1), F.sqrt(vp / vt)).otherwise(NAN).alias("sd_ratio"),
    )


def extended_metrics(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Metrics after dropping incomplete pairs, with means and sample SDs."""
    pairs = df.dropna(subset=["y_true", "y_pred"]).where(~F.isnan("y_true") & ~F.isnan("y_pred"))
    spread = pairs.groupBy(*keys).agg(
        F.avg("y_pred").alias("pred_mean"), F.avg("y_true").alias("true_mean"),
        F.stddev_samp("y_pred").alias("pred_sd"), F.stddev_samp("y_true").alias("true_sd"),
        F.count(F.lit(1)).alias("n"),
        F.coalesce(_pearson("y_true", "y_pred"), F.lit(NAN)).alias("pearson"),
        F.avg((F.col("y_pred") - F.col("y_true")) ** 2).alias("mse"),
        F.avg(F.abs(F.col("y_pred") - F.col("y_true"))).alias("mae"),
        F.var_pop("y_true").alias("_v"),
    )
    return (
        spread.withColumn("rmse", F.sqrt("mse"))
        .withColumn("r2", F.when(F.col("_v") > 0, 1 - F.col("mse") / F.col("_v")).otherwise(NAN))
        .drop("_v")
    )


def _long(fold_metrics: DataFrame, keys: Sequence[str]) -> DataFrame:
    return fold_metrics.unpivot(list(keys), METRICS, "metric", "value")


def summarize_metrics(
    fold_metrics: DataFrame,
    keys: Sequence[str] = ("model", "trait"),
    seeds: Sequence[int] = (1, 2, 3),
    folds: Sequence[int] = (0, 1, 2, 3, 4),
    strict: bool = False,
) -> DataFrame:
    """Mean and sample SD per metric, overall and per seed.

    The seed x fold grid must be complete without repeats.  ``n`` counts all
    evaluations; mean and SD are over the defined values, unless ``strict``
    makes an undefined one an error.
    """
    keys, fold_metrics = list(keys), stable(fold_metrics)  # one row per evaluation, read twice
    require_empty(incomplete_grid(fold_metrics, keys, seeds, folds), "incomplete seed x fold table")
    long = _long(fold_metrics, [*keys, "seed", "fold"])
    undefined = F.raise_error(F.lit("undefined metric")).cast("double") if strict else F.lit(None).cast("double")
    defined = F.when(F.isnan("value"), undefined).otherwise(F.col("value"))
    grouped = [F.col(c) for c in [*keys, "metric", "seed"]]
    out = long.groupingSets([grouped, grouped[:-1]], *grouped).agg(
        F.grouping("seed").alias("_all"), F.count(F.lit(1)).alias("n"),
        F.avg(defined).alias("mean"), F.stddev_samp(defined).alias("sd"),
    )
    scope = F.when(F.col("_all") == 1, "overall").otherwise(F.concat(F.lit("seed"), F.col("seed").cast("string")))
    return out.select(*keys, scope.alias("scope"), "metric", "n", "mean", "sd")


def summarize_valid_counts(fold_metrics: DataFrame, keys: Sequence[str] = ("model", "trait")) -> DataFrame:
    """Mean and sample SD over the defined values, with total, valid and NaN counts."""
    keys = list(keys)
    long = _long(fold_metrics, [*keys, "seed", "fold"])
    valid = F.when(~F.isnan("value"), F.col("value"))
    grouped = [F.col(c) for c in [*keys, "metric", "seed"]]
    out = long.groupingSets([grouped, grouped[:-1]], *grouped).agg(
        F.grouping("seed").alias("_all"),
        F.count(F.lit(1)).alias("n_total"), F.count(valid).alias("n_valid"),
        F.count_if(F.isnan("value")).alias("n_nan"),
        F.avg(valid).alias("mean"), F.stddev_samp(valid).alias("sd"),
    )
    scope = F.when(F.col("_all") == 1, "overall").otherwise(F.concat(F.lit("seed"), F.col("seed").cast("string")))
    return out.select(*keys, scope.alias("scope"), "metric", "n_total", "n_valid", "n_nan", "mean", "sd")


def wide_fold_report(
    fold_metrics: DataFrame, traits: Sequence[str], metrics: Sequence[str] = ("pearson", "mse")
) -> DataFrame:
    """One table with fold rows, seed means and the mean of the seed means, traits side by side."""
    wide = fold_metrics.groupBy("model", "seed", "fold").agg(*[
        F.max(F.when(F.col("trait") == t, F.col(m))).alias(f"{m}_{t}") for t in traits for m in metrics
    ])
    names = [f"{m}_{t}" for t in traits for m in metrics]
    per_seed = wide.groupBy("model", "seed").agg(*[F.avg(c).alias(c) for c in names])
    overall = per_seed.groupBy("model").agg(*[F.avg(c).alias(c) for c in names])
    return (
        wide.select(F.lit("fold").alias("level"), "*")
        .unionByName(per_seed.select(F.lit("seed_mean").alias("level"), "*"), allowMissingColumns=True)
        .unionByName(overall.select(F.lit("all_mean").alias("level"), "*"), allowMissingColumns=True)
    )


def seed_overall_summary(
    fold_metrics: DataFrame, per_seed: int, seeds: int, keys: Sequence[str] = ("model", "trait")
) -> DataFrame:
    """Long summary per seed and over all seeds; a wrong number of rows is an error."""
    long = _long(fold_metrics, [*keys, "seed", "fold"])
    grouped = [F.col(c) for c in [*keys, "metric", "seed"]]
    out = long.groupingSets([grouped, grouped[:-1]], *grouped).agg(
        F.grouping("seed").alias("_all"), F.count(F.lit(1)).alias("n"),
        F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"),
    )
    wanted = F.when(F.col("_all") == 1, per_seed * seeds).otherwise(per_seed)
    n = F.when(F.col("n") != wanted, F.raise_error(F.lit("wrong number of evaluations"))).otherwise(F.col("n"))
    scope = F.when(F.col("_all") == 1, "all").otherwise(F.col("seed").cast("string"))
    return out.select(*keys, scope.alias("seed"), "metric", n.cast("long").alias("n"), "mean", "sd")


def concat_metrics(tables: Sequence[DataFrame]) -> DataFrame:
    """Stack metric tables; columns missing in one are NULL there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def trait_correlation_matrix(df: DataFrame, traits: Sequence[str], train: Column) -> DataFrame:
    """Trait x trait correlation on training rows; a constant trait correlates 0."""
    def sd(t):
        s = F.stddev_samp(t)
        return F.when(s < 1e-6, F.lit(1.0)).otherwise(s)

    rows = []
    for a in traits:
        for b in traits:
            r = F.covar_samp(a, b) / (sd(a) * sd(b))
            r = F.coalesce(F.nanvl(r, F.lit(0.0)), F.lit(0.0))
            rows.append(F.struct(F.lit(a).alias("trait_a"), F.lit(b).alias("trait_b"),
                                 F.greatest(F.lit(-1.0), F.least(F.lit(1.0), r)).alias("r")))
    return df.where(train).agg(F.array(*rows).alias("_a")).select(F.inline("_a"))


def epoch_score(
    df: DataFrame, keys: Sequence[str], binary: Sequence[str] = ()
) -> tuple[DataFrame, DataFrame]:
    """Per key and trait the clamped correlation, 0 where it is undefined, and per
    key the mean over the defined traits only (0 if there is none).

    Predictions of binary traits pass through the logistic link first.
    """
    p = F.when(F.col("trait").isin(list(binary)), sigmoid("y_pred")).otherwise(F.col("y_pred"))
    linked = df.withColumn("y_pred", p)
    n = F.count(F.lit(1))
    large = (F.sqrt(F.var_pop("y_true") * n) > 1e-9) & (F.sqrt(F.var_pop("y_pred") * n) > 1e-9)
    r = _pearson("y_true", "y_pred")
    per = linked.groupBy(*keys, "trait").agg(
        large.alias("valid"),
        F.coalesce(F.when(large, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), r))), F.lit(0.0)).alias("score"),
    )
    mean = per.groupBy(*keys).agg(
        F.coalesce(F.avg(F.when(F.col("valid"), F.col("score"))), F.lit(0.0)).alias("score"),
        F.count_if("valid").alias("n_valid"),
    )
    return per, mean


def evaluation_losses(df: DataFrame, factor: float = 1.0) -> DataFrame:
    """MSE, log-cosh and correlation loss, as mean and as worst trait.

    A constant column counts as uncorrelated; a single row has no correlation loss.
    """
    d = F.col("y_pred") - F.col("y_true")
    big = F.abs(d)
    log_cosh = F.when(big < 20, F.ln(F.cosh(d) + 1e-12)).otherwise(big - F.ln(F.lit(2.0)))
    n = F.count(F.lit(1))
    large = (F.sqrt(F.var_pop("y_true") * n) >= 1e-9) & (F.sqrt(F.var_pop("y_pred") * n) >= 1e-9)
    r = F.when(large, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), _pearson("y_true", "y_pred"))))
    gap = F.when(n > 1, (1.0 - F.coalesce(r, F.lit(0.0))) / factor).otherwise(0.0)
    per = df.groupBy("trait").agg(
        n.alias("n"), F.sum(d * d).alias("s"), F.avg(d * d).alias("mse"),
        F.sum(log_cosh).alias("lc"), (gap * gap).alias("corr_loss"),
    )
    return per.agg(
        (F.sum("s") / F.sum("n")).alias("mse_mean"), F.max("mse").alias("mse_minimax"),
        (F.sum("lc") / F.sum("n")).alias("log_cosh"),
        F.avg("corr_loss").alias("corr_mean"), F.max("corr_loss").alias("corr_minimax"),
    )


def strict_reread_audit(
    predictions: DataFrame, stored: DataFrame, keys: Sequence[str], tolerance: float = 1e-9
) -> DataFrame:
    """Metrics recomputed from predictions against stored ones: differences above
    the tolerance, or keys on one side only."""
    fresh = regression_metrics(predictions, keys)
    old = stored.select(*keys, *[F.col(m).alias(f"_{m}") for m in METRICS], F.lit(True).alias("_old"))
    both = fresh.withColumn("_new", F.lit(True)).join(old, list(keys), "full")

    def gap(m):
        same_nan = F.isnan(m) & F.isnan(f"_{m}")
        return F.when(same_nan, 0.0).otherwise(F.abs(F.col(m) - F.col(f"_{m}")))

    worst = F.greatest(*[gap(m) for m in METRICS])
    one_sided = F.col("_old").isNull() | F.col("_new").isNull()
    return both.select(*keys, one_sided.alias("one_sided"), worst.alias("max_diff")).where(
        one_sided | ~(F.col("max_diff") <= tolerance)
    )
