"""Profiles of numeric feature columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.scan import exact_quantiles

PERCENTILES = [0, 1, 5, 25, 50, 75, 95, 99, 100]
SKEW_LIMIT = 2
CONSTANT_SD = 1e-8


def feature_dim_stats(df: DataFrame, dims: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Min, max, mean, population SD and non-zero count per column (and key).

    One pass computes all columns; only the single result row per key is unpivoted.
    """
    aggs = []
    for d in dims:
        aggs.append(F.struct(
            F.lit(d).alias("dim"), F.count(d).alias("n"), F.min(d).cast("double").alias("min"),
            F.max(d).cast("double").alias("max"), F.avg(d).alias("mean"),
            F.stddev_pop(d).alias("sd"), F.count_if(F.col(d) != 0).alias("n_nonzero"),
        ))
    wide = df.groupBy(*keys).agg(F.array(*aggs).alias("_a"))
    return wide.select(*keys, F.inline("_a"))


def feature_correlations(df: DataFrame, dims: Sequence[str]) -> DataFrame:
    """Pearson correlation of every pair of non-constant columns, in one pass."""
    pairs = [(a, b) for i, a in enumerate(dims) for b in dims[i + 1:]]
    rows = [
        F.struct(
            F.lit(a).alias("dim_a"), F.lit(b).alias("dim_b"),
            F.covar_pop(a, b).alias("cov"), F.stddev_pop(a).alias("sa"), F.stddev_pop(b).alias("sb"),
        ) for a, b in pairs
    ]
    long = df.agg(F.array(*rows).alias("_a")).select(F.inline("_a"))
    valid = (F.col("sa") > CONSTANT_SD) & (F.col("sb") > CONSTANT_SD)
    return long.where(valid).select("dim_a", "dim_b", (F.col("cov") / (F.col("sa") * F.col("sb"))).alias("r"))


def correlation_summary(df: DataFrame, dims: Sequence[str]) -> DataFrame:
    """Range, mean and absolute mean of the correlations with the constant columns listed."""
    pairs = feature_correlations(df, dims).agg(
        F.min("r").alias("min"), F.max("r").alias("max"), F.avg("r").alias("mean"),
        F.avg(F.abs("r")).alias("abs_mean"),
    )
    spread = feature_dim_stats(df, dims).where(F.col("sd") <= CONSTANT_SD)
    constant = spread.agg(
        F.concat_ws(",", F.array_sort(F.collect_list("dim"))).alias("invalid_dims"),
        F.count(F.lit(1)).alias("invalid_dims_count"),
    )
    found = constant.first()  # one row: the number of columns is fixed
    return pairs.select(
        "*", F.lit(len(dims) - found["invalid_dims_count"]).alias("valid_dims_count"),
        F.lit(found["invalid_dims_count"]).alias("invalid_dims_count"),
        F.lit(found["invalid_dims"]).alias("invalid_dims"),
    )


def distribution_profile(df: DataFrame, value: str, keys: Sequence[str] = ()) -> DataFrame:
    """Positive share, exact percentiles, mean, median, SD, skew and advice."""
    keys = list(keys)
    x = F.col(value)
    wanted = {f"p{p}": p / 100 for p in PERCENTILES}
    spread = exact_quantiles(df.where(x > 0), keys, value, wanted).drop("n")
    positive = F.when(x > 0, x)
    moments = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(x > 0).alias("n_positive"),
        F.avg(positive).alias("mean"), F.stddev_pop(positive).alias("sd"),
    )
    if keys:
        out = moments.join(spread, keys, "left")
    else:
        row = spread.first()
        out = moments.select("*", *[F.lit(row[c] if row else None).cast("double").alias(c) for c in spread.columns])
    skew = F.when(F.col("sd") > 0, 3 * (F.col("mean") - F.col("p50")) / F.col("sd"))
    advice = (
        F.when(F.col("skew") > SKEW_LIMIT, "log").when(F.col("skew") < -SKEW_LIMIT, "sqrt").otherwise("none")
    )
    return (
        out.withColumn("positive_share", F.col("n_positive") / F.col("n"))
        .withColumn("median", F.col("p50")).withColumn("skew", skew).withColumn("advice", advice)
    )
