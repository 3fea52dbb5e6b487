"""Column scaling operators.  Statistics are one aggregate row per group; rows
are never gathered, and quantiles come from the exact distributed selection."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.joins import attach_measured
from ..plans.scan import exact_quantiles, prefix_scan, with_row_number
from ..plans.session import stable

EPS = 1e-10


def attach(df: DataFrame, stats: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Join per-key statistics; without keys the single row is attached to every row."""
    if keys:
        return attach_measured(df, stats, keys)
    row = stats.first()
    return df.select("*", *[
        F.lit(row[name]).cast(stats.schema[name].dataType).alias(name) for name in stats.columns
    ])


def _unit(x: Column, low: Column, high: Column) -> Column:
    span = high - low
    return F.when(span < EPS, F.lit(0.0)).otherwise((x - low) / (span + EPS))


def _moments(df: DataFrame, value: str, keys: Sequence[str]) -> DataFrame:
    """Everything the monotone scalings need, in one pass."""
    x = F.col(value)
    return df.groupBy(*keys).agg(
        F.min(F.when(x > 0, x)).alias("_least"), F.max(F.when(x > 0, x)).alias("_top"),
        F.avg(F.when(x > 0, x)).alias("_mean"), F.min(x).alias("_lo"), F.max(x).alias("_hi"),
    )


_MOMENTS = ["_least", "_top", "_mean", "_lo", "_hi"]


def _positive_unit(value: str, form) -> Column:
    """Min-max of ``form(x)`` for x > 0 and 0 elsewhere.

    ``form`` rises with x, so the ends of the result follow from the smallest
    and largest positive value and no second pass over the rows is needed.
    """
    x, zero = F.col(value), F.lit(0.0)
    some_zero = F.col("_lo") <= 0
    low = F.when(F.col("_least").isNull(), zero).when(
        some_zero, F.least(zero, form(F.col("_least")))).otherwise(form(F.col("_least")))
    high = F.when(F.col("_top").isNull(), zero).when(
        some_zero, F.greatest(zero, form(F.col("_top")))).otherwise(form(F.col("_top")))
    return _unit(F.when(x > 0, form(x)).otherwise(zero), low, high)


def _log_form(x: Column) -> Column:
    return F.ln(x + F.col("_least") / 10)


def minmax(df: DataFrame, value: str, keys: Sequence[str] = (), name: str = "scaled") -> DataFrame:
    """(x - min) / (max - min + 1e-10); a range below 1e-10 gives 0."""
    stats = df.groupBy(*keys).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    out = attach(df, stats, keys)
    return out.withColumn(name, _unit(F.col(value), F.col("_lo"), F.col("_hi"))).drop("_lo", "_hi")


def log_scale(df: DataFrame, value: str, keys: Sequence[str] = (), name: str = "scaled") -> DataFrame:
    """ln(x + smallest positive / 10) for x > 0, else 0; then min-max."""
    out = attach(df, _moments(df, value, keys), keys)
    return out.withColumn(name, _positive_unit(value, _log_form)).drop(*_MOMENTS)


def power_scale(
    df: DataFrame, value: str, power: float = 0.5, keys: Sequence[str] = (), name: str = "scaled"
) -> DataFrame:
    """x ** power for x > 0, else 0; then min-max.  The power must be positive."""
    if power <= 0:
        raise ValueError("power must be positive")
    out = attach(df, _moments(df, value, keys), keys)
    return out.withColumn(
        name, _positive_unit(value, lambda x: F.pow(x, F.lit(power)))).drop(*_MOMENTS)


def adaptive_scale(
    df: DataFrame, value: str, keys: Sequence[str] = (), name: str = "scaled"
) -> DataFrame:
    """Log for a strong right skew, square root for a moderate one, else linear.

    Strong: mean > 2 * median of the positive values; moderate: max > 5 * median.
    Without a positive value everything is 0.
    """
    x = F.col(value)
    keys = list(keys)
    medians = exact_quantiles(df.where(x > 0), keys, value, {"_median": 0.5}).drop("n")
    moments = _moments(df, value, keys)
    if keys:
        stats = moments.join(medians, keys, "left")
    else:
        found = medians.first()
        stats = moments.withColumn("_median", F.lit(found["_median"] if found else None).cast("double"))
    out = attach(df, stats, keys)
    middle = F.col("_median")
    scaled = (
        F.when(middle.isNull(), F.lit(0.0))
        .when(F.col("_mean") > 2 * middle, _positive_unit(value, _log_form))
        .when(F.col("_top") > 5 * middle, _positive_unit(value, F.sqrt))
        .otherwise(_unit(x, F.col("_lo"), F.col("_hi")))
    )
    return out.withColumn(name, scaled).drop(*_MOMENTS, "_median")


# Published rational approximation of the inverse normal CDF
# (P. J. Acklam), relative error below 1.15e-9.
_A = [-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02,
      1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00]
_B = [-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02,
      6.680131188771972e01, -1.328068155288572e01]
_C = [-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00,
      -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00]
_D = [7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00,
      3.754408661907416e00]
_TAIL = 0.02425
_CLIP = 1e-7


def _poly(coefficients: Sequence[float], x: Column) -> Column:
    out = F.lit(coefficients[0])
    for c in coefficients[1:]:
        out = out * x + F.lit(c)
    return out


def inverse_normal(p: Column) -> Column:
    q = p - 0.5
    middle = _poly(_A, q * q) * q / _poly([*_B, 1.0], q * q)
    low = F.sqrt(-2 * F.ln(p))
    high = F.sqrt(-2 * F.ln(1 - p))
    return (
        F.when(p < _TAIL, _poly(_C, low) / _poly([*_D, 1.0], low))
        .when(p > 1 - _TAIL, -_poly(_C, high) / _poly([*_D, 1.0], high))
        .otherwise(middle)
    )


def quantile_normal(df: DataFrame, value: str, name: str = "scaled") -> DataFrame:
    """Rank to normal scores, then min-max.

    Where more than half of the values are zero only the others are moved and
    zeros stay 0.  Equal values share the middle of their rank range.
    """
    x = F.col(value)
    zero_share = df.agg(F.avg((x == 0).cast("double")).alias("s")).first()["s"]
    moving = (x != 0) if (zero_share or 0.0) > 0.5 else x.isNotNull()
    counted = df.where(moving).groupBy(value).agg(F.count(F.lit(1)).alias("_n"))
    ranks = stable(prefix_scan(counted, [], [value], {"_cum": ("sum", F.col("_n"), True)}))
    total = ranks.agg(F.max("_cum")).first()[0] or 0
    middle = (F.col("_cum") - F.col("_n") + F.col("_cum") - 1) / 2
    share = middle / F.lit(float(max(total - 1, 1)))
    clipped = F.least(F.lit(1 - _CLIP), F.greatest(F.lit(_CLIP), share))
    scored = ranks.select(value, inverse_normal(clipped).alias("_z"))
    ends = scored.agg(F.min("_z").alias("lo"), F.max("_z").alias("hi")).first()
    low, span = ends["lo"] or 0.0, (ends["hi"] or 0.0) - (ends["lo"] or 0.0)
    unit = (F.col("_z") - F.lit(low)) / F.lit(span) if span > 0 else F.col("_z")
    scored = scored.select(value, unit.alias(name))
    return attach_measured(df, scored, [value], "left").fillna(0.0, [name])


def zscore(
    df: DataFrame, value: str, train: Column, keys: Sequence[str] = (), name: str = "scaled"
) -> DataFrame:
    """Standardise by training mean and population SD; SD <= 1e-8 counts as 1."""
    x = F.col(value)
    stats = df.groupBy(*keys).agg(
        F.avg(F.when(train, x)).alias("mean"), F.stddev_pop(F.when(train, x)).alias("sd")
    ).withColumn("sd", F.when(F.col("sd") <= 1e-8, F.lit(1.0)).otherwise(F.col("sd")))
    return attach(df, stats, keys).withColumn(name, (x - F.col("mean")) / F.col("sd"))


def unzscore(scaled: str | Column, mean: str | Column, sd: str | Column) -> Column:
    """Back to original units."""
    columns = [F.col(c) if isinstance(c, str) else c for c in (scaled, mean, sd)]
    return columns[0] * columns[2] + columns[1]


def phenotype_minmax(df: DataFrame, value: str, keys: Sequence[str], name: str = "scaled") -> DataFrame:
    """Min-max by trait; a range of at most 1e-8 counts as 1."""
    stats = df.groupBy(*keys).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    span = F.col("_hi") - F.col("_lo")
    unit = (F.col(value) - F.col("_lo")) / F.when(span <= 1e-8, F.lit(1.0)).otherwise(span)
    return attach(df, stats, keys).withColumn(name, unit).drop("_lo", "_hi")


def mixed_trait_scale(
    df: DataFrame, value: str, trait: str, train: Column, binary: Sequence[str], name: str = "scaled",
    keys: Sequence[str] = (),
) -> DataFrame:
    """Binary traits stay 0/1 (anything else is an error), others are z-scored on training rows."""
    x, is_binary = F.col(value), F.col(trait).isin(list(binary))
    out = zscore(df, value, train, [*keys, trait], "_z")
    kept = F.when(x.isin(0.0, 1.0) | x.isNull(), x.cast("double")).otherwise(
        F.raise_error(F.concat(F.lit("binary trait holds other values: "), F.col(trait)))
    )
    return out.withColumn(name, F.when(is_binary, kept).otherwise(F.col("_z"))).drop("_z", "mean", "sd")


def scale_audit(df: DataFrame, trait: str, scaled: str, train: Column, keys: Sequence[str] = ()) -> DataFrame:
    """Training mean and SD after scaling (about 0 and 1 for z-scored traits)."""
    x = F.when(train, F.col(scaled))
    return df.groupBy(*keys, trait).agg(F.avg(x).alias("mean"), F.stddev_pop(x).alias("sd"))


def chrom_scaled_position(
    df: DataFrame,
    chrom: str = "chrom",
    per_chrom: Sequence[str] = ("pos", "center"),
    overall: Sequence[str] = ("length", "density"),
    method: str = "sine",
) -> DataFrame:
    """Position columns scaled within a chromosome, others over all markers.

    ``sine``: sin(2 pi * min-max), a range below 1 counts as 1; ``zscore``:
    population z-score, left as it is where the SD is at most 1e-8.
    """
    per, over = [], []
    for c in per_chrom:
        per += [F.min(c).alias(f"_lo_{c}"), F.max(c).alias(f"_hi_{c}"),
                F.avg(c).alias(f"_mu_{c}"), F.stddev_pop(c).alias(f"_sd_{c}")]
    for c in overall:
        over += [F.avg(c).alias(f"_mu_{c}"), F.stddev_pop(c).alias(f"_sd_{c}")]
    out = attach(df, df.groupBy(chrom).agg(*per), [chrom])
    out = attach(out, df.agg(*over), [])

    def z(c):
        return F.when(
            F.col(f"_sd_{c}") > 1e-8, (F.col(c) - F.col(f"_mu_{c}")) / F.col(f"_sd_{c}")
        ).otherwise(F.col(c).cast("double"))

    def sine(c):
        span = F.greatest(F.col(f"_hi_{c}") - F.col(f"_lo_{c}"), F.lit(1.0))
        return F.sin((F.col(c) - F.col(f"_lo_{c}")) / span * (2 * F.pi()))

    scaled = [(sine if method == "sine" else z)(c).alias(f"{c}_scaled") for c in per_chrom]
    scaled += [z(c).alias(f"{c}_scaled") for c in overall]
    return out.select(*df.columns, *scaled)


def rank_order(df: DataFrame, order: Sequence[str], name: str = "ord") -> DataFrame:
    """0-based global position in ``order``."""
    return with_row_number(df, [], order, "_rn").withColumn(name, F.col("_rn") - 1).drop("_rn")
