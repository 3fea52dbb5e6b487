"""Per-marker aggregation, audits and imputation.

Everything is built from counts and sums, so partial aggregates are merged
before the shuffle and a marker called in every sample is one small row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.codes import CHANNELS
from ..plans.joins import attach_measured
from ..plans.scan import exact_quantiles
from ..plans.session import stable
from .checks import CheckFailed

MAF_TOLERANCE = 0.02
MAF_MEDIAN_LIMIT = 0.01
MAF_SHARE_LIMIT = 0.90


def marker_allele_freq(calls: DataFrame) -> DataFrame:
    """Calls, call rate, frequency of the counted allele and minor frequency."""
    n, total = F.count("dosage"), F.count(F.lit(1))
    counted = calls.groupBy("marker_idx").agg(
        total.alias("n_total"), n.alias("n_called"), F.sum("dosage").alias("dosage_sum")
    )
    p = F.when(F.col("n_called") > 0, F.col("dosage_sum") / (2.0 * F.col("n_called")))
    return counted.select(
        "marker_idx", "n_called", (F.col("n_called") / F.col("n_total")).alias("call_rate"),
        p.alias("p"), F.least(p, 1.0 - p).alias("maf"),
    )


def maf_audit(freq: DataFrame, published: DataFrame) -> DataFrame:
    """Error of the minor frequency against a published one, and of the counted allele.

    ``published`` is (marker_idx, maf_ref).  ``passes`` combines both gates.
    """
    both = freq.join(published, "marker_idx").where(F.col("p").isNotNull() & F.col("maf_ref").isNotNull())
    both = stable(both.select(F.abs(F.col("maf") - F.col("maf_ref")).alias("err")))
    spread = exact_quantiles(both, [], "err", {"median_err": 0.5, "p95_err": 0.95})
    close = F.col("err") <= MAF_TOLERANCE
    found = spread.first()
    shares = both.agg(F.count(F.lit(1)).alias("n_markers"), F.avg(close.cast("double")).alias("within"))
    return shares.select(
        "n_markers",
        F.lit(found["median_err"] if found else None).cast("double").alias("median_err"),
        F.lit(found["p95_err"] if found else None).cast("double").alias("p95_err"),
        "within",
    ).withColumn(
        "passes",
        ~((F.col("median_err") > MAF_MEDIAN_LIMIT) | (F.col("within") < MAF_SHARE_LIMIT)),
    )


def orientation_audit(freq: DataFrame, published: DataFrame) -> DataFrame:
    """Share of markers whose counted allele matches the published frequency."""
    both = freq.join(published, "marker_idx").where(F.col("p").isNotNull() & F.col("maf_ref").isNotNull())
    close = F.abs(F.col("p") - F.col("maf_ref")) <= MAF_TOLERANCE
    return both.agg(
        F.count(F.lit(1)).alias("n_markers"), F.avg(close.cast("double")).alias("direct_rate")
    ).withColumn("passes", F.col("direct_rate") >= MAF_SHARE_LIMIT)


def call_code_counts(codes: DataFrame, code: str = "code") -> DataFrame:
    return codes.groupBy(code).agg(F.count(F.lit(1)).alias("n"))


def channel_counts(encoded: DataFrame, channel: str = "channel") -> DataFrame:
    """Calls per channel; all ten channels are listed, also the empty ones."""
    stats = encoded.agg(*[
        F.count_if(F.col(channel) == i).alias(str(i)) for i in range(len(CHANNELS))
    ])
    long = stats.unpivot([], [str(i) for i in range(len(CHANNELS))], "channel", "n")
    return long.select(F.col("channel").cast("int").alias("channel"), "n")


def marker_fill(encoded: DataFrame, method: str = "mode") -> DataFrame:
    """Fill missing channels with the marker's mode (lowest on a tie) or rounded mean.

    A marker without any call keeps its missing calls.
    """
    if method == "mode":
        counts = encoded.where("channel IS NOT NULL").groupBy("marker_idx", "channel").agg(
            F.count(F.lit(1)).alias("n")
        )
        best = F.max_by("channel", F.struct("n", -F.col("channel")))
        fills = counts.groupBy("marker_idx").agg(best.alias("fill"))
    elif method == "mean":
        mean = F.bround(F.avg("channel"), 0).cast("int")
        fills = encoded.groupBy("marker_idx").agg(F.least(F.lit(9), F.greatest(F.lit(0), mean)).alias("fill"))
    else:
        raise ValueError(f"unknown fill method {method!r}")
    out = attach_measured(encoded, fills, ["marker_idx"], "left")
    return out.select(
        *encoded.columns, F.coalesce("channel", "fill").cast("int").alias("filled")
    )


def train_marker_stats(calls: DataFrame, val_folds: DataFrame, n_folds: int) -> DataFrame:
    """Training counts per (seed, fold, marker): n, n0, n1, n2, mean, sd, median.

    Calls are counted once per validation fold; the training counts of a fold
    are the sums over the other folds, taken on the counts and not on the calls.
    Evaluation rows therefore never enter.
    """
    at = [F.count_if(F.col("dosage") == d).alias(f"n{d}") for d in (0, 1, 2)]
    parts = calls.join(val_folds, "sample_id").groupBy("seed", "val_fold", "marker_idx").agg(*at)
    spread = parts.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(n_folds - 1))))
    trains = F.col("fold") != F.col("val_fold")
    sums = spread.groupBy("seed", "fold", "marker_idx").agg(
        *[F.sum(F.when(trains, F.col(f"n{d}")).otherwise(0)).alias(f"n{d}") for d in (0, 1, 2)]
    )
    return with_dosage_stats(sums)


def with_dosage_stats(counts: DataFrame) -> DataFrame:
    """n, mean, population SD and median from the three dosage counts."""
    n = F.col("n0") + F.col("n1") + F.col("n2")
    low, high = F.floor((F.col("n") - 1) / 2), F.ceil((F.col("n") - 1) / 2)

    def at(rank: Column) -> Column:
        return (
            F.when(rank < F.col("n0"), 0.0)
            .when(rank < F.col("n0") + F.col("n1"), 1.0)
            .otherwise(2.0)
        )

    mean = (F.col("n1") + 2 * F.col("n2")) / F.col("n")
    square = (F.col("n1") + 4 * F.col("n2")) / F.col("n")
    one_level = (
        (F.col("n0") == F.col("n")) | (F.col("n1") == F.col("n")) | (F.col("n2") == F.col("n"))
    )
    out = counts.withColumn("n", n)
    called = F.col("n") > 0
    return (
        out.withColumn("mean", F.when(called, mean))
        .withColumn("sd", F.when(called & one_level, 0.0).when(
            called, F.sqrt(F.greatest(square - F.col("mean") * F.col("mean"), F.lit(0.0)))))
        .withColumn("median", F.when(called, (at(low) + at(high)) / 2))
    )


def impute_train(
    calls: DataFrame, val_folds: DataFrame, stats: DataFrame, method: str
) -> DataFrame:
    """Fill missing calls of training and evaluation samples from training rows.

    One row per call and fold of ``stats``: for a model of one or a few folds.
    Over all folds use ``imputed_values``, which does not grow with the samples.
    """
    fill = _fill(method)
    fold_stats = stats.select("seed", "fold", "marker_idx", "mean", "median")
    out = attach_measured(calls.join(val_folds, "sample_id"), fold_stats, ["seed", "marker_idx"])
    split = F.when(F.col("fold") == F.col("val_fold"), "val").otherwise("train")
    return out.select(
        "seed", "fold", "sample_id", "marker_idx", split.alias("split"),
        F.coalesce(F.col("dosage").cast("double"), fill).alias("x"),
    )


def fold_values(stats: DataFrame, value: Column, name: str) -> DataFrame:
    """(seed, fold, marker_idx, dosage, ``name``): what each dosage, NULL too, becomes in a training fold.

    Four rows per marker and fold, however many samples there are; ``value`` may
    use the statistics and ``dosage``.
    """
    spread = stats.withColumn("dosage", F.explode(F.array(*[F.lit(d).cast("int") for d in (0, 1, 2, None)])))
    return spread.select("seed", "fold", "marker_idx", "dosage", value.alias(name))


def imputed_values(stats: DataFrame, method: str) -> DataFrame:
    """``fold_values`` of an imputation with training rows only.

    ``median``: a marker without training calls is filled with 0.  ``mean``:
    such a marker is an error.
    """
    fill = _fill(method)
    return fold_values(stats, F.coalesce(F.col("dosage").cast("double"), fill), "x")


def _fill(method: str) -> Column:
    if method == "median":
        return F.coalesce("median", F.lit(0.0))
    if method == "mean":
        missing = F.concat(F.lit("no training call for marker "), F.col("marker_idx").cast("string"))
        return F.when(F.col("mean").isNull(), F.raise_error(missing).cast("double")).otherwise(F.col("mean"))
    raise ValueError(f"unknown imputation {method!r}")


def split_sums(calls: DataFrame, val_folds: DataFrame, values: DataFrame, name: str, n_folds: int) -> DataFrame:
    """(seed, fold, split, marker_idx, n, total, squares) of ``values`` over all calls.

    Calls are counted once per seed, validation fold, marker and dosage; the
    folds are told apart on these counts, so no call is copied.
    """
    keys = ["seed", "val_fold", "marker_idx", "dosage"]
    counted = calls.join(val_folds, "sample_id").groupBy(*keys).agg(F.count(F.lit(1)).alias("c"))
    spread = counted.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(n_folds - 1)))).withColumn(
        "_d", F.coalesce("dosage", F.lit(-1)))
    keyed = values.select("seed", "fold", "marker_idx", F.coalesce("dosage", F.lit(-1)).alias("_d"), name)
    split = F.when(F.col("fold") == F.col("val_fold"), "val").otherwise("train").alias("split")
    out = attach_measured(spread, keyed, ["seed", "fold", "marker_idx", "_d"])
    return out.groupBy("seed", "fold", split, "marker_idx").agg(
        F.sum("c").alias("n"), F.sum(F.col("c") * F.col(name)).alias("total"),
        F.sum(F.col("c") * F.col(name) * F.col(name)).alias("squares"))


def call_information_weight(codes: DataFrame, code: str = "code") -> DataFrame:
    """-ln(share of the code within its marker) for every code a marker has.

    The result has one row per marker and code; ``weighted_calls`` brings it
    to the calls.
    """
    counts = codes.groupBy("marker_idx", code).agg(F.count(F.lit(1)).alias("n"))
    totals = counts.groupBy("marker_idx").agg(F.sum("n").alias("n_marker"))
    return counts.join(totals, "marker_idx").select(
        "marker_idx", code, "n", (F.abs(F.ln(F.col("n") / F.col("n_marker")))).alias("weight")
    )


def weighted_calls(codes: DataFrame, weights: DataFrame, code: str = "code") -> DataFrame:
    return attach_measured(codes, weights.select("marker_idx", code, "weight"), ["marker_idx", code])


def genotype_value_stats(weights: DataFrame) -> DataFrame:
    """Range, mean and population SD of the call weights over all calls, with a
    block for the positive ones, in one pass over the counted weights."""
    w, n = F.col("weight"), F.col("n")
    blocks = []
    for label, kept in (("all", F.lit(True)), ("non_zero", w > 0)):
        count = F.sum(F.when(kept, n))
        mean = F.sum(F.when(kept, w * n)) / count
        square = F.sum(F.when(kept, w * w * n)) / count
        blocks.append(F.struct(
            F.lit(label).alias("block"), count.alias("count"), F.min(F.when(kept, w)).alias("min"),
            F.max(F.when(kept, w)).alias("max"), mean.alias("mean"),
            F.sqrt(F.greatest(square - mean * mean, F.lit(0.0))).alias("sd"),
        ))
    return weights.agg(F.array(*blocks).alias("_b")).select(F.inline("_b"))


def require_audit(audit: DataFrame, message: str) -> None:
    if not audit.select(F.coalesce("passes", F.lit(False))).first()[0]:
        raise CheckFailed(message)


def marker_order(markers: DataFrame, keys: Sequence[str] = ("chrom", "pos", "marker_idx")) -> DataFrame:
    """Global marker order; the sort is range-partitioned."""
    return markers.orderBy(*keys)


def fold_leak_check(calls: DataFrame, val_folds: DataFrame, n_folds: int) -> DataFrame:
    """Training statistics that move when the evaluation rows of a fold are altered.

    The counts of ``train_marker_stats`` are compared with counts taken from the
    training rows of calls whose evaluation dosages were flipped, for all folds
    in one pass; ``n_changed`` must be 0.
    """
    levels = (0, 1, 2)
    base = train_marker_stats(calls, val_folds, n_folds).select("seed", "fold", "marker_idx", "n0", "n1", "n2")
    folds = []
    for fold in range(n_folds):
        held = F.col("val_fold") == fold
        dosage = F.when(held, 2 - F.coalesce("dosage", F.lit(0))).otherwise(F.col("dosage"))
        folds.append(F.struct(F.lit(fold).alias("fold"), *[
            F.sum(F.when(~held & (dosage == d), 1).otherwise(0)).alias(f"m{d}") for d in levels]))
    altered = calls.join(val_folds, "sample_id").groupBy("seed", "marker_idx").agg(F.array(*folds).alias("_f"))
    both = base.join(altered.select("seed", "marker_idx", F.inline("_f")), ["seed", "fold", "marker_idx"], "full")
    same = F.lit(True)
    for d in levels:
        same = same & F.col(f"n{d}").eqNullSafe(F.col(f"m{d}"))
    return both.groupBy("seed", "fold").agg(
        F.count(F.lit(1)).alias("n_stats"), F.count_if(~same).alias("n_changed"))
