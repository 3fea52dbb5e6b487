"""Sample splits.  Random orders are hashes of the sample ID, so a split is a
function of the ID and seed alone and survives recomputation."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.scan import exact_quantiles, with_row_number
from .checks import CheckFailed


def hashed(seed: int | str | Column, key: str = "sample_id") -> list[Column]:
    """Default order: a hash of ID and seed, with the ID as tie-break."""
    seed_col = seed if isinstance(seed, Column) else F.lit(seed)
    return [F.xxhash64(F.col(key), seed_col), F.col(key)]


def median_bin(df: DataFrame, value: str, name: str) -> DataFrame:
    """0 up to the interpolated median, 1 above.

    A median equal to the smallest or largest value leaves no second quantile
    edge, which is an error.
    """
    found = exact_quantiles(df, [], value, {"low": 0.0, "m": 0.5, "top": 1.0}).first()
    if found["m"] is None or not found["low"] < found["m"] < found["top"]:
        raise CheckFailed(f"{value} cannot be cut into two quantile groups")
    middle = found["m"]
    return df.withColumn(
        name, F.when(F.col(value) <= middle, 0).when(F.col(value) > middle, 1))


def joint_strata(df: DataFrame, first: str, second: str, name: str = "stratum") -> DataFrame:
    return df.withColumn(name, F.concat_ws("_", F.col(first).cast("string"), F.col(second).cast("string")))


def strata_counts(df: DataFrame, stratum: str = "stratum") -> DataFrame:
    return df.groupBy(stratum).agg(F.count(F.lit(1)).alias("n"))


def holdout_sizes(counts: dict[str, int], share: float) -> dict[str, int] | None:
    """Test rows per stratum: the training total is dealt by largest remainder.

    ``None`` where stratifying is impossible (a stratum with a single row, or
    fewer test rows than strata).
    """
    n = sum(counts.values())
    n_test = math.ceil(share * n)
    n_train = n - n_test
    if min(counts.values(), default=0) < 2 or min(n_test, n_train) < len(counts):
        return None
    exact = {k: c * n_train / n for k, c in counts.items()}
    train = {k: math.floor(v) for k, v in exact.items()}
    left = n_train - sum(train.values())
    for k in sorted(counts, key=lambda k: (train[k] - exact[k], k))[:left]:
        train[k] += 1
    return {k: counts[k] - train[k] for k in counts}


def stratified_holdout(
    df: DataFrame, stratum: str, share: float = 0.15, order: Sequence[str | Column] | None = None,
    seed: int = 42,
) -> DataFrame:
    """Adds ``split`` (trainval / test) with the test share per stratum.

    Falls back to an unstratified split of floor(share * n) rows where a
    stratum is too small.  The strata are few by construction (a binary trait
    times two bins), so only their counts reach the driver.
    """
    order = list(order) if order is not None else hashed(seed)
    counts = {r[0]: r[1] for r in strata_counts(df, stratum).collect()}
    sizes = holdout_sizes(counts, share)
    if sizes is None:
        n_test = int(sum(counts.values()) * share)
        ranked = with_row_number(df, [], order, "_rn")
        limit = F.lit(n_test)
    else:
        ranked = with_row_number(df, [stratum], order, "_rn")
        limit = F.coalesce(*[F.when(F.col(stratum) == k, v) for k, v in sizes.items()])
    return ranked.withColumn("split", F.when(F.col("_rn") <= limit, "test").otherwise("trainval")).drop("_rn")


def kfold_assign(
    ids: DataFrame, seeds: Sequence[int], k: int = 5, order: Sequence[str | Column] | None = None
) -> DataFrame:
    """(seed, fold, sample_id, split): shuffled k folds, the first n mod k one larger."""
    order = list(order) if order is not None else hashed(F.col("seed"))
    n = ids.count()
    small, extra = divmod(n, k)
    if small < 1:
        raise CheckFailed("fewer samples than folds")
    seeded = ids.select("*", F.explode(F.array(*[F.lit(int(s)) for s in seeds])).alias("seed"))
    at = F.col("_rn") - 1
    head = (small + 1) * extra
    val = F.when(at < head, F.floor(at / (small + 1))).otherwise(extra + F.floor((at - head) / small))
    ranked = with_row_number(seeded, ["seed"], order, "_rn").withColumn("val_fold", val.cast("int"))
    folds = ranked.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    split = F.when(F.col("fold") == F.col("val_fold"), "val").otherwise("train")
    return folds.select("seed", "fold", "sample_id", split.alias("split"))


def contiguous_folds(
    df: DataFrame, k: int, order: Sequence[str | Column], test_ratio: float = 0.0
) -> DataFrame:
    """Floor-size folds in order, the last takes the remainder; the final
    floor(n * test_ratio) rows are the test set (fold NULL).  A test size of 0
    leaves every row in development."""
    n = df.count()
    n_dev = n - int(n * test_ratio)
    size = n_dev // k
    if size < 1:
        raise CheckFailed("fewer development samples than folds")
    ranked = with_row_number(df, [], order, "_rn")
    fold = F.least(F.floor((F.col("_rn") - 1) / size), F.lit(k - 1)).cast("int")
    return ranked.withColumn("fold", F.when(F.col("_rn") <= n_dev, fold)).drop("_rn")


def ratio_sizes(n: int, val_ratio: float, test_ratio: float) -> tuple[int, int, int]:
    """Sizes of train, val and test.

    Shares are rounded down.  If one of the three would be empty, each share that
    is asked for gets at least one row; while nothing is left to train on, test
    gives one row back, then val.  All are 0 if that does not help.
    """
    sizes = {"test": math.floor(n * test_ratio), "val": math.floor(n * val_ratio)}
    asked = {"test": test_ratio > 0, "val": val_ratio > 0}
    if any(size < 1 for size in (*sizes.values(), n - sum(sizes.values()))) and n:
        sizes = {part: max(size, 1) * asked[part] for part, size in sizes.items()}
        for part in sizes:
            sizes[part] -= sizes[part] > 0 and sum(sizes.values()) >= n
    train = n - sum(sizes.values())
    return (train, sizes["val"], sizes["test"]) if train > 0 else (0, 0, 0)


def ratio_split(
    df: DataFrame, val_ratio: float, test_ratio: float, order: Sequence[str | Column] | None = None,
    seed: int = 42,
) -> DataFrame:
    train, val, test = ratio_sizes(df.count(), val_ratio, test_ratio)
    ranked = with_row_number(df, [], list(order) if order is not None else hashed(seed), "_rn")
    at = F.col("_rn")
    split = F.when(at <= train, "train").when(at <= train + val, "val").when(at <= train + val + test, "test")
    return ranked.withColumn("split", split).drop("_rn")


def tail_validation_split(df: DataFrame, order: Sequence[str | Column], share: float = 0.8) -> DataFrame:
    """The first 80 % in stored order train, the rest validates."""
    cut = int(df.count() * share)
    ranked = with_row_number(df, [], order, "_rn")
    return ranked.withColumn("split", F.when(F.col("_rn") <= cut, "train").otherwise("val")).drop("_rn")


def quantile_stratum(df: DataFrame, value: str, name: str = "stratum") -> DataFrame:
    """Quartile labels Q1..Q4, right-closed at the interpolated quartiles."""
    cuts = exact_quantiles(df, [], value, {"a": 0.25, "b": 0.5, "c": 0.75}).first()
    x = F.col(value)
    label = (
        F.when(x <= cuts["a"], "Q1").when(x <= cuts["b"], "Q2").when(x <= cuts["c"], "Q3")
        .when(x.isNotNull(), "Q4")
    )
    return df.withColumn(name, label)


def first_per_key(df: DataFrame, key: str, order: str) -> DataFrame:
    """The first row of each key in file order, by a mergeable aggregate."""
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.min_by(F.struct(*rest), order).alias("_r")).select(key, "_r.*")


def factorize_by_appearance(df: DataFrame, value: str, order: str, name: str = "code") -> DataFrame:
    """1-based code of each distinct value in order of first appearance."""
    firsts = df.groupBy(value).agg(F.min(order).alias("_first"))
    return with_row_number(firsts, [], ["_first"], name).select(value, name)
