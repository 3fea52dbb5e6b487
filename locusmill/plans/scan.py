"""Ordered computations that never place a whole group in one task.

A plain ``Window.partitionBy(key)`` sorts each key in a single task, and a
window without keys sorts everything in one.  Here the rows are range-sorted
over all keys at once, so a hot key spreads over many slices.  Each slice is
scanned on its own and receives one carried value for the single key that it
may share with the slices before it.  The carry table has one row per slice.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .joins import attach_measured
from .session import stable

_SLICE, _POS = "_slice", "_pos"


def sorted_slices(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """Globally sorted rows, written once with their slice number and a global position.

    ``order`` must end in a unique column wherever ties would matter; it also
    lets the range partitioner cut a run of equal values.
    """
    ranged = df.orderBy(*keys, *order)
    return stable(
        ranged.withColumn(_SLICE, F.spark_partition_id()).withColumn(_POS, F.monotonically_increasing_id())
    )


def with_row_number(
    df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], name: str
) -> DataFrame:
    """1-based ``row_number`` within ``keys`` (or overall)."""
    if keys:
        return prefix_scan(df, keys, order, {name: ("count", F.lit(1), True)})
    rows = sorted_slices(df, [], order)
    spark = df.sparkSession
    sizes = sorted((r[0], r[1]) for r in rows.groupBy(_SLICE).count().collect())
    base, offsets = 0, []
    for number, size in sizes:
        offsets.append((number, base))
        base += size
    table = spark.createDataFrame(offsets, f"{_SLICE} int, _base long")
    within = F.col(_POS) - F.shiftleft(F.col(_SLICE).cast("long"), 33)
    return (
        rows.join(F.broadcast(table), _SLICE)  # one row per slice
        .withColumn(name, F.col("_base") + within + 1)
        .drop(_SLICE, _POS, "_base")
    )


def _aggregate(op: str, column: Column) -> Column:
    if op == "count":
        return F.count(column)
    if op == "sum":
        return F.sum(column)
    if op == "max":
        return F.max(column)
    if op == "last":
        return F.max_by(column, F.when(column.isNotNull(), F.col(_POS)))
    raise ValueError(f"unknown scan {op!r}")


def _local(op: str, column: Column, window: Window) -> Column:
    if op == "last":
        return F.last(column, ignorenulls=True).over(window)
    return _aggregate(op, column).over(window)


def _combine(op: str, left, right):
    if left is None or right is None:
        return right if left is None else left
    if op in ("count", "sum"):
        return left + right
    if op == "max":
        return max(left, right)
    return right


def prefix_scan(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str | Column],
    specs: dict[str, tuple[str, Column, bool]],
) -> DataFrame:
    """Running count / sum / max / last-non-null within ``keys`` in ``order``.

    ``specs`` maps an output name to ``(op, column, inclusive)``; an exclusive
    scan sees only the rows before the current one (``last`` is then a lag).
    """
    out = scan_sorted(sorted_slices(df, keys, order), keys, specs)
    return out.drop(_SLICE, _POS)


def scan_sorted(
    rows: DataFrame, keys: Sequence[str], specs: dict[str, tuple[str, Column, bool]]
) -> DataFrame:
    """``prefix_scan`` over rows that ``sorted_slices`` has already placed."""
    keys, names = list(keys), list(specs)
    parts = [_SLICE, *keys]
    totals = rows.groupBy(*parts).agg(
        F.min(_POS).alias("_lo"),
        F.max(_POS).alias("_hi"),
        *[_aggregate(op, col).alias(f"_a{i}") for i, (op, col, _) in enumerate(specs.values())],
    )
    state = F.struct(*keys, *[f"_a{i}" for i in range(len(names))])
    ends = totals.groupBy(_SLICE).agg(
        F.min_by(state, "_lo").alias("head"), F.max_by(state, "_hi").alias("tail")
    )
    types = ends.schema["head"].dataType
    carried, running, running_key = [], [None] * len(names), None
    for row in sorted(ends.collect(), key=lambda r: r[_SLICE]):  # one row per slice
        head_key = tuple(row["head"][: len(keys)])
        tail_key = tuple(row["tail"][: len(keys)])
        tail = list(row["tail"][len(keys):])
        joined = running_key is not None and running_key == head_key
        if joined:
            carried.append((row[_SLICE], *head_key, *running))
        if joined and head_key == tail_key:
            running = [
                _combine(op, a, b) for (op, _, _), a, b in zip(specs.values(), running, tail)
            ]
        else:
            running = tail
        running_key = tail_key
    schema = T.StructType(
        [T.StructField(_SLICE, T.IntegerType())]
        + [T.StructField(k, types[k].dataType) for k in keys]
        + [T.StructField(f"_c{i}", types[f"_a{i}"].dataType) for i in range(len(names))]
    )
    carry = rows.sparkSession.createDataFrame(carried, schema)
    kept = [c for c in rows.columns if c not in names]
    window = Window.partitionBy(*parts).orderBy(_POS)
    upto = window.rowsBetween(Window.unboundedPreceding, 0)
    before = window.rowsBetween(Window.unboundedPreceding, -1)
    for i, (op, col, inclusive) in enumerate(specs.values()):
        rows = rows.withColumn(f"_l{i}", _local(op, col, upto if inclusive else before))
    rows = rows.join(F.broadcast(carry), parts, "left")  # at most one row per slice
    outputs = []
    for i, (name, (op, _, _)) in enumerate(specs.items()):
        local, before_slice = F.col(f"_l{i}"), F.col(f"_c{i}")
        if op in ("count", "sum"):
            zero = F.lit(0)
            value = F.when(
                local.isNull() & before_slice.isNull(), F.lit(0 if op == "count" else None)
            ).otherwise(F.coalesce(local, zero) + F.coalesce(before_slice, zero))
        elif op == "max":
            value = F.greatest(local, before_slice)
        else:
            value = F.coalesce(local, before_slice)
        outputs.append(value.alias(name))
    return rows.select(*kept, *outputs)


def _with_totals(counted: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Counted values (keys, _v, _n) with the running count _cum and the key total n."""
    rows = sorted_slices(counted, keys, ["_v"])
    totals = rows.groupBy(*keys).agg(F.sum("_n").alias("n"))
    scanned = scan_sorted(rows, keys, {"_cum": ("sum", F.col("_n"), True)})
    if keys:
        return attach_measured(scanned, totals, keys)
    return scanned.withColumn("n", F.lit(totals.first()[0]))


SKETCH = 10_000
"""Accuracy of the sketch that brackets a quantile: its rank error is at most one in so many rows."""


def exact_quantiles(
    df: DataFrame, keys: Sequence[str], value: str, probabilities: dict[str, float]
) -> DataFrame:
    """Exact interpolated quantiles per key, with ``n``; NULL and NaN are left out.

    A mergeable sketch brackets every quantile; the rows below a bracket are
    counted, and only those inside it are sorted, equal values collapsed to one
    counted row.  So neither a hot key nor a repeated value has to fit in one
    task, and the table is not sorted.
    """
    keys = list(keys)
    x = F.col(value).cast("double")
    clean = df.where(F.col(value).isNotNull() & ~F.isnan(x)).select(*keys, x.alias("_v"))
    wanted = list(probabilities.values())
    reach = 3.0 / SKETCH
    cuts = [min(max(p + side * reach, 0.0), 1.0) for p in wanted for side in (-1, 1)]
    sketch = clean.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.percentile_approx("_v", cuts, SKETCH).alias("_q"))
    brackets = []
    for i, p in enumerate(wanted):
        few = F.col("n") * reach < 9  # a bracket of a few ranks is no use: such a group is its own bracket
        low = F.when(few | F.lit(p <= reach), F.lit(float("-inf"))).otherwise(F.col("_q")[2 * i])
        high = F.when(few | F.lit(p >= 1 - reach), F.lit(float("inf"))).otherwise(F.col("_q")[2 * i + 1])
        brackets.append(F.struct(F.lit(i).alias("i"), low.alias("low"), high.alias("high")))
    stats = stable(sketch.where("n > 0").select(*keys, "n", F.array(*brackets).alias("_b")))
    if keys:
        near = attach_measured(clean, stats.select(*keys, "_b"), keys)
    else:
        only = stats.first()
        if only is None:
            nothing = [F.max(F.lit(None).cast("double")).alias(name) for name in probabilities]
            return clean.agg(F.max(F.lit(None).cast("long")).alias("n"), *nothing)
        near = clean.withColumn("_b", F.array(*[
            F.struct(F.lit(r["i"]).alias("i"), F.lit(r["low"]).alias("low"), F.lit(r["high"]).alias("high")) for r in only["_b"]
        ]))
    # of each bracket: how many rows lie below it, and the counted values inside
    reached = F.filter("_b", lambda r: F.col("_v") <= r["high"])
    placed = near.withColumn("_r", F.explode(reached)).withColumn("_in", F.when(F.col("_v") >= F.col("_r.low"), F.col("_v")))
    counted = stable(placed.groupBy(*keys, F.col("_r.i").alias("_i"), "_in").agg(F.count(F.lit(1)).alias("_n")))
    below = counted.where("_in IS NULL").select(*keys, "_i", F.col("_n").alias("_below"))
    rows = sorted_slices(counted.where("_in IS NOT NULL"), [*keys, "_i"], ["_in"])
    scanned = scan_sorted(rows, [*keys, "_i"], {"_cum": ("sum", F.col("_n"), True)})
    scanned = attach_measured(scanned, below, [*keys, "_i"], "left").withColumn(
        "_cum", F.col("_cum") + F.coalesce("_below", F.lit(0)))
    scanned = attach_measured(scanned, stats.select(*keys, "n"), keys) if keys else scanned.withColumn("n", F.lit(only["n"]))
    at = (F.col("n") - 1) * F.element_at(F.array(*[F.lit(float(p)) for p in wanted]), F.col("_i") + 1)
    picks = [
        F.max(F.when((F.col("_cum") - F.col("_n") <= rank) & (rank < F.col("_cum")), F.col("_in"))).alias(side)
        for side, rank in (("_lo", F.floor(at)), ("_hi", F.ceil(at)))
    ]
    found = scanned.groupBy(*keys, "_i").agg(F.max("n").alias("n"), F.max(at - F.floor(at)).alias("_f"), *picks)
    missed = F.col("_lo").isNull() | F.col("_hi").isNull()
    value_at = F.when(missed, F.raise_error(F.lit("quantile outside its bracket")).cast("double")).otherwise(
        F.col("_lo") + (F.col("_hi") - F.col("_lo")) * F.col("_f"))
    outputs = [F.max(F.when(F.col("_i") == i, value_at)).alias(name) for i, name in enumerate(probabilities)]
    return found.groupBy(*keys).agg(F.max("n").alias("n"), *outputs).select(*keys, "n", *probabilities)


def upper_median(df: DataFrame, keys: Sequence[str], value: str, name: str) -> DataFrame:
    """``sorted[n // 2]`` per key: the upper median, never interpolated."""
    keys = list(keys)
    counted = df.groupBy(*keys, F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    scanned = _with_totals(counted, keys)
    rank = F.floor(F.col("n") / 2)
    hit = (F.col("_cum") - F.col("_n") <= rank) & (rank < F.col("_cum"))
    return scanned.groupBy(*keys).agg(F.max(F.when(hit, F.col("_v"))).alias(name))
