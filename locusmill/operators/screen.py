"""Marker screening by a dependence score, and selection from the scores."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.joins import attach_measured
from ..plans.scan import scan_sorted, sorted_slices, with_row_number
from .checks import same_rows

ALPHA = 0.6
MIN_PAIRS = 10
MIN_GRID = 4
CELLS = 240
TABLES_AT_ONCE = 1 << 19
"""Counts that are scored in one step; bounds a task's memory."""
CUTS_AT_ONCE = 1 << 20
"""Pairs of cuts that one step of the optimiser holds; bounds a task's memory."""


def pool_cells(phenotypes: DataFrame, traits: Sequence[str]) -> int:
    """Cells of the trait axis: at least as many as bins of the finest grid that the pool allows."""
    counts = phenotypes.agg(*[F.count(t).alias(t) for t in traits]).first()
    bins = max(counts) ** ALPHA / 2
    return CELLS * max(1, int(np.ceil(bins / CELLS)))


def trait_cells(phenotypes: DataFrame, traits: Sequence[str], cells: int = CELLS) -> DataFrame:
    """(trait, sample_id, cell, value): equal-frequency cells of each trait over the pool.

    Equal values share a cell.  The rank comes from a scan over the counted
    distinct values, not from sorting a trait in one task.
    """
    long = phenotypes.unpivot(["sample_id"], list(traits), "trait", "value").where("value IS NOT NULL")
    counted = long.groupBy("trait", "value").agg(F.count(F.lit(1)).alias("_n"))
    rows = sorted_slices(counted, ["trait"], ["value"])
    totals = rows.groupBy("trait").agg(F.sum("_n").alias("_total"))
    ranked = scan_sorted(rows, ["trait"], {"_before": ("sum", F.col("_n"), False)})
    ranked = attach_measured(ranked.fillna(0, ["_before"]), totals, ["trait"])
    cut = ranked.select("trait", "value", F.floor(F.col("_before") * cells / F.col("_total")).cast("int").alias("cell"))
    return attach_measured(long, cut, ["trait", "value"]).select("trait", "sample_id", "cell", "value")


def _entropy_terms(counts: np.ndarray) -> np.ndarray:
    return np.where(counts > 0, counts * np.log(np.where(counts > 0, counts, 1.0)), 0.0)


def grid_scores(tables: np.ndarray, places: np.ndarray | None = None, cells: int | None = None) -> np.ndarray:
    """Largest normalised mutual information over the allowed grids, per table.

    ``tables`` holds counts of rows x 3 dosages x cells.  The dosage axis takes
    its three groupings, the trait axis every number of bins b (merged adjacent
    cells) with groups * b <= max(n ** 0.6, 4).  Where ``tables`` has columns for
    some of the ``cells`` only, ``places`` names them, ascending in each row and
    ``cells`` where a column is unused.
    """
    rows, _, width = tables.shape
    if places is None:
        places, cells = np.broadcast_to(np.arange(width), (rows, width)), width
    order = (places + np.arange(rows)[:, None] * (cells + 1)).ravel()  # ascending
    n = tables.sum(axis=(1, 2))
    budget = np.maximum(n ** ALPHA, MIN_GRID)
    running = np.concatenate([np.zeros((rows, 3, 1)), np.cumsum(tables, axis=2)], axis=2)
    best = np.zeros(rows)
    for groups in (2, 3):
        bins = np.minimum(budget // groups, cells)
        for b in range(2, int(bins.max(initial=0)) + 1):
            fits = bins >= b
            edges = -(-np.arange(b + 1) * cells // b)
            some = np.flatnonzero(fits)[:, None]
            before = np.searchsorted(order, edges + some * (cells + 1)) - some * width  # columns before each edge
            binned = np.diff(np.ascontiguousarray(running[some, :, before].swapaxes(1, 2)), axis=2)
            low, mid, high = binned[:, 0], binned[:, 1], binned[:, 2]
            options = (
                [np.stack([low, mid + high], axis=1), np.stack([low + mid, high], axis=1)]
                if groups == 2 else [binned]
            )
            for joint in options:
                information = (
                    _entropy_terms(joint).sum(axis=(1, 2)) - _entropy_terms(joint.sum(axis=2)).sum(axis=1)
                    - _entropy_terms(joint.sum(axis=1)).sum(axis=1) + _entropy_terms(n[fits])
                ) / n[fits]
                best[fits] = np.maximum(best[fits], information / np.log(min(groups, b)))
    return best


def _clumps(joint: np.ndarray) -> np.ndarray:
    """Counts of groups x cells with empty cells left out and neighbours of one and the same group merged.

    No best cut lies within such a clump.
    """
    joint = joint[:, joint.any(axis=0)]
    pure = np.where((joint > 0).sum(axis=0) == 1, joint.argmax(axis=0), -1)
    first = np.ones(len(pure), bool)
    first[1:] = (pure[1:] != pure[:-1]) | (pure[1:] < 0)
    return np.add.reduceat(joint, np.flatnonzero(first), axis=1)


def best_cuts(joints: list[np.ndarray], bins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Largest mutual information in nats of each table with its trait axis cut into at most 2, and at most ``bins``, bins.

    The best cut of the first t clumps into b bins ends with some bin (s, t] after
    a best cut of the first s into b - 1, as bins add up in the conditional
    entropy.  Every table takes clumps^2 x bins steps, many tables at once.
    """
    width = max(j.shape[1] for j in joints)
    rows, groups = len(joints), joints[0].shape[0]
    table = np.zeros((rows, groups, width))
    for i, j in enumerate(joints):
        table[i, :, : j.shape[1]] = j
    running = np.concatenate([np.zeros((rows, groups, 1)), np.cumsum(table, axis=2)], axis=2)
    inside = np.maximum(running[:, :, None, :] - running[:, :, :, None], 0)  # counts after s, up to t
    gain = _entropy_terms(inside).sum(axis=1) - _entropy_terms(inside.sum(axis=1))
    gain[:, np.tri(width + 1, k=-1, dtype=bool)] = -np.inf
    total = running[:, :, -1]
    n = total.sum(axis=1)
    fixed = _entropy_terms(n) - _entropy_terms(total).sum(axis=1)
    best, two, most = gain[:, 0, :], None, np.zeros(rows)
    for b in range(2, int(bins.max()) + 1):
        further = (best[:, :, None] + gain).max(axis=1)
        settled, best = b > 2 and np.array_equal(further, best), further
        two = best[:, -1] if two is None else two
        most = np.where(bins >= b, best[:, -1], most)
        if settled:
            break
    return (two + fixed) / n, (most + fixed) / n


def optimal_scores(tables: np.ndarray) -> np.ndarray:
    """Maximal information coefficient per table of rows x 3 dosages x cells, over all cuts between cells.

    Grids are those of ``grid_scores``, but a grid of b bins takes its best cut
    instead of the equal-frequency one.  More bins never lose information, so
    of each grouping the finest grid and, for three groups, the one of two bins
    (which has a smaller divisor) hold the maximum.
    """
    budget = np.maximum(tables.sum(axis=(1, 2)) ** ALPHA, MIN_GRID)
    best = np.zeros(len(tables))
    low, mid, high = tables[:, 0], tables[:, 1], tables[:, 2]
    for joint in (np.stack([low, mid + high], 1), np.stack([low + mid, high], 1), tables):
        groups = joint.shape[1]
        bins = (budget // groups).astype(int)
        use = np.flatnonzero((bins >= 2) & ((joint.sum(axis=2) > 0).sum(axis=1) >= 2))
        clumps = {i: _clumps(joint[i]) for i in use.tolist()}
        order = sorted(clumps, key=lambda i: (clumps[i].shape[1], bins[i]))
        at = 0
        while at < len(order):
            size = 1
            while at + size < len(order) and (size + 1) * (clumps[order[at + size]].shape[1] + 1) ** 2 <= CUTS_AT_ONCE:
                size += 1
            some = np.array(order[at : at + size])
            two, most = best_cuts([clumps[i] for i in some.tolist()], bins[some])
            score = most / np.log(np.minimum(groups, bins[some]))
            best[some] = np.maximum.reduce([best[some], score, two / np.log(2)])
            at += size
    return best


def _tables(at: list[np.ndarray], counts: list[np.ndarray], cells: int) -> tuple[np.ndarray, np.ndarray]:
    """Counts of rows x 3 dosages x columns, one for each cell that a row has, and the cells; ``cells`` where it has fewer."""
    used = [np.unique(a % cells, return_inverse=True) for a in at]
    width = max(len(u) for u, _ in used)
    tables, places = np.zeros((len(at), 3, width)), np.full((len(at), width), cells)
    for i, (u, column) in enumerate(used):
        places[i, : len(u)] = u
        tables[i, at[i] // cells, column] = counts[i]
    return tables, places


def _steps(sizes: list[int]) -> Iterator[slice]:
    """Neighbours whose tables are scored together: the widest decides how many."""
    start = widest = 0
    for at, size in enumerate(sizes):
        widest = max(widest, size)
        if at > start and 3 * widest * (at + 1 - start) > TABLES_AT_ONCE:
            yield slice(start, at)
            start, widest = at, size
    if sizes:
        yield slice(start, len(sizes))


def dependence_screen(calls: DataFrame, cells_of: DataFrame, cells: int = CELLS) -> DataFrame:
    """(marker_idx, trait, n_pairs, score) over the given samples.

    A lower bound of the maximal information coefficient: the trait axis is cut
    in equal-frequency bins of the whole pool rather than optimised.  Fewer than
    10 complete pairs give NULL; a constant dosage or trait gives 0.  Where all
    pairs of a marker with differing trait values lie in one cell, the cells are
    too coarse for it and the score is NULL, not 0.

    Calls are counted per (marker, trait, dosage, cell) first, so a marker of
    any size reaches its task as at most 3 x ``cells`` counts.
    """
    return _screened(calls, cells_of, cells, grid_scores)


def dependence_coefficient(calls: DataFrame, cells_of: DataFrame, cells: int = CELLS) -> DataFrame:
    """``dependence_screen`` with the trait axis cut where the information is largest: the coefficient itself.

    Cuts lie between cells, so it is exact where no two values share a cell,
    and never below the equal-frequency score.
    """
    return _screened(calls, cells_of, cells, lambda tables, *_: optimal_scores(tables))


def _screened(calls: DataFrame, cells_of: DataFrame, cells: int, scores: Callable[[np.ndarray, np.ndarray, int], np.ndarray]) -> DataFrame:
    """Counts of each marker and trait, scored by tables."""
    pairs = attach_measured(calls.where("dosage IS NOT NULL"), cells_of, ["sample_id"])
    counted = pairs.groupBy("marker_idx", "trait", "dosage", "cell").agg(
        F.count(F.lit(1)).alias("c"), F.min("value").alias("_lo"), F.max("value").alias("_hi"))
    packed = counted.groupBy("marker_idx", "trait").agg(
        F.sum("c").alias("n_pairs"),
        (F.min("dosage") == F.max("dosage")).alias("_same_x"),
        (F.min("_lo") == F.max("_hi")).alias("_same_y"),
        (F.min("cell") == F.max("cell")).alias("_one_cell"),
        F.collect_list((F.col("dosage") * cells + F.col("cell")).cast("int")).alias("_at"),
        F.collect_list("c").alias("_c"),
    )

    @F.pandas_udf("double")
    def score(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for places, sizes in batches:
            out = [np.empty(0)]
            for step in _steps([len(p) for p in places]):
                out.append(scores(*_tables(places[step].tolist(), sizes[step].tolist(), cells), cells))
            yield pd.Series(np.concatenate(out))

    value = (
        F.when(F.col("n_pairs") < MIN_PAIRS, F.lit(None).cast("double"))
        .when(F.col("_same_x") | F.col("_same_y"), F.lit(0.0))
        .when(F.col("_one_cell"), F.lit(None).cast("double"))
        .otherwise(score("_at", "_c"))
    )
    return packed.select("marker_idx", "trait", "n_pairs", value.alias("score"))


def _front(valid: DataFrame, k: int) -> DataFrame:
    """What each task alone cannot rule out of the k best per trait."""

    def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for batch in batches:
            rows = batch if held is None else pd.concat([held, batch])
            ordered = rows.sort_values(["trait", "score", "marker_idx"], ascending=[True, False, True], kind="stable")
            held = ordered.groupby("trait", sort=False).head(k)
        if held is not None:
            yield held

    return valid.mapInPandas(best, valid.schema)


def topk_markers(scores: DataFrame, k: int) -> DataFrame:
    """The k best scored markers per trait (all if there are fewer); ties by index.

    Every task first keeps its own k per trait; only these are ranked together.
    """
    valid = _front(scores.where(F.col("score").isNotNull() & ~F.isnan("score")), k)
    ranked = with_row_number(valid, ["trait"], [F.desc("score"), F.col("marker_idx")], "rank")
    return ranked.where(F.col("rank") <= k)


def top_ratio_markers(scores: DataFrame, ratios: dict[str, float]) -> DataFrame:
    """Distinct markers in the best ceil(ratio * count) of at least one trait."""
    valid = scores.where(F.col("score").isNotNull() & F.col("trait").isin(list(ratios)))
    sizes = {r[0]: r[1] for r in valid.groupBy("trait").count().collect()}  # one row per named trait
    ranked = with_row_number(valid, ["trait"], [F.desc("score"), F.col("marker_idx")], "rank")
    limit = F.coalesce(*[
        F.when(F.col("trait") == t, F.lit(int(np.ceil(r * sizes.get(t, 0))))) for t, r in ratios.items()
    ])
    return ranked.where(F.col("rank") <= limit).select("marker_idx").distinct()


def union_marker_sets(selected: DataFrame) -> DataFrame:
    """Distinct union of the per-trait sets."""
    return selected.select("marker_idx").distinct()


def marker_set_gaps(selected: DataFrame, available: DataFrame) -> DataFrame:
    """Markers on one side only."""
    return same_rows(selected.select("marker_idx"), available.select("marker_idx").distinct())
