"""The dependence coefficient against all cuts of the trait axis."""

import itertools
import math

import numpy as np
import pytest

from locusmill.operators import screen


def information(joint):
    n = joint.sum()
    rows, cols = joint.sum(axis=1), joint.sum(axis=0)
    return sum(
        joint[i, j] / n * math.log(joint[i, j] * n / (rows[i] * cols[j]))
        for i in range(joint.shape[0]) for j in range(joint.shape[1]) if joint[i, j]
    )


def exhaustive(table):
    """Every grouping of dosages with every cut into every allowed number of bins."""
    best, n, cells = 0.0, table.sum(), table.shape[1]
    for joint in (np.stack([table[0], table[1] + table[2]]), np.stack([table[0] + table[1], table[2]]), table):
        most = int(max(n ** screen.ALPHA, screen.MIN_GRID) // len(joint))
        for b in range(2, min(most, cells) + 1):
            for cut in itertools.combinations(range(1, cells), b - 1):
                binned = np.add.reduceat(joint, [0, *cut], axis=1)
                best = max(best, information(binned) / math.log(min(len(joint), b)))
    return best


@pytest.mark.parametrize("n, cells", [(5, 4), (10, 7), (14, 9), (30, 9), (60, 8)])
def test_all_cuts(n, cells):
    rng = np.random.default_rng(n)
    tables = np.zeros((25, 3, cells))
    for t in range(25):
        at = rng.integers(0, cells, n)
        signal = np.clip(at * 3 // cells + rng.integers(-1, 2, n), 0, 2)
        np.add.at(tables[t], (rng.integers(0, 3, n) if t % 2 else signal, at), 1)
    assert screen.optimal_scores(tables) == pytest.approx([exhaustive(t) for t in tables])


def test_never_below_equal_bins():
    rng = np.random.default_rng(1)
    tables = rng.poisson(rng.choice([0.02, 0.3, 2.0], (40, 3, 240))).astype(float)
    tables[0], tables[1, 1:], tables[2, :, 5:] = 0, 0, 0  # no call, one dosage, few cells
    tables[0, 0, 0] = 1
    found, equal = screen.optimal_scores(tables), screen.grid_scores(tables)
    assert (found >= equal - 1e-12).all() and (found <= 1 + 1e-12).all() and found[0] == 0 and found[1] == pytest.approx(0)


def test_parts_agree(monkeypatch):
    rng = np.random.default_rng(2)
    tables = rng.poisson(0.2, (30, 3, 60)).astype(float)
    whole = screen.optimal_scores(tables)
    monkeypatch.setattr(screen, "CUTS_AT_ONCE", 1)
    assert screen.optimal_scores(tables) == pytest.approx(whole)


def test_rules(spark):
    traits = spark.createDataFrame([(i, float(i), 5.0) for i in range(40)], "sample_id long, y double, flat double")
    rows = [(i, 0, i % 3) for i in range(9)] + [(i, 1, 1) for i in range(40)] + [(i, 2, 0 if i < 7 else 2) for i in range(40)]
    calls = spark.createDataFrame(rows + [(3, 9, None)], "sample_id long, marker_idx long, dosage int")
    cells = screen.trait_cells(traits, ["y", "flat"])
    out = {(r.marker_idx, r.trait): r.score for r in screen.dependence_coefficient(calls, cells).collect()}
    assert out[(0, "y")] is None and out[(1, "y")] == 0.0 and out[(2, "flat")] == 0.0 and (9, "y") not in out
    share = 7 / 40  # a cut at 7 of 40 tells all: the entropy of the dosage is left
    assert out[(2, "y")] == pytest.approx(-(share * math.log2(share) + (1 - share) * math.log2(1 - share)))
    assert screen.dependence_coefficient(calls.limit(0), cells).count() == 0


def test_query(spark):
    import __spark_entry__ as contract

    known, sf = contract.queries(), "/root/testdata/sf0.001"
    best = {(r.marker_idx, r.trait): r for r in known["m01_dependence_coefficient"](spark, sf).collect()}
    equal = {(r.marker_idx, r.trait): r for r in known["m01_dependence_screen"](spark, sf).collect()}
    assert best.keys() == equal.keys() and len(best) > 100
    scores = [(best[k].score, equal[k].score) for k in best]
    assert all((a is None) == (b is None) and (a is None or a >= b - 1e-8) for a, b in scores)
    assert any(a is not None and a > b + 1e-3 for a, b in scores)


def test_used_cells_alone_give_the_same_scores():
    """Tables of the cells that occur, however many the trait has, score as the whole ones; wide ones are few at a time."""
    rng, cells = np.random.default_rng(3), 1920
    at = [rng.permutation(3 * cells)[: rng.integers(1, 50)] for _ in range(40)]
    counts = [rng.integers(1, 5, len(a)) for a in at]
    whole = np.zeros((40, 3 * cells))
    for i, a in enumerate(at):
        whole[i, a] = counts[i]
    tables, places = screen._tables(at, counts, cells)
    assert tables.shape[2] < 50
    whole = whole.reshape(40, 3, cells)
    np.testing.assert_allclose(screen.grid_scores(tables, places, cells), screen.grid_scores(whole), atol=1e-12)
    np.testing.assert_allclose(screen.optimal_scores(tables), screen.optimal_scores(whole), atol=1e-12)
    assert list(screen._steps([5, 5, screen.TABLES_AT_ONCE, 1])) == [slice(0, 2), slice(2, 3), slice(3, 4)]
