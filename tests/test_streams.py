"""Early stopping over a feed out of order, against a plain loop."""

import random

import pytest

from locusmill.streaming import feeds


def direct(scores, patience, min_delta):
    best = best_epoch = stop = None
    wait = 0
    for epoch, score in sorted(scores):
        if best is None or score > best + min_delta:
            best, best_epoch, wait = score, epoch, 0
        else:
            wait += 1
            if wait >= patience:
                stop = epoch
                break
    return best_epoch, stop


def run(spark, tmp_path, files, late, patience=3, min_delta=0.05):
    schema = "run string, epoch long, score double"
    folder = str(tmp_path / "feed")
    for rows in files:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
    feed = feeds.file_feed(spark, folder, spark.createDataFrame([], schema), files_at_once=1)
    out = feeds.stream_early_stop(feed, str(tmp_path / "job"), patience, min_delta, late)
    return {r.run: (r.best_epoch, r.stop_epoch, r.n_late) for r in out.collect()}


@pytest.mark.parametrize("late", [6, 1000])
def test_shuffled(spark, tmp_path, late):
    rng = random.Random(late)
    runs = {f"r{k}": [(e, rng.random() * min(e, 9)) for e in range(1, rng.randrange(2, 40))] for k in range(12)}
    rows = sorted(((r, e, s) for r, all_ in runs.items() for e, s in all_), key=lambda x: x[1] + rng.random() * 5)
    cuts = [0, len(rows) // 5, len(rows) // 2, len(rows)]
    files = [rows[a:b] for a, b in zip(cuts, cuts[1:])]
    for rows in files:
        rng.shuffle(rows)
    assert run(spark, tmp_path, files, late) == {r: (*direct(s, 3, 0.05), 0) for r, s in runs.items()}


def test_late_replayed_and_missing_rows(spark, tmp_path):
    first = [("a", 1, 0.1), ("a", 2, 0.5), ("a", 9, 0.2), (None, 1, 1.0), ("b", None, 1.0), ("b", 4, None)]
    again = [("a", 2, 0.5), ("a", 3, 0.9), ("a", 9, 0.8), ("a", 10, 0.1), ("a", 11, 0.1)]
    # after the first file all up to 9 - 3 counts: 2 and 3 come too late, the second 9 replaces nothing
    assert run(spark, tmp_path, [first, again], 3) == {"a": (2, 11, 2)}


def test_one_row(spark, tmp_path):
    assert run(spark, tmp_path, [[("a", 5, -1.0)]], 0) == {"a": (5, None, 0)}


def test_runs_share_a_call(spark, tmp_path, monkeypatch):
    """Many runs, few of them in the second file: what they are grouped by is neither a run nor seen in the result."""
    monkeypatch.setattr(feeds, "RUN_GROUPS", 3)
    rng = random.Random(5)
    runs = {f"r{k}": [(e, rng.random()) for e in range(1, rng.randrange(2, 12))] for k in range(40)}
    first = [(r, e, s) for r, all_ in runs.items() for e, s in all_[:4]]
    then = [(r, e, s) for r, all_ in runs.items() for e, s in all_[4:]]
    assert run(spark, tmp_path, [first, then], 2) == {r: (*direct(s, 3, 0.05), 0) for r, s in runs.items()}
