"""Distributed scans against plain Python, with one key holding most rows."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from locusmill.plans.joins import attach_measured
from locusmill.plans.scan import exact_quantiles, prefix_scan, upper_median, with_row_number


def rows(seed=1, n=3000):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        key = "hot" if rng.random() < 0.6 else f"k{rng.randrange(40)}"
        value = None if rng.random() < 0.1 else float(rng.choice([1, 2, 2, 2, 5, rng.random() * 10]))
        out.append((key, i, value))
    return out


@pytest.fixture(scope="module")
def frame(spark):
    return spark.createDataFrame(rows(), "k string, i int, v double").repartition(16, "i")


def test_prefix_scan(frame):
    specs = {
        "n": ("count", F.col("v"), True), "n0": ("count", F.lit(1), False), "s": ("sum", F.col("v"), False),
        "m": ("max", F.col("v"), True), "last": ("last", F.col("v"), False),
    }
    got = {(r.k, r.i): r for r in prefix_scan(frame, ["k"], ["i"], specs).collect()}
    assert len(got) == 3000
    state = {}
    for k, i, v in rows():
        seen = state.setdefault(k, [])
        r, known = got[(k, i)], [x for x in seen if x is not None]
        after = [x for x in [*seen, v] if x is not None]
        assert (r.n, r.n0) == (len(after), len(seen))
        assert r.s == (pytest.approx(sum(known)) if known else None)
        assert r.m == (max(after) if after else None)
        assert r.last == (known[-1] if known else None)
        seen.append(v)


def test_row_number(frame):
    overall = {r.i: r.rn for r in with_row_number(frame, [], [F.desc("i")], "rn").collect()}
    assert overall == {i: 3000 - i for i in range(3000)}
    keyed = with_row_number(frame, ["k"], ["i"], "rn").toPandas()
    expected = keyed.sort_values("i").groupby("k").cumcount() + 1
    assert (expected.sort_index() == keyed["rn"]).all()


def test_quantiles(frame):
    got = exact_quantiles(frame, ["k"], "v", {"a": 0.0, "b": 0.3, "c": 0.5, "d": 1.0}).toPandas().set_index("k")
    data = pd.DataFrame(rows(), columns=["k", "i", "v"]).dropna()
    for k, part in data.groupby("k"):
        np.testing.assert_allclose(
            got.loc[k, ["n", "a", "b", "c", "d"]].astype(float),
            [len(part), *np.quantile(part["v"], [0, 0.3, 0.5, 1])])
    whole = exact_quantiles(frame, [], "v", {"m": 0.5}).first()
    assert whole["m"] == pytest.approx(data["v"].median())


def test_quantiles_skip_nan_and_empty(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (None,), (3.0,)], "v double")
    assert exact_quantiles(df, [], "v", {"m": 0.5}).first()["m"] == 2.0
    assert exact_quantiles(df.where("v > 100 AND NOT isnan(v)"), [], "v", {"m": 0.5}).first()["m"] is None


def test_upper_median(spark):
    df = spark.createDataFrame([("a", v) for v in (4, 1, 3, 2)] + [("b", 7)], "k string, v int")
    assert {r.k: r.m for r in upper_median(df, ["k"], "v", "m").collect()} == {"a": 3, "b": 7}


def test_measured_join(frame, monkeypatch):
    from locusmill.plans import joins

    stats = frame.groupBy("k").agg(F.max("v").alias("top"))
    small = attach_measured(frame, stats, ["k"])
    assert "BroadcastHashJoin" in small._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(joins, "BROADCAST_BYTES", 0)
    large = attach_measured(frame, stats, ["k"])
    assert large.count() == small.count() == 3000
