"""Hand-computed cases, one per rule that is easy to get wrong."""

import math

import pytest
from pyspark.sql import functions as F

from locusmill.functions import codes, scaling
from locusmill.operators import align, checks, epochs, intervals, markers, metrics, models, splits
from locusmill.plans import joins

NAN = float("nan")


def one(spark, column, schema="x int", rows=((1,),)):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(column).collect()]


def test_chrom_and_position(spark):
    rows = [("1.0",), (" 2 ",), ("X",), ("chr3",), ("1.5",)]
    assert one(spark, codes.normalize_chrom("c"), "c string", rows) == ["1", "2", "X", "chr3", "1.5"]
    assert one(spark, codes.normalize_pos("c"), "c string", [("12.9",), ("7",)]) == [12, 7]
    with pytest.raises(Exception, match="unreadable marker position"):
        one(spark, codes.normalize_pos("c"), "c string", [("abc",)])
    assert one(spark, codes.chr_pos_id("c", "p"), "c string, p string", [("1.0", "5.0")]) == ["1:5"]
    assert one(spark, codes.plain_chrom("c"), "c string", [("chr7",), ("7.0",)]) == ["7", "7"]


def test_packed_orientation(spark):
    rows = [(0,), (1,), (2,), (3,)]
    assert one(spark, codes.decode_call_code("x", 2), "x int", rows) == [0, None, 1, 2]
    assert one(spark, codes.decode_call_code("x", 1), "x int", rows) == [2, None, 1, 0]
    with pytest.raises(ValueError):
        codes.decode_call_code("x", 0)


@pytest.mark.parametrize("a1,a2", [("A", "G"), ("G", "A"), ("T", "C"), ("C", "G"), ("a", "t")])
def test_channel_round_trip(spark, a1, a2):
    rows = [(a1, a2, d) for d in (0, 1, 2, None)]
    df = spark.createDataFrame(rows, "a1 string, a2 string, d int").withColumn(
        "c", codes.encode_channel("a1", "a2", "d"))
    out = df.select("d", "c", codes.decode_channel("a1", "a2", "c").alias("e")).collect()
    assert [r.d for r in out] == [r.e for r in out]
    order = ["AA", "AT", "AC", "AG", "TT", "TC", "TG", "CC", "CG", "GG"]
    pair = (a1 + a2).upper()
    assert out[1].c == next(i for i, p in enumerate(order) if sorted(p) == sorted(pair))


def test_channel_of_unknown_allele(spark):
    assert one(spark, codes.encode_channel("a", "b", "d"), "a string, b string, d int", [("N", "G", 0)]) == [None]


def test_one_hot(spark):
    df = spark.createDataFrame([(3,), (None,)], "c int").select(codes.onehot("c").alias("v"))
    assert [sum(r.v) for r in df.collect()] == [1.0, 0.0]
    assert [r[0] for r in df.select(codes.is_one_hot("v")).collect()] == [True, True]
    bad = spark.createDataFrame([([1.0, 1.0] + [0.0] * 8,), ([0.5] + [0.0] * 9,)], "v array<double>")
    assert [r[0] for r in bad.select(codes.is_one_hot("v")).collect()] == [False, False]


def test_sample_id_rules(spark):
    rows = [("f", "i"), ("s", "s")]
    assert one(spark, codes.iid_sample_id("f", "i", "joined"), "f string, i string", rows) == ["f_i", "s_s"]
    assert one(spark, codes.iid_sample_id("f", "i", "individual"), "f string, i string", rows) == ["i", "s_s"]


def metric_rows(spark, pairs):
    df = spark.createDataFrame([("k", float(a), float(b)) for a, b in pairs], "k string, y_true double, y_pred double")
    return metrics.regression_metrics(df, ["k"]).first()


def test_metrics_perfect(spark):
    r = metric_rows(spark, [(1, 1), (2, 2), (3, 3)])
    assert (r.n, r.mse, r.rmse, r.mae) == (3, 0, 0, 0)
    assert (r.pearson, r.r2, r.sd_ratio) == (pytest.approx(1), pytest.approx(1), pytest.approx(1))


def test_metrics_undefined_is_nan(spark):
    constant = metric_rows(spark, [(2, 1), (2, 3)])
    assert all(math.isnan(constant[c]) for c in ("pearson", "r2", "sd_ratio"))
    flat = metric_rows(spark, [(1, 2), (3, 2)])
    assert math.isnan(flat.pearson) and flat.sd_ratio == 0 and flat.r2 == pytest.approx(0)
    single = metric_rows(spark, [(1, 2)])
    assert math.isnan(single.sd_ratio) and single.mse == 1


@pytest.mark.parametrize("bad", [NAN, float("inf")])
def test_metrics_reject_nonfinite(spark, bad):
    with pytest.raises(Exception, match="non-finite"):
        metric_rows(spark, [(1, bad), (2, 2)])


def test_extended_drops_incomplete(spark):
    df = spark.createDataFrame([("k", 1.0, 1.0), ("k", None, 2.0), ("k", 3.0, NAN), ("k", 5.0, 6.0)],
                               "k string, y_true double, y_pred double")
    r = metrics.extended_metrics(df, ["k"]).first()
    assert (r.n, r.true_mean, r.mae) == (2, 3.0, 0.5) and r.true_sd == pytest.approx(math.sqrt(8))


def grid(spark, drop=0, twice=False):
    rows = [("m", "t", s, f, 3, 0.1 * s + f, 1.0, 1.0 + f, 1.0, 0.5, NAN if f == 0 else 1.0)
            for s in (1, 2, 3) for f in range(5)]
    rows = rows[drop:] + (rows[-1:] if twice else [])
    return spark.createDataFrame(rows, "model string, trait string, seed int, fold int, n long, pearson double, "
                                       "mse double, rmse double, mae double, r2 double, sd_ratio double")


def test_summary_needs_full_grid(spark):
    out = {(r.scope, r.metric): r for r in metrics.summarize_metrics(grid(spark)).collect()}
    r = out[("seed1", "rmse")]
    assert (r.n, r["mean"]) == (5, 3.0) and r.sd == pytest.approx(math.sqrt(2.5))
    assert out[("overall", "pearson")].n == 15
    for broken in (grid(spark, drop=1), grid(spark, twice=True)):
        with pytest.raises(checks.CheckFailed):
            metrics.summarize_metrics(broken)


def test_valid_counts(spark):
    out = {(r.scope, r.metric): r for r in metrics.summarize_valid_counts(grid(spark)).collect()}
    r = out[("overall", "sd_ratio")]
    assert (r.n_total, r.n_valid, r.n_nan, r["mean"]) == (15, 12, 3, 1.0)


def test_epoch_score_zero_for_degenerate(spark):
    rows = [(0, t, float(i), float(i) if t == "a" else 1.0) for t in "ab" for i in range(4)]
    df = spark.createDataFrame(rows, "epoch int, trait string, y_true double, y_pred double")
    per, mean = metrics.epoch_score(df, ["epoch"])
    assert {r.trait: r.score for r in per.collect()} == {"a": pytest.approx(1.0), "b": 0.0}
    assert mean.first().score == pytest.approx(1.0) and mean.first().n_valid == 1


def test_losses(spark):
    rows = [("a", 0.0, 1.0), ("a", 1.0, 2.0), ("b", 0.0, 800.0), ("b", 1.0, 801.0)]
    r = metrics.evaluation_losses(spark.createDataFrame(rows, "trait string, y_true double, y_pred double")).first()
    assert r.mse_minimax == 640000.0 and math.isfinite(r.log_cosh) and r.corr_mean == pytest.approx(0, abs=1e-12)


def test_trait_correlation_constant(spark):
    df = spark.createDataFrame([(1.0, 5.0), (2.0, 5.0), (4.0, 5.0)], "a double, b double")
    out = {(r.trait_a, r.trait_b): r.r for r in metrics.trait_correlation_matrix(df, ["a", "b"], F.lit(True)).collect()}
    assert out[("a", "a")] == pytest.approx(1) and out[("a", "b")] == 0 and out[("b", "b")] == 0


CALLS = [(s, 0, d) for s, d in enumerate([0, 0, 1, 2, None, 2])] + [(s, 1, None) for s in range(6)]


def calls(spark):
    return spark.createDataFrame(CALLS, "sample_id long, marker_idx long, dosage int")


def test_allele_frequency(spark):
    out = {r.marker_idx: r for r in markers.marker_allele_freq(calls(spark)).collect()}
    assert (out[0].n_called, out[0].p, out[0].maf) == (5, 0.5, 0.5) and out[1].p is None


def folds(spark):
    return spark.createDataFrame([(1, s, s % 2) for s in range(6)], "seed int, sample_id long, val_fold int")


def test_training_median_and_mean(spark):
    stats = markers.train_marker_stats(calls(spark), folds(spark), 2)
    got = {(r.fold, r.marker_idx): r for r in stats.collect()}
    # fold 0 trains on samples 1, 3, 5: dosages 0, 2, 2; fold 1 on 0, 2, 4: 0, 1, missing
    assert (got[(0, 0)].median, got[(0, 0)]["mean"], got[(0, 0)].n) == (2.0, pytest.approx(4 / 3), 3)
    assert (got[(1, 0)].median, got[(1, 0)].n, got[(1, 1)]["mean"]) == (0.5, 2, None)
    filled = markers.impute_train(calls(spark), folds(spark), stats, "median").where("marker_idx = 1")
    assert {r.x for r in filled.collect()} == {0.0}
    with pytest.raises(Exception, match="no training call"):
        markers.impute_train(calls(spark), folds(spark), stats, "mean").collect()


def test_no_leak(spark):
    out = markers.fold_leak_check(calls(spark), folds(spark), 2).collect()
    assert len(out) == 2 and all(r.n_changed == 0 and r.n_stats == 2 for r in out)


def test_mode_takes_lowest_and_skips_empty(spark):
    rows = [(0, 0, 4), (1, 0, 2), (2, 0, 4), (3, 0, 2), (4, 0, None), (5, 1, None)]
    df = spark.createDataFrame(rows, "sample_id int, marker_idx int, channel int")
    out = {(r.sample_id, r.marker_idx): r.filled for r in markers.marker_fill(df).collect()}
    assert out[(4, 0)] == 2 and out[(5, 1)] is None
    mean = {r.sample_id: r.filled for r in markers.marker_fill(df.where("marker_idx = 0"), "mean").collect()}
    assert mean[4] == 3
    half = spark.createDataFrame([(0, 0, 2), (1, 0, 3), (2, 0, None)], "sample_id int, marker_idx int, channel int")
    assert {r.sample_id: r.filled for r in markers.marker_fill(half, "mean").collect()}[2] == 2


def test_information_weight(spark):
    df = spark.createDataFrame([(0, 0), (0, 0), (0, 1), (0, 2), (1, 1)], "marker_idx int, code int")
    out = {(r.marker_idx, r.code): r.weight for r in markers.call_information_weight(df).collect()}
    assert out[(0, 0)] == pytest.approx(math.log(2)) and out[(1, 1)] == 0.0


def test_holdout_sizes():
    assert splits.holdout_sizes({"a": 50, "b": 50}, 0.15) == {"a": 7, "b": 8}
    sizes = splits.holdout_sizes({"a": 40, "b": 37, "c": 23}, 0.15)
    assert sum(sizes.values()) == 15
    assert splits.holdout_sizes({"a": 1, "b": 99}, 0.15) is None


@pytest.mark.parametrize("n,val,test,expected", [
    (100, 0.1, 0.15, (75, 10, 15)), (3, 0.1, 0.1, (1, 1, 1)), (2, 0.1, 0.1, (1, 1, 0)), (1, 0.1, 0.1, (1, 0, 0)),
    (5, 0.0, 0.0, (5, 0, 0)), (0, 0.1, 0.1, (0, 0, 0)), (20, 0.5, 0.5, (1, 10, 9)), (4, 1.0, 0.0, (1, 3, 0)),
    (2, 0.0, 0.4, (1, 0, 1)), (10, 0.01, 0.3, (6, 1, 3)),
])
def test_ratio_sizes(n, val, test, expected):
    assert splits.ratio_sizes(n, val, test) == expected


def test_folds(spark):
    ids = spark.range(13).withColumnRenamed("id", "sample_id")
    k = splits.kfold_assign(ids, [1, 2], 5)
    sizes = k.where("split = 'val'").groupBy("seed", "fold").count().orderBy("seed", "fold").collect()
    assert [r["count"] for r in sizes] == [3, 3, 3, 2, 2] * 2
    assert [r.n_samples for r in checks.validation_coverage(k, ids).collect()] == [13, 13]
    bad = checks.fold_membership(k, ids).where("n_duplicate + n_overlap + n_unknown + n_absent > 0")
    assert bad.isEmpty()
    contiguous = splits.contiguous_folds(ids, 5, ["sample_id"]).groupBy("fold").count().orderBy("fold").collect()
    assert [r["count"] for r in contiguous] == [2, 2, 2, 2, 5]
    again = splits.kfold_assign(ids.repartition(7), [1, 2], 5)
    assert checks.same_rows(k, again).isEmpty()


def test_fold_membership_faults(spark):
    rows = [(1, 0, "a", "train"), (1, 0, "a", "val"), (1, 0, "b", "train"), (1, 0, "b", "train"), (1, 0, "x", "val")]
    df = spark.createDataFrame(rows, "seed int, fold int, sample_id string, split string")
    ids = spark.createDataFrame([("a",), ("b",), ("c",)], "sample_id string")
    r = checks.fold_membership(df, ids).first()
    assert (r.n_overlap, r.n_duplicate, r.n_unknown, r.n_absent) == (1, 1, 1, 1)
    cover = {r.times: r.n_samples for r in checks.validation_coverage(df, ids).collect()}
    assert cover == {1: 1, 0: 2}


def test_median_bin(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (2.0,), (9.0,)], "v double")
    assert sorted((r.v, r.b) for r in splits.median_bin(df, "v", "b").collect()) == [(1, 0), (2, 0), (2, 0), (9, 1)]
    for values in ([1, 1], [1, 1, 1, 2], [1, 3, 3, 3]):
        with pytest.raises(checks.CheckFailed):
            splits.median_bin(spark.createDataFrame([(float(v),) for v in values], "v double"), "v", "b")


def test_export_policy(spark):
    df = spark.createDataFrame([("train",), ("val",), ("test",)], "split string")
    assert checks.exportable(df, ["train", "val"]).count() == 2
    with pytest.raises(ValueError):
        checks.exportable(df, ["test"])


def test_gap_fill(spark):
    genes = spark.createDataFrame([("1", 0, 9), ("1", 10, 20), ("1", 30, 40), ("2", 5, 99)], "chrom string, g_start long, g_end long")
    lengths = spark.createDataFrame([("1", 100), ("2", 100), ("3", 50)], "chrom string, length long")
    out = sorted(tuple(r) for r in intervals.gap_fill_intervals(genes, lengths).collect())
    assert out == [
        ("1", 0, 9, "gene"), ("1", 10, 20, "gene"), ("1", 21, 29, "non-gene"), ("1", 30, 40, "gene"),
        ("1", 41, 100, "non-gene"), ("2", 0, 4, "non-gene"), ("2", 5, 99, "gene"), ("3", 0, 50, "non-gene"),
    ]


def test_overlapping_intervals_take_lowest_start(spark):
    spans = spark.createDataFrame([("1", 0, 100, "gene"), ("1", 50, 60, "gene")], "chrom string, start long, end long, kind string")
    where = spark.createDataFrame([(0, "chr1", 55), (1, "1.0", 101)], "marker_idx int, chrom string, pos long")
    out = {r.marker_idx: r.start for r in intervals.locate_in_interval(where, spans).collect()}
    assert out == {0: 0, 1: None}
    genes = spans.toDF("chrom", "g_start", "g_end", "kind")
    assert [r.g_start for r in intervals.overlapping_genes(genes).collect()] == [50]


def test_locate_against_every_pair(spark):
    """Overlapping, nested, equal and empty intervals, one of 250 million positions, and markers without a place."""
    import random

    rng = random.Random(5)
    spans = [(rng.choice(["chr1", "2"]), a := rng.randrange(300), a + rng.randrange(-3, 60), rng.choice(["gene", "non-gene"])) for _ in range(60)]
    spans += [("3", 0, 250_000_000, "non-gene"), ("3", 5, 9, "gene"), (None, 0, 400, "gene"), ("1", None, 400, "gene"), spans[0]]
    points = [(i, rng.choice(["1", "chr2", "3.0", "4"]), rng.randrange(-5, 380)) for i in range(300)]
    points += [(300, "3", 249_999_999), (301, "3", 250_000_001), (302, None, 5), (303, "1", None), points[0]]
    marks = spark.createDataFrame(points, "marker_idx int, chrom string, pos long")
    table = spark.createDataFrame(spans, "chrom string, start long, end long, kind string")

    def best(chrom, pos):
        plain = lambda c: c and c.removeprefix("chr").removesuffix(".0")
        held = [
            (s, -e, k) for c, s, e, k in spans
            if None not in (c, s, chrom, pos) and plain(c) == plain(chrom) and s <= pos <= e
        ]
        if not held:
            return None, None, None
        s, e, k = min(held)
        return s, -e, k

    key = lambda r: tuple((x is None, x) for x in r)
    wanted = sorted(((*p, *best(p[1], p[2])) for p in points), key=key)
    assert sorted((tuple(r) for r in intervals.locate_in_interval(marks, table).collect()), key=key) == wanted
    inner = intervals.locate_in_interval(marks, table, "inner").collect()
    assert sorted((tuple(r) for r in inner), key=key) == [r for r in wanted if r[3] is not None]
    assert intervals.locate_in_interval(marks, table.limit(0)).where("start IS NOT NULL").isEmpty()
    assert intervals.locate_in_interval(marks.limit(0), table).isEmpty()


def test_early_stop(spark):
    scores = [0.1, 0.5, 0.55, 0.4, 0.58, 0.9, 0.2, 0.2, 0.2, 0.95]
    df = spark.createDataFrame([("r", e, s) for e, s in enumerate(scores)] + [("q", 0, 1.0)], "run string, epoch int, score double")
    out = {r.run: r for r in epochs.early_stop_min_delta(df, 4, 0.1).collect()}
    assert (out["r"].best_epoch, out["r"].stop_epoch) == (5, 9) and out["q"].stop_epoch is None
    short = {r.run: r for r in epochs.early_stop_min_delta(df, 3, 0.1).collect()}
    assert (short["r"].best_epoch, short["r"].stop_epoch) == (1, 4)


def test_best_epoch_is_first_of_ties(spark):
    df = spark.createDataFrame([("r", "t", e, s) for e, s in enumerate([0.1, 0.7, 0.7, 0.2])], "run string, trait string, epoch int, score double")
    assert epochs.best_epoch(df).first().epoch == 1
    best = [r.best_so_far for r in epochs.running_best(df).orderBy("epoch").collect()]
    assert best == [0.1, 0.7, 0.7, 0.7]


def brute_scale(values, form):
    moved = [form(v) if v > 0 else 0.0 for v in values]
    low, high = min(moved), max(moved)
    return [0.0 if high - low < 1e-10 else (m - low) / (high - low + 1e-10) for m in moved]


@pytest.mark.parametrize("values", [
    [0.0, 1.0, 4.0, 9.0], [0.5, 0.25, 2.0], [-1.0, -2.0], [3.0, 3.0], [0.0, 0.001, 5.0], [-1.0, 0.2, 0.7],
    [1.0, 1.0, 1.0, 1.0, 100.0], [1.0, 3.0, 4.0, 4.0, 20.0],
])
def test_scalings(spark, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double")
    positive = sorted(v for v in values if v > 0)

    def got(out):
        return [r.scaled for r in out.orderBy("i").collect()]

    least = positive[0] if positive else 1.0
    log = brute_scale(values, lambda v: math.log(v + least / 10))
    root = brute_scale(values, math.sqrt)
    low, high = min(values), max(values)
    plain = [0.0 if high - low < 1e-10 else (v - low) / (high - low + 1e-10) for v in values]
    assert got(scaling.log_scale(df, "v")) == pytest.approx(log)
    assert got(scaling.power_scale(df, "v")) == pytest.approx(root)
    assert got(scaling.minmax(df, "v")) == pytest.approx(plain)
    if not positive:
        expected = [0.0] * len(values)
    else:
        half = len(positive) // 2
        middle = positive[half] if len(positive) % 2 else (positive[half - 1] + positive[half]) / 2
        mean = sum(positive) / len(positive)
        expected = log if mean > 2 * middle else root if positive[-1] > 5 * middle else plain
    assert got(scaling.adaptive_scale(df, "v")) == pytest.approx(expected)


def test_quantile_normal(spark):
    from statistics import NormalDist

    values = [0.0, 1.0, 2.0, 2.0, 5.0, 7.0, 8.0]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double")
    got = [r.scaled for r in scaling.quantile_normal(df, "v").orderBy("i").collect()]
    shares = [0, 1, 2.5, 2.5, 4, 5, 6]
    z = [NormalDist().inv_cdf(min(max(s / 6, 1e-7), 1 - 1e-7)) for s in shares]
    assert got == pytest.approx([(x - z[0]) / (z[-1] - z[0]) for x in z], abs=1e-6)
    zeros = spark.createDataFrame([(i, v) for i, v in enumerate([0.0] * 5 + [1.0, 3.0, 9.0])], "i int, v double")
    got = [r.scaled for r in scaling.quantile_normal(zeros, "v").orderBy("i").collect()]
    assert got == pytest.approx([0.0] * 5 + [0.0, 0.5, 1.0], abs=1e-6)


def test_zscore_and_mixed(spark):
    df = spark.createDataFrame([("a", 1.0, 0), ("a", 2.0, 0), ("a", 3.0, 0), ("a", 9.0, 1), ("b", 0.0, 0), ("b", 1.0, 1)], "trait string, v double, f int")
    out = scaling.zscore(df, "v", F.col("f") == 0, ["trait"]).where("trait = 'a'").first()
    assert out["mean"] == 2.0 and out.sd == pytest.approx(math.sqrt(2 / 3))
    mixed = scaling.mixed_trait_scale(df, "v", "trait", F.col("f") == 0, ["b"])
    assert sorted(r.scaled for r in mixed.where("trait = 'b'").collect()) == [0.0, 1.0]
    with pytest.raises(Exception, match="binary trait"):
        scaling.mixed_trait_scale(df, "v", "trait", F.col("f") == 0, ["a"]).collect()


def samples(spark, rows):
    return spark.createDataFrame(rows, "sample_id string, fid string, iid string, ord int")


def phenos(spark, ids):
    return spark.createDataFrame([(p, i) for i, p in enumerate(ids)], "pheno_id string, ord int")


def test_alignment_methods(spark):
    direct = samples(spark, [("a", "a", "a", 0), ("b", "b", "b", 1)])
    assert align.align_by_any_id(direct, phenos(spark, ["b", "z"]))[0] == "direct"
    longer = samples(spark, [("F1_p1", "F1", "p1", 0), ("F1_p12", "F1", "p12", 1), ("F2_q", "F2", "q", 2)])
    method, pairs = align.align_by_any_id(longer, phenos(spark, ["p1", "p12", "nothing"]))
    assert method == "pheno_subset"
    assert {r.sample_id: r.pheno_id for r in pairs.collect()} == {"F1_p1": "p1", "F1_p12": "p1"}
    shorter = samples(spark, [("s1", "s1", "s1", 0), ("s2", "s2", "s2", 1)])
    method, pairs = align.align_by_any_id(shorter, phenos(spark, ["xs1", "xs2y", "xs1z"]))
    assert method == "geno_subset"
    assert {r.sample_id: r.pheno_id for r in pairs.collect()} == {"s1": "xs1z", "s2": "xs2y"}
    mixed = samples(spark, [(f"g{i}", f"f{i}", f"i{i}", i) for i in range(6)])
    method, pairs = align.align_by_any_id(mixed, phenos(spark, ["i3", "i5"]))
    assert method == "iid_only" and sorted(r.sample_id for r in pairs.collect()) == ["g3", "g5"]


def test_alias_must_hit_once(spark):
    fam = spark.createDataFrame([(0, "f", "i"), (1, "f", "j"), (2, "x", "f_i")], "sample_idx int, fid string, iid string")
    wanted = spark.createDataFrame([("f:j",), ("f_i",), ("zz",)], "sample_id string")
    out = {r.sample_id: (r.n_hits, r.sample_idx) for r in align.align_alias(wanted, fam).collect()}
    assert out == {"f:j": (1, 1), "f_i": (2, None), "zz": (0, None)}


def test_selection_errors(spark):
    df = spark.createDataFrame([(1, 2.0, 3.0)], "sample_id int, Bw double, LE double")
    assert align.select_traits(df, ["bw", "LE"]).columns == ["sample_id", "Bw", "LE"]
    with pytest.raises(checks.CheckFailed):
        align.select_traits(df, ["height"])
    with pytest.raises(checks.CheckFailed):
        align.select_markers(spark.createDataFrame([(1, 1)], "marker_idx int, d int"), spark.createDataFrame([(9,)], "marker_idx int"))
    with pytest.raises(checks.CheckFailed):
        align.ordered_export(df, spark.createDataFrame([(1, 0), (2, 1)], "sample_id int, ord int"))


def test_context_faults(spark):
    f = spark.createDataFrame([(1, 0, "a", "train"), (1, 0, "b", "val")], "seed int, fold int, sample_id string, split string")
    good = f.withColumn("pcs", F.array(F.lit(1.0), F.lit(2.0)))
    assert align.attach_context(f, {"x": good, "y": good}).first().context == [1.0, 2.0, 1.0, 2.0]
    with pytest.raises(Exception, match="no covariates"):
        align.attach_context(f, {"x": good.where("sample_id = 'a'")}).collect()
    with pytest.raises(Exception, match="split differs"):
        align.attach_context(f, {"x": good.withColumn("split", F.lit("val"))}).collect()


def test_default_position_features(spark):
    df = spark.createDataFrame([(0, "3", "77"), (1, "X", "bad")], "marker_idx int, chrom string, pos string")
    out = [tuple(r) for r in intervals.default_position_features(df).orderBy("marker_idx").collect()]
    assert out == [(0, 3.0, 77.0, 77.0, 1000.0, 0.001, 0.5), (1, 0.0, 0.0, 0.0, 1000.0, 0.001, 0.5)]


def test_imputed_values_equal_the_filled_calls(spark):
    """The dictionary per fold says what filling every call says."""
    from pyspark.sql import functions as F

    stats = markers.train_marker_stats(calls(spark), folds(spark), 2)
    every = markers.impute_train(calls(spark), folds(spark), stats, "median")
    want = every.groupBy("seed", "fold", "split", "marker_idx").agg(F.count("*").alias("n"), F.sum("x").alias("total"))
    got = markers.split_sums(calls(spark), folds(spark), markers.imputed_values(stats, "median"), "x", 2)
    assert sorted(map(tuple, want.collect())) == sorted(map(tuple, got.select(want.columns).collect()))


@pytest.mark.parametrize("bad", [NAN, float("inf"), None])
def test_covariates_are_finite(spark, bad):
    folds = spark.createDataFrame([(1, 0, "a", "train"), (1, 0, "b", "train")], "seed int, fold int, sample_id string, split string")
    schema = "seed int, fold int, sample_id string, split string, pcs array<double>"
    source = spark.createDataFrame([(1, 0, "a", "train", [1.0, 2.0]), (1, 0, "b", "train", [1.0, bad])], schema)
    with pytest.raises(Exception, match="x: covariate not finite for sample b"):
        align.attach_context(folds, {"x": source}).collect()
    assert [r.sample_id for r in align.context_problems(folds, source).collect()] == ["b"]


def test_fold_members_are_dealt_to_many_tasks(spark, monkeypatch):
    """A task counts few members; duplicates and strangers are found as before."""
    monkeypatch.setattr(checks, "MEMBERS", 4)
    ids = spark.createDataFrame([(i,) for i in range(20)], "sample_id long")
    rows = [(1, f, i, "val" if i % 2 == f else "train") for f in (0, 1) for i in range(20)] + [(1, 0, 3, "train"), (1, 1, 99, "val")]
    folds = spark.createDataFrame(rows, "seed int, fold int, sample_id long, split string")
    got = {r.fold: r for r in checks.fold_membership(folds, ids).collect()}
    assert (got[0].n_train, got[0].n_val, got[0].n_duplicate, got[0].n_unknown) == (11, 10, 1, 0)
    assert (got[1].n_train, got[1].n_val, got[1].n_duplicate, got[1].n_unknown, got[1].n_absent) == (10, 11, 0, 1, 0)


def test_substrings_in_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(align, "OUTER_IDS", 3)
    outer = spark.createDataFrame([(f"n{i:03d}",) for i in range(20)] + [("n001",), (None,)], "name string")
    inner = spark.createDataFrame([(str(i), -i) for i in range(12)], "id string, ord int")
    got = {r.name: r.id for r in align.contains_match(outer, inner, "name", "id", "ord").collect()}
    assert got == {f"n{i:03d}": str(max(k for k in range(12) if str(k) in f"n{i:03d}")) for i in range(20)}


def test_holdout_is_sent_before_predictions_are_shuffled(spark, monkeypatch):
    """Neither a holdout row that comes twice counts twice, nor are predictions of others sent around."""
    preds = spark.range(0, 400, 1, 4).selectExpr("0 AS seed", "0 AS fold", "id AS sample_id", "id * 0.5 AS y_pred")
    truth = spark.range(400).selectExpr("id AS sample_id", "id * 0.4 AS y")
    held = spark.createDataFrame([(3,), (3,), (8,), (9,)], "sample_id long")
    monkeypatch.setattr(joins, "PLANNED_BYTES", 0)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = models.holdout_eval(preds, truth.withColumnRenamed("y", "y_true"), held.unionByName(held))
        assert [r.n for r in out.collect()] == [3]
        assert "BroadcastHashJoin" in out._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
