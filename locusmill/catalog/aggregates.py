"""Marker, interval, feature and metric aggregations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.codes import encode_channel
from ..operators import intervals, markers, metrics, profile, splits
from ..operators.checks import incomplete_grid
from ..plans.session import stable
from ..sources.views import calls, genes_intervals, panel, preds, raw_calls, val_folds, view
from .registry import query

FREQ = (
    "SELECT marker_idx, count(dosage) AS n_called, count(dosage) / count(*) AS call_rate,"
    " sum(dosage) / (2 * nullif(count(dosage), 0)) AS p FROM v_calls GROUP BY marker_idx"
)
FREQ_MAF = f"SELECT *, least(p, 1 - p) AS maf FROM ({FREQ})"


@query("a01_marker_allele_freq", FREQ_MAF, ["calls"], ["call_rate", "p", "maf"])
def _(spark, d):
    return markers.marker_allele_freq(calls(spark, d))


AUDIT_ROWS = (
    f", f AS ({FREQ_MAF}), e AS (SELECT abs(maf - maf_ref) AS err, abs(p - maf_ref) AS direct"
    " FROM f JOIN v_markers USING (marker_idx) WHERE p IS NOT NULL) "
)


@query(
    "a02_maf_audit",
    AUDIT_ROWS + "SELECT *, NOT (median_err > 1e-2 OR within < 9e-1) AS passes FROM (SELECT count(*) AS n_markers,"
    " quantile_cont(err, 0.5) AS median_err, quantile_cont(err, 0.95) AS p95_err,"
    " avg(CASE WHEN err <= 2e-2 THEN 1 ELSE 0 END) AS within FROM e)",
    ["calls", "markers"], ["median_err", "p95_err", "within"],
)
def _(spark, d):
    return markers.maf_audit(markers.marker_allele_freq(calls(spark, d)), view(spark, d, "markers"))


@query(
    "a03_orientation_audit",
    AUDIT_ROWS + "SELECT *, direct_rate >= 9e-1 AS passes FROM (SELECT count(*) AS n_markers,"
    " avg(CASE WHEN direct <= 2e-2 THEN 1 ELSE 0 END) AS direct_rate FROM e)",
    ["calls", "markers"], ["direct_rate"],
)
def _(spark, d):
    return markers.orientation_audit(markers.marker_allele_freq(calls(spark, d)), view(spark, d, "markers"))


@query("a04_call_code_counts", "SELECT code, count(*) AS n FROM v_raw_calls GROUP BY code", ["raw_calls"])
def _(spark, d):
    return markers.call_code_counts(raw_calls(spark, d))


PAIR = (
    "CASE dosage WHEN 0 THEN a1 || a1 WHEN 1 THEN least(a1, a2) || greatest(a1, a2) WHEN 2 THEN a2 || a2 END"
)
CHANNEL = (
    f"CASE {PAIR} WHEN 'AA' THEN 0 WHEN 'AT' THEN 1 WHEN 'AC' THEN 2 WHEN 'AG' THEN 3 WHEN 'TT' THEN 4"
    " WHEN 'CT' THEN 5 WHEN 'GT' THEN 6 WHEN 'CC' THEN 7 WHEN 'CG' THEN 8 WHEN 'GG' THEN 9 END"
)
ENCODED = f"SELECT sample_id, marker_idx, a1, a2, dosage, {CHANNEL} AS channel FROM v_calls JOIN v_markers USING (marker_idx)"


def encoded(spark, d):
    both = calls(spark, d).join(view(spark, d, "markers").select("marker_idx", "a1", "a2"), "marker_idx")
    return both.select("sample_id", "marker_idx", "a1", "a2", "dosage",
                       encode_channel("a1", "a2", "dosage").alias("channel"))


@query(
    "a05_channel_counts",
    f", e AS ({ENCODED}) SELECT cast(c.channel AS int) AS channel, count(e.channel) AS n"
    " FROM (SELECT unnest(range(10)) AS channel) c LEFT JOIN e ON e.channel = c.channel GROUP BY c.channel",
    ["calls", "markers"],
)
def _(spark, d):
    return markers.channel_counts(encoded(spark, d))


FILL_SQL = (
    f", e AS ({ENCODED}), f AS ({{fill}}) SELECT sample_id, marker_idx, channel,"
    " coalesce(channel, fill) AS filled FROM e LEFT JOIN f USING (marker_idx)"
)


@query(
    "a06_marker_mode_fill",
    FILL_SQL.format(fill=(
        "SELECT marker_idx, channel AS fill FROM (SELECT marker_idx, channel, row_number() OVER (PARTITION BY"
        " marker_idx ORDER BY count(*) DESC, channel) AS r FROM e WHERE channel IS NOT NULL"
        " GROUP BY marker_idx, channel) WHERE r = 1")),
    ["calls", "markers"],
)
def _(spark, d):
    return markers.marker_fill(encoded(spark, d).select("sample_id", "marker_idx", "channel"), "mode")


@query(
    "a06_marker_mean_fill",
    FILL_SQL.format(fill="SELECT marker_idx, cast(round_even(avg(channel), 0) AS int) AS fill FROM e GROUP BY marker_idx"),
    ["calls", "markers"],
)
def _(spark, d):
    return markers.marker_fill(encoded(spark, d).select("sample_id", "marker_idx", "channel"), "mean")


TRAIN_SQL = (
    ", c AS (SELECT seed, val_fold, sample_id, marker_idx, dosage FROM v_panel JOIN v_panel_folds USING (sample_id)),"
    " s AS (SELECT seed, f.fold, marker_idx, {stat} AS fill FROM c CROSS JOIN (SELECT cast(unnest(range(5)) AS int) AS fold) f"
    " WHERE f.fold <> val_fold GROUP BY seed, f.fold, marker_idx)"
    " SELECT seed, fold, sample_id, marker_idx, CASE WHEN fold = val_fold THEN 'val' ELSE 'train' END AS split,"
    " coalesce(cast(dosage AS double), fill{tail}) AS x FROM c JOIN s USING (seed, marker_idx)"
)


def _train(spark, d):
    rows = panel(spark, d)
    folds = val_folds(rows.select("sample_id").distinct())
    return rows, folds, markers.train_marker_stats(rows, folds, 5)


def split_sums_sql(body: str, value: str) -> str:
    """Sums per seed, fold, split and marker of what ``body`` says about every call."""
    head, _, tail = body.rpartition(" SELECT seed, fold, sample_id")
    return (f"{head}, every AS (SELECT seed, fold, sample_id{tail}) SELECT seed, fold, split, marker_idx, count(*) AS n,"
            f" sum({value}) AS total, sum({value} * {value}) AS squares FROM every GROUP BY ALL")


SUMS = ["total", "squares"]


@query("a07_train_median_impute", split_sums_sql(TRAIN_SQL.format(stat="median(dosage)", tail=", 0"), "x"), ["panel", "panel_folds"], SUMS)
def _(spark, d):
    rows, folds, stats = _train(spark, d)
    return markers.split_sums(rows, folds, markers.imputed_values(stats, "median"), "x", 5)


@query("a08_train_mean_impute", split_sums_sql(TRAIN_SQL.format(stat="avg(dosage)", tail=""), "x"), ["panel", "panel_folds"], SUMS)
def _(spark, d):
    rows, folds, stats = _train(spark, d)
    return markers.split_sums(rows, folds, markers.imputed_values(stats, "mean"), "x", 5)


INTERVALS = (
    ", len AS (SELECT chrom, max(pos) + 1000 AS length FROM v_markers GROUP BY chrom),"
    " g AS (SELECT genes.*, length, lag(g_end) OVER (PARTITION BY chrom ORDER BY g_start) AS prev_end,"
    " lead(g_start) OVER (PARTITION BY chrom ORDER BY g_start) AS next_start FROM v_genes genes JOIN len USING (chrom)),"
    " iv AS (SELECT chrom, g_start AS start, g_end AS \"end\", 'gene' AS kind FROM g"
    " UNION ALL SELECT chrom, 0, g_start - 1, 'non-gene' FROM g WHERE prev_end IS NULL AND g_start > 0"
    " UNION ALL SELECT chrom, prev_end + 1, g_start - 1, 'non-gene' FROM g WHERE g_start - prev_end > 1"
    " UNION ALL SELECT chrom, g_end + 1, length, 'non-gene' FROM g WHERE next_start IS NULL AND g_end < length - 1"
    " UNION ALL SELECT chrom, 0, length, 'non-gene' FROM len WHERE chrom NOT IN (SELECT chrom FROM v_genes)),"
    " loc AS (SELECT m.marker_idx, m.chrom, m.pos, iv.start, iv.\"end\", iv.kind FROM v_markers m LEFT JOIN iv"
    " ON m.chrom = iv.chrom AND m.pos BETWEEN iv.start AND iv.\"end\") "
)


@query(
    "a09_interval_marker_counts",
    INTERVALS + "SELECT chrom, start, \"end\", count(*) AS snp_count FROM loc WHERE start IS NOT NULL GROUP BY ALL",
    ["markers", "genes"],
)
def _(spark, d):
    located = intervals.locate_in_interval(view(spark, d, "markers"), genes_intervals(spark, d))
    return intervals.interval_marker_counts(located)


@query(
    "a10_interval_counts",
    INTERVALS + "SELECT coalesce(chrom, 'all') AS chrom, count(*) AS total, count(*) FILTER (kind = 'gene') AS gene,"
    " count(*) FILTER (kind <> 'gene') AS non_gene FROM iv GROUP BY GROUPING SETS ((chrom), ())",
    ["markers", "genes"],
)
def _(spark, d):
    return intervals.interval_counts(genes_intervals(spark, d))


@query(
    "a10_interval_lengths",
    INTERVALS + ", l AS (SELECT kind, \"end\" - start + 1 AS len FROM iv UNION ALL SELECT 'all', \"end\" - start + 1 FROM iv),"
    " r AS (SELECT kind, len, row_number() OVER (PARTITION BY kind ORDER BY len) - 1 AS i, count(*) OVER (PARTITION BY kind) AS n FROM l)"
    " SELECT kind, count(*) AS n, min(len) AS min, max(len) AS max, avg(len) AS mean,"
    " max(len) FILTER (i = n // 2) AS median FROM r GROUP BY kind",
    ["markers", "genes"], ["mean"],
)
def _(spark, d):
    return intervals.interval_lengths(genes_intervals(spark, d))


DIMS = ["quantity", "price", "discount", "tax", "flat"]


def _dim_sql(keys: str = "") -> str:
    sep = f"{keys}, " if keys else ""
    group = f" GROUP BY {keys}" if keys else ""
    return " UNION ALL ".join(
        f"SELECT {sep}'{c}' AS dim, count({c}) AS n, min({c}) AS min, max({c}) AS max, avg({c}) AS mean,"
        f" stddev_pop({c}) AS sd, count(*) FILTER ({c} <> 0) AS n_nonzero FROM v_features{group}" for c in DIMS
    )


@query("a11_feature_dim_stats", _dim_sql(), ["features"], ["min", "max", "mean", "sd"])
def _(spark, d):
    return profile.feature_dim_stats(view(spark, d, "features"), DIMS)


CORR_SQL = ", cc AS (" + " UNION ALL ".join(
    f"SELECT '{a}' AS dim_a, '{b}' AS dim_b, covar_pop({a}, {b}) AS c, stddev_pop({a}) AS sa, stddev_pop({b}) AS sb FROM v_features"
    for i, a in enumerate(DIMS) for b in DIMS[i + 1:]
) + "), r AS (SELECT dim_a, dim_b, c / (sa * sb) AS r FROM cc WHERE sa > 1e-8 AND sb > 1e-8) "


@query("a12_feature_correlations", CORR_SQL + "SELECT * FROM r", ["features"], ["r"])
def _(spark, d):
    return profile.feature_correlations(view(spark, d, "features"), DIMS)


@query(
    "a12_correlation_summary",
    CORR_SQL + "SELECT min(r) AS min, max(r) AS max, avg(r) AS mean, avg(abs(r)) AS abs_mean,"
    " 4 AS valid_dims_count, 1 AS invalid_dims_count, 'flat' AS invalid_dims FROM r",
    ["features"], ["min", "max", "mean", "abs_mean"],
)
def _(spark, d):
    return profile.correlation_summary(view(spark, d, "features"), DIMS)


@query("a13_chrom_feature_stats", _dim_sql("chrom"), ["features"], ["min", "max", "mean", "sd"])
def _(spark, d):
    return profile.feature_dim_stats(view(spark, d, "features"), DIMS, ["chrom"])


PERC = ", ".join(f"quantile_cont(price, {p / 100}) FILTER (price > 0) AS p{p}" for p in profile.PERCENTILES)
PROFILE_COLUMNS = [f"p{p}" for p in profile.PERCENTILES] + ["mean", "sd", "positive_share", "median", "skew"]


@query(
    "a14_distribution_profile",
    f"SELECT *, CASE WHEN skew > 2 THEN 'log' WHEN skew < -2 THEN 'sqrt' ELSE 'none' END AS advice FROM (SELECT *,"
    f" CASE WHEN sd > 0 THEN 3 * (mean - p50) / sd END AS skew FROM (SELECT chrom, count(*) AS n,"
    f" count(*) FILTER (price > 0) AS n_positive, avg(price) FILTER (price > 0) AS mean,"
    f" stddev_pop(price) FILTER (price > 0) AS sd, {PERC}, count(*) FILTER (price > 0) / count(*) AS positive_share,"
    " quantile_cont(price, 0.5) FILTER (price > 0) AS median FROM v_features GROUP BY chrom))",
    ["features"], PROFILE_COLUMNS,
)
def _(spark, d):
    return profile.distribution_profile(view(spark, d, "features"), "price", ["chrom"])


WEIGHTS = (
    "SELECT marker_idx, code, n, -ln(n / sum(n) OVER (PARTITION BY marker_idx)) AS weight FROM"
    " (SELECT marker_idx, code, count(*) AS n FROM v_raw_calls GROUP BY marker_idx, code)"
)


@query(
    "a15_genotype_value_stats",
    f", w AS (SELECT weight FROM v_raw_calls JOIN ({WEIGHTS}) USING (marker_idx, code))"
    " SELECT 'all' AS block, count(*) AS count, min(weight) AS min, max(weight) AS max, avg(weight) AS mean,"
    " stddev_pop(weight) AS sd FROM w UNION ALL SELECT 'non_zero', count(*), min(weight), max(weight), avg(weight),"
    " stddev_pop(weight) FROM w WHERE weight > 0",
    ["raw_calls"], ["min", "max", "mean", "sd"],
)
def _(spark, d):
    return markers.genotype_value_stats(markers.call_information_weight(raw_calls(spark, d)))


@query("a16_call_information_weight", WEIGHTS, ["raw_calls"], ["weight"])
def _(spark, d):
    return markers.call_information_weight(raw_calls(spark, d))


@query(
    "a16_weighted_calls",
    f"SELECT sample_id, marker_idx, code, weight FROM v_raw_calls JOIN ({WEIGHTS}) USING (marker_idx, code)",
    ["raw_calls"], ["weight"],
)
def _(spark, d):
    codes = stable(raw_calls(spark, d))
    return markers.weighted_calls(codes, markers.call_information_weight(codes))


METRIC_SQL = (
    "count(*) AS n, CASE WHEN var_pop(y_true) > 0 AND var_pop(y_pred) > 0 THEN covar_pop(y_true, y_pred)"
    " / sqrt(var_pop(y_true) * var_pop(y_pred)) ELSE 'nan'::double END AS pearson, avg((y_pred - y_true) ** 2) AS mse,"
    " sqrt(avg((y_pred - y_true) ** 2)) AS rmse, avg(abs(y_pred - y_true)) AS mae,"
    " CASE WHEN var_pop(y_true) > 0 THEN 1 - avg((y_pred - y_true) ** 2) / var_pop(y_true) ELSE 'nan'::double END AS r2,"
    " CASE WHEN var_pop(y_true) > 0 AND count(*) > 1 THEN sqrt(var_pop(y_pred) / var_pop(y_true)) ELSE 'nan'::double END AS sd_ratio"
)
FOLD_SQL = f"SELECT model, trait, seed, fold, {METRIC_SQL} FROM v_preds GROUP BY model, trait, seed, fold"
KEYS = ["model", "trait", "seed", "fold"]


def fold_metrics(spark, d):
    return metrics.regression_metrics(preds(spark, d), KEYS)


@query("a17_regression_metrics", FOLD_SQL, ["preds"], metrics.METRICS)
def _(spark, d):
    return fold_metrics(spark, d)


@query(
    "a18_extended_metrics",
    f"SELECT * EXCLUDE (sd_ratio) FROM (SELECT model, trait, avg(y_pred) AS pred_mean, avg(y_true) AS true_mean,"
    f" stddev_samp(y_pred) AS pred_sd, stddev_samp(y_true) AS true_sd, {METRIC_SQL} FROM v_preds GROUP BY model, trait)",
    ["preds"], ["pred_mean", "true_mean", "pred_sd", "true_sd", "pearson", "mse", "mae", "rmse", "r2"],
)
def _(spark, d):
    out = metrics.extended_metrics(preds(spark, d), ["model", "trait"])
    return out


LONG_SQL = (
    f", f AS ({FOLD_SQL}), l AS (" + " UNION ALL ".join(
        f"SELECT model, trait, seed, fold, '{m}' AS metric, {m} AS value FROM f" for m in metrics.METRICS) + ") "
)
SETS = "FROM l GROUP BY GROUPING SETS ((model, trait, metric, seed), (model, trait, metric))"


@query(
    "a19_summarize_metrics",
    LONG_SQL + "SELECT model, trait, CASE WHEN grouping(seed) = 1 THEN 'overall' ELSE 'seed' || seed END AS scope,"
    f" metric, count(*) AS n, avg(value) AS mean, stddev_samp(value) AS sd {SETS}",
    ["preds"], ["mean", "sd"],
)
def _(spark, d):
    return metrics.summarize_metrics(fold_metrics(spark, d))


@query(
    "a19_undefined_folds",
    LONG_SQL + "SELECT model, trait, CASE WHEN grouping(seed) = 1 THEN 'overall' ELSE 'seed' || seed END AS scope,"
    f" metric, count(*) AS n, avg(value) FILTER (metric <> 'pearson' OR seed <> 1 OR fold <> 2) AS mean,"
    f" stddev_samp(value) FILTER (metric <> 'pearson' OR seed <> 1 OR fold <> 2) AS sd {SETS}",
    ["preds"], ["mean", "sd"],
)
def _(spark, d):
    """One fold without a defined correlation is left out of mean and SD."""
    planted = F.when((F.col("seed") == 1) & (F.col("fold") == 2), F.lit(float("nan"))).otherwise(F.col("pearson"))
    return metrics.summarize_metrics(fold_metrics(spark, d).withColumn("pearson", planted))


@query(
    "a20_summarize_valid_counts",
    LONG_SQL + "SELECT model, trait, CASE WHEN grouping(seed) = 1 THEN 'overall' ELSE 'seed' || seed END AS scope,"
    " metric, count(*) AS n_total, count(*) FILTER (NOT isnan(value)) AS n_valid, count(*) FILTER (isnan(value)) AS n_nan,"
    f" avg(value) FILTER (NOT isnan(value)) AS mean, stddev_samp(value) FILTER (NOT isnan(value)) AS sd {SETS}",
    ["preds"], ["mean", "sd"],
)
def _(spark, d):
    return metrics.summarize_valid_counts(fold_metrics(spark, d))


WIDE = ["pearson_bw", "mse_bw", "pearson_le", "mse_le"]
_cells = ", ".join(
    f"max({m}) FILTER (trait = '{t}') AS {m}_{t}" for t in ("bw", "le") for m in ("pearson", "mse"))
_means = ", ".join(f"avg({c}) AS {c}" for c in WIDE)


@query(
    "a21_wide_fold_report",
    f", f AS ({FOLD_SQL}), w AS (SELECT model, seed, fold, {_cells} FROM f GROUP BY model, seed, fold),"
    f" s AS (SELECT model, seed, {_means} FROM w GROUP BY model, seed)"
    f" SELECT 'fold' AS level, model, seed, fold, {', '.join(WIDE)} FROM w"
    f" UNION ALL SELECT 'seed_mean', model, seed, NULL, {', '.join(WIDE)} FROM s"
    f" UNION ALL SELECT 'all_mean', model, NULL, NULL, {_means} FROM s GROUP BY model",
    ["preds"], WIDE,
)
def _(spark, d):
    return metrics.wide_fold_report(fold_metrics(spark, d), ["bw", "le"])


@query(
    "a22_seed_overall_summary",
    LONG_SQL + "SELECT model, trait, CASE WHEN grouping(seed) = 1 THEN 'all' ELSE cast(seed AS varchar) END AS seed,"
    f" metric, count(*) AS n, avg(value) AS mean, stddev_samp(value) AS sd {SETS}",
    ["preds"], ["mean", "sd"],
)
def _(spark, d):
    return metrics.seed_overall_summary(fold_metrics(spark, d), 5, 3)


@query(
    "a23_check_grid_complete",
    f", f AS (SELECT model, trait, seed, fold, count(*) AS n_rows FROM v_preds GROUP BY ALL),"
    " w AS (SELECT model, trait, s.seed, o.fold FROM (SELECT DISTINCT model, trait FROM v_preds) k,"
    " (SELECT unnest([1, 2, 3, 4]) AS seed) s, (SELECT unnest([0, 1, 2, 3]) AS fold) o)"
    " SELECT model, trait, seed, fold, coalesce(n_rows, 0) AS n_rows, w.seed IS NOT NULL AS expected"
    " FROM (SELECT *, 1 AS one FROM w) w FULL JOIN (SELECT model, trait, seed, fold, 1 AS n_rows FROM f) f"
    " USING (model, trait, seed, fold) WHERE one IS NULL OR coalesce(n_rows, 0) <> 1",
    ["preds"],
)
def _(spark, d):
    """Against a grid that is too wide in seeds and too narrow in folds, so both kinds of gap show."""
    return incomplete_grid(fold_metrics(spark, d), ["model", "trait"], (1, 2, 3, 4), (0, 1, 2, 3))


@query(
    "a24_strata_counts",
    ", b AS (SELECT surv || '_' || CASE WHEN bw <= (SELECT median(bw) FROM v_samples) THEN 0 ELSE 1 END AS stratum"
    " FROM v_samples) SELECT stratum, count(*) AS n FROM b GROUP BY stratum",
    ["samples"],
)
def _(spark, d):
    binned = splits.median_bin(view(spark, d, "samples"), "bw", "bin")
    return splits.strata_counts(splits.joint_strata(binned, "surv", "bin"))


TRAITS = ["bw", "le", "surv"]


@query(
    "a25_trait_correlation_matrix",
    " UNION ALL ".join(
        f"SELECT '{a}' AS trait_a, '{b}' AS trait_b, greatest(-1, least(1, covar_samp({a}, {b}) / (stddev_samp({a}) * stddev_samp({b})))) AS r"
        " FROM v_samples JOIN v_sample_folds USING (sample_id) WHERE seed = 1 AND val_fold <> 0" for a in TRAITS for b in TRAITS),
    ["samples", "sample_folds"], ["r"],
)
def _(spark, d):
    """Training rows of seed 1, fold 0."""
    samples = view(spark, d, "samples")
    folds = val_folds(samples.select("sample_id"), [1])
    return metrics.trait_correlation_matrix(samples.join(folds, "sample_id"), TRAITS, F.col("val_fold") != 0)


EPOCH_SQL = (
    ", p AS (SELECT fold, trait, y_true, CASE WHEN trait = 'le' THEN 1 / (1 + exp(-y_pred)) ELSE y_pred END AS y_pred FROM v_preds),"
    " s AS (SELECT fold, trait, true AS valid, covar_pop(y_true, y_pred) / sqrt(var_pop(y_true) * var_pop(y_pred)) AS score"
    " FROM p GROUP BY fold, trait) "
)


@query("a26_epoch_score", EPOCH_SQL + "SELECT * FROM s", ["preds"], ["score"])
def _(spark, d):
    return metrics.epoch_score(preds(spark, d), ["fold"], ["le"])[0]


@query(
    "a26_epoch_mean_score",
    EPOCH_SQL + "SELECT fold, avg(score) AS score, count(*) AS n_valid FROM s GROUP BY fold", ["preds"], ["score"])
def _(spark, d):
    return metrics.epoch_score(preds(spark, d), ["fold"], ["le"])[1]


@query(
    "a27_evaluation_losses",
    ", p AS (SELECT trait, count(*) AS n, sum((y_pred - y_true) ** 2) AS s, avg((y_pred - y_true) ** 2) AS mse,"
    " sum(ln((exp(y_pred - y_true) + exp(y_true - y_pred)) / 2 + 1e-12)) AS lc,"
    " (1 - covar_pop(y_true, y_pred) / sqrt(var_pop(y_true) * var_pop(y_pred))) ** 2 AS c FROM v_preds GROUP BY trait)"
    " SELECT sum(s) / sum(n) AS mse_mean, max(mse) AS mse_minimax, sum(lc) / sum(n) AS log_cosh,"
    " avg(c) AS corr_mean, max(c) AS corr_minimax FROM p",
    ["preds"], ["mse_mean", "mse_minimax", "log_cosh", "corr_mean", "corr_minimax"],
)
def _(spark, d):
    return metrics.evaluation_losses(preds(spark, d))


@query(
    "a29_strict_reread_audit",
    f", f AS ({FOLD_SQL}) SELECT model, trait, seed, fold, false AS one_sided, 1.0 AS max_diff FROM f WHERE fold = seed",
    ["preds"], ["max_diff"],
)
def _(spark, d):
    """The stored table carries a planted error of 1 in the MAE of some cells."""
    fresh = fold_metrics(spark, d)
    planted = F.when(F.col("fold") == F.col("seed"), F.col("mae") + 1).otherwise(F.col("mae"))
    return metrics.strict_reread_audit(preds(spark, d), fresh.withColumn("mae", planted), KEYS)


@query(
    "u04_concat_metrics",
    f", f AS ({FOLD_SQL}), h AS (SELECT model, trait, seed, count(*) AS n, avg(abs(y_pred - y_true)) AS mae FROM v_preds GROUP BY ALL)"
    " SELECT model, trait, seed, fold, n, pearson, mse, rmse, mae, r2, sd_ratio FROM f"
    " UNION ALL SELECT model, trait, seed, NULL, n, NULL, NULL, NULL, mae, NULL, NULL FROM h",
    ["preds"], metrics.METRICS,
)
def _(spark, d):
    short = metrics.regression_metrics(preds(spark, d), ["model", "trait", "seed"]).select(
        "model", "trait", "seed", "n", "mae")
    return metrics.concat_metrics([fold_metrics(spark, d), short])
