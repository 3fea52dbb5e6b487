"""Standardisation, components, relationship matrices and models."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.regression import LinearRegression
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import align, grid, markers, matrix, models
from ..plans.session import scratch_path, stable
from ..sources.views import N_FOLDS, panel, panel_trait, preds, table, val_folds, vectors
from .aggregates import METRIC_SQL, SUMS, split_sums_sql
from .joins import CENTRED, PAIRS
from .registry import query

STANDARD = (
    ", c AS (SELECT seed, val_fold, sample_id, marker_idx, dosage FROM v_panel JOIN v_panel_folds USING (sample_id)),"
    " s AS (SELECT seed, f.fold, marker_idx, avg(dosage) AS mu, stddev_pop(dosage) AS sd FROM c CROSS JOIN"
    " (SELECT cast(unnest(range(5)) AS int) AS fold) f WHERE f.fold <> val_fold GROUP BY seed, f.fold, marker_idx) "
)


def panel_stats(spark, d, seeds=(1, 2, 3)):
    rows = panel(spark, d)
    folds = val_folds(rows.select("sample_id").distinct(), seeds)
    return rows, folds, markers.train_marker_stats(rows, folds, N_FOLDS)


def first_fold(spark, d):
    """Seed 1, fold 0."""
    rows, folds, stats = panel_stats(spark, d, (1,))
    return rows, folds, stats.where("fold = 0")


@query(
    "m02_fold_standardize",
    split_sums_sql(
        STANDARD + "SELECT seed, fold, sample_id, marker_idx, CASE WHEN fold = val_fold THEN 'val' ELSE 'train' END AS split,"
        " coalesce((dosage - mu) / CASE WHEN sd > 0 THEN sd ELSE 1 END, 0) AS z FROM c JOIN s USING (seed, marker_idx)", "z"),
    ["panel", "panel_folds"], SUMS)
def _(spark, d):
    rows, folds, stats = panel_stats(spark, d)
    return markers.split_sums(rows, folds, matrix.standard_values(stats), "z", N_FOLDS)


@query("m03_fold_pca")
def _(spark, d):
    """Scores of all fifteen fits."""
    scores, _, _ = matrix.fold_pca(*panel_stats(spark, d), 8)
    return scores.withColumn("score", F.round("score", 6))


@query("m03_explained_variance")
def _(spark, d):
    _, _, variances = matrix.fold_pca(*panel_stats(spark, d), 8)
    return variances.select("seed", "fold", "component", F.round("ratio", 8).alias("ratio"))


@query(
    "m03_component_audit",
    STANDARD + ", t AS (SELECT seed, fold, marker_idx, coalesce((dosage - mu) / CASE WHEN sd > 0 THEN sd ELSE 1 END, 0) AS z"
    " FROM c JOIN s USING (seed, marker_idx) WHERE fold <> val_fold)"
    " SELECT seed, fold, cast(component AS int) AS component, total, TRUE AS orthonormal, TRUE AS eigenvector, TRUE AS falling FROM"
    " (SELECT seed, fold, sum(z * z) AS total FROM t GROUP BY seed, fold) CROSS JOIN (SELECT unnest(range(8)) AS component)",
    ["panel", "panel_folds"], ["total"])
def _(spark, d):
    """What components must satisfy, computed from the returned scores and loadings and the calls."""
    rows, folds, stats = panel_stats(spark, d)
    stats = stable(stats)
    scores, loadings, variances = matrix.fold_pca(rows, folds, stats, 8)
    loadings, cell = stable(loadings), ["seed", "fold"]
    one, two = loadings.alias("a"), loadings.alias("b")
    pairs = one.join(two, [*cell, "marker_idx"]).groupBy(*cell, F.col("a.component").alias("component"), F.col("b.component").alias("other"))
    product = pairs.agg(F.sum(F.col("a.loading") * F.col("b.loading")).alias("p"))
    off = F.abs(F.col("p") - F.when(F.col("component") == F.col("other"), 1.0).otherwise(0.0))
    unit = product.groupBy(*cell, "component").agg((F.max(off) < 1e-9).alias("orthonormal"))
    z = matrix.fold_standardize(rows, folds, stats).where("split = 'train'")
    image = z.join(scores.where("split = 'train'").select(*cell, "sample_id", "component", "score"), [*cell, "sample_id"])
    image = image.groupBy(*cell, "marker_idx", "component").agg(F.sum(F.col("z") * F.col("score")).alias("w"))
    length = F.col("ratio") * F.col("total")
    gap = image.join(loadings, [*cell, "marker_idx", "component"]).join(variances, [*cell, "component"])
    gap = gap.groupBy(*cell, "component").agg(F.max(F.abs(F.col("w") - length * F.col("loading")) / length).alias("gap"))
    order = variances.withColumn("falling", F.coalesce(F.col("ratio") <= F.lag("ratio").over(
        Window.partitionBy(*cell).orderBy("component")) + 1e-12, F.lit(True)))  # one row per component
    return order.join(unit, [*cell, "component"]).join(gap, [*cell, "component"]).select(
        *cell, "component", "total", "orthonormal", (F.col("gap") < 1e-8).alias("eigenvector"), "falling")


@query(
    "m04_pca_audit",
    ", s AS (SELECT sample_id, marker_idx AS component, value AS a, -value + (sample_id % 5) * 1e-3 AS b FROM v_vectors),"
    " t AS (SELECT component, CASE WHEN covar_pop(a, b) < 0 THEN -1 ELSE 1 END AS sign FROM s GROUP BY component)"
    " SELECT component, min(sign) < 0 AS flipped, covar_pop(a, b * sign) / sqrt(var_pop(a) * var_pop(b)) AS corr,"
    " sqrt(avg((a - b * sign) ** 2)) / stddev_pop(a) AS relative_rmse, max(abs(a - b * sign)) AS max_abs_error"
    " FROM s JOIN t USING (component) GROUP BY component",
    ["vectors"], ["corr", "relative_rmse", "max_abs_error"])
def _(spark, d):
    """Vector components against a flipped, slightly shifted copy."""
    stored = vectors(spark, d).select("sample_id", F.col("marker_idx").alias("component"), F.col("value").alias("score"))
    shifted = stored.withColumn("score", -F.col("score") + (F.col("sample_id") % 5) * 1e-3)
    return matrix.pca_audit(stored, shifted)


RELATION = (
    PAIRS.replace("sum(a.z * b.z) AS g", "round(sum(a.z * b.z) / (SELECT sum(mean * (1 - mean / 2)) FROM m), 8)"
                  " + CASE WHEN a.sample_id = b.sample_id THEN 0.01 ELSE 0 END AS g")
)


@query("m05_relationship_joint", CENTRED + RELATION, ["panel"], ["g"])
def _(spark, d):
    return matrix.genomic_relationship(panel(spark, d))


@query(
    "m05_relationship_training",
    CENTRED.replace("FROM v_panel GROUP BY", "FROM v_panel JOIN v_panel_folds USING (sample_id) WHERE seed = 1 AND val_fold <> 0 GROUP BY")
    + RELATION,
    ["panel", "panel_folds"], ["g"])
def _(spark, d):
    rows = panel(spark, d)
    train = val_folds(rows.select("sample_id").distinct(), [1]).where("val_fold <> 0").select("sample_id")
    return matrix.genomic_relationship(rows, train)


def panel_case(spark, d):
    """Panel, membership of seed 1 and the trait derived from the vectors."""
    rows = stable(panel(spark, d))
    folds = align.expand_folds(val_folds(rows.select("sample_id").distinct(), [1]), N_FOLDS)
    return rows, stable(folds), stable(panel_trait(spark, d))


RATIOS = (
    ", c AS (SELECT seed, val_fold, sample_id, marker_idx, dosage FROM v_panel JOIN v_panel_folds USING (sample_id)),"
    " f AS (SELECT cast(unnest(range(5)) AS int) AS fold),"
    " s AS (SELECT seed, fold, marker_idx, avg(dosage) AS mu FROM c CROSS JOIN f WHERE fold <> val_fold GROUP BY ALL),"
    " y0 AS (SELECT seed, fold, sample_id, y FROM v_panel_trait JOIN v_panel_folds USING (sample_id) CROSS JOIN f WHERE fold <> val_fold),"
    " y1 AS (SELECT *, y - avg(y) OVER (PARTITION BY seed, fold) AS r FROM y0),"
    " z AS (SELECT c.seed, s.fold, c.sample_id, marker_idx, coalesce(dosage - mu, 0) AS z, r FROM c JOIN s USING (seed, marker_idx)"
    " JOIN y1 ON y1.seed = c.seed AND y1.fold = s.fold AND y1.sample_id = c.sample_id WHERE s.fold <> val_fold),"
    " n AS (SELECT seed, fold, sample_id, sum(z * z) AS q, any_value(r) AS r FROM z GROUP BY ALL),"
    " b AS (SELECT seed, fold, marker_idx, sum(z * r) AS t FROM z GROUP BY ALL),"
    " g AS (SELECT a.seed, a.fold, a.marker_idx AS i, b.marker_idx AS j, sum(a.z * b.z) AS g FROM z a JOIN z b USING (seed, fold, sample_id) GROUP BY ALL),"
    " m AS (SELECT seed, fold, sum(mu * (1 - mu / 2)) AS d FROM s GROUP BY ALL),"
    " k AS (SELECT seed, fold, ((SELECT sum(t * t) FROM b WHERE b.seed = m.seed AND b.fold = m.fold)"
    " - (SELECT sum(q * r * r) FROM n WHERE n.seed = m.seed AND n.fold = m.fold)) / 2 / d"
    " / (((SELECT sum(g * g) FROM g WHERE g.seed = m.seed AND g.fold = m.fold)"
    " - (SELECT sum(q * q) FROM n WHERE n.seed = m.seed AND n.fold = m.fold)) / 2 / d / d)"
    " / (SELECT var_samp(r) FROM n WHERE n.seed = m.seed AND n.fold = m.fold) AS share FROM m)"
    " SELECT seed, fold, (1 - share) / share AS ratio, TRUE AS solved FROM k"
)


@query("m06_marker_effect_model")
def _(spark, d):
    """Predictions of all fifteen fits."""
    rows, folds, stats = panel_stats(spark, d)
    fits = models.marker_effect_fits(rows, folds, stable(stats), panel_trait(spark, d))
    return fits.predictions.withColumn("y_pred", F.round("y_pred", 6))


@query("m06_effect_audit", RATIOS, ["panel", "panel_folds", "panel_trait"], ["ratio"])
def _(spark, d):
    """Variance ratios, and whether the effects satisfy the normal equations, computed from the calls."""
    rows, folds, stats = panel_stats(spark, d)
    rows, folds, stats, trait = stable(rows), stable(folds), stable(stats), stable(panel_trait(spark, d))
    fits, cell = models.marker_effect_fits(rows, folds, stats, trait), ["seed", "fold"]
    named = [(*c, fits.ratios[c], fits.penalties[c]) for c in fits.ratios]
    wanted = spark.createDataFrame(named, "seed int, fold int, ratio double, penalty double")
    left = fits.predictions.join(folds, ["seed", "sample_id"]).where("val_fold <> fold").join(trait, "sample_id")
    left = left.select(*cell, "sample_id", (F.col("y") - F.col("y_pred")).alias("e"))
    z = matrix.fold_standardize(rows, folds, stats.withColumn("sd", F.lit(1.0))).where("split = 'train'")
    pull = z.join(left, [*cell, "sample_id"]).groupBy(*cell, "marker_idx").agg(F.sum(F.col("z") * F.col("e")).alias("w"))
    pull = pull.join(fits.effects, [*cell, "marker_idx"]).join(wanted, cell)
    want = F.col("penalty") * F.col("effect")
    off = F.sqrt(F.sum((F.col("w") - want) ** 2)) / F.sqrt(F.sum(F.col("w") ** 2))
    return pull.groupBy(*cell).agg(F.first("ratio").alias("ratio"), (off < 1e-8).alias("solved"))


@query("m07_boosted_trees_baseline")
def _(spark, d):
    """Twenty trees of the default depth and rate; the operator's default is 200."""
    rows, folds, stats = first_fold(spark, d)
    x = markers.impute_train(rows, folds, stats, "median").select("sample_id", "marker_idx", "x")
    train = folds.where("val_fold <> 0").select("sample_id")
    trait = panel_trait(spark, d).join(train, "sample_id", "left_semi")
    return models.boosted_trees_model(x, trait, trees=20).withColumn("y_pred", F.round("y_pred", 4))


@query("m08_score_frozen_model")
def _(spark, d):
    rows, folds, trait = panel_case(spark, d)
    train = folds.where("fold = 0 AND split = 'train'").select("sample_id")
    held = folds.where("fold = 0 AND split = 'val'").select("sample_id")
    means = stable(matrix.marker_means(rows.join(train, "sample_id", "left_semi")))
    y = trait.join(train, "sample_id", "left_semi")
    scale = y.agg(F.avg("y").alias("m"), F.stddev_pop("y").alias("s")).first()
    z = matrix.center_calls(rows, means)
    fitted = models.feature_vectors(z, "z").join(
        y.select("sample_id", ((F.col("y") - scale["m"]) / scale["s"]).alias("label")), "sample_id")
    model = Pipeline(stages=[LinearRegression(regParam=0.1)]).fit(fitted)
    path = scratch_path(spark, "frozen")
    models.save_frozen_model(model, means, scale["m"], scale["s"], path)
    return models.score_frozen_model(spark, path, rows, held).withColumn("y_pred", F.round("y_pred", 4))


def grid_case(spark, d):
    """Panel, folds of three seeds, and two traits: one from the vectors, one from the panel's own dosages."""
    rows = stable(panel(spark, d))
    folds = stable(val_folds(rows.select("sample_id").distinct()))
    own = rows.groupBy("sample_id").agg(F.sum(F.col("dosage") * (F.col("marker_idx") % 5 - 2)).cast("double").alias("y"))
    return rows, folds, {"vector": stable(panel_trait(spark, d)), "dosage": stable(own)}


@query(
    "m09_fold_grid_run",
    " SELECT 'ridge' AS model, t.trait, seed, val_fold AS fold, count(*) AS n, TRUE AS predicted FROM v_panel_folds"
    " CROSS JOIN (SELECT unnest(['vector', 'dosage']) AS trait) t GROUP BY ALL", ["panel_folds"])
def _(spark, d):
    """Three seeds, five folds, two traits: every cell once, over all its validation samples, better than chance on the whole."""
    rows, folds, truths = grid_case(spark, d)
    out = grid.fold_grid_run(rows, folds, truths, {"ridge": grid.ridge()}, [1, 2, 3], range(N_FOLDS), scratch_path(spark, "grid"))
    means = out.summary.where("metric = 'pearson' AND scope = 'overall'").select("model", "trait", (F.col("mean") > 0.05).alias("predicted"))
    return out.metrics.join(means, ["model", "trait"]).select("model", "trait", "seed", "fold", "n", "predicted")


@query("m09_trees_grid")
def _(spark, d):
    """Boosted trees on all fifteen cells, as many and as deep as the operator's defaults: 200 of depth 5."""
    rows, folds, truths = grid_case(spark, d)
    one = {"vector": truths["vector"]}
    out = grid.fold_grid_run(rows, folds, one, {"trees": grid.trees()}, [1, 2, 3], range(N_FOLDS), scratch_path(spark, "grid"))
    return out.metrics.select("model", "trait", "seed", "fold", "n", F.round("pearson", 3).alias("pearson"))


@query(
    "m08_score_stored_fits",
    " SELECT seed, cast(f.fold AS int) AS fold, count(*) AS n, TRUE AS same FROM v_panel_folds"
    " CROSS JOIN (SELECT unnest(range(5)) AS fold) f GROUP BY ALL", ["panel_folds"])
def _(spark, d):
    """Stored fits of all fifteen cells applied to every sample, against the predictions of the fit itself."""
    rows, folds, truths = grid_case(spark, d)
    path, one = scratch_path(spark, "grid"), {"vector": truths["vector"]}
    grid.fold_grid_run(rows, folds, one, {"ridge": grid.ridge()}, [1, 2, 3], range(N_FOLDS), path)
    scored = grid.score_stored(spark, path, "ridge", "vector", rows)
    published = grid.Ledger(spark, path).table("predictions").select("seed", "fold", "sample_id", F.col("y_pred").alias("want"))
    both = scored.join(published, ["seed", "fold", "sample_id"], "left")
    gap = F.coalesce(F.max(F.abs(F.col("want") - F.col("y_pred"))), F.lit(1.0))
    return both.groupBy("seed", "fold").agg(F.count("*").alias("n"), (gap < 1e-6).alias("same"))


@query(
    "m10_fold_leak_check",
    "SELECT seed, cast(unnest(range(5)) AS int) AS fold, (SELECT count(DISTINCT marker_idx) FROM v_panel) AS n_stats, 0 AS n_changed"
    " FROM (SELECT unnest([1, 2, 3]) AS seed)", ["panel"])
def _(spark, d):
    rows = panel(spark, d)
    return markers.fold_leak_check(rows, val_folds(rows.select("sample_id").distinct()), N_FOLDS)


@query(
    "m11_holdout_eval",
    f", h AS (SELECT o_custkey AS sample_id FROM orders WHERE o_orderpriority = '1-URGENT' AND o_totalprice > 400000),"
    " p AS (SELECT model, trait, v_preds.seed AS round, s.seed, cast(f.fold AS int) AS fold, y_true, y_pred + s.seed * 0.125 - f.fold * 0.0625 AS y_pred FROM v_preds"
    " CROSS JOIN (SELECT unnest([1, 2, 3]) AS seed) s CROSS JOIN (SELECT unnest(range(5)) AS fold) f WHERE"
    f" sample_id IN (SELECT sample_id FROM h)) SELECT model, trait, round, seed, fold, {METRIC_SQL} FROM p GROUP BY ALL",
    ["preds"], ["pearson", "mse", "rmse", "mae", "r2", "sd_ratio"])
def _(spark, d):
    """Fifteen fold models, each shifted a little, on one holdout."""
    rows = preds(spark, d)
    cell = ["model", "trait", F.col("seed").alias("round")]
    models_of = rows.select(*cell, "sample_id", "y_pred", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("seed")).withColumn(
        "fold", F.explode(F.sequence(F.lit(0), F.lit(4))))
    shifted = models_of.withColumn("y_pred", F.col("y_pred") + F.col("seed") * 0.125 - F.col("fold") * 0.0625)
    held = table(spark, d, "orders").where("o_orderpriority = '1-URGENT' AND o_totalprice > 400000").select(
        F.col("o_custkey").alias("sample_id"))
    return models.holdout_eval(
        shifted, rows.select(*cell, "sample_id", "y_true"), held, ["model", "trait", "round", "seed", "fold"])
