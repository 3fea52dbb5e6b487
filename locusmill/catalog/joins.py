"""Alignment, interval location and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import align, checks, intervals, matrix
from ..sources.views import N_FOLDS, calls, genes_intervals, panel, preds, table, val_folds, view
from .aggregates import INTERVALS
from .columns import FEATURES_SQL, marker_features
from .registry import query


def supplier_traits(spark, d):
    return table(spark, d, "supplier").selectExpr("s_suppkey AS sample_id", "s_acctbal / 1000 AS bw")


@query(
    "j01_align_phenotypes",
    "SELECT c_custkey AS sample_id, s_acctbal / 1000 AS bw, s_suppkey IS NOT NULL AS matched FROM customer"
    " LEFT JOIN supplier ON c_custkey = s_suppkey", doubles=["bw"],
)
def _(spark, d):
    return align.align_phenotypes(view(spark, d, "samples").select("sample_id"), supplier_traits(spark, d))


@query(
    "j01_match_report",
    "SELECT count(*) AS n_samples, count(s_suppkey) AS n_matched, count(*) - count(s_suppkey) AS n_missing"
    " FROM customer LEFT JOIN supplier ON c_custkey = s_suppkey",
)
def _(spark, d):
    return align.match_report(
        align.align_phenotypes(view(spark, d, "samples").select("sample_id"), supplier_traits(spark, d)))


@query(
    "j02_align_contains_fallback",
    "SELECT c_name AS sample_id, arg_min(cast(s_suppkey AS varchar), -s_suppkey) AS pheno_id FROM customer JOIN supplier"
    " ON contains(c_name, cast(s_suppkey AS varchar)) GROUP BY c_name",
)
def _(spark, d):
    """Supplier numbers inside customer names; the largest number is listed first."""
    outer = table(spark, d, "customer").select(F.col("c_name").alias("sample_id"))
    inner = table(spark, d, "supplier").select(
        F.col("s_suppkey").cast("string").alias("pheno_id"), (-F.col("s_suppkey")).alias("ord"))
    return align.contains_match(outer, inner, "sample_id", "pheno_id", "ord")


@query(
    "j02_align_by_any_id",
    "SELECT 'pheno_subset' AS method, c_name AS sample_id, arg_min(cast(s_suppkey AS varchar), -s_suppkey) AS pheno_id FROM customer"
    " JOIN supplier ON contains(c_name, cast(s_suppkey AS varchar)) GROUP BY c_name",
)
def _(spark, d):
    """No ID agrees directly, and only supplier numbers lie inside customer names."""
    samples = table(spark, d, "customer").select(
        F.col("c_name").alias("sample_id"), F.lit("f").alias("fid"), F.col("c_name").alias("iid"), F.col("c_custkey").alias("ord"))
    phenotypes = table(spark, d, "supplier").select(
        F.col("s_suppkey").cast("string").alias("pheno_id"), (-F.col("s_suppkey")).alias("ord"))
    method, pairs = align.align_by_any_id(samples, phenotypes)
    return pairs.select(F.lit(method).alias("method"), "sample_id", "pheno_id")


FAM = [
    "c_custkey AS sample_idx", "cast(c_nationkey AS {s}) AS fid", "cast(c_custkey AS {s}) AS iid",
    "concat(cast(c_nationkey AS {s}), '_', cast(c_custkey AS {s})) AS sample_id",
]


def fam(spark, d):
    return table(spark, d, "customer").selectExpr(*[e.format(s="string") for e in FAM])


FAM_SQL = f"(SELECT {', '.join(FAM).format(s='varchar')} FROM customer)"


@query(
    "j03_align_iid_fallback",
    f"SELECT sample_id, cast(s_suppkey AS varchar) AS pheno_id FROM {FAM_SQL} JOIN supplier ON iid = cast(s_suppkey AS varchar)")
def _(spark, d):
    phenotypes = table(spark, d, "supplier").select(F.col("s_suppkey").cast("string").alias("pheno_id"))
    return align.iid_match(fam(spark, d), phenotypes)


WANTED = (
    "CASE c_mktsegment WHEN 'MACHINERY' THEN cast(c_custkey AS {s}) WHEN 'HOUSEHOLD' THEN concat(cast(c_nationkey AS {s}), '_', cast(c_custkey AS {s}))"
    " WHEN 'FURNITURE' THEN concat(cast(c_nationkey AS {s}), ':', cast(c_custkey AS {s})) WHEN 'BUILDING' THEN"
    " concat(cast(c_nationkey AS {s}), '-', cast(c_custkey AS {s})) ELSE concat('x', cast(c_custkey AS {s})) END"
)


@query(
    "j04_align_alias",
    f"SELECT {WANTED.format(s='varchar')} AS sample_id, CASE WHEN c_mktsegment IN ('MACHINERY','HOUSEHOLD','FURNITURE','BUILDING')"
    " THEN 1 ELSE 0 END AS n_hits, CASE WHEN c_mktsegment IN ('MACHINERY','HOUSEHOLD','FURNITURE','BUILDING') THEN c_custkey END AS sample_idx"
    " FROM customer",
)
def _(spark, d):
    """IDs in the four spellings and, for the last segment, in an unknown one."""
    wanted = table(spark, d, "customer").selectExpr(f"{WANTED.format(s='string')} AS sample_id")
    return align.align_alias(wanted, fam(spark, d).drop("sample_id"))


def listed_markers(spark, d):
    return table(spark, d, "lineitem").select(F.col("l_partkey").alias("marker_idx")).distinct()


@query(
    "j05_annotate_markers",
    "SELECT marker_idx, chrom, pos, a1, a2 FROM (SELECT DISTINCT l_partkey AS marker_idx FROM lineitem) JOIN v_markers USING (marker_idx)",
    ["markers"])
def _(spark, d):
    markers = view(spark, d, "markers").select("marker_idx", "chrom", "pos", "a1", "a2")
    return align.annotate_markers(listed_markers(spark, d), markers, "marker_idx")


@query(
    "j05_annotation_gaps",
    "SELECT c_custkey AS marker_idx, 'calls' AS only_in FROM customer WHERE c_custkey NOT IN (SELECT s_suppkey FROM supplier)"
    " UNION ALL SELECT s_suppkey, 'annotation' FROM supplier WHERE s_suppkey NOT IN (SELECT c_custkey FROM customer)",
)
def _(spark, d):
    """Customer keys as called, supplier keys as annotated markers."""
    called = table(spark, d, "customer").select(F.col("c_custkey").alias("marker_idx"))
    known = table(spark, d, "supplier").select(F.col("s_suppkey").alias("marker_idx"))
    return align.annotation_gaps(called, known, "marker_idx")


CANDIDATES = "SELECT DISTINCT l_partkey AS marker_idx FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 45"


def candidates(spark, d):
    lines = table(spark, d, "lineitem").where("l_returnflag = 'R' AND l_quantity > 45")
    return lines.select(F.col("l_partkey").alias("marker_idx")).distinct()


@query(
    "j06_restrict_candidates",
    f"SELECT marker_idx, chrom, pos FROM v_markers WHERE marker_idx IN ({CANDIDATES})", ["markers"])
def _(spark, d):
    markers = view(spark, d, "markers").select("marker_idx", "chrom", "pos")
    return align.restrict_candidates(markers, candidates(spark, d), "marker_idx")


@query(
    "j06_missing_candidates",
    f"SELECT marker_idx FROM ({CANDIDATES}) WHERE marker_idx NOT IN (SELECT marker_idx FROM v_markers WHERE a1 = 'A')",
    ["markers"])
def _(spark, d):
    known = view(spark, d, "markers").where("a1 = 'A'")
    return align.missing_candidates(known, candidates(spark, d), "marker_idx")


@query("j07_locate_in_interval", INTERVALS + "SELECT * FROM loc", ["markers", "genes"])
def _(spark, d):
    markers = view(spark, d, "markers").select("marker_idx", "chrom", "pos")
    return intervals.locate_in_interval(markers, genes_intervals(spark, d))


@query(
    "j08_chrom_alias_match",
    "SELECT m.marker_idx, g_start AS start, g_end AS \"end\" FROM v_markers m JOIN v_genes g"
    " ON m.chrom = g.chrom AND m.pos BETWEEN g_start AND g_end",
    ["markers", "genes"])
def _(spark, d):
    """Markers say ``1.0`` where genes say ``chr1``."""
    markers = view(spark, d, "markers").select("marker_idx", F.concat("chrom", F.lit(".0")).alias("chrom"), "pos")
    genes = view(spark, d, "genes").select(
        F.concat(F.lit("chr"), "chrom").alias("chrom"), F.col("g_start").alias("start"),
        F.col("g_end").alias("end"), F.lit("gene").alias("kind"))
    return intervals.locate_in_interval(markers, genes).where("start IS NOT NULL").select(
        "marker_idx", "start", "end")


FOLDS_SQL = (
    "SELECT seed, cast(f.fold AS int) AS fold, sample_id, CASE WHEN f.fold = val_fold THEN 'val' ELSE 'train' END AS split"
    " FROM {source} CROSS JOIN (SELECT unnest(range(5)) AS fold) f"
)


def sample_folds(spark, d):
    return align.expand_folds(val_folds(view(spark, d, "samples").select("sample_id")), N_FOLDS)


@query(
    "j09_attach_fold",
    f", f AS ({FOLDS_SQL.format(source='v_sample_folds')}) SELECT seed, fold, split, sample_id, bw FROM f JOIN v_samples USING (sample_id)",
    ["sample_folds", "samples"], ["bw"])
def _(spark, d):
    return align.attach_fold(view(spark, d, "samples").select("sample_id", "bw"), sample_folds(spark, d)).select(
        "seed", "fold", "split", "sample_id", "bw")


def vector_context(spark, d):
    pcs = table(spark, d, "embeddings").select(
        F.col("vec_id").alias("sample_id"), F.col("embedding").cast("array<double>").alias("pcs"))
    folds = align.expand_folds(val_folds(pcs.select("sample_id")), N_FOLDS)
    return folds, folds.join(pcs, "sample_id")


@query(
    "j10_attach_context",
    f", f AS ({FOLDS_SQL.format(source='v_panel_folds')}) SELECT seed, fold, sample_id, split, 2 * len(embedding) AS width,"
    " 2 * (SELECT sum(cast(u AS double)) FROM (SELECT unnest(embedding) AS u)) AS ends FROM f JOIN embeddings ON vec_id = sample_id",
    ["panel_folds"], ["ends"])
def _(spark, d):
    """Two covariate sources side by side."""
    folds, source = vector_context(spark, d)
    out = align.attach_context(folds, {"first": source, "second": source})
    return out.select("seed", "fold", "sample_id", "split", F.size("context").alias("width"),
                      F.aggregate("context", F.lit(0.0), lambda total, x: total + x).alias("ends"))


@query(
    "j10_context_problems",
    f", f AS ({FOLDS_SQL.format(source='v_panel_folds')}) SELECT seed, fold, sample_id, split,"
    " CASE WHEN label IN (1, 2) THEN 'train' END AS source_split FROM f JOIN embeddings ON vec_id = sample_id"
    " WHERE label NOT IN (1, 2) OR split <> 'train'",
    ["panel_folds"])
def _(spark, d):
    """Covariates for two labels only, all marked as training rows."""
    folds, source = vector_context(spark, d)
    labels = table(spark, d, "embeddings").where("label IN (1, 2)").select(F.col("vec_id").alias("sample_id"))
    planted = source.join(labels, "sample_id", "left_semi").withColumn("split", F.lit("train"))
    return align.context_problems(folds, planted)


@query(
    "j11_pair_truth_prediction",
    "SELECT model, trait, seed, sample_id, y_true, y_pred, y_pred - y_true AS residual, abs(y_pred - y_true) AS abs_error, (y_pred - y_true) ** 2 AS sq_error"
    " FROM v_preds WHERE sample_id IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT' AND o_totalprice > 400000)",
    ["preds"], ["y_true", "y_pred", "residual", "abs_error", "sq_error"])
def _(spark, d):
    rows, cell = preds(spark, d), ["model", "trait", "seed", "sample_id"]
    urgent = table(spark, d, "orders").where("o_orderpriority = '1-URGENT' AND o_totalprice > 400000")
    return align.pair_truth_prediction(
        rows.select(*cell, "y_true"), rows.select(*cell, "y_pred"), urgent.select(F.col("o_custkey").alias("sample_id")), cell)


CENTRED = (
    ", m AS (SELECT marker_idx, avg(dosage) AS mean FROM v_panel GROUP BY marker_idx),"
    " z AS (SELECT sample_id, marker_idx, coalesce(dosage - mean, 0) AS z FROM v_panel JOIN m USING (marker_idx)) "
)
PAIRS = "SELECT a.sample_id AS i, b.sample_id AS j, sum(a.z * b.z) AS g FROM z a JOIN z b ON a.marker_idx = b.marker_idx AND a.sample_id <= b.sample_id GROUP BY a.sample_id, b.sample_id"


@query("j12_sample_pairs", CENTRED + PAIRS, ["panel"], ["g"])
def _(spark, d):
    rows = panel(spark, d)
    return matrix.sample_pairs(matrix.center_calls(rows, matrix.marker_means(rows)))


@query(
    "j13_assemble_features",
    FEATURES_SQL + "SELECT sample_id, marker_idx, dosage, pos, center, length, is_gene FROM v_calls JOIN feat USING (marker_idx)",
    ["markers", "genes", "calls"], ["center", "length", "is_gene"])
def _(spark, d):
    return align.assemble_features(
        calls(spark, d), marker_features(spark, d), ["pos", "center", "length", "density", "is_gene"], drop_density=True
    ).select("sample_id", "marker_idx", "dosage", "pos", "center", "length", "is_gene")


ID_ORDER = "SELECT o_custkey AS sample_id, min(o_orderkey) AS ord FROM orders WHERE o_orderstatus = 'F' GROUP BY o_custkey"


def requested_ids(spark, d):
    closed = table(spark, d, "orders").where("o_orderstatus = 'F'")
    return closed.groupBy(F.col("o_custkey").alias("sample_id")).agg(F.min("o_orderkey").alias("ord"))


@query(
    "p15_select_samples",
    f", ids AS ({ID_ORDER}) SELECT sample_id, bw, le, surv, ord FROM v_samples JOIN ids USING (sample_id)",
    ["samples"], ["bw", "le"])
def _(spark, d):
    return align.select_samples(view(spark, d, "samples"), requested_ids(spark, d))


@query(
    "t04_ordered_export",
    f", ids AS ({ID_ORDER}) SELECT sample_id, bw, le, surv, ord FROM v_samples JOIN ids USING (sample_id) ORDER BY ord",
    ["samples"], ["bw", "le"])
def _(spark, d):
    return align.ordered_export(view(spark, d, "samples"), requested_ids(spark, d))


@query(
    "p16_select_markers",
    "SELECT sample_id, marker_idx, dosage FROM v_calls WHERE marker_idx IN (SELECT s_suppkey * 7 FROM supplier)", ["calls"])
def _(spark, d):
    kept = table(spark, d, "supplier").select((F.col("s_suppkey") * 7).alias("marker_idx"))
    return align.select_markers(calls(spark, d), kept)


@query("p14_select_traits", "SELECT sample_id, le, bw FROM v_samples", ["samples"], ["bw", "le"])
def _(spark, d):
    out = align.select_traits(view(spark, d, "samples"), ["LE", "Bw"])
    return out.toDF("sample_id", "le", "bw")


@query(
    "u02_check_fold_membership",
    "SELECT seed, cast(f.fold AS int) AS fold, count(*) FILTER (val_fold <> f.fold) AS n_train, count(*) FILTER (val_fold = f.fold) AS n_val,"
    " 0 AS n_duplicate, 0 AS n_overlap, 0 AS n_unknown, 0 AS n_absent, true AS expected FROM v_sample_folds CROSS JOIN (SELECT unnest(range(5)) AS fold) f GROUP BY ALL",
    ["sample_folds"])
def _(spark, d):
    return checks.fold_membership(sample_folds(spark, d), view(spark, d, "samples"), [1, 2, 3], range(N_FOLDS))


@query(
    "u02_planted_faults",
    "SELECT seed, cast(f.fold AS int) AS fold, count(*) FILTER (seed = 1 AND f.fold < 4 AND val_fold <> f.fold) AS n_train,"
    " count(*) FILTER (seed = 1 AND f.fold < 4 AND val_fold = f.fold) AS n_val, 0 AS n_duplicate, 0 AS n_overlap, 0 AS n_unknown,"
    " count(*) FILTER (seed <> 1 OR f.fold = 4) AS n_absent, true AS expected FROM v_sample_folds CROSS JOIN (SELECT unnest(range(5)) AS fold) f"
    " WHERE seed < 3 GROUP BY ALL", ["sample_folds"])
def _(spark, d):
    """Fold 4 of seed 1 and all of seed 2 are absent from the tables, and must be listed."""
    planted = sample_folds(spark, d).where("seed = 1 AND fold < 4")
    return checks.fold_membership(planted, view(spark, d, "samples"), [1, 2], range(N_FOLDS))


@query(
    "u02_missing_validation",
    "SELECT seed, CASE WHEN seed = 2 THEN 0 ELSE 1 END AS times, count(*) AS n_samples FROM v_sample_folds GROUP BY seed", ["sample_folds"])
def _(spark, d):
    """A seed without any validation row is counted at 0."""
    planted = sample_folds(spark, d).where("seed <> 2 OR split = 'train'")
    return checks.validation_coverage(planted, view(spark, d, "samples"), [1, 2, 3])


@query(
    "u02_validation_coverage",
    "SELECT seed, 1 AS times, count(*) AS n_samples FROM v_sample_folds GROUP BY seed", ["sample_folds"])
def _(spark, d):
    return checks.validation_coverage(sample_folds(spark, d), view(spark, d, "samples"))


@query("u03_check_train_test_overlap", "SELECT s_suppkey AS sample_id FROM supplier INTERSECT SELECT c_custkey FROM customer")
def _(spark, d):
    return checks.overlap(supplier_traits(spark, d), view(spark, d, "samples"))
