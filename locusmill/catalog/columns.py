"""Column transforms, validation and scaling."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import codes, scaling
from ..operators import checks, intervals
from ..plans.session import stable
from ..sources.views import genes_intervals, preds, raw_calls, table, val_folds, vectors, view
from .aggregates import ENCODED, INTERVALS, encoded
from .registry import query

SPELLED = (
    "p_partkey AS marker_idx",
    "CASE p_partkey % 4 WHEN 0 THEN concat(cast(p_partkey % 5 + 1 AS {s}), '.0') WHEN 1 THEN 'X'"
    " WHEN 2 THEN concat(' ', cast(p_partkey % 5 + 1 AS {s})) ELSE concat('chr', cast(p_partkey % 5 + 1 AS {s})) END AS chrom_text",
    "CASE p_partkey % 3 WHEN 0 THEN concat(cast(p_partkey * 100 + p_size AS {s}), '.7')"
    " ELSE cast(p_partkey * 100 + p_size AS {s}) END AS pos_text",
)
SPELLED_SQL = f"(SELECT {', '.join(SPELLED).format(s='varchar')} FROM part)"
CHROM_SQL = (
    "CASE WHEN try_cast(trim(chrom_text) AS double) IS NOT NULL THEN cast(cast(trim(chrom_text) AS double) AS bigint)::varchar"
    " ELSE trim(chrom_text) END"
)
POS_SQL = "cast(floor(cast(pos_text AS double)) AS bigint)"


def spelled(spark, d):
    return table(spark, d, "part").selectExpr(*[e.format(s="string") for e in SPELLED])


CHROM_SQL = CHROM_SQL.replace("cast(cast(trim(chrom_text) AS double) AS bigint)", "cast(try_cast(trim(chrom_text) AS double) AS bigint)")


@query("p01_normalize_chrom", f"SELECT marker_idx, {CHROM_SQL} AS chrom FROM {SPELLED_SQL}")
def _(spark, d):
    return spelled(spark, d).select("marker_idx", codes.normalize_chrom("chrom_text").alias("chrom"))


@query("p02_normalize_pos", f"SELECT marker_idx, {POS_SQL} AS pos FROM {SPELLED_SQL}")
def _(spark, d):
    return spelled(spark, d).select("marker_idx", codes.normalize_pos("pos_text").alias("pos"))


@query("p03_chr_pos_id", f"SELECT marker_idx, {CHROM_SQL} || ':' || {POS_SQL} AS marker_id FROM {SPELLED_SQL}")
def _(spark, d):
    return spelled(spark, d).select("marker_idx", codes.chr_pos_id("chrom_text", "pos_text").alias("marker_id"))


@query(
    "p04_decode_call_code",
    "SELECT l_orderkey, l_linenumber, CASE l_partkey % 4 WHEN 0 THEN 0 WHEN 2 THEN 1 WHEN 3 THEN 2 END AS allele2,"
    " CASE l_partkey % 4 WHEN 0 THEN 2 WHEN 2 THEN 1 WHEN 3 THEN 0 END AS allele1 FROM lineitem",
)
def _(spark, d):
    code = F.col("l_partkey") % 4
    return table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", codes.decode_call_code(code, 2).alias("allele2"),
        codes.decode_call_code(code, 1).alias("allele1"))


@query("p05_missing_to_null", "SELECT sample_id, marker_idx, nullif(code, 3) AS dosage FROM v_raw_calls", ["raw_calls"])
def _(spark, d):
    return raw_calls(spark, d).select("sample_id", "marker_idx", codes.missing_to_null("code", 3).alias("dosage"))


@query("p06_bad_dosages", "SELECT sample_id, marker_idx, code FROM v_raw_calls WHERE code NOT IN (0, 1, 2)", ["raw_calls"])
def _(spark, d):
    return checks.bad_dosages(raw_calls(spark, d), "code")


ODD_ALLELES = [
    "p_partkey AS marker_idx",
    "CASE WHEN p_brand = 'Brand#7' THEN 'N' WHEN p_size = 9 THEN 'g' ELSE 'A' END AS a1",
    "CASE WHEN p_type = 'SMALL' THEN 'A' WHEN p_type = 'ECONOMY' THEN NULL ELSE 'G' END AS a2",
]


@query(
    "p07_bad_alleles",
    f"SELECT * FROM (SELECT {', '.join(ODD_ALLELES)} FROM part) WHERE NOT coalesce(upper(a1) IN ('A','C','G','T')"
    " AND upper(a2) IN ('A','C','G','T') AND upper(a1) <> upper(a2), false)",
)
def _(spark, d):
    return checks.bad_alleles(table(spark, d, "part").selectExpr(*ODD_ALLELES))


@query("p08_encode_channels", ENCODED, ["calls", "markers"])
def _(spark, d):
    return encoded(spark, d)


@query("p09_decode_channels", f", e AS ({ENCODED}) SELECT sample_id, marker_idx, dosage FROM e", ["calls", "markers"])
def _(spark, d):
    """Encoding and decoding again gives the dosage back."""
    return encoded(spark, d).select(
        "sample_id", "marker_idx", codes.decode_channel("a1", "a2", "channel").alias("dosage"))


@query(
    "p10_assert_one_hot",
    "SELECT c_custkey, NOT (c_nationkey < 10 AND c_acctbal < 0) AS fine FROM customer",
)
def _(spark, d):
    """Nations 0..9 give a one, others an all-zero vector; a negative balance plants a 2."""
    planted = F.transform(codes.onehot("c_nationkey"), lambda x: F.when(F.col("c_acctbal") < 0, x * 2).otherwise(x))
    return table(spark, d, "customer").select("c_custkey", codes.is_one_hot(planted).alias("fine"))


@query(
    "f11_onehot_array",
    f", e AS ({ENCODED}), c AS (SELECT sample_id, marker_idx, unnest(range(10)) AS place, channel FROM e)"
    " SELECT place, count(*) FILTER (channel = place) AS ones, count(*) FILTER (channel IS NULL OR channel <> place) AS zeros,"
    " count(*) FILTER (channel IS NULL) AS missing FROM c GROUP BY place",
    ["calls", "markers"],
)
def _(spark, d):
    rows = encoded(spark, d).select("channel", F.posexplode(codes.onehot("channel")).alias("place", "bit"))
    return rows.groupBy("place").agg(
        F.count_if(F.col("bit") == 1.0).alias("ones"), F.count_if(F.col("bit") == 0.0).alias("zeros"),
        F.count_if(F.col("channel").isNull()).alias("missing"))


@query("p11_complete_case_filter", "SELECT * FROM v_phenotypes WHERE bw IS NOT NULL AND le IS NOT NULL", ["phenotypes"], ["bw", "le"])
def _(spark, d):
    return checks.complete_cases(view(spark, d, "phenotypes"), ["bw", "le"])


@query(
    "p12_incomplete_traits",
    " UNION ALL ".join(
        f"SELECT '{t}' AS trait, count(*) FILTER ({t} IS NULL) AS n_missing FROM v_phenotypes" for t in ("bw", "le", "surv")),
    ["phenotypes"],
)
def _(spark, d):
    return checks.missing_counts(view(spark, d, "phenotypes"), ["bw", "le", "surv"]).select("trait", "n_missing")


@query(
    "p13_na_report",
    " UNION ALL ".join(
        f"SELECT '{t}' AS trait, count(*) AS n, count(*) FILTER ({t} IS NULL) AS n_missing,"
        f" count(*) FILTER ({t} IS NULL) / count(*) AS na_ratio FROM v_phenotypes" for t in ("bw", "le", "surv")),
    ["phenotypes"], ["na_ratio"],
)
def _(spark, d):
    return checks.missing_counts(view(spark, d, "phenotypes"), ["bw", "le", "surv"])


@query(
    "p17_assert_binary_trait",
    "SELECT 'surv' AS trait, count(*) FILTER (surv NOT IN (0, 1)) AS n_bad FROM v_samples"
    " UNION ALL SELECT 'bw', count(*) FILTER (bw NOT IN (0, 1)) FROM v_samples",
    ["samples"],
)
def _(spark, d):
    return checks.bad_binary(view(spark, d, "samples"), ["surv", "bw"])


@query(
    "p18_assert_finite",
    "SELECT chrom, count(*) FILTER (quantity IS NULL) AS bad_quantity, count(*) FILTER (discount = 0) AS bad_inverse"
    " FROM v_features GROUP BY chrom",
    ["features"],
)
def _(spark, d):
    """The reciprocal of a zero discount stands in for an infinite score."""
    inverse = F.when(F.col("discount") == 0, float("inf")).otherwise(1 / F.col("discount"))
    return checks.nonfinite_counts(
        view(spark, d, "features").withColumn("inverse", inverse), ["quantity", "inverse"], ["chrom"])


@query("p19_assert_unique", "SELECT l_orderkey, l_partkey, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def _(spark, d):
    return checks.duplicates(table(spark, d, "lineitem"), ["l_orderkey", "l_partkey"])


@query(
    "p20_export_stage_policy",
    "SELECT seed, sample_id, 'val' AS split FROM v_sample_folds WHERE val_fold = 2", ["sample_folds"])
def _(spark, d):
    folds = val_folds(view(spark, d, "samples").select("sample_id"))
    split = F.when(F.col("val_fold") == 2, "val").when(F.col("val_fold") == 3, "test").otherwise("train")
    return checks.exportable(folds.select("seed", "sample_id", split.alias("split")), ["val"])


@query(
    "f01_minmax",
    "SELECT sample_id, marker_idx, (value - lo) / (hi - lo + 1e-10) AS scaled FROM (SELECT *, min(value) OVER (PARTITION BY marker_idx) AS lo,"
    " max(value) OVER (PARTITION BY marker_idx) AS hi FROM v_vectors)",
    ["vectors"], ["scaled"],
)
def _(spark, d):
    return scaling.minmax(vectors(spark, d), "value", ["marker_idx"]).select("sample_id", "marker_idx", "scaled")


UNIT = "CASE WHEN hi - lo < 1e-10 THEN 0 ELSE (t - lo) / (hi - lo + 1e-10) END AS scaled"
ENDS = "min(t) OVER (PARTITION BY marker_idx) AS lo, max(t) OVER (PARTITION BY marker_idx) AS hi"
LEAST = "min(value) FILTER (value > 0) OVER (PARTITION BY marker_idx)"


@query(
    "f02_log_scale",
    f"SELECT sample_id, marker_idx, {UNIT} FROM (SELECT *, {ENDS} FROM (SELECT sample_id, marker_idx,"
    f" CASE WHEN value > 0 THEN ln(value + {LEAST} / 10) ELSE 0 END AS t FROM v_vectors))",
    ["vectors"], ["scaled"],
)
def _(spark, d):
    return scaling.log_scale(vectors(spark, d), "value", ["marker_idx"]).select("sample_id", "marker_idx", "scaled")


@query(
    "f03_power_scale",
    f"SELECT sample_id, marker_idx, {UNIT} FROM (SELECT *, {ENDS} FROM (SELECT sample_id, marker_idx,"
    " CASE WHEN value > 0 THEN pow(value, 0.5) ELSE 0 END AS t FROM v_vectors))",
    ["vectors"], ["scaled"],
)
def _(spark, d):
    return scaling.power_scale(vectors(spark, d), "value", 0.5, ["marker_idx"]).select(
        "sample_id", "marker_idx", "scaled")


@query(
    "f04_adaptive_scale",
    f", s AS (SELECT marker_idx, avg(value) AS mu, median(value) AS med, max(value) AS top, min(value) AS least"
    " FROM v_vectors WHERE value > 0 GROUP BY marker_idx), m AS (SELECT sample_id, marker_idx,"
    " CASE WHEN med IS NULL THEN 0 WHEN mu > 2 * med THEN CASE WHEN value > 0 THEN ln(value + least / 10) ELSE 0 END"
    " WHEN top > 5 * med THEN CASE WHEN value > 0 THEN sqrt(value) ELSE 0 END ELSE value END AS t"
    f" FROM v_vectors LEFT JOIN s USING (marker_idx)) SELECT sample_id, marker_idx, {UNIT} FROM (SELECT *, {ENDS} FROM m)",
    ["vectors"], ["scaled"],
)
def _(spark, d):
    return scaling.adaptive_scale(vectors(spark, d), "value", ["marker_idx"]).select(
        "sample_id", "marker_idx", "scaled")


def _horner(coefficients, x: str) -> str:
    out = f"cast({coefficients[0]!r} AS double)"
    for c in coefficients[1:]:
        out = f"({out} * {x} + cast({c!r} AS double))"
    return out


def _inverse_normal_sql(p: str) -> str:
    a, b, c, e = scaling._A, scaling._B, scaling._C, scaling._D
    low, high = f"sqrt(-2 * ln({p}))", f"sqrt(-2 * ln(1 - {p}))"
    q = f"({p} - 0.5)"
    return (
        f"CASE WHEN {p} < {scaling._TAIL} THEN {_horner(c, low)} / {_horner([*e, 1.0], low)}"
        f" WHEN {p} > 1 - {scaling._TAIL} THEN -{_horner(c, high)} / {_horner([*e, 1.0], high)}"
        f" ELSE {_horner(a, f'({q} * {q})')} * {q} / {_horner([*b, 1.0], f'({q} * {q})')} END"
    )


@query(
    "f05_quantile_normal",
    "WITH r AS (SELECT l_orderkey, l_linenumber, (rank() OVER (ORDER BY l_extendedprice) - 1 + (count(*) OVER (PARTITION BY l_extendedprice) - 1) / 2)"
    " / cast(count(*) OVER () - 1 AS double) AS share FROM lineitem),"
    " p AS (SELECT l_orderkey, l_linenumber, least(1 - 1e-7, greatest(1e-7, share)) AS p FROM r),"
    f" z AS (SELECT l_orderkey, l_linenumber, {_inverse_normal_sql('p')} AS z FROM p)"
    " SELECT l_orderkey, l_linenumber, round((z - min(z) OVER ()) / (max(z) OVER () - min(z) OVER ()), 6) AS scaled FROM z")
def _(spark, d):
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_extendedprice").alias("value"))
    return scaling.quantile_normal(lines, "value").select("l_orderkey", "l_linenumber", F.round("scaled", 6).alias("scaled"))


FOLD_TRAITS = "SELECT seed, sample_id, bw, le, surv, val_fold FROM v_samples JOIN v_sample_folds USING (sample_id) "


def fold_traits(spark, d):
    samples = view(spark, d, "samples")
    return samples.join(val_folds(samples.select("sample_id")), "sample_id")


@query(
    "f06_zscore",
    f", r AS ({FOLD_TRAITS}), s AS (SELECT seed, avg(bw) AS mu, stddev_pop(bw) AS sd FROM r WHERE val_fold <> 0 GROUP BY seed)"
    " SELECT seed, sample_id, (bw - mu) / sd AS scaled, bw AS restored FROM r JOIN s USING (seed)",
    ["samples", "sample_folds"], ["scaled", "restored"],
)
def _(spark, d):
    out = scaling.zscore(fold_traits(spark, d), "bw", F.col("val_fold") != 0, ["seed"])
    return out.select("seed", "sample_id", "scaled", scaling.unzscore("scaled", "mean", "sd").alias("restored"))


LONG_TRAITS = f", r AS ({FOLD_TRAITS}), l AS (" + " UNION ALL ".join(
    f"SELECT seed, sample_id, val_fold, '{t}' AS trait, cast({t} AS double) AS value FROM r" for t in ("bw", "le", "surv")) + ") "


def long_traits(spark, d):
    wide = fold_traits(spark, d).withColumn("surv", F.col("surv").cast("double"))
    return wide.unpivot(["seed", "sample_id", "val_fold"], ["bw", "le", "surv"], "trait", "value")


@query(
    "f07_phenotype_minmax",
    LONG_TRAITS + "SELECT seed, sample_id, trait, (value - min(value) OVER (PARTITION BY trait)) / (max(value) OVER (PARTITION BY trait)"
    " - min(value) OVER (PARTITION BY trait)) AS scaled FROM l",
    ["samples", "sample_folds"], ["scaled"],
)
def _(spark, d):
    return scaling.phenotype_minmax(long_traits(spark, d), "value", ["trait"]).select("seed", "sample_id", "trait", "scaled")


MIXED = LONG_TRAITS + (
    ", s AS (SELECT seed, trait, avg(value) AS mu, stddev_pop(value) AS sd FROM l WHERE val_fold <> 0 GROUP BY seed, trait),"
    " z AS (SELECT seed, sample_id, val_fold, trait, CASE WHEN trait = 'surv' THEN value ELSE (value - mu) / sd END AS scaled"
    " FROM l JOIN s USING (seed, trait)) "
)


@query("f08_mixed_trait_scale", MIXED + "SELECT seed, sample_id, trait, scaled FROM z", ["samples", "sample_folds"], ["scaled"])
def _(spark, d):
    return scaling.mixed_trait_scale(long_traits(spark, d), "value", "trait", F.col("val_fold") != 0, ["surv"], keys=["seed"]).select(
        "seed", "sample_id", "trait", "scaled")


@query(
    "f08_scale_audit",
    MIXED + "SELECT seed, trait, avg(scaled) AS mean, stddev_pop(scaled) AS sd FROM z WHERE val_fold <> 0 GROUP BY seed, trait",
    ["samples", "sample_folds"], ["mean", "sd"],
)
def _(spark, d):
    train = F.col("val_fold") != 0
    scaled = scaling.mixed_trait_scale(long_traits(spark, d), "value", "trait", train, ["surv"], keys=["seed"])
    return scaling.scale_audit(scaled, "trait", "scaled", train, ["seed"])


FEATURES_SQL = (
    INTERVALS + ", c AS (SELECT chrom, start, \"end\", count(*) AS snp_count FROM loc WHERE start IS NOT NULL GROUP BY ALL),"
    " feat AS (SELECT marker_idx, chrom, pos, coalesce((start + \"end\") / 2, 0) AS center,"
    " coalesce(\"end\" - start + 1, 0)::double AS length, coalesce(snp_count / (\"end\" - start + 1), 0) AS density,"
    " CASE WHEN kind = 'gene' THEN 1.0 ELSE 0.0 END AS is_gene FROM loc LEFT JOIN c USING (chrom, start, \"end\")) "
)
FEATURE_COLUMNS = ["center", "length", "density", "is_gene"]


def marker_features(spark, d):
    markers = view(spark, d, "markers").select("marker_idx", "chrom", "pos")
    return intervals.interval_features(markers, genes_intervals(spark, d))


@query("f09_interval_features", FEATURES_SQL + "SELECT * FROM feat", ["markers", "genes"], FEATURE_COLUMNS)
def _(spark, d):
    return marker_features(spark, d)


@query(
    "f10_default_position_features",
    f"SELECT marker_idx, coalesce(try_cast(chrom_text AS double), 0) AS chrom, coalesce(try_cast(pos_text AS double), 0) AS pos,"
    " coalesce(try_cast(pos_text AS double), 0) AS center, 1000::double AS length, 0.001::double AS density, 0.5::double AS is_gene"
    f" FROM {SPELLED_SQL}",
    doubles=["chrom", "pos", *FEATURE_COLUMNS],
)
def _(spark, d):
    return intervals.default_position_features(
        spelled(spark, d).withColumnsRenamed({"chrom_text": "chrom", "pos_text": "pos"}))


@query("f12_sigmoid", "SELECT model, trait, seed, fold, sample_id, 1 / (1 + exp(-y_pred)) AS p FROM v_preds", ["preds"], ["p"])
def _(spark, d):
    return preds(spark, d).select("model", "trait", "seed", "fold", "sample_id", codes.sigmoid("y_pred").alias("p"))


@query(
    "w17_chrom_scaled_position",
    FEATURES_SQL + "SELECT marker_idx,"
    " sin((pos - min(pos) OVER c) / greatest(max(pos) OVER c - min(pos) OVER c, 1) * 2 * pi()) AS pos_scaled,"
    " sin((center - min(center) OVER c) / greatest(max(center) OVER c - min(center) OVER c, 1) * 2 * pi()) AS center_scaled,"
    " (length - avg(length) OVER ()) / stddev_pop(length) OVER () AS length_scaled,"
    " (density - avg(density) OVER ()) / stddev_pop(density) OVER () AS density_scaled"
    " FROM feat WINDOW c AS (PARTITION BY chrom)",
    ["markers", "genes"], ["pos_scaled", "center_scaled", "length_scaled", "density_scaled"],
)
def _(spark, d):
    return scaling.chrom_scaled_position(stable(marker_features(spark, d))).select(
        "marker_idx", "pos_scaled", "center_scaled", "length_scaled", "density_scaled")


