"""Scans and sinks.  The given tables are written in each text or packed layout
below the shared folder and read back by the scan, so the work grows with them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scaling import rank_order
from ..operators import align
from ..operators.checks import store_shapes
from ..plans.session import scratch_path, stable
from ..sources import bed, store, text
from ..sources.packed_sink import sink_packed
from ..sources.views import N_FOLDS, calls, panel, preds, table, val_folds, view
from .joins import FOLDS_SQL, ID_ORDER, fam, requested_ids, sample_folds
from .registry import query


def _lines(df: DataFrame, label: str, *parts, order: str | None = None, sep: str = " ") -> str:
    """Write one text line per row, in ``order`` over the part files."""
    path = scratch_path(df.sparkSession, label)
    rows = df.orderBy(order) if order else df
    rows.select(F.concat_ws(sep, *[p.cast("string") for p in parts]).alias("value")).write.text(path)
    return path


@query(
    "s01_scan_bim",
    "SELECT marker_idx, chrom, 'm' || marker_idx AS marker_id, 0.5::double AS cm, pos, a1, a2 FROM v_markers",
    ["markers"], ["cm"])
def _(spark, d):
    c = F.col
    path = _lines(view(spark, d, "markers"), "bim", c("chrom"), F.concat(F.lit("m"), c("marker_idx")), F.lit("0.5"),
                  c("pos"), c("a1"), c("a2"), order="marker_idx")
    return text.scan_bim(spark, path)


@query(
    "s02_scan_fam",
    "SELECT c_custkey AS sample_idx, cast(c_nationkey AS varchar) AS fid, cast(c_custkey AS varchar) AS iid, '0' AS pid, '0' AS mid,"
    " '1' AS sex, '-9' AS pheno, CASE WHEN c_nationkey = c_custkey THEN concat(c_custkey, '_', c_custkey) ELSE cast(c_custkey AS varchar) END AS sample_id"
    " FROM customer")
def _(spark, d):
    c, one = F.col, F.lit
    path = _lines(fam(spark, d), "fam", c("fid"), c("iid"), one("0"), one("0"), one("1"), one("-9"), order="sample_idx", sep="  ")
    return text.scan_fam(spark, path, "individual")


@query("s03_scan_bed", "SELECT sample_id, marker_idx, dosage FROM v_panel", ["panel"])
def _(spark, d):
    rows = stable(panel(spark, d))
    ids = rows.select("sample_id").distinct()
    n_samples, n_markers = ids.count(), rows.select("marker_idx").distinct().count()
    path = scratch_path(spark, "bed").removeprefix("file:")
    sink_packed(rows.withColumnRenamed("sample_id", "sample_idx"), n_samples, n_markers, path)
    named = ids.select(F.col("sample_id").alias("sample_idx"), "sample_id")
    return bed.bed_calls(bed.scan_bed(spark, path, n_samples, 2, 16), named)


def _wide(rows: DataFrame, token, sep: str) -> DataFrame:
    """One line of tokens per sample, markers in order; a line has one token per marker."""
    packed = rows.groupBy("sample_id").agg(F.array_sort(F.collect_list(F.struct("marker_idx", token.alias("t")))).alias("r"))
    return packed.select("sample_id", F.array_join(F.transform("r", lambda x: x["t"]), sep).alias("line"))


@query("s04_scan_dosage_table", "SELECT cast(sample_id AS varchar) AS sample_id, marker_idx, 'm' || marker_idx AS marker_id, dosage FROM v_panel", ["panel"])
def _(spark, d):
    rows = panel(spark, d)
    token = F.coalesce(F.col("dosage").cast("string"), F.when(F.col("sample_id") % 2 == 0, "NA").otherwise("3"))
    path = _lines(_wide(rows, token, "\t"), "dosage", F.col("sample_id"), F.col("line"), sep="\t")
    width = table(spark, d, "embeddings").select(F.max(F.size("embedding"))).first()[0]
    header = "\t".join(["Id", *[f"m{i}" for i in range(width)]])
    return text.scan_dosage_table(spark, path, 3, header)


@query("s05_scan_compact_calls", "SELECT cast(sample_id AS varchar) AS sample_id, marker_idx, dosage FROM v_panel"
       " WHERE sample_id IN (SELECT vec_id FROM embeddings WHERE label IN (1, 3))", ["panel"])
def _(spark, d):
    """Only the samples of two labels are wanted."""
    token = F.coalesce(F.col("dosage").cast("string"), F.lit("5"))
    path = _lines(_wide(panel(spark, d), token, ""), "compact", F.col("sample_id"), F.col("line"))
    vectors = table(spark, d, "embeddings")
    width = vectors.select(F.max(F.size("embedding"))).first()[0]
    wanted = vectors.where("label IN (1, 3)").select(F.col("vec_id").cast("string").alias("sample_id"))
    return text.scan_compact_calls(spark, path, width, wanted)


@query("s06_scan_marker_annotation", "SELECT cast(marker_idx AS varchar) AS marker_id, chrom, a1, a2 FROM v_markers", ["markers"])
def _(spark, d):
    path = scratch_path(spark, "annotation")
    view(spark, d, "markers").select(
        F.col("marker_idx").alias("Id"), F.col("chrom").alias("Chromosome"), F.lower("a1").alias("Allele1"),
        F.col("a2").alias("Allele2"), "maf_ref").write.csv(path, sep="\t", header=True)
    return text.scan_marker_annotation(
        spark, path, {"marker_id": "Id", "chrom": "Chromosome", "a1": "Allele1", "a2": "Allele2"})


@query("s07_scan_phenotypes", "SELECT cast(sample_id AS varchar) AS sample_id, bw, le FROM v_phenotypes", ["phenotypes"], ["bw", "le"])
def _(spark, d):
    path = scratch_path(spark, "phenotypes")
    view(spark, d, "phenotypes").write.csv(path, sep="\t", header=True, nullValue="NA")
    return text.scan_phenotypes(spark, path, ["bw", "le"])


@query("s08_scan_sniffed_table", "SELECT cast(sample_id AS varchar) AS sample_id, cast(surv AS varchar) AS survival FROM v_samples", ["samples"])
def _(spark, d):
    path = scratch_path(spark, "sniffed")
    view(spark, d, "samples").select(F.col("sample_id").alias("Fish_ID"), "bw", F.col("surv").alias("SURVIVAL")).write.csv(
        path, header=True)
    return text.scan_sniffed_table(spark, path, {"sample_id": ["id", "fish_id"], "survival": ["survival", "alive"]})


GENE_TEXT = (
    "SELECT chrom, 0 AS g_start, max(g_end) + 1000 AS g_end, 'length' AS what FROM v_genes GROUP BY chrom"
    " UNION ALL SELECT chrom, g_start, g_end, 'gene' FROM v_genes"
)


@query("s09_scan_gene_annotation", GENE_TEXT, ["genes"])
def _(spark, d):
    path = scratch_path(spark, "genes")
    genes = view(spark, d, "genes")
    bodies = genes.select("chrom", "g_start", "g_end", F.lit("ID=gene").alias("t"))
    whole = genes.groupBy("chrom").agg(
        F.lit(0).cast("long").alias("g_start"), (F.max("g_end") + 1000).alias("g_end"), F.lit("chromosome").alias("t"))
    bodies.unionByName(whole).write.csv(path, sep="\t")
    lengths, spans = text.scan_gene_annotation(spark, path)
    return lengths.select("chrom", F.lit(0).cast("long").alias("g_start"), F.col("length").alias("g_end"), F.lit("length").alias("what")).unionByName(
        spans.withColumn("what", F.lit("gene")))


@query("s10_scan_id_list", f"SELECT row_number() OVER (ORDER BY ord) - 1 AS ord, cast(sample_id AS varchar) AS sample_id FROM ({ID_ORDER})")
def _(spark, d):
    path = _lines(requested_ids(spark, d), "ids", F.col("sample_id"), order="ord")
    return text.scan_id_list(spark, path)


@query("s11_scan_folds", f"SELECT seed, fold, cast(sample_id AS varchar) AS sample_id, split FROM ({FOLDS_SQL.format(source='v_sample_folds')})", ["sample_folds"])
def _(spark, d):
    path = scratch_path(spark, "folds")
    for seed in (1, 2, 3):
        sample_folds(spark, d).where(F.col("seed") == seed).select("fold", "sample_id", "split").write.csv(
            f"{path}/cv_splits_{seed}", header=True)
    return text.scan_folds(spark, f"{path}/*")


@query(
    "s12_scan_context",
    f", f AS ({FOLDS_SQL.format(source='v_panel_folds')}) SELECT seed, fold, cast(sample_id AS varchar) AS sample_id, split,"
    " len(embedding) AS k, cast(embedding[1] AS double) AS first, cast(embedding[len(embedding)] AS double) AS last,"
    " (SELECT sum(cast(u AS double)) FROM (SELECT unnest(embedding) AS u)) AS total FROM f JOIN embeddings ON vec_id = sample_id",
    ["panel_folds"], ["first", "last", "total"])
def _(spark, d):
    given = table(spark, d, "embeddings")
    width = given.select(F.max(F.size("embedding"))).first()[0]
    pcs = given.select(F.col("vec_id").alias("sample_id"), *[
        F.element_at("embedding", i).cast("double").alias(f"PC{i}") for i in range(1, width + 1)])
    folds = align.expand_folds(val_folds(pcs.select("sample_id")), N_FOLDS).join(pcs, "sample_id")
    path = scratch_path(spark, "context")
    keyed = folds.withColumn("_seed", F.concat(F.lit("seed_"), "seed")).withColumn("_fold", F.concat(F.lit("fold_"), "fold"))
    keyed.drop("seed", "fold").write.partitionBy("_seed", "_fold").csv(path, header=True)
    out = text.scan_context(spark, f"{path}/*/*", width, r"seed_(\d+)/_fold=fold_(\d+)")
    return out.select("seed", "fold", "sample_id", "split", F.size("pcs").alias("k"),
                      F.element_at("pcs", 1).alias("first"), F.element_at("pcs", -1).alias("last"),
                      F.aggregate("pcs", F.lit(0.0), lambda total, x: total + x).alias("total"))


@query(
    "s13_scan_manifest_json",
    "SELECT sample_id, marker_idx AS component, value AS ratio, 'randomized' AS solver FROM v_vectors", ["vectors"], ["ratio"])
def _(spark, d):
    """One manifest per vector, its components as variance ratios."""
    path = scratch_path(spark, "manifests")
    table(spark, d, "embeddings").select(
        F.lit("COMPLETED").alias("status"), F.col("vec_id").alias("sample_id"),
        F.col("embedding").cast("array<double>").alias("explained_variance_ratio"),
        F.struct(F.lit("randomized").alias("svd_solver"), F.lit(float("nan")).alias("tol")).alias("algorithm"),
    ).write.json(path)
    rows = text.scan_manifest_json(spark, path, one_per_file=False)
    return rows.select("sample_id", F.posexplode("explained_variance_ratio").alias("component", "ratio"),
                       F.col("algorithm.svd_solver").alias("solver"))


def call_store(spark, d) -> str:
    path = scratch_path(spark, "store")
    store.sink_calls(calls(spark, d), view(spark, d, "markers"), path)
    return path


STORED = "SELECT sample_id, marker_idx, dosage, chrom FROM v_calls JOIN v_markers USING (marker_idx)"


@query("s14_sink_calls", STORED, ["calls", "markers"])
def _(spark, d):
    return store.scan_calls(spark, call_store(spark, d)).withColumn("chrom", F.col("chrom").cast("string"))


@query("s15_scan_calls", STORED + " WHERE marker_idx IN (SELECT p_partkey FROM part WHERE p_size = 11)", ["calls", "markers"])
def _(spark, d):
    """The marker subset of one part size."""
    wanted = table(spark, d, "part").where("p_size = 11").select(F.col("p_partkey").alias("marker_idx"))
    return store.scan_calls(spark, call_store(spark, d), wanted).withColumn("chrom", F.col("chrom").cast("string")).select(
        "sample_id", "marker_idx", "dosage", "chrom")


@query("s16_sink_predictions", "SELECT sample_id, trait, model, seed, y_true, y_pred FROM v_preds", ["preds"], ["y_true", "y_pred"])
def _(spark, d):
    path = scratch_path(spark, "predictions")
    store.sink_table(preds(spark, d).select("sample_id", "trait", "model", "seed", "y_true", "y_pred"), path)
    return spark.read.csv(path, header=True, schema="sample_id long, trait string, model string, seed int, y_true double, y_pred double")


@query(
    "s17_verify_file_manifest",
    "WITH h AS (SELECT n_nationkey, n_name AS name, sha256(n_name || ': ' || n_regionkey || chr(10)) AS found FROM nation)"
    " SELECT name, CASE WHEN n_nationkey = 3 THEN 'wrong' END AS sha256, found FROM h WHERE n_nationkey IN (3, 4)"
    " UNION ALL SELECT 'NOWHERE', 'listed only', NULL")
def _(spark, d):
    """One file per nation; one listed hash is wrong, one file is not listed, one listed file does not exist."""
    path, lines = scratch_path(spark, "hashed"), table(spark, d, "nation")
    line = F.concat("n_name", F.lit(": "), F.col("n_regionkey").cast("string"))
    lines.select(F.col("n_name").alias("name"), line.alias("value")).repartition("name").write.partitionBy("name").text(path)
    right = F.sha2(F.concat(line, F.lit("\n")).cast("binary"), 256)
    listed = F.when(F.col("n_nationkey") == 3, F.lit("wrong")).otherwise(right)
    files = lines.where("n_nationkey <> 4").select(F.create_map("n_name", listed).alias("files_SHA256"))
    extra = spark.range(1).select(F.create_map(F.lit("NOWHERE"), F.lit("listed only")).alias("files_SHA256"))
    expected = store.expected_hashes(files.union(extra))
    out = store.verify_file_manifest(spark, f"{path}/*/*.txt", expected, r"name=([^/]+)/")
    return out.withColumn("name", F.regexp_replace("name", "%20", " "))


@query(
    "s18_check_store_shapes",
    " UNION ALL ".join(
        f"SELECT '{s}' AS store, 'calls' AS what, count(*) AS n FROM v_{s} UNION ALL SELECT '{s}', 'samples', count(DISTINCT sample_id) FROM v_{s}"
        f" UNION ALL SELECT '{s}', 'markers', count(DISTINCT marker_idx) FROM v_{s}" for s in ("calls", "panel")),
    ["calls", "panel"])
def _(spark, d):
    return store_shapes({"calls": calls(spark, d), "panel": panel(spark, d)})


@query(
    "u05_binding_check",
    "SELECT 1 AS seed, 0 AS fold, coalesce(a.ord, b.ord) AS ord, a.sample_id AS left_id, b.sample_id AS right_id"
    f" FROM (SELECT row_number() OVER (ORDER BY ord) - 1 AS ord, sample_id FROM ({ID_ORDER})) a FULL JOIN"
    " (SELECT row_number() OVER (ORDER BY min(o_orderkey)) - 1 AS ord, o_custkey AS sample_id FROM orders GROUP BY o_custkey) b"
    " ON a.ord = b.ord WHERE a.sample_id IS DISTINCT FROM b.sample_id")
def _(spark, d):
    """Customers in order of their first closed order against those in order of any order."""


    first = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("sample_id")).agg(F.min("o_orderkey").alias("k"))
    closed = requested_ids(spark, d).withColumnRenamed("ord", "k")
    keys = (F.lit(1).alias("seed"), F.lit(0).alias("fold"), "ord", "sample_id")
    left, right = rank_order(closed, ["k"]).select(*keys), rank_order(first, ["k"]).select(*keys)
    return text.binding_check(left, right)


@query(
    "t04_export_dosage",
    "SELECT cast(sample_id AS varchar) AS sample_id, marker_idx, 'm' || marker_idx AS marker_id, dosage, sample_id * 0.1 AS y FROM v_panel",
    ["panel"], ["y"])
def _(spark, d):
    """The panel exported as a wide table with phenotypes, and read again."""
    rows = stable(panel(spark, d))
    names = rows.select("marker_idx").distinct().withColumn("marker_id", F.concat(F.lit("m"), F.col("marker_idx")))
    traits = rows.select("sample_id").distinct().withColumn("y", F.col("sample_id") * F.lit(0.1))
    path = scratch_path(spark, "export")
    header = store.export_dosage(rows, names, traits, path, sep="\t", missing="NA")
    back = text.scan_dosage_table(spark, f"{path}/dosage", None, header)
    y = spark.read.schema("sample_id string, y double").option("header", True).csv(f"{path}/phenotypes")
    ids = spark.read.text(f"{path}/sample_ids").withColumnRenamed("value", "sample_id")
    return back.join(y.join(ids, "sample_id"), "sample_id").select("sample_id", "marker_idx", "marker_id", "dosage", "y")
