"""Call store and exports on Parquet / CSV, and file integrity."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.checks import duplicates, require_empty
from ..plans.scan import with_row_number
from ..plans.session import stable

ORIENTATION = "0=allele1 homozygote,1=heterozygote,2=allele2 homozygote"


def sink_calls(calls: DataFrame, markers: DataFrame, path: str, partitions: int | None = None) -> None:
    """Write (sample_id, marker_idx, dosage) by chromosome, clustered by marker.

    A marker without a chromosome is an error.  The range partitioning includes the sample, so one heavily called marker
    is cut over several files; row-group statistics then prune marker subsets.
    """
    known = calls.join(markers.select("marker_idx", "chrom"), "marker_idx", "left")
    missing = F.raise_error(F.concat(F.lit("no chromosome for marker "), F.col("marker_idx").cast("string")))
    placed = known.withColumn("chrom", F.when(F.col("chrom").isNull(), missing.cast("string")).otherwise(F.col("chrom").cast("string")))
    keys = ["chrom", "marker_idx", "sample_id"]
    ranged = placed.repartitionByRange(partitions, *keys) if partitions else placed.repartitionByRange(*keys)
    ranged.sortWithinPartitions(*keys).write.mode("errorifexists").partitionBy("chrom").parquet(f"{path}/calls")
    calls.sparkSession.createDataFrame([("orientation", ORIENTATION)], "key string, value string").write.mode(
        "errorifexists").parquet(f"{path}/properties")


def scan_calls(spark: SparkSession, path: str, markers: Sequence[int] | DataFrame | None = None) -> DataFrame:
    """Read a call store, optionally a marker subset (pushed to the scan where
    it is a short list, a semi join otherwise)."""
    orientation = spark.read.parquet(f"{path}/properties").where("key = 'orientation'").first()
    if orientation is None or orientation["value"] != ORIENTATION:
        raise ValueError("call store has no known orientation")
    calls = spark.read.option("basePath", f"{path}/calls").parquet(f"{path}/calls")
    if markers is None:
        return calls
    if isinstance(markers, DataFrame):
        return calls.join(markers.select("marker_idx"), "marker_idx", "left_semi")
    return calls.where(F.col("marker_idx").isin(list(markers)))


def sink_table(df: DataFrame, path: str, form: str = "csv") -> None:
    """Predictions or metrics; doubles keep every digit, nothing is overwritten."""
    writer = df.write.mode("errorifexists")
    if form == "csv":
        writer.option("header", True).csv(path)
    elif form == "parquet":
        writer.parquet(path)
    else:
        raise ValueError(f"unknown form {form!r}")


def export_dosage(
    calls: DataFrame, markers: DataFrame, phenotypes: DataFrame, path: str, sep: str = ",", missing: str = ""
) -> str:
    """Write a wide dosage table, phenotypes and sample IDs below ``path``; returns the table's header line.

    ``calls`` is (sample_id, marker_idx, dosage), ``markers`` (marker_idx,
    marker_id), ``phenotypes`` sample_id and traits.  ``dosage`` has a line per
    phenotyped sample with every marker in index order, ``missing`` where there
    is no call; ``phenotypes`` keeps every digit; ``sample_ids`` lists the same
    samples; ``header`` names the columns.  Lines and rows are in order of
    sample IDs over the part files.  A repeated sample, marker ID or call, a
    call outside 0, 1 and 2, and a call of an unknown marker or sample are
    errors.  Nothing is overwritten.

    A line is as wide as the table, which is the format; lines are built by
    sample from placed tokens, and the driver only sees the header.
    """
    spark = calls.sparkSession
    require_empty(duplicates(phenotypes, ["sample_id"]), "duplicate sample")
    require_empty(duplicates(markers, ["marker_id"]), "duplicate marker ID")
    require_empty(duplicates(markers, ["marker_idx"]), "duplicate marker index")
    require_empty(duplicates(calls, ["sample_id", "marker_idx"]), "duplicate call")
    require_empty(calls.join(phenotypes, "sample_id", "left_anti"), "call of an unknown sample")
    require_empty(calls.join(markers, "marker_idx", "left_anti"), "call of an unknown marker")
    require_empty(calls.where("dosage NOT IN (0, 1, 2)"), "unknown dosage")
    places = stable(with_row_number(markers.select("marker_idx", "marker_id"), [], ["marker_idx"], "place"))
    width = places.count()
    header = sep.join(["sample_id", *(r[0] for r in places.orderBy("place").select("marker_id").toLocalIterator())])
    tokens = calls.where("dosage IS NOT NULL").join(places, "marker_idx")
    tokens = tokens.select("sample_id", F.struct(F.col("place").cast("int").alias("place"), F.col("dosage").cast("string").alias("t")).alias("r"))
    lists = tokens.groupBy("sample_id").agg(F.array_sort(F.collect_list("r")).alias("r"))
    gap = lambda n: F.repeat(F.lit(sep + missing), n)
    before = lambda i: F.when(i > 0, F.element_at("r", F.greatest(i, F.lit(1)))["place"]).otherwise(0)
    placed = F.array_join(F.transform("r", lambda x, i: F.concat(gap(x["place"] - before(i) - 1), F.lit(sep), x["t"])), "")
    tail = F.concat(placed, gap(F.lit(width) - F.element_at("r", -1)["place"]))
    line = F.concat(F.col("sample_id").cast("string"), F.coalesce(tail, gap(F.lit(width))))
    ids = phenotypes.select("sample_id")
    lines = ids.join(lists, "sample_id", "left").select("sample_id", line.alias("value"))
    lines.orderBy("sample_id").select("value").write.text(f"{path}/dosage")
    ordered = phenotypes.select("sample_id", *[c for c in phenotypes.columns if c != "sample_id"]).orderBy("sample_id")
    ordered.write.option("header", True).csv(f"{path}/phenotypes")
    ids.orderBy("sample_id").select(F.col("sample_id").cast("string")).write.text(f"{path}/sample_ids")
    spark.createDataFrame([(header,)], "value string").write.text(f"{path}/header")
    return header


def expected_hashes(manifest: DataFrame, column: str = "files_SHA256") -> DataFrame:
    """(name, sha256) from a manifest's map of file names to hashes."""
    return manifest.select(F.explode(column).alias("name", "sha256"))


def verify_file_manifest(spark: SparkSession, path: str, expected: DataFrame, name: str = r"([^/]+)$") -> DataFrame:
    """Files whose SHA-256 differs from the expected (name, sha256), is missing or unlisted.

    ``name`` is the pattern whose first group names a file within its path.  A
    file is hashed as one value, so it must stay below the reader's 2 GB.
    """
    files = spark.read.format("binaryFile").load(path).select(
        F.regexp_extract("path", name, 1).alias("name"), F.sha2("content", 256).alias("found"))
    both = files.join(expected, "name", "full")
    return both.where(~F.col("found").eqNullSafe(F.col("sha256"))).select("name", "sha256", "found")
