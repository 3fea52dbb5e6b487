"""Text scans.  Wide rows stay one string until they are exploded to long calls,
so no schema grows with the number of markers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.codes import iid_sample_id
from ..operators.checks import CheckFailed, duplicates, require_empty
from ..plans.scan import with_row_number

MISSING_TOKENS = ["NA", "NAN", "."]


def _fields() -> Column:
    return F.split(F.trim("value"), r"\s+")


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(ord, value): non-blank lines with their 0-based order in the file."""
    rows = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("_f"),
                                        F.col("_metadata.file_block_start").alias("_b"))
    rows = rows.withColumn("_id", F.monotonically_increasing_id())
    kept = rows.where(F.length(F.trim("value")) > 0)
    out = with_row_number(kept, [], ["_f", "_b", "_id"], "_rn")
    return out.select((F.col("_rn") - 1).alias("ord"), "value")


def scan_bim(spark: SparkSession, path: str) -> DataFrame:
    """Marker table: six whitespace-separated columns without a header."""
    f = F.col("f")
    return numbered_lines(spark, path).select("ord", _fields().alias("f")).select(
        F.col("ord").alias("marker_idx"), f[0].alias("chrom"), f[1].alias("marker_id"),
        f[2].cast("double").alias("cm"), f[3].cast("long").alias("pos"), f[4].alias("a1"), f[5].alias("a2"),
    )


def scan_fam(spark: SparkSession, path: str, id_rule: str = "joined") -> DataFrame:
    """Sample table with the composed sample ID."""
    f = F.col("f")
    rows = numbered_lines(spark, path).select("ord", _fields().alias("f")).select(
        F.col("ord").alias("sample_idx"), f[0].alias("fid"), f[1].alias("iid"), f[2].alias("pid"),
        f[3].alias("mid"), f[4].alias("sex"), f[5].alias("pheno"),
    )
    return rows.withColumn("sample_id", iid_sample_id("fid", "iid", id_rule))


def _header(spark: SparkSession, path: str) -> tuple[str, list[str]]:
    line = spark.read.text(path).where(F.length(F.trim("value")) > 0).first()["value"]
    return line, line.split()


def scan_dosage_table(
    spark: SparkSession, path: str, missing_code: int | None = 3, header: str | None = None
) -> DataFrame:
    """Wide sample x marker text -> (sample_id, marker_idx, marker_id, dosage).

    The first line names the markers; for a table in several files the header
    line is passed instead.  A duplicate sample, a line of another width and an
    unreadable code are errors; NA, NAN and . are missing.
    """
    header, names = _header(spark, path) if header is None else (header, header.split())
    markers = spark.createDataFrame(
        [(i, m) for i, m in enumerate(names[1:])], "marker_idx int, marker_id string")
    width = len(names)
    lines = spark.read.text(path).where((F.length(F.trim("value")) > 0) & (F.col("value") != header))
    fields = lines.select(_fields().alias("f")).select(F.col("f")[0].alias("sample_id"), "f")
    require_empty(duplicates(fields.select("sample_id"), ["sample_id"]), "duplicate sample in dosage table")
    checked = F.when(
        F.size("f") != width, F.raise_error(F.concat(F.lit("wrong number of calls for sample "), F.col("sample_id")))
    ).otherwise(F.slice("f", 2, width))
    calls = fields.select("sample_id", F.posexplode(checked).alias("marker_idx", "token"))
    number = F.col("token").try_cast("double")
    missing = F.upper("token").isin(MISSING_TOKENS)
    if missing_code is not None:
        missing = missing | (number == missing_code)
    dosage = (
        F.when(missing, F.lit(None).cast("int"))
        .when(number.isin(0.0, 1.0, 2.0), number.cast("int"))
        .otherwise(F.raise_error(F.concat(F.lit("unknown dosage "), F.col("token"))).cast("int"))
    )
    return calls.select("sample_id", "marker_idx", dosage.alias("dosage")).join(markers, "marker_idx")


def scan_compact_calls(
    spark: SparkSession, path: str, n_markers: int, wanted: DataFrame | None = None, missing_code: int = 5
) -> DataFrame:
    """``id digits`` lines -> long calls.  Unwanted samples leave before the
    digits are exploded; a listed sample that is absent is an error."""
    rows = spark.read.text(path).where(F.length(F.trim("value")) > 0).select(_fields().alias("f")).select(
        F.col("f")[0].alias("sample_id"), F.array_join(F.slice("f", 2, F.greatest(F.size("f") - 1, F.lit(0))), "").alias("digits"))
    if wanted is not None:
        rows = rows.join(wanted.select("sample_id"), "sample_id", "left_semi")
        require_empty(wanted.join(rows, "sample_id", "left_anti"), "selected sample missing from calls")
    require_empty(duplicates(rows.select("sample_id"), ["sample_id"]), "duplicate sample in compact calls")
    checked = F.when(
        F.length("digits") != n_markers,
        F.raise_error(F.concat(F.lit("wrong call length for sample "), F.col("sample_id"))),
    ).otherwise(F.split("digits", ""))
    calls = rows.select("sample_id", F.posexplode(checked).alias("marker_idx", "token"))
    dosage = (
        F.when(F.col("token") == str(missing_code), F.lit(None).cast("int"))
        .when(F.col("token").isin("0", "1", "2"), F.col("token").cast("int"))
        .otherwise(F.raise_error(F.concat(F.lit("unknown call "), F.col("token"))).cast("int"))
    )
    return calls.select("sample_id", "marker_idx", dosage.alias("dosage"))


def scan_marker_annotation(
    spark: SparkSession, path: str, columns: dict[str, str], sep: str = "\t"
) -> DataFrame:
    """Annotation with the given source columns renamed; a missing column or a
    repeated marker is an error.  Alleles are upper-cased."""
    raw = spark.read.csv(path, header=True, sep=sep)
    absent = [c for c in columns.values() if c not in raw.columns]
    if absent:
        raise CheckFailed(f"annotation lacks columns {absent}")
    out = raw.select(*[F.col(f"`{source}`").alias(name) for name, source in columns.items()])
    for allele in ("a1", "a2"):
        if allele in columns:
            out = out.withColumn(allele, F.upper(allele))
    require_empty(duplicates(out, ["marker_id"]), "duplicate marker in annotation")
    return out


def scan_phenotypes(
    spark: SparkSession, path: str, traits: Sequence[str], key: str = "sample_id", sep: str = "\t"
) -> DataFrame:
    """Phenotype table with traits as doubles (unreadable text is missing); a
    table without rows and a trait without any value are errors."""
    raw = spark.read.csv(path, header=True, sep=sep)
    absent = [t for t in [key, *traits] if t not in raw.columns]
    if absent:
        raise CheckFailed(f"phenotype table lacks columns {absent}")
    values = {t: F.nanvl(F.col(f"`{t}`").try_cast("double"), F.lit(None).cast("double")) for t in traits}
    out = raw.select(F.col(f"`{key}`").alias("sample_id"), *[v.alias(t) for t, v in values.items()])
    filled = out.agg(F.count(F.lit(1)).alias("_n"), *[F.count(t).alias(t) for t in traits]).first()
    empty = [t for t in traits if filled[t] == 0]
    if not filled["_n"] or empty:
        raise CheckFailed(f"no phenotype values in {empty or path}")
    return out


def sniff_separator(spark: SparkSession, path: str) -> str | None:
    """First of whitespace (None), comma and tab that gives more than one column."""
    line = spark.read.text(path).where(F.length(F.trim("value")) > 0).first()["value"]
    for name, parts in ((None, line.split()), (",", line.split(",")), ("\t", line.split("\t"))):
        if len(parts) > 1:
            return name
    raise CheckFailed(f"cannot find a separator in {path}")


def scan_sniffed_table(
    spark: SparkSession, path: str, aliases: dict[str, Sequence[str]]
) -> DataFrame:
    """Table of unknown separator; columns are found by alias without regard to case."""
    sep = sniff_separator(spark, path)
    if sep is None:
        header, names = _header(spark, path)
        lines = spark.read.text(path).where((F.length(F.trim("value")) > 0) & (F.col("value") != header))
        raw = lines.select(_fields().alias("f")).select(
            *[F.try_element_at("f", F.lit(i + 1)).alias(c) for i, c in enumerate(names)])
    else:
        raw = spark.read.csv(path, header=True, sep=sep)
    chosen = []
    for name, spellings in aliases.items():
        wanted = {s.lower() for s in spellings}
        hits = [c for c in raw.columns if c.strip().lower() in wanted]
        if not hits:
            raise CheckFailed(f"no column for {name} among {raw.columns}")
        chosen.append(F.col(f"`{hits[0]}`").alias(name))
    return raw.select(*chosen)


def scan_gene_annotation(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(lengths, genes) from a four-column annotation whose text names the kind."""
    rows = spark.read.csv(path, sep="\t", schema="chrom string, start long, end long, text string")
    chromosome = F.col("text").contains("chromosome")
    lengths = rows.where(chromosome).select("chrom", F.col("end").alias("length"))
    genes = rows.where(~chromosome & F.col("text").contains("gene")).select(
        "chrom", F.col("start").alias("g_start"), F.col("end").alias("g_end"))
    return lengths, genes


def scan_id_list(spark: SparkSession, path: str, expected: int | None = None) -> DataFrame:
    """(ord, sample_id) in file order; duplicates and a wrong count are errors."""
    out = numbered_lines(spark, path).select("ord", F.trim("value").alias("sample_id"))
    require_empty(duplicates(out.select("sample_id"), ["sample_id"]), "duplicate ID in list")
    if expected is not None and out.count() != expected:
        raise CheckFailed(f"expected {expected} IDs in {path}")
    return out


def scan_folds(spark: SparkSession, path: str, pattern: str = r"cv_splits_(\d+)") -> DataFrame:
    """Per-seed membership files -> (seed, fold, sample_id, split)."""
    raw = spark.read.csv(path, header=True, schema="fold int, sample_id string, split string", enforceSchema=False)
    seed = F.regexp_extract(F.col("_metadata.file_path"), pattern, 1).cast("int")
    return raw.select(seed.alias("seed"), "fold", "sample_id", "split")


def scan_context(
    spark: SparkSession, path: str, k: int, pattern: str = r"seed_(\d+)/fold_(\d+)"
) -> DataFrame:
    """Per-fold covariate files -> (seed, fold, sample_id, split, pcs)."""
    names = [f"PC{i}" for i in range(1, k + 1)]
    raw = spark.read.csv(path, header=True).withColumn("_f", F.col("_metadata.file_path"))
    absent = [c for c in ["sample_id", "split", *names] if c not in raw.columns]
    if absent:
        raise CheckFailed(f"covariate files lack columns {absent}")
    return raw.select(
        F.regexp_extract("_f", pattern, 1).cast("int").alias("seed"),
        F.regexp_extract("_f", pattern, 2).cast("int").alias("fold"),
        "sample_id", "split", F.array(*[F.col(c).cast("double") for c in names]).alias("pcs"),
    )


def scan_manifest_json(spark: SparkSession, path: str, one_per_file: bool = True) -> DataFrame:
    """Nested manifests, one row per file (or per line); bare NaN literals are accepted."""
    raw = spark.read.json(path, multiLine=one_per_file, allowNonNumericNumbers=True)
    return raw.withColumn("file_path", F.col("_metadata.file_path"))


def manifest_ids(manifests: DataFrame, column: str) -> DataFrame:
    """(seed, fold, ord, sample_id) of one ordered ID list of the manifests."""
    return manifests.select("seed", "fold", F.posexplode(column).alias("ord", "sample_id"))


def binding_check(listed: DataFrame, expected: DataFrame) -> DataFrame:
    """Positions at which two ordered ID lists differ; both are (seed, fold, ord, sample_id)."""
    keys = ["seed", "fold", "ord"]
    both = listed.select(*keys, F.col("sample_id").alias("left_id")).join(
        expected.select(*keys, F.col("sample_id").alias("right_id")), keys, "full")
    return both.where(~F.col("left_id").eqNullSafe(F.col("right_id")))


def scan_map(spark: SparkSession, path: str) -> DataFrame:
    """Genetic map: chromosome, marker, distance, position; no header."""
    f = F.col("f")
    return numbered_lines(spark, path).select("ord", _fields().alias("f")).select(
        F.col("ord").alias("marker_idx"), f[0].alias("chrom"), f[1].alias("marker_id"),
        f[2].try_cast("double").alias("cm"), f[3].try_cast("double").cast("long").alias("pos"))
