"""Genome intervals: building, locating markers, per-interval counts and features."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.codes import plain_chrom
from ..plans.joins import attach_measured
from ..plans.scan import prefix_scan, upper_median
from ..plans.session import stable


def gap_fill_intervals(genes: DataFrame, lengths: DataFrame) -> DataFrame:
    """Alternating gene and non-gene intervals per chromosome.

    ``genes`` is (chrom, g_start, g_end), ``lengths`` (chrom, length).  A gap is
    filled before the first gene, between genes more than one apart, and after
    the last one; a chromosome without genes is one interval.  The previous
    gene's end is carried by a distributed scan, so a chromosome holding most
    genes is not sorted in one task.
    """
    known = genes.join(lengths, "chrom")
    scanned = prefix_scan(
        known, ["chrom"], ["g_start", "g_end"], {"prev_end": ("last", F.col("g_end"), False)}
    )
    gene = F.struct(F.col("g_start").alias("start"), F.col("g_end").alias("end"), F.lit("gene").alias("kind"))
    gap_start = F.when(F.col("prev_end").isNull(), F.lit(0).cast("long")).otherwise(F.col("prev_end") + 1)
    gap = F.struct(gap_start.alias("start"), (F.col("g_start") - 1).alias("end"), F.lit("non-gene").alias("kind"))
    open_before = F.when(F.col("prev_end").isNull(), F.col("g_start") > 0).otherwise(
        F.col("g_start") - F.col("prev_end") > 1)
    bodies = scanned.select("chrom", F.inline(F.when(open_before, F.array(gap, gene)).otherwise(F.array(gene))))
    last = known.groupBy("chrom", "length").agg(
        F.max_by("g_end", F.struct("g_start", "g_end")).alias("e")
    ).where("e < length - 1").select("chrom", (F.col("e") + 1).alias("start"), F.col("length").alias("end"))
    bare = lengths.join(genes, "chrom", "left_anti").select(
        "chrom", F.lit(0).cast("long").alias("start"), F.col("length").alias("end"))
    gaps = last.unionByName(bare)
    return bodies.unionByName(gaps.withColumn("kind", F.lit("non-gene")))


def overlapping_genes(genes: DataFrame) -> DataFrame:
    """Genes that start at or before the furthest end so far on their chromosome."""
    scanned = prefix_scan(
        genes, ["chrom"], ["g_start", "g_end"], {"furthest": ("max", F.col("g_end"), False)}
    )
    return scanned.where("g_start <= furthest")


def visible_stretches(intervals: DataFrame) -> DataFrame:
    """(_chrom, _low, end, start, kind): where each interval is the one of lowest start that holds a position.

    An interval shows from behind the furthest end before it to its own end, so
    the stretches of a chromosome are disjoint.  Of intervals with one start the
    longest shows, then the first kind by name.
    """
    start, end = F.col("start").cast("long"), F.col("end").cast("long")
    known = intervals.select(plain_chrom("chrom").alias("_chrom"), start.alias("start"), end.alias("end"), "kind")
    known = known.where("_chrom IS NOT NULL AND start <= end")
    scanned = prefix_scan(known, ["_chrom"], ["start", F.col("end").desc(), "kind"], {"furthest": ("max", F.col("end"), False)})
    low = F.greatest("start", F.col("furthest") + 1)  # NULL counts for nothing
    return scanned.select("_chrom", low.alias("_low"), "end", "start", "kind").where("_low <= end")


def locate_in_interval(markers: DataFrame, intervals: DataFrame, how: str = "left") -> DataFrame:
    """The interval that holds each marker, NULL where there is none; ``how="inner"`` leaves such markers out.

    Markers and the stretches where intervals show are sorted as one table by
    chromosome and position, and the last stretch is carried along: a marker is
    in it or in none.  An interval is one row however long it is, and a hot
    chromosome covers many slices.  Chromosomes match with or without a ``chr``
    prefix.  Where intervals overlap the lowest start wins.  Markers without a
    chromosome or position are in no interval; repeated markers stay.
    """
    if how not in ("left", "inner"):
        raise ValueError(f"unknown join {how!r}")
    shown = visible_stretches(intervals)
    held = F.struct("end", "start", "kind")
    row = F.struct(*markers.columns)
    points = markers.select(plain_chrom("chrom").alias("_chrom"), F.col("pos").alias("_at"), F.lit(True).alias("_marker"), row.alias("_row"))
    edges = shown.select("_chrom", F.col("_low").alias("_at"), F.lit(False).alias("_marker"), held.alias("_held"))
    both = points.unionByName(edges, allowMissingColumns=True)
    scanned = prefix_scan(both, ["_chrom"], ["_at", "_marker"], {"_in": ("last", F.col("_held"), True)}).where("_marker")
    inside = F.col("_chrom").isNotNull() & (F.col("_at") <= F.col("_in.end"))
    out = scanned.select("_row.*", *[F.when(inside, F.col(f"_in.{c}")).alias(c) for c in ("start", "end", "kind")])
    return out.where("start IS NOT NULL") if how == "inner" else out


def interval_marker_counts(located: DataFrame) -> DataFrame:
    """Markers per interval; intervals without markers do not appear."""
    return located.where("start IS NOT NULL").groupBy(
        plain_chrom("chrom").alias("chrom"), "start", "end"
    ).agg(F.count(F.lit(1)).alias("snp_count"))


def interval_counts(intervals: DataFrame) -> DataFrame:
    """Gene and non-gene intervals per chromosome and over all."""
    return intervals.groupBy("chrom").agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("kind") == "gene").alias("gene"),
        F.count_if(F.col("kind") == "non-gene").alias("non_gene"),
    ).unionByName(intervals.agg(
        F.lit("all").alias("chrom"),
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("kind") == "gene").alias("gene"),
        F.count_if(F.col("kind") == "non-gene").alias("non_gene"),
    ))


def interval_lengths(intervals: DataFrame) -> DataFrame:
    """Min, max, mean and upper median of the lengths, per kind and over all."""
    lengths = stable(intervals.select("kind", (F.col("end") - F.col("start") + 1).alias("len")))
    both = lengths.unionByName(lengths.withColumn("kind", F.lit("all")))
    stats = both.groupBy("kind").agg(
        F.count(F.lit(1)).alias("n"), F.min("len").alias("min"), F.max("len").alias("max"),
        F.avg("len").alias("mean"),
    )
    return stats.join(upper_median(both, ["kind"], "len", "median"), "kind")


def interval_features(markers: DataFrame, intervals: DataFrame) -> DataFrame:
    """Six position features per marker; 0 in the last four where no interval holds it."""
    located = stable(locate_in_interval(markers, intervals))
    counts = interval_marker_counts(located).withColumnRenamed("chrom", "_chrom")
    out = attach_measured(
        located.withColumn("_chrom", plain_chrom("chrom")), counts, ["_chrom", "start", "end"], "left")
    length = F.col("end") - F.col("start") + 1
    zero = F.lit(0.0)
    return out.select(
        "marker_idx", "chrom", "pos",
        F.coalesce((F.col("start") + F.col("end")) / 2, zero).alias("center"),
        F.coalesce(length.cast("double"), zero).alias("length"),
        F.coalesce(F.col("snp_count") / length, zero).alias("density"),
        F.when(F.col("kind") == "gene", 1.0).otherwise(zero).alias("is_gene"),
    )


def default_position_features(markers: DataFrame) -> DataFrame:
    """Features without annotation: centre = position and fixed length, density, gene share."""
    chrom = F.coalesce(F.col("chrom").cast("string").try_cast("double"), F.lit(0.0))
    pos = F.coalesce(F.col("pos").cast("string").try_cast("double"), F.lit(0.0))
    return markers.select(
        "marker_idx", chrom.alias("chrom"), pos.alias("pos"), pos.alias("center"),
        F.lit(1000.0).alias("length"), F.lit(0.001).alias("density"), F.lit(0.5).alias("is_gene"),
    )
