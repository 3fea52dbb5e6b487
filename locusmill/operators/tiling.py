"""Genome tiles: runs of markers in (chromosome, position) order.

A tile is named by the global index of its first marker, so every step works on
a set of start indexes.  Markers find their tile by a running count of starts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.scan import exact_quantiles, prefix_scan, with_row_number
from ..plans.session import stable
from .intervals import gap_fill_intervals, locate_in_interval

SMALL_SHARE = 5
LARGE_FACTOR = 2


def order_index(markers: DataFrame) -> DataFrame:
    """0-based global index ``ord`` in (chrom, pos, marker_idx) order."""
    out = with_row_number(markers, [], ["chrom", "pos", "marker_idx"], "_rn")
    return out.withColumn("ord", F.col("_rn") - 1).drop("_rn")


def block_assign(markers: DataFrame, length: int) -> DataFrame:
    """Fixed-length marker blocks and their sizes; the last one may be short."""
    return markers.withColumn("block", F.floor(F.col("marker_idx") / length))


def block_sizes(blocks: DataFrame) -> DataFrame:
    return blocks.groupBy("block").agg(F.count(F.lit(1)).alias("n_markers"))


def initial_tiles(ordered: DataFrame, size: int) -> DataFrame:
    """Equal-count tiles over the global order."""
    return ordered.withColumn("tile_id", F.floor(F.col("ord") / size))


def gene_of_marker(
    ordered: DataFrame, genes: DataFrame, lengths: DataFrame | None = None
) -> DataFrame:
    """``ordered`` plus the start of the gene that holds the marker (NULL: none), and ``in_gap``.

    With the chromosomes' ``lengths`` a marker is in a gap only where the filled
    gaps hold it; without them wherever no gene does.
    """
    spans = genes.select("chrom", F.col("g_start").alias("start"), F.col("g_end").alias("end"),
                         F.lit("gene").alias("kind"))
    if lengths is not None:
        spans = gap_fill_intervals(genes, lengths).select("chrom", "start", "end", "kind")
    located = locate_in_interval(ordered, spans)
    in_gene = F.col("kind").eqNullSafe(F.lit("gene"))
    in_gap = F.col("kind").eqNullSafe(F.lit("non-gene")) if lengths is not None else ~in_gene
    return located.select(*ordered.columns, F.when(in_gene, F.col("start")).alias("gene_start"), in_gap.alias("in_gap"))


def boundary_starts(located: DataFrame, size: int) -> DataFrame:
    """Tile starts after moving each boundary that falls into a gene past that gene.

    A boundary between chromosomes stays, and so does one whose gene reaches the
    last marker.  Boundaries that meet collapse into one, which is what merging
    the emptied tiles into their predecessor gives.
    """
    total = located.count()
    ends = located.where("gene_start IS NOT NULL").groupBy("chrom", "gene_start").agg(
        (F.max("ord") + 1).alias("after"))
    edges = located.where((F.col("ord") % size == 0))
    before = located.where((F.col("ord") % size == size - 1)).select(
        (F.col("ord") + 1).alias("ord"), F.col("chrom").alias("prev_chrom"))
    moved = edges.join(before, "ord", "left").join(ends, ["chrom", "gene_start"], "left")
    crosses = (F.col("prev_chrom") == F.col("chrom")) & (F.col("after") < total)
    start = F.when(F.col("after").isNotNull() & crosses, F.col("after")).otherwise(F.col("ord"))
    return moved.select(start.alias("start")).distinct()


def tiles_from_starts(located: DataFrame, starts: DataFrame) -> DataFrame:
    """Markers with ``tile_id`` = number of starts at or before them, from 0."""
    flagged = located.join(
        starts.select(F.col("start").alias("ord"), F.lit(1).alias("_s")), "ord", "left")
    out = prefix_scan(flagged, [], ["ord"], {"_t": ("count", F.col("_s"), True)})
    return out.withColumn("tile_id", F.col("_t") - 1).drop("_t", "_s")


def tile_table(tiled: DataFrame) -> DataFrame:
    """One row per tile: index and position span and marker count."""
    return tiled.groupBy("tile_id").agg(
        F.min("ord").alias("start_idx"), F.max("ord").alias("end_idx"),
        F.min_by("chrom", "ord").alias("start_chrom"), F.max_by("chrom", "ord").alias("end_chrom"),
        F.min_by("pos", "ord").alias("start_pos"), F.max_by("pos", "ord").alias("end_pos"),
        F.count(F.lit(1)).alias("snp_count"),
    )


def merge_small(tiles: DataFrame, size: int) -> DataFrame:
    """Starts left after tiles under size/5 joined the tile before them.

    The leading tiles join forward until together they reach the threshold, so
    a start survives if its tile is large enough and at least one threshold of
    markers lies before it; the first tile always survives.
    """
    least = size / SMALL_SHARE
    enough = F.col("end_idx") + 1 >= least
    head_end = tiles.where(enough).agg(F.min("end_idx")).first()[0]
    keeps = (F.col("start_idx") == 0) | (
        (F.col("snp_count") >= least) & (F.col("start_idx") > F.lit(head_end).cast("long")))
    return tiles.where(keeps).select(F.col("start_idx").alias("start"))


def split_large(located: DataFrame, starts: DataFrame, size: int) -> DataFrame:
    """Cut tiles above twice the size at a non-gene marker next to their middle.

    The nearest one at or after the middle (before the last marker) is taken,
    else the nearest before it.  A tile without one stays.  All tiles are cut
    in the same round, so the number of rounds is the logarithm of the largest
    tile over the size; each round is two aggregates over the non-gene markers.
    """
    limit = size * LARGE_FACTOR
    starts = stable(starts)
    while True:
        tiled = tiles_from_starts(located, starts)
        spans = tile_table(tiled).where(F.col("snp_count") > limit).select(
            "tile_id", "start_idx", "end_idx",
            (F.col("start_idx") + F.floor(F.col("snp_count") / 2)).alias("middle"))
        free = tiled.where("in_gap").join(spans, "tile_id")
        after = (F.col("ord") >= F.col("middle")) & (F.col("ord") < F.col("end_idx"))
        before = (F.col("ord") < F.col("middle")) & (F.col("ord") > F.col("start_idx"))
        cuts = free.groupBy("tile_id").agg(
            F.min(F.when(after, F.col("ord"))).alias("a"), F.max(F.when(before, F.col("ord"))).alias("b"))
        fresh = stable(cuts.select(F.coalesce("a", "b").alias("start")).where("start IS NOT NULL"))
        if fresh.isEmpty():
            return starts
        starts = stable(starts.unionByName(fresh).distinct())


def split_chromosomes(located: DataFrame, starts: DataFrame) -> DataFrame:
    """Add a start wherever the chromosome changes, so no tile spans two."""
    firsts = located.groupBy("chrom").agg(F.min("ord").alias("start")).select("start")
    return starts.unionByName(firsts).distinct()


def partition_genome(
    markers: DataFrame, genes: DataFrame, size: int, lengths: DataFrame | None = None
) -> DataFrame:
    """All steps: markers in order with their final ``tile_id``."""
    located = stable(gene_of_marker(order_index(markers), genes, lengths))
    starts = boundary_starts(located, size)
    starts = merge_small(tile_table(tiles_from_starts(located, starts)), size)
    starts = split_large(located, starts, size)
    return tiles_from_starts(located, split_chromosomes(located, starts))


def chromosome_edges(tiles: DataFrame, whole: DataFrame, lengths: DataFrame) -> DataFrame:
    """Tiles cut at a chromosome change get the chromosome's edges as positions:
    the left part ends at its length, the right part starts at 0.

    ``whole`` are the tile starts before the cut at chromosomes.
    """
    kept = whole.select(F.col("start").alias("start_idx"), F.lit(True).alias("_kept"))
    after = whole.select((F.col("start") - 1).alias("end_idx"), F.lit(True).alias("_stops"))
    last = tiles.agg(F.max("end_idx")).first()[0]
    out = tiles.join(kept, "start_idx", "left").join(after, "end_idx", "left").join(
        lengths.select(F.col("chrom").alias("start_chrom"), "length"), "start_chrom", "left")
    stops = F.col("_stops").isNotNull() | (F.col("end_idx") == F.lit(last))
    return out.select(
        "tile_id", "start_idx", "end_idx", "start_chrom",
        F.when(F.col("_kept").isNull(), F.lit(0)).otherwise(F.col("start_pos")).cast("long").alias("start_pos"),
        F.when(stops, F.col("end_pos")).otherwise(F.coalesce("length", F.lit(0))).cast("long").alias("end_pos"),
        "snp_count",
    )


def marker_to_tile(markers: DataFrame, tiled: DataFrame) -> DataFrame:
    """Tile of each (chrom, pos), -1 where there is none."""
    keyed = tiled.groupBy("chrom", "pos").agg(F.max("tile_id").alias("tile_id"))
    out = markers.join(keyed, ["chrom", "pos"], "left")
    return out.withColumn("tile_id", F.coalesce("tile_id", F.lit(-1)))


def tile_offsets(tiles: DataFrame) -> DataFrame:
    """Tiles with the number of markers before them."""
    return prefix_scan(tiles, [], ["tile_id"], {"offset": ("sum", F.col("snp_count"), False)}).fillna(
        0, ["offset"])


def tile_statistics(tiles: DataFrame, length: str = "snp_count") -> DataFrame:
    """Number of tiles and min, max, mean and median of their lengths."""
    middle = exact_quantiles(tiles, [], length, {"m": 0.5}).first()
    return tiles.agg(
        F.count(F.lit(1)).alias("n"), F.min(length).alias("min"), F.max(length).alias("max"),
        F.avg(length).alias("mean"),
    ).withColumn("median", F.lit(middle["m"] if middle else None).cast("double"))
