"""Tiles: cases worked out by hand, and what must hold for any markers and genes."""

import random

import pytest

from locusmill.operators import tiling


def tile_starts(spark, markers, genes, size):
    frame = spark.createDataFrame([(i, c, p) for i, (c, p) in enumerate(markers)], "marker_idx long, chrom string, pos long")
    spans = spark.createDataFrame(genes, "chrom string, g_start long, g_end long")
    out = tiling.partition_genome(frame, spans, size).orderBy("ord").collect()
    assert [r.marker_idx for r in out] == list(range(len(markers)))
    starts = [r.ord for i, r in enumerate(out) if i == 0 or r.tile_id != out[i - 1].tile_id]
    assert sorted({r.tile_id for r in out}) == list(range(len(starts)))
    return starts


ONE = lambda n: [("1", p) for p in range(n)]


@pytest.mark.parametrize("markers,genes,size,starts", [
    (ONE(10), [], 4, [0, 4, 8]),  # equal counts, a short last tile
    (ONE(10), [("1", 3, 5)], 4, [0, 6, 8]),  # the edge at 4 moves past its gene
    (ONE(10), [("1", 6, 9)], 4, [0, 4, 8]),  # a gene up to the last marker moves nothing
    (ONE(30), [("1", 10, 18)], 10, [0, 20]),  # the one-marker tile at 19 joins the tile before it
    # three edges meet behind the gene; the first tile is cut before its middle, and once only
    (ONE(30), [("1", 3, 12)], 4, [0, 2, 13, 16, 20, 24, 28]),
    ([("1", p) for p in range(6)] + [("2", p) for p in range(6)], [], 4, [0, 4, 6, 8]),  # cut where the chromosome changes
    ([("1", p) for p in range(4)] + [("2", p) for p in range(8)], [("2", 0, 2)], 4, [0, 4, 8]),  # such an edge does not move
])
def test_by_hand(spark, markers, genes, size, starts):
    assert tile_starts(spark, markers, genes, size) == starts


def case(seed):
    rng = random.Random(seed)
    markers, genes = [], []
    for chrom in ["1", "2", "3"]:
        places = sorted(rng.sample(range(2000), rng.randrange(1, 60)))
        markers += [(chrom, p) for p in places]
        at = 0
        while at < 1900 and rng.random() < 0.9:
            start = at + rng.randrange(1, 200)
            end = start + rng.choice([10, 50, 300, 900])
            genes.append((chrom, start, end))
            at = end + 1
    return markers, genes


@pytest.mark.parametrize("seed,size", [(1, 5), (2, 10), (4, 7), (6, 1), (7, 40)])
def test_no_gene_is_cut(spark, seed, size):
    """Tiles keep to one chromosome, and no edge lies inside a gene that ends before the last marker."""
    markers, genes = case(seed)
    starts = tile_starts(spark, markers, genes, size)
    holds = lambda g, m: g[0] == m[0] and g[1] <= m[1] <= g[2]
    changes = [i for i in range(len(markers)) if i == 0 or markers[i][0] != markers[i - 1][0]]
    assert set(changes) <= set(starts)
    for i in set(starts) - set(changes):
        inside = [g for g in genes if holds(g, markers[i]) and holds(g, markers[i - 1])]
        assert all(holds(g, markers[-1]) for g in inside)


def test_missing_tile_is_minus_one(spark):
    tiled = spark.createDataFrame([("1", 5, 0)], "chrom string, pos long, tile_id long")
    asked = spark.createDataFrame([("1", 5), ("1", 6)], "chrom string, pos long")
    assert {r.pos: r.tile_id for r in tiling.marker_to_tile(asked, tiled).collect()} == {5: 0, 6: -1}
