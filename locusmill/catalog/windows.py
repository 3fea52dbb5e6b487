"""Splits, epoch histories, tiling, ordering and marker selection."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import epochs, markers, screen, splits, tiling
from ..plans.scan import with_row_number
from ..plans.session import stable
from ..sources.views import calls, genes_intervals, table, view
from .aggregates import INTERVALS
from .registry import query

SHUFFLED = "(sample_id * 7919 + 13) % 10007"


def samples(spark, d):
    return view(spark, d, "samples")


def shuffled(seed=None):
    key = F.expr(SHUFFLED) if seed is None else F.expr(f"(sample_id * 7919 + {seed} * 104729) % 10007")
    return [key, F.col("sample_id")]


BINNED = ", b AS (SELECT *, CASE WHEN bw <= (SELECT median(bw) FROM v_samples) THEN 0 ELSE 1 END AS bin FROM v_samples) "


@query("w01_median_bin", BINNED + "SELECT sample_id, bin FROM b", ["samples"])
def _(spark, d):
    return splits.median_bin(samples(spark, d), "bw", "bin").select("sample_id", "bin")


@query("w02_joint_strata", BINNED + "SELECT sample_id, surv || '_' || bin AS stratum FROM b", ["samples"])
def _(spark, d):
    return splits.joint_strata(splits.median_bin(samples(spark, d), "bw", "bin"), "surv", "bin").select(
        "sample_id", "stratum")


def strata(spark, d):
    return splits.joint_strata(splits.median_bin(samples(spark, d), "bw", "bin"), "surv", "bin").select(
        "sample_id", "stratum")


HOLDOUT = BINNED + (
    ", s AS (SELECT sample_id, surv || '_' || bin AS stratum FROM b), k AS (SELECT stratum, count(*) AS c FROM s GROUP BY stratum),"
    " t AS (SELECT sum(c) AS n, sum(c) - ceil(0.15 * sum(c)) AS n_train FROM k),"
    " e AS (SELECT stratum, c, cast(floor(c * n_train / n) AS bigint) AS base, c * n_train / n - floor(c * n_train / n) AS frac, n_train FROM k, t),"
    " a AS (SELECT stratum, c - base - CASE WHEN row_number() OVER (ORDER BY frac DESC, stratum) <= n_train - sum(base) OVER () THEN 1 ELSE 0 END AS n_test FROM e),"
    f" r AS (SELECT sample_id, stratum, row_number() OVER (PARTITION BY stratum ORDER BY {SHUFFLED}, sample_id) AS rn FROM s) "
)


@query(
    "w03_stratified_holdout",
    HOLDOUT + "SELECT sample_id, stratum, CASE WHEN rn <= n_test THEN 'test' ELSE 'trainval' END AS split FROM r JOIN a USING (stratum)",
    ["samples"])
def _(spark, d):
    return splits.stratified_holdout(strata(spark, d), "stratum", 0.15, shuffled())


@query(
    "w03_hashed_holdout_sizes",
    HOLDOUT + "SELECT stratum, cast(n_test AS bigint) AS n_test FROM a", ["samples"])
def _(spark, d):
    """The default hashed order gives other members but the same sizes."""
    out = splits.stratified_holdout(strata(spark, d), "stratum", 0.15, seed=42)
    return out.groupBy("stratum").agg(F.count_if(F.col("split") == "test").alias("n_test"))


KFOLD = (
    ", n AS (SELECT count(*) AS n FROM v_samples), r AS (SELECT seed, sample_id, row_number() OVER (PARTITION BY seed ORDER BY"
    " (sample_id * 7919 + seed * 104729) % 10007, sample_id) - 1 AS i FROM v_samples, (SELECT unnest([1, 2, 3]) AS seed)),"
    " v AS (SELECT seed, sample_id, CASE WHEN i < (n // 5 + 1) * (n % 5) THEN i // (n // 5 + 1)"
    " ELSE n % 5 + (i - (n // 5 + 1) * (n % 5)) // (n // 5) END AS val_fold FROM r, n) "
)


@query(
    "w04_kfold_assign",
    KFOLD + "SELECT seed, cast(f.fold AS int) AS fold, sample_id, CASE WHEN f.fold = val_fold THEN 'val' ELSE 'train' END AS split"
    " FROM v CROSS JOIN (SELECT unnest(range(5)) AS fold) f",
    ["samples"])
def _(spark, d):
    ids = samples(spark, d).select("sample_id")
    order = [F.expr("(sample_id * 7919 + seed * 104729) % 10007"), F.col("sample_id")]
    return splits.kfold_assign(ids, [1, 2, 3], 5, order)


@query(
    "w04_hashed_kfold_sizes",
    KFOLD + "SELECT seed, cast(f.fold AS int) AS fold, CASE WHEN f.fold = val_fold THEN 'val' ELSE 'train' END AS split, count(*) AS n"
    " FROM v CROSS JOIN (SELECT unnest(range(5)) AS fold) f GROUP BY ALL",
    ["samples"])
def _(spark, d):
    """The default hashed order gives other members but the same sizes."""
    out = splits.kfold_assign(samples(spark, d).select("sample_id"), [1, 2, 3], 5)
    return out.groupBy("seed", "fold", "split").agg(F.count("*").alias("n"))


@query(
    "w05_contiguous_folds",
    f", r AS (SELECT sample_id, row_number() OVER (ORDER BY {SHUFFLED}, sample_id) - 1 AS i, count(*) OVER () AS n FROM v_samples),"
    " s AS (SELECT *, n - cast(floor(n * 0.15) AS bigint) AS dev FROM r)"
    " SELECT sample_id, CASE WHEN i < dev THEN least(i // (dev // 5), 4) END AS fold FROM s",
    ["samples"])
def _(spark, d):
    return splits.contiguous_folds(samples(spark, d), 5, shuffled(), 0.15).select("sample_id", "fold")


@query(
    "w06_ratio_split",
    f", r AS (SELECT sample_id, row_number() OVER (ORDER BY {SHUFFLED}, sample_id) AS i, count(*) OVER () AS n FROM v_samples)"
    " SELECT sample_id, CASE WHEN i <= n - cast(floor(n * 0.1) AS bigint) - cast(floor(n * 0.15) AS bigint) THEN 'train'"
    " WHEN i <= n - cast(floor(n * 0.15) AS bigint) THEN 'val' ELSE 'test' END AS split FROM r",
    ["samples"])
def _(spark, d):
    return splits.ratio_split(samples(spark, d), 0.1, 0.15, shuffled()).select("sample_id", "split")


@query(
    "w07_quantile_stratum",
    ", q AS (SELECT quantile_cont(bw, [0.25, 0.5, 0.75]) AS q FROM v_samples) SELECT sample_id, CASE WHEN bw <= q[1] THEN 'Q1'"
    " WHEN bw <= q[2] THEN 'Q2' WHEN bw <= q[3] THEN 'Q3' ELSE 'Q4' END AS stratum FROM v_samples, q",
    ["samples"])
def _(spark, d):
    return splits.quantile_stratum(samples(spark, d), "bw").select("sample_id", "stratum")


@query(
    "w08_first_per_key",
    "SELECT o_custkey, arg_min(o_orderpriority, o_orderkey) AS o_orderpriority, min(o_orderkey) AS o_orderkey FROM orders GROUP BY o_custkey")
def _(spark, d):
    rows = table(spark, d, "orders").select("o_custkey", "o_orderpriority", "o_orderkey")
    return splits.first_per_key(rows, "o_custkey", "o_orderkey")


@query(
    "w09_factorize_by_appearance",
    "SELECT p_brand, row_number() OVER (ORDER BY min(p_partkey)) AS code FROM part GROUP BY p_brand")
def _(spark, d):
    return splits.factorize_by_appearance(table(spark, d, "part"), "p_brand", "p_partkey")


@query(
    "w21_tail_validation_split",
    "SELECT sample_id, CASE WHEN row_number() OVER (ORDER BY sample_id) <= floor(0.8 * count(*) OVER ()) THEN 'train' ELSE 'val' END AS split FROM v_samples",
    ["samples"])
def _(spark, d):
    return splits.tail_validation_split(samples(spark, d), ["sample_id"]).select("sample_id", "split")


@query(
    "w10_gap_fill_intervals",
    views=["markers", "genes"],
    sql=INTERVALS + "SELECT chrom, start, \"end\", kind FROM iv")
def _(spark, d):
    return genes_intervals(spark, d)


@query(
    "w11_block_assign",
    "SELECT marker_idx // 32 AS block, count(*) AS n_markers FROM v_markers GROUP BY ALL", ["markers"])
def _(spark, d):
    return tiling.block_sizes(tiling.block_assign(view(spark, d, "markers"), 32))


ORDERED = ", o AS (SELECT marker_idx, chrom, pos, row_number() OVER (ORDER BY chrom, pos, marker_idx) - 1 AS ord FROM v_markers) "
TILE = 20


def ordered(spark, d):
    return tiling.order_index(view(spark, d, "markers").select("marker_idx", "chrom", "pos"))


@query("w12_tile_initial", ORDERED + f"SELECT marker_idx, chrom, pos, ord, ord // {TILE} AS tile_id FROM o", ["markers"])
def _(spark, d):
    return tiling.initial_tiles(ordered(spark, d), TILE)


STARTS = ORDERED + (
    ", l AS (SELECT o.*, g_start FROM o LEFT JOIN v_genes g ON o.chrom = g.chrom AND o.pos BETWEEN g_start AND g_end),"
    " e AS (SELECT chrom, g_start, max(ord) + 1 AS after FROM l WHERE g_start IS NOT NULL GROUP BY ALL),"
    " p AS (SELECT l.*, lag(chrom) OVER (ORDER BY ord) AS prev_chrom, count(*) OVER () AS total FROM l),"
    f" st AS (SELECT DISTINCT CASE WHEN after < total AND prev_chrom = p.chrom THEN after ELSE ord END AS start FROM p"
    f" LEFT JOIN e ON p.chrom = e.chrom AND p.g_start = e.g_start WHERE ord % {TILE} = 0) "
)


@query("w13_tile_gene_boundary", STARTS + "SELECT start FROM st", ["markers", "genes"])
def _(spark, d):
    located = stable(tiling.gene_of_marker(ordered(spark, d), view(spark, d, "genes")))
    return tiling.boundary_starts(located, TILE)


SMALL_TILE = 8
"""One gene takes the place of three here, so that several edges fall into it: tiles of this size merge and are cut."""

MERGE_SPLIT = (
    ", wide AS (SELECT chrom, g_start, coalesce(next - 1, g_end) AS g_end FROM"
    " (SELECT *, row_number() OVER w AS k, lead(g_start, 3) OVER w AS next FROM v_genes WINDOW w AS (PARTITION BY chrom ORDER BY g_start))"
    " WHERE k % 4 = 1)"
    + STARTS.replace("v_genes", "wide").replace(f"ord % {TILE}", f"ord % {SMALL_TILE}")
    + ", n AS (SELECT count(*) AS total FROM o),"
    " t AS (SELECT start AS s, lead(start, 1, total) OVER (ORDER BY start) - 1 AS e FROM st, n),"
    f" head AS (SELECT min(e) AS e FROM t WHERE 5 * (e + 1) >= {SMALL_TILE}),"
    f" kept AS (SELECT s FROM t WHERE s = 0 OR (5 * (e - s + 1) >= {SMALL_TILE} AND s > (SELECT e FROM head))),"
    " merged AS (SELECT s, lead(s, 1, total) OVER (ORDER BY s) - 1 AS e FROM kept, n),"
    " cuts AS (WITH RECURSIVE r(s, e) AS (SELECT s, e FROM merged UNION ALL"
    " SELECT unnest([s, cut]), unnest([cut - 1, e]) FROM (SELECT r.s, r.e,"
    " coalesce(min(CASE WHEN ord >= r.s + (r.e - r.s + 1) // 2 THEN ord END), max(CASE WHEN ord < r.s + (r.e - r.s + 1) // 2 THEN ord END)) AS cut"
    f" FROM r JOIN l ON ord > r.s AND ord < r.e AND g_start IS NULL WHERE r.e - r.s + 1 > 2 * {SMALL_TILE} GROUP BY r.s, r.e))"
    " SELECT DISTINCT s FROM r),"
    " tiles AS (SELECT s, lead(s, 1, total) OVER (ORDER BY s) - 1 AS e, row_number() OVER (ORDER BY s) - 1 AS tile_id FROM cuts, n)"
    " SELECT tile_id, s AS start_idx, e AS end_idx, a.chrom AS start_chrom, b.chrom AS end_chrom, a.pos AS start_pos, b.pos AS end_pos,"
    " e - s + 1 AS snp_count FROM tiles JOIN o a ON a.ord = s JOIN o b ON b.ord = e"
)


def wide_genes(spark, d):
    genes = with_row_number(view(spark, d, "genes"), ["chrom"], ["g_start"], "k")
    third = genes.select("chrom", (F.col("k") - 3).alias("k"), F.col("g_start").alias("next"))
    first = genes.where("k % 4 = 1").join(third, ["chrom", "k"], "left")
    return first.select("chrom", "g_start", F.coalesce(F.col("next") - 1, "g_end").alias("g_end"))


@query("w14_tile_merge_split", MERGE_SPLIT, ["markers", "genes"])
def _(spark, d):
    lengths = view(spark, d, "markers").groupBy("chrom").agg((F.max("pos") + 1000).alias("length"))
    located = stable(tiling.gene_of_marker(ordered(spark, d), wide_genes(spark, d), lengths))
    starts = tiling.boundary_starts(located, SMALL_TILE)
    starts = tiling.merge_small(tiling.tile_table(tiling.tiles_from_starts(located, starts)), SMALL_TILE)
    return tiling.tile_table(tiling.tiles_from_starts(located, tiling.split_large(located, starts, SMALL_TILE)))


CHROM_TILES = ORDERED + (
    f", t AS (SELECT o.*, dense_rank() OVER (ORDER BY chrom, ord // {TILE}) - 1 AS tile_id FROM o) "
)


def chrom_tiles(spark, d):
    located = stable(ordered(spark, d))
    initial = located.where(F.col("ord") % TILE == 0).select(F.col("ord").alias("start"))
    return tiling.tiles_from_starts(located, tiling.split_chromosomes(located, initial)), initial


@query(
    "w15_tile_split_chrom",
    CHROM_TILES + ", n AS (SELECT max(ord) AS last FROM o), len AS (SELECT chrom, max(pos) + 1000 AS length FROM v_markers GROUP BY chrom)"
    " SELECT tile_id, min(ord) AS start_idx, max(ord) AS end_idx, t.chrom AS start_chrom,"
    f" CASE WHEN min(ord) % {TILE} = 0 THEN min(pos) ELSE 0 END AS start_pos,"
    f" CASE WHEN (max(ord) + 1) % {TILE} = 0 OR max(ord) = max(last) THEN max(pos) ELSE max(length) END AS end_pos, count(*) AS snp_count"
    " FROM t JOIN len ON t.chrom = len.chrom, n GROUP BY tile_id, t.chrom",
    ["markers"])
def _(spark, d):
    tiled, initial = chrom_tiles(spark, d)
    lengths = view(spark, d, "markers").groupBy("chrom").agg((F.max("pos") + 1000).alias("length"))
    return tiling.chromosome_edges(tiling.tile_table(tiled), initial, lengths)


@query(
    "w16_marker_to_tile",
    CHROM_TILES + "SELECT s_suppkey * 30 AS key, coalesce(t.tile_id, -1) AS tile_id FROM supplier"
    " LEFT JOIN v_markers m ON m.marker_idx = s_suppkey * 30 LEFT JOIN t ON t.marker_idx = m.marker_idx",
    ["markers"])
def _(spark, d):
    """Looked up by (chrom, pos); keys beyond the markers have no tile."""
    tiled, _ = chrom_tiles(spark, d)
    keys = table(spark, d, "supplier").select((F.col("s_suppkey") * 30).alias("key"))
    asked = keys.join(view(spark, d, "markers").select(F.col("marker_idx").alias("key"), "chrom", "pos"), "key", "left")
    return tiling.marker_to_tile(asked, tiled).select("key", "tile_id")


@query(
    "w16_tile_offsets",
    CHROM_TILES + ", s AS (SELECT tile_id, min(chrom) AS start_chrom, count(*) AS snp_count FROM t GROUP BY tile_id)"
    " SELECT tile_id, start_chrom, snp_count, sum(snp_count) OVER (ORDER BY tile_id) - snp_count AS \"offset\" FROM s",
    ["markers"])
def _(spark, d):
    tiles = tiling.tile_table(chrom_tiles(spark, d)[0])
    return tiling.tile_offsets(tiles.select("tile_id", "start_chrom", "snp_count"))


@query(
    "a28_tile_statistics",
    CHROM_TILES + ", s AS (SELECT count(*) AS len FROM t GROUP BY tile_id) SELECT count(*) AS n, min(len) AS min, max(len) AS max,"
    " avg(len) AS mean, median(len) AS median FROM s",
    ["markers"], ["mean", "median"])
def _(spark, d):
    return tiling.tile_statistics(tiling.tile_table(chrom_tiles(spark, d)[0]))


@query("w18_best_epoch", "SELECT run, trait, arg_max(epoch, (score, -epoch)) AS epoch, max(score) AS score FROM v_epochs GROUP BY ALL", ["epochs"], ["score"])
def _(spark, d):
    return epochs.best_epoch(view(spark, d, "epochs"))


@query(
    "w19_running_best",
    "SELECT run, trait, epoch, score, max(score) OVER (PARTITION BY run, trait ORDER BY epoch) AS best_so_far FROM v_epochs",
    ["epochs"], ["score", "best_so_far"])
def _(spark, d):
    return epochs.running_best(view(spark, d, "epochs"))


IDLE = (
    ", p AS (SELECT run, trait, epoch, score, max(score) OVER (PARTITION BY run, trait ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM v_epochs),"
    " q AS (SELECT run, trait, epoch, max(CASE WHEN prev IS NULL OR score > prev THEN epoch END) OVER (PARTITION BY run, trait ORDER BY epoch) AS last FROM p),"
    " i AS (SELECT run, epoch, min(epoch - last) AS idle FROM q GROUP BY run, epoch) "
)


@query(
    "w20_early_stop_all_idle",
    IDLE + "SELECT run, min(epoch) AS stop_epoch FROM i WHERE idle >= 4000 GROUP BY run", ["epochs"])
def _(spark, d):
    return epochs.early_stop_all_idle(view(spark, d, "epochs"), 4000)


MIN_DELTA_SQL = (
    "SELECT run, best_epoch, stop_epoch FROM (WITH RECURSIVE e AS (SELECT o_custkey AS run, o_orderkey AS epoch, o_totalprice / 100000 AS score,"
    " row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS i FROM orders),"
    " w AS (SELECT run, i, epoch, score AS best, 0 AS wait, epoch AS best_epoch, CAST(NULL AS bigint) AS stop_epoch FROM e WHERE i = 1"
    " UNION ALL SELECT e.run, e.i, e.epoch, CASE WHEN e.score > best + 0.1 THEN e.score ELSE best END,"
    " CASE WHEN e.score > best + 0.1 THEN 0 ELSE wait + 1 END, CASE WHEN e.score > best + 0.1 THEN e.epoch ELSE best_epoch END,"
    " CASE WHEN NOT e.score > best + 0.1 AND wait + 1 >= 4 THEN e.epoch END"
    " FROM w JOIN e ON e.run = w.run AND e.i = w.i + 1 WHERE w.stop_epoch IS NULL)"
    " SELECT run, arg_max(best_epoch, i) AS best_epoch, max(stop_epoch) AS stop_epoch FROM w GROUP BY run)"
)


@query("w20_early_stop_min_delta", MIN_DELTA_SQL)
def _(spark, d):
    return epochs.early_stop_min_delta(view(spark, d, "epochs").drop("trait"), 4, 0.1)


@query(
    "t03_order_markers",
    "SELECT marker_idx, chrom, pos, a1, a2, maf_ref FROM v_markers ORDER BY chrom, pos, marker_idx", ["markers"], ["maf_ref"])
def _(spark, d):
    return markers.marker_order(view(spark, d, "markers"))


@query(
    "t05_preview",
    "SELECT sample_id, marker_idx, dosage FROM v_calls ORDER BY sample_id, marker_idx LIMIT 20", ["calls"])
def _(spark, d):
    """A preview is a limited report by its nature."""
    return calls(spark, d).select("sample_id", "marker_idx", "dosage").orderBy("sample_id", "marker_idx").limit(20)


SCREEN = (
    ", l AS (SELECT sample_id, 'bw' AS trait, bw AS value FROM v_samples UNION ALL SELECT sample_id, 'le', le FROM v_samples),"
    " k AS (SELECT trait, sample_id, floor((rank() OVER (PARTITION BY trait ORDER BY value) - 1) * 240 / count(*) OVER (PARTITION BY trait)) AS cell FROM l),"
    " pr AS (SELECT marker_idx, trait, dosage, cell, count(*) AS c FROM v_calls JOIN k USING (sample_id) WHERE dosage IS NOT NULL GROUP BY ALL),"
    " nn AS (SELECT marker_idx, trait, sum(c) AS n, min(dosage) = max(dosage) OR min(cell) = max(cell) AS flat FROM pr GROUP BY ALL),"
    " gr AS (SELECT unnest([{'o': 1, 'g': 2}, {'o': 2, 'g': 2}, {'o': 3, 'g': 3}]) AS gr),"
    " bb AS (SELECT marker_idx, trait, n, gr.o AS o, gr.g AS g, unnest(range(2, cast(least(floor(greatest(pow(n, 0.6), 4) / gr.g), 240) AS bigint) + 1)) AS b FROM nn, gr),"
    " j AS (SELECT marker_idx, trait, n, o, g, b, CASE o WHEN 1 THEN least(dosage, 1) WHEN 2 THEN greatest(dosage, 1) ELSE dosage END AS gx,"
    " floor(cell * b / 240) AS bin, sum(c) AS c FROM bb JOIN pr USING (marker_idx, trait) GROUP BY ALL),"
    " mi AS (SELECT marker_idx, trait, o, g, b, sum(c / n * ln(c * n / (cx * cy))) / ln(least(g, b)) AS s FROM"
    " (SELECT *, sum(c) OVER (PARTITION BY marker_idx, trait, o, b, gx) AS cx, sum(c) OVER (PARTITION BY marker_idx, trait, o, b, bin) AS cy FROM j) GROUP BY marker_idx, trait, o, g, b),"
    " sc AS (SELECT marker_idx, trait, cast(n AS bigint) AS n_pairs, CASE WHEN n < 10 THEN NULL WHEN flat THEN 0 ELSE greatest(max(s), 0) END AS score"
    " FROM nn LEFT JOIN mi USING (marker_idx, trait) GROUP BY marker_idx, trait, n, flat) "
)


def screened(spark, d, score=screen.dependence_screen):
    traits = samples(spark, d).select("sample_id", "bw", "le")
    n = screen.pool_cells(traits, ["bw", "le"])
    return score(calls(spark, d), screen.trait_cells(traits, ["bw", "le"], n), n)


@query("m01_dependence_coefficient", None, (), ["score"])
def _(spark, d):
    """The best cuts of every marker; tests/test_screen.py holds it against all cuts there are."""
    return screened(spark, d, screen.dependence_coefficient)


@query("m01_dependence_screen", SCREEN + "SELECT * FROM sc", ["samples", "calls"], ["score"])
def _(spark, d):
    return screened(spark, d)


# Selection reads scores that both engines hold exactly: the mean quantity of a
# part by return flag, in place of floating-point screening scores.
SCORES = (
    ", sc AS (SELECT l_partkey AS marker_idx, l_returnflag AS trait, CASE WHEN count(*) < 5 THEN NULL"
    " ELSE sum(l_quantity) / count(*) END AS score FROM lineitem GROUP BY ALL) "
)


def part_scores(spark, d):
    grouped = table(spark, d, "lineitem").groupBy(
        F.col("l_partkey").alias("marker_idx"), F.col("l_returnflag").alias("trait"))
    return grouped.agg(F.when(F.count("*") >= 5, F.sum("l_quantity") / F.count("*")).alias("score"))


RANKED = SCORES + (
    ", r AS (SELECT marker_idx, trait, score, row_number() OVER (PARTITION BY trait ORDER BY score DESC, marker_idx) AS rank,"
    " count(*) OVER (PARTITION BY trait) AS n FROM sc WHERE score IS NOT NULL) "
)


@query(
    "t01_topk_markers", RANKED.replace(", sc AS", "WITH sc AS", 1) + "SELECT marker_idx, trait, score, rank FROM r WHERE rank <= 100",
    doubles=["score"])
def _(spark, d):
    return screen.topk_markers(part_scores(spark, d), 100)


@query(
    "t02_top_ratio_markers",
    RANKED.replace(", sc AS", "WITH sc AS", 1) + "SELECT DISTINCT marker_idx FROM r WHERE rank <= ceil(n * CASE trait WHEN 'A' THEN 0.1 WHEN 'R' THEN 0.05 END)")
def _(spark, d):
    return screen.top_ratio_markers(part_scores(spark, d), {"A": 0.1, "R": 0.05})


@query(
    "u01_union_marker_sets",
    RANKED.replace(", sc AS", "WITH sc AS", 1) + "SELECT DISTINCT marker_idx FROM r WHERE rank <= 100")
def _(spark, d):
    return screen.union_marker_sets(screen.topk_markers(part_scores(spark, d), 100))


@query(
    "u01_marker_set_gaps",
    RANKED.replace(", sc AS", "WITH sc AS", 1) + ", s AS (SELECT DISTINCT marker_idx FROM r WHERE rank <= 100), a AS (SELECT p_partkey AS marker_idx FROM part WHERE p_size > 25)"
    " SELECT marker_idx, 'left' AS side FROM (SELECT * FROM s EXCEPT SELECT * FROM a) UNION ALL SELECT marker_idx, 'right' FROM (SELECT * FROM a EXCEPT SELECT * FROM s)")
def _(spark, d):
    chosen = screen.union_marker_sets(screen.topk_markers(part_scores(spark, d), 100))
    large = table(spark, d, "part").where("p_size > 25").select(F.col("p_partkey").alias("marker_idx"))
    return screen.marker_set_gaps(chosen, large)
