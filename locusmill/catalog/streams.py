"""Streaming jobs over the given tables as append-only feeds."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.metrics import METRICS
from ..plans.session import scratch_path
from ..sources.views import SIMPLE, expand_fits, table
from ..streaming.feeds import file_feed, stream_early_stop, stream_fold_metrics, stream_running_best
from .aggregates import METRIC_SQL
from .registry import query
from .windows import MIN_DELTA_SQL


PARTS = 4


def in_parts(spark, rows):
    """A table as a feed of several files, one to a micro-batch."""
    path = scratch_path(spark, "feed")
    rows.repartition(PARTS, F.col(rows.columns[0])).write.parquet(path)
    return file_feed(spark, path, rows, files_at_once=1)


@query(
    "r01_stream_running_best",
    "SELECT run, trait, arg_max(epoch, (score, -epoch)) AS epoch, max(score) AS score FROM v_epochs GROUP BY ALL",
    ["epochs"], ["score"])
def _(spark, d):
    feed = in_parts(spark, table(spark, d, "orders")).selectExpr(*SIMPLE["epochs"][1])
    return stream_running_best(feed, scratch_path(spark, "best"))


@query(
    "r02_stream_fold_metrics",
    f"SELECT model, trait, seed, fold, {METRIC_SQL} FROM v_preds GROUP BY model, trait, seed, fold", ["preds"], METRICS)
def _(spark, d):
    """Every prediction row arrives twice and counts once."""
    rows = table(spark, d, "customer")
    bw = rows.selectExpr(*SIMPLE["fits_bw"][1])
    fits = bw.unionByName(rows.selectExpr(*SIMPLE["fits_le"][1]))
    sent = fits.withColumn("sent", F.lit("2024-01-01 00:00:00").cast("timestamp"))
    copies = sent.withColumn("_copy", F.explode(F.array(F.lit(0), F.lit(1))))
    late = copies.withColumn("sent", F.col("sent") + F.make_dt_interval(mins=F.col("_copy"))).drop("_copy")
    feed = in_parts(spark, late)
    times = feed.select("sent", *[c for c in feed.columns if c != "sent"])
    return stream_fold_metrics(expand_fits(times, ["sent"]), scratch_path(spark, "metrics"), ["model", "trait", "seed", "fold"], "sent")


LATE = 1000


@query("r01_stream_early_stop", f"SELECT *, 0::bigint AS n_late FROM ({MIN_DELTA_SQL})")
def _(spark, d):
    """Orders as epochs that come up to ``LATE`` places too late, in files one after the other."""
    rows = table(spark, d, "orders").selectExpr("o_custkey AS run", "o_orderkey AS epoch", "o_totalprice / 100000 AS score")
    moved = rows.withColumn("_sent", F.col("epoch") + F.pmod(F.hash("epoch"), F.lit(LATE)))
    step = moved.agg(F.max("_sent")).first()[0] // PARTS + 1
    path = scratch_path(spark, "feed")
    for part in range(PARTS):  # the source reads files by age
        moved.where(F.floor(F.col("_sent") / step) == part).drop("_sent").repartition(1).write.mode("append").parquet(path)
    return stream_early_stop(file_feed(spark, path, rows, files_at_once=1), scratch_path(spark, "stop"), 4, 0.1, LATE)
