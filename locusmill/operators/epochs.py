"""Epoch histories: best, running best and early stopping."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.scan import prefix_scan, with_row_number
from ..plans.session import stable

RUN = ["run", "trait"]


def best_epoch(epochs: DataFrame) -> DataFrame:
    """First epoch with the strictly highest score, as one mergeable aggregate."""
    top = F.max_by(F.struct("epoch", "score"), F.struct("score", -F.col("epoch")))
    return epochs.groupBy(*RUN).agg(top.alias("_b")).select(*RUN, "_b.epoch", "_b.score")


def running_best(epochs: DataFrame) -> DataFrame:
    """Score history with the best so far."""
    return prefix_scan(epochs, RUN, ["epoch"], {"best_so_far": ("max", F.col("score"), True)})


def early_stop_all_idle(epochs: DataFrame, patience: int) -> DataFrame:
    """First epoch at which every trait of a run has been idle for ``patience`` epochs.

    Runs that never stop do not appear.
    """
    known = prefix_scan(epochs, RUN, ["epoch"], {"_prev": ("max", F.col("score"), False)})
    fresh = F.col("_prev").isNull() | (F.col("score") > F.col("_prev"))
    known = known.withColumn("_new", F.when(fresh, F.col("epoch")))
    seen = prefix_scan(known, RUN, ["epoch"], {"_last": ("max", F.col("_new"), True)})
    idle = seen.groupBy("run", "epoch").agg(F.min(F.col("epoch") - F.col("_last")).alias("idle"))
    return idle.where(F.col("idle") >= patience).groupBy("run").agg(F.min("epoch").alias("stop_epoch"))


def early_stop_min_delta(scores: DataFrame, patience: int, min_delta: float) -> DataFrame:
    """Stop once ``patience`` epochs in a row fail to beat the best by ``min_delta``.

    ``scores`` is (run, epoch, score).  An accepted best depends only on the
    previous one, so each epoch points to the epoch that would replace it; the
    pointers are doubled until the chain from the first epoch ends.  A pointer
    looks at most ``patience`` rows ahead, which bounds every group to two
    blocks of that length.  Returns (run, best_epoch, stop_epoch), with a NULL
    stop for a run that ends first.
    """
    numbered = stable(with_row_number(scores, ["run"], ["epoch"], "i"))
    block = F.floor(F.col("i") / patience)
    spread = numbered.withColumn("_own", block).withColumn(
        "_block", F.explode(F.array(F.col("_own"), F.col("_own") - 1)))
    ahead = Window.partitionBy("run", "_block").orderBy("i").rowsBetween(1, patience)
    listed = spread.withColumn("_next", F.collect_list(F.struct("i", "score")).over(ahead))
    better = F.filter("_next", lambda r: r["score"] > F.col("score") + min_delta)
    jump = F.coalesce(F.try_element_at(F.transform(better, lambda r: r["i"]), F.lit(1)), F.col("i"))
    links = stable(listed.where("_own = _block").select("run", "i", jump.alias("to")))
    while True:
        step = links.select("run", F.col("i").alias("to"), F.col("to").alias("_far"))
        longer = stable(links.join(step, ["run", "to"]).select("run", "i", F.col("_far").alias("to"), (F.col("_far") != F.col("to")).alias("_moved")))
        links = longer.drop("_moved")
        if longer.where("_moved").isEmpty():
            break
    last = links.where("i = 1").select("run", F.col("to").alias("i"))
    best = last.join(numbered, ["run", "i"]).select("run", "i", F.col("epoch").alias("best_epoch"))
    stop = best.withColumn("i", F.col("i") + patience).join(
        numbered.select("run", "i", F.col("epoch").alias("stop_epoch")), ["run", "i"], "left")
    return stop.select("run", "best_epoch", "stop_epoch")
