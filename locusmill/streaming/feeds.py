"""Append-only feeds as Structured Streaming jobs.

State is one small aggregate row per key, and for deduplication one per
prediction no older than the watermark.  Each micro-batch writes the rows it
changed below the shared folder under its batch number, so a retried batch
replaces its own output and the newest row per key is the result.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState

from ..operators.metrics import regression_metrics


def _run(updates: DataFrame, path: str, keys: list[str]) -> DataFrame:
    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/out/batch={number}")

    query = (
        updates.writeStream.outputMode("update").foreachBatch(write)
        .option("checkpointLocation", f"{path}/progress").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    late = sum(int(op["numRowsDroppedByWatermark"]) for p in query.recentProgress for op in p["stateOperators"])
    if late:
        warnings.warn(f"{late} rows came later than the watermark and were left out", stacklevel=3)
    rows = updates.sparkSession.read.parquet(f"{path}/out")
    values = [c for c in rows.columns if c not in (*keys, "batch")]
    latest = rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch").alias("_v"))
    return latest.select(*keys, "_v.*")


def stream_running_best(feed: DataFrame, path: str) -> DataFrame:
    """Best epoch so far per (run, trait) from a feed of (run, trait, epoch, score)."""
    top = F.max_by(F.struct("epoch", "score"), F.struct("score", -F.col("epoch")))
    best = feed.groupBy("run", "trait").agg(top.alias("b")).select("run", "trait", "b.epoch", "b.score")
    return _run(best, path, ["run", "trait"])


def stream_fold_metrics(feed: DataFrame, path: str, keys: list[str], time: str, late: str = "1 hour") -> DataFrame:
    """Fold metrics refreshed as prediction rows arrive; a sample counts once per key.

    A repeated row must come within ``late`` of the first one by its ``time``;
    older state is dropped, so it stays bounded.  Rows that come later than
    that are left out, and a warning says how many.
    """
    unique = feed.withWatermark(time, late).dropDuplicatesWithinWatermark([*keys, "sample_id"])
    return _run(regression_metrics(unique, keys), path, keys)


RUN_GROUPS = 1 << 14
"""Groups of runs; each is one call of Python and one state a batch.  A checkpoint keeps its own number."""
_STOP_STATE = (
    "run array<{kind}>, best array<double>, best_epoch array<bigint>, wait array<int>, stop_epoch array<bigint>, applied array<bigint>, "
    "newest array<bigint>, n_late array<bigint>, epochs array<array<bigint>>, scores array<array<double>>"
)


def _step(state: tuple, epoch: int, score: float, patience: int, min_delta: float) -> tuple:
    """(best, best epoch, epochs waited, stop epoch) after one more epoch; nothing changes behind the stop."""
    best, best_epoch, wait, stop = state
    if stop is not None:
        return state
    if best is None or score > best + min_delta:
        return score, epoch, 0, None
    return best, best_epoch, wait + 1, epoch if wait + 1 >= patience else None


def stream_early_stop(feed: DataFrame, path: str, patience: int, min_delta: float, late: int) -> DataFrame:
    """(run, best_epoch, stop_epoch, n_late) from a feed of (run, epoch, score) whose rows may come out of order.

    The rule of ``early_stop_min_delta`` depends on the order of epochs.  A run's
    state holds the outcome up to its newest epoch less ``late`` and, sorted,
    the epochs after it; these are applied again on top whenever rows arrive,
    so every batch shows the outcome of all rows so far.  A row for an epoch
    that was already applied for good, a replayed one as well, changes nothing
    and is counted in ``n_late``.  A second score of an open epoch replaces none.
    Rows without run, epoch or score are left out.  State is per run one entry and
    the epochs within ``late`` of its newest one, however long the run is.  Runs are
    dealt by hash to ``RUN_GROUPS`` groups, as a call for every run and batch would
    cost far more than its rows.
    """

    def advance(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        runs = {}  # run -> [outcome, applied, newest, n_late, open epochs]
        if state.exists:
            for run, best, best_epoch, wait, stop, *rest, epochs, scores in zip(*state.get):
                runs[run] = [(best, best_epoch, wait, stop), *rest, dict(zip(epochs, scores))]
        seen = {}
        for batch in batches:
            for run, epoch, score in zip(batch["run"].tolist(), batch["epoch"].tolist(), batch["score"].tolist()):
                seen[run] = now = runs.setdefault(run, [(None, None, 0, None), None, None, 0, {}])
                if now[1] is not None and epoch <= now[1]:
                    now[3] += 1
                else:
                    now[4].setdefault(epoch, score)
                    now[2] = epoch if now[2] is None else max(now[2], epoch)
        found = []
        for run, now in seen.items():
            outcome, applied, newest, n_late, waiting = now
            for epoch in [e for e in sorted(waiting) if e <= newest - late]:
                outcome = _step(outcome, epoch, waiting.pop(epoch), patience, min_delta)
            now[:2] = outcome, newest - late if applied is None else max(newest - late, applied)
            for epoch in sorted(waiting):
                outcome = _step(outcome, epoch, waiting[epoch], patience, min_delta)
            found.append((run, outcome[1], outcome[3], n_late))
        rows = [(run, *now[0], *now[1:4], list(now[4]), list(now[4].values())) for run, now in runs.items()]
        state.update(tuple(map(list, zip(*rows))))
        out = pd.DataFrame(found, columns=["run", "best_epoch", "stop_epoch", "n_late"])
        yield out.astype({"best_epoch": "Int64", "stop_epoch": "Int64"})

    kind = feed.schema["run"].dataType.simpleString()
    known = feed.select("run", F.col("epoch").cast("long").alias("epoch"), F.col("score").cast("double").alias("score")).dropna()
    known = known.withColumn("_group", F.pmod(F.xxhash64("run"), F.lit(RUN_GROUPS)))
    out = known.groupBy("_group").applyInPandasWithState(
        advance, f"run {kind}, best_epoch long, stop_epoch long, n_late long", _STOP_STATE.format(kind=kind), "update", "NoTimeout")
    return _run(out, path, ["run"])


def file_feed(
    spark: SparkSession, folder: str, like: DataFrame, names: str = "*.parquet", files_at_once: int | None = None
) -> DataFrame:
    """The Parquet files of a folder as a stream with the schema of ``like``."""
    reader = spark.readStream.schema(like.schema).option("pathGlobFilter", names)
    if files_at_once:
        reader = reader.option("maxFilesPerTrigger", files_at_once)
    return reader.parquet(folder)


__all__ = ["file_feed", "stream_early_stop", "stream_fold_metrics", "stream_running_best"]
