"""Joining per-key statistics to large tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .session import stable

BROADCAST_BYTES = 64 << 20
PLANNED_BYTES = 8 << 20
_ROW_OVERHEAD = 32


def attach_measured(big: DataFrame, stats: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join ``stats`` to ``big`` without shuffling ``big`` where that is safe.

    Where the planner already expects a small table it is left to choose the
    join.  Otherwise the statistics are written to the shared folder once and
    counted.  Up to ``BROADCAST_BYTES`` they are sent to every executor, so a
    hot key costs nothing extra; beyond that a shuffle join runs, whose skewed
    partitions Spark splits at run time.
    """
    if _planned_bytes(stats) <= min(PLANNED_BYTES, BROADCAST_BYTES):
        return big.join(stats, list(keys), how)
    stats = stable(stats)
    width = _ROW_OVERHEAD + sum(_field_bytes(f.dataType) for f in stats.schema.fields)
    if stats.count() * width <= BROADCAST_BYTES:
        stats = F.broadcast(stats)
    return big.join(stats, list(keys), how)


def _planned_bytes(df: DataFrame) -> int:
    """The planner's size estimate; unknown counts as large."""
    try:
        return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes().toString())
    except AttributeError:  # no plan object behind a remote session
        return BROADCAST_BYTES + 1


def _field_bytes(kind) -> int:
    """Bytes to allow for one value; text and nested values count generously."""
    fixed = {"boolean": 8, "tinyint": 8, "smallint": 8, "int": 8, "bigint": 8, "float": 8, "double": 8}
    return fixed.get(kind.simpleString(), 256)
