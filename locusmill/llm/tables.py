"""Joining small written tables to the texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.joins import BROADCAST_BYTES

_ROW_BYTES = 128


def attach(big: DataFrame, written: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join a written table of a few plain columns to ``big``.

    Its rows are counted: a table below ``BROADCAST_BYTES`` is sent to every
    task, so that texts are not moved; a larger one is joined by a shuffle.
    """
    if written.count() * _ROW_BYTES <= BROADCAST_BYTES:
        written = F.broadcast(written)
    return big.join(written, keys, how)


def without(rows: DataFrame, written: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose keys a written table does not list."""
    return attach(rows, written.select(*keys), keys, "left_anti")
