"""Registered queries with the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.views import with_views

DIGITS = 8
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, views: Sequence[str] = (), doubles: Sequence[str] = ()):
    """Register ``fn(spark, sf_dir)``.

    Floating-point columns named in ``doubles`` are rounded on both sides, since
    sums are taken in another order on every run.
    """

    def add(fn: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            out = fn(spark, sf_dir)
            return out.select(*[
                F.round(F.col(c).cast("double"), DIGITS).alias(c) if c in doubles else F.col(c)
                for c in out.columns
            ])

        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = run
        if sql is not None:
            body = with_views(sql, *views) if views else sql
            if doubles:
                fixed = ", ".join(f"round(cast({c} AS double), {DIGITS}) + 0.0 AS {c}" for c in doubles)
                body = f"SELECT * REPLACE ({fixed}) FROM ({body})"
            ORACLES[name] = body
        return fn

    return add
