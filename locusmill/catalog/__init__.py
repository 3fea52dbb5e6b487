"""All registered queries and their checking SQL."""

from . import aggregates, columns, joins, matrices, scans, streams, windows
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "aggregates", "columns", "joins", "matrices", "scans", "streams", "windows"]
