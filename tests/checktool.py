"""Run registered queries against their SQL on the given tables.

    python tests/checktool.py [sf_dir] [name-part ...]
"""

from __future__ import annotations

import math
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import duckdb
import numpy as np

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def _cell(value):
    if value is None:
        return None
    if isinstance(value, (bool, np.bool_)):
        return bool(value)
    if isinstance(value, (list, tuple, np.ndarray)):
        return tuple(_cell(v) for v in value)
    if isinstance(value, (int, np.integer)):
        return float(value)
    if isinstance(value, (float, np.floating)) or type(value).__name__ == "Decimal":
        return "nan" if math.isnan(value) else round(float(value), 8) + 0.0
    return str(value)


def _sortable(row):
    return tuple((v is None, str(type(v)), v if v is not None else 0) for v in row)


def compare(spark, con, query, sql: str, sf_dir: str) -> str:
    """Empty string where both sides agree, else what differs."""
    out = query(spark, sf_dir)
    columns = sorted(out.columns)
    left = out.select(*[f"`{c}`" for c in columns]).toArrow().to_pylist()
    left = sorted((tuple(_cell(r[c]) for c in columns) for r in left), key=_sortable)
    cursor = con.execute(sql)
    names = [c[0] for c in cursor.description]
    if sorted(names) != columns:
        return f"columns {columns} / {sorted(names)}"
    places = [names.index(c) for c in columns]
    right = sorted((tuple(_cell(r[p]) for p in places) for r in cursor.fetchall()), key=_sortable)
    if len(left) != len(right):
        return f"rows {len(left)} / {len(right)}: {left[:2]} / {right[:2]}"
    for a, b in zip(left, right):
        if a != b:
            return f"{columns}: {a} / {b}"
    return "" if left else "EMPTY"


def main() -> None:
    from __spark_entry__ import oracle_sql, queries
    from locusmill.plans.session import local_session

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    parts = sys.argv[2:]
    spark, con = local_session(cores=os.environ.get("BENCH_CPUS", "8")), connect(sf_dir)
    oracles, failed = oracle_sql(), []
    for name, query in queries().items():
        if parts and not any(p in name for p in parts):
            continue
        start = time.time()
        try:
            if name in oracles:
                problem = compare(spark, con, query, oracles[name], sf_dir)
            else:
                rows = query(spark, sf_dir).count()
                problem = f"rows only: {rows}"
        except Exception as error:
            problem = "ERROR " + str(error)[:700]
        print(f"{time.time() - start:6.1f}s {name}: {problem or 'ok'}", flush=True)
        if problem and not problem.startswith("rows only"):
            failed.append(name)
    print("failed:", failed)


if __name__ == "__main__":
    main()
