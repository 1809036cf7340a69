"""Run a query key in Spark and its oracle SQL in DuckDB; compare results.

Comparison: same column names, same row count, and the same multiset of rows
with doubles compared exactly (``exact``) or at a relative tolerance.
Usable from pytest and as a script: ``python tests/oracle_check.py [keys]``.
"""

from __future__ import annotations

import math
import os
import sys

import duckdb
import pandas as pd

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
if ROOT not in sys.path:
    sys.path.insert(0, ROOT)

from realpay.sources.tables import TABLES  # noqa: E402

SF_DIR = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.01")


def duck(sf_dir: str = SF_DIR) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        path = os.path.join(sf_dir, f"{t}.parquet")
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}')")
    return con


def _norm(v):
    if v is None or v is pd.NA or v is pd.NaT:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return v
    if hasattr(v, "isoformat"):
        return v.isoformat()[:10] if len(v.isoformat()) >= 10 else v.isoformat()
    if isinstance(v, (int,)):
        return float(v)
    try:
        import numpy as np
        if isinstance(v, np.generic):
            return _norm(v.item())
    except ImportError:
        pass
    return v


def _rows(pdf: pd.DataFrame, cols):
    out = []
    for rec in pdf[cols].itertuples(index=False, name=None):
        out.append(tuple(_norm(x) for x in rec))
    key = lambda r: tuple((x is None, str(type(x)), x if x is not None else 0) for x in r)
    return sorted(out, key=key)


def _close(a, b, rel):
    if a is None or b is None:
        return a is None and b is None
    if isinstance(a, float) and isinstance(b, float):
        if a == b:
            return True
        return rel > 0 and abs(a - b) <= rel * max(1.0, abs(a), abs(b))
    return a == b


def compare(spark, key: str, sf_dir: str = SF_DIR, rel: float = 0.0, con=None):
    """Return (ok, message)."""
    from __spark_entry__ import oracle_sql, queries
    sdf = queries()[key](spark, sf_dir)
    spdf = sdf.toPandas()
    con = con or duck(sf_dir)
    opdf = con.execute(oracle_sql()[key]).df()
    scols, ocols = sorted(spdf.columns), sorted(opdf.columns)
    if scols != ocols:
        return False, f"columns differ: spark={scols} oracle={ocols}"
    if len(spdf) != len(opdf):
        return False, f"row count differs: spark={len(spdf)} oracle={len(opdf)}"
    a, b = _rows(spdf, scols), _rows(opdf, scols)
    bad = 0
    first = None
    for ra, rb in zip(a, b):
        if not all(_close(x, y, rel) for x, y in zip(ra, rb)):
            bad += 1
            first = first or (ra, rb)
    if bad:
        return False, f"{bad} rows differ; first: spark={first[0]} oracle={first[1]} cols={scols}"
    return True, f"{len(spdf)} rows equal"


if __name__ == "__main__":
    from realpay.session import build_session
    from __spark_entry__ import queries
    spark = build_session("local[8]", 8)
    keys = sys.argv[1:] or list(queries())
    con = duck()
    for k in keys:
        try:
            ok, msg = compare(spark, k, con=con)
        except Exception as exc:  # report and continue
            ok, msg = False, f"ERROR {type(exc).__name__}: {str(exc)[:400]}"
        print(f"{'OK ' if ok else 'BAD'} {k}: {msg}", flush=True)
