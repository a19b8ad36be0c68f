"""Spark-vs-DuckDB parity check, shaped like the driver's gate: columns sorted by
name, row counts, column names, and an order-insensitive multiset of row values.

CLI: ``python tests/parity.py /root/testdata/sf0.01 [name ...]``
"""

from __future__ import annotations

import datetime as dt
import decimal
import math
import os
import sys
import time
from collections import Counter

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

VIEWS = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
         "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def duck(sf_dir: str):
    import duckdb
    con = duckdb.connect()
    for v in VIEWS:
        con.execute(f"CREATE VIEW {v} AS SELECT * FROM read_parquet('{sf_dir}/{v}.parquet')")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        return None if math.isnan(v) else float(v)
    if isinstance(v, decimal.Decimal):
        return float(v)
    if hasattr(v, "item") and not isinstance(v, (list, tuple, dict)):
        try:
            return _norm(v.item())
        except (ValueError, AttributeError):
            pass
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, dt.date):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if hasattr(v, "tolist"):
        return tuple(_norm(x) for x in v.tolist())
    if isinstance(v, dict):
        return tuple(sorted((k, _norm(x)) for k, x in v.items()))
    return v


def spark_rows(df):
    cols = sorted(df.columns)
    rows = [tuple(_norm(r[c]) for c in cols) for r in df.select(*cols).collect()]
    return cols, rows


def duck_rows(con, sql):
    rel = con.execute(sql)
    names = [d[0] for d in rel.description]
    data = rel.fetchall()
    order = sorted(range(len(names)), key=lambda i: names[i])
    cols = [names[i] for i in order]
    rows = [tuple(_norm(r[i]) for i in order) for r in data]
    return cols, rows


def compare(spark, con, name, fn, sql, sf_dir):
    t0 = time.time()
    scols, srows = spark_rows(fn(spark, sf_dir))
    t1 = time.time()
    dcols, drows = duck_rows(con, sql)
    ok_cols = scols == dcols
    ok_n = len(srows) == len(drows)
    ok_vals = Counter(srows) == Counter(drows)
    detail = ""
    if not (ok_cols and ok_n and ok_vals):
        detail = f"cols spark={scols} duck={dcols}; rows {len(srows)} vs {len(drows)}"
        if ok_cols:
            a, b = Counter(srows), Counter(drows)
            detail += f"; spark-only {list((a - b).elements())[:3]}; duck-only {list((b - a).elements())[:3]}"
    return ok_cols and ok_n and ok_vals, len(srows), round(t1 - t0, 2), detail


def main(argv):
    from tagwise.plans import ORACLES, QUERIES
    from tagwise.session import build_session
    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    names = argv[2:] or list(QUERIES)
    spark = build_session("local[8]", shuffle_partitions=8)
    con = duck(sf_dir)
    bad = 0
    for name in names:
        fn = QUERIES[name]
        if name not in ORACLES:
            t0 = time.time()
            n = fn(spark, sf_dir).count()
            print(f"ROWS-ONLY {name}: {n} rows {time.time() - t0:.2f}s", flush=True)
            continue
        try:
            ok, n, secs, detail = compare(spark, con, name, fn, ORACLES[name], sf_dir)
        except Exception as e:  # report and continue
            ok, n, secs, detail = False, -1, 0, f"{type(e).__name__}: {str(e)[:600]}"
        bad += not ok
        print(f"{'OK  ' if ok else 'FAIL'} {name}: {n} rows {secs}s {detail}", flush=True)
    print(f"{len(names) - bad}/{len(names)} ok")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv) else 0)
