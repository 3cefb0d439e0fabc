"""Run registered queries on Spark and their oracle SQL on DuckDB; compare.

usage: python tools/check_oracle.py [sf_dir] [name-substring ...]
Prints one line per query: rows, column match, exact / approximate match.
"""

from __future__ import annotations

import datetime as dt
import decimal
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

from sigfolio.plans.registry import ORACLE, QUERIES, load_all  # noqa: E402
from sigfolio.session import build_session  # noqa: E402

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else v
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, dt.datetime) and v.tzinfo is not None:
        return v.replace(tzinfo=None)
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, norm(x)) for k, x in v.items()))
    return v


def key(row):
    return tuple((0, "") if x is None else (1, repr(x)) for x in row)


def close(a, b):
    if isinstance(a, float) and isinstance(b, (float, int)):
        return abs(a - b) <= 1e-9 * max(1.0, abs(a), abs(b))
    if isinstance(a, tuple) and isinstance(b, tuple):
        return len(a) == len(b) and all(close(x, y) for x, y in zip(a, b))
    return a == b


SPARK_TO_DUCK = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
                 "date": "DATE", "timestamp_ntz": "TIMESTAMP", "timestamp": "TIMESTAMP WITH TIME ZONE",
                 "boolean": "BOOLEAN", "float": "FLOAT", "smallint": "SMALLINT", "tinyint": "TINYINT"}


def type_diffs(sdf, cur):
    st = {n: SPARK_TO_DUCK.get(t, t.upper()) for n, t in sdf.dtypes}
    dt_ = {d[0]: str(d[1]).upper() for d in cur.description}
    return {n: (st[n], dt_.get(n)) for n in st if dt_.get(n) is not None and st[n] != dt_.get(n)}


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    pats = sys.argv[2:]
    load_all()
    spark = build_session("local[8]")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    ok = bad = 0
    for name in sorted(QUERIES):
        if pats and not any(p in name for p in pats):
            continue
        t0 = time.time()
        try:
            sdf = QUERIES[name](spark, sf)
            cols = sdf.columns
            srows = [tuple(norm(r[c]) for c in sorted(cols)) for r in sdf.collect()]
        except Exception as e:  # noqa: BLE001
            print(f"{name:32s} SPARK-ERROR {type(e).__name__}: {str(e)[:300]}")
            bad += 1
            continue
        ts = time.time() - t0
        if name not in ORACLE:
            print(f"{name:32s} rows={len(srows):7d} (no oracle) {ts:.1f}s")
            continue
        try:
            cur = con.execute(ORACLE[name])
            dcols = [d[0] for d in cur.description]
            drows = [tuple(norm(r[dcols.index(c)]) for c in sorted(dcols)) for r in cur.fetchall()]
        except Exception as e:  # noqa: BLE001
            print(f"{name:32s} DUCK-ERROR {type(e).__name__}: {str(e)[:300]}")
            bad += 1
            continue
        same_cols = sorted(cols) == sorted(dcols)
        tdiff = type_diffs(sdf, cur)
        a, b = sorted(srows, key=key), sorted(drows, key=key)
        exact = a == b
        approx = exact or (len(a) == len(b) and all(close(x, y) for x, y in zip(a, b)))
        status = "OK" if (same_cols and exact) else ("APPROX" if same_cols and approx else "MISMATCH")
        ok += status == "OK"
        bad += status != "OK"
        print(f"{name:32s} rows={len(a):7d}/{len(b):7d} cols={'=' if same_cols else sorted(cols) + sorted(dcols)} {status} {ts:.1f}s"
              + (f" types:{tdiff}" if tdiff else ""))
        if status == "MISMATCH" and same_cols:
            sa, sb = set(a), set(b)
            print("   spark-only:", list(sa - sb)[:3])
            print("   duck-only: ", list(sb - sa)[:3])
    print(f"ok={ok} not-ok={bad}")
    spark.stop()


if __name__ == "__main__":
    main()
