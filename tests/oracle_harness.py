"""Run registered Spark queries and their DuckDB oracles side by side.

Usage: python tests/oracle_harness.py [sf_dir] [name-prefix ...]
"""

from __future__ import annotations

import datetime as dt
import decimal
import math
import os
import sys
import time

import duckdb

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return round(v, 4)
    if isinstance(v, decimal.Decimal):
        return round(float(v), 4)
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, dt.date):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    return v


def _key(row):
    return tuple((x is None, str(type(x)), str(x)) for x in row)


def _close(a, b):
    if isinstance(a, float) and isinstance(b, float):
        return math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9)
    if isinstance(a, (int, float)) and isinstance(b, (int, float)) and not isinstance(a, bool):
        return math.isclose(float(a), float(b), rel_tol=1e-9, abs_tol=1e-9)
    return a == b


def _raw(v):
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, dt.date):
        return v.isoformat()
    return v


def rows_close(sr, dr):
    if len(sr) != len(dr):
        return False
    return all(len(a) == len(b) and all(_close(x, y) for x, y in zip(a, b)) for a, b in zip(sr, dr))


def canon_raw(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    keyed = sorted(rows, key=lambda r: _key(tuple(_norm(r[i]) for i in order)))
    return [tuple(_raw(r[i]) for i in order) for r in keyed]


def canon(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(_norm(r[i]) for i in order) for r in rows]
    return [cols[i] for i in order], sorted(out, key=_key)


def compare(spark, sf_dir, names=None, verbose=True):
    import __spark_entry__ as E

    qs, sqls = E.queries(), E.oracle_sql()
    con = duck(sf_dir)
    results = {}
    for name, fn in qs.items():
        if names and not any(name.startswith(n) for n in names):
            continue
        t0 = time.time()
        df = fn(spark, sf_dir)
        srows = [tuple(r) for r in df.collect()]
        scols = df.columns
        st = time.time() - t0
        if name not in sqls:
            results[name] = ("rows-only", len(srows), st)
            if verbose:
                print(f"{name:45s} rows-only  n={len(srows)}  {st:.2f}s", flush=True)
            continue
        rel = con.sql(sqls[name])
        dcols = rel.columns
        drows = rel.fetchall()
        sc, sr = canon(scols, srows)
        dc, dr = canon(dcols, drows)
        ok_cols = sc == dc
        ok_n = len(sr) == len(dr)
        ok_v = sr == dr or rows_close(canon_raw(scols, srows), canon_raw(dcols, drows))
        status = "OK" if (ok_cols and ok_n and ok_v) else "MISMATCH"
        results[name] = (status, len(srows), st)
        if verbose:
            print(f"{name:45s} {status:8s} n={len(srows)}/{len(drows)}  {st:.2f}s", flush=True)
            if not ok_cols:
                print("   cols spark:", sc, "\n   cols duck: ", dc)
            elif not ok_v:
                diff_s = [r for r in sr if r not in dr][:3]
                diff_d = [r for r in dr if r not in sr][:3]
                print("   spark-only:", diff_s, "\n   duck-only: ", diff_d)
    return results


if __name__ == "__main__":
    from wardflow.session import build_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = build_session("local[8]", shuffle_partitions=8)
    res = compare(spark, sf, sys.argv[2:] or None)
    bad = [k for k, v in res.items() if v[0] == "MISMATCH"]
    print(f"\n{len(res)} queries, {len(bad)} mismatches: {bad}")
