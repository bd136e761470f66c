"""Run named queries in Spark and their DuckDB oracles; compare results.

Usage: python tests/oracle_compare.py [sf_dir] [name ...]
"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from chatspark.sources.tables import TABLES  # noqa: E402


def duck_connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return float(f"{v:.9g}")
    if hasattr(v, "item") and not isinstance(v, (str, bytes)):
        try:
            return _norm(v.item())
        except Exception:
            pass
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if hasattr(v, "tolist"):
        return tuple(_norm(x) for x in v.tolist())
    return v


def rows_of(columns, records):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(_norm(r[i]) for i in order) for r in records]
    return sorted(out, key=lambda r: tuple((x is None, str(x)) for x in r))


def compare(spark, con, name, build, oracle, sf_dir):
    t0 = time.time()
    sdf = build(spark, sf_dir)
    srows = [tuple(r) for r in sdf.collect()]
    scols = sdf.columns
    t1 = time.time()
    if oracle is None:
        return {"name": name, "status": "rows-only", "rows": len(srows), "sec": round(t1 - t0, 2)}
    rel = con.execute(oracle)
    dcols = [d[0] for d in rel.description]
    drows = rel.fetchall()
    res = {"name": name, "rows": len(srows), "duck_rows": len(drows), "sec": round(t1 - t0, 2)}
    if sorted(scols) != sorted(dcols):
        res.update(status="COLS", spark_cols=scols, duck_cols=dcols)
        return res
    a, b = rows_of(scols, srows), rows_of(dcols, drows)
    if a == b:
        res["status"] = "ok"
    else:
        res["status"] = "VALUES"
        diff = [(x, y) for x, y in zip(a, b) if x != y][:3]
        res["diff"] = diff if diff else f"len {len(a)} vs {len(b)}"
    return res


def main(argv):
    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    names = argv[2:]
    from chatspark.plans.registry import load_all
    from chatspark.session import local_session

    spark = local_session(8)
    con = duck_connect(sf_dir)
    qs = load_all()
    bad = 0
    for n, q in qs.items():
        if names and n not in names:
            continue
        try:
            r = compare(spark, con, n, q.build, q.oracle, sf_dir)
        except Exception as e:  # report and go on
            r = {"name": n, "status": "ERROR", "error": str(e).splitlines()[0][:300]}
        if r["status"] not in ("ok", "rows-only"):
            bad += 1
        print(r, flush=True)
    print(f"BAD {bad}")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv) else 0)
