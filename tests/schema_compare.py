"""Compare column types of each Spark query with its DuckDB oracle.

Usage: python tests/schema_compare.py [sf_dir] [name ...]
"""

from __future__ import annotations

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from oracle_compare import duck_connect  # noqa: E402

_SPARK = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN",
          "date": "DATE", "timestamp_ntz": "TIMESTAMP", "timestamp": "TIMESTAMP WITH TIME ZONE", "float": "FLOAT",
          "smallint": "SMALLINT", "tinyint": "TINYINT"}


def spark_type(t: str) -> str:
    if t.startswith("array<"):
        return spark_type(t[6:-1]) + "[]"
    return _SPARK.get(t, t.upper())


def main(argv):
    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    names = argv[2:]
    from chatspark.plans.registry import load_all
    from chatspark.session import local_session
    spark = local_session(8)
    con = duck_connect(sf_dir)
    bad = 0
    for n, q in load_all().items():
        if q.oracle is None or (names and n not in names):
            continue
        try:
            s = {f: spark_type(t) for f, t in q.build(spark, sf_dir).dtypes}
            d = {r[0]: str(r[1]) for r in con.execute(f"DESCRIBE {q.oracle}").fetchall()}
        except Exception as e:
            print({"name": n, "status": "ERROR", "error": str(e).splitlines()[0][:200]}, flush=True)
            bad += 1
            continue
        diff = {c: (s.get(c), d.get(c)) for c in set(s) | set(d) if s.get(c) != d.get(c)}
        if diff:
            bad += 1
            print({"name": n, "status": "TYPES", "diff": diff}, flush=True)
    print(f"BAD {bad}")


if __name__ == "__main__":
    main(sys.argv)
