"""Compare registered queries with their SQL on the given tables.

    python tools/check.py [folder] [name ...]
"""

from __future__ import annotations

import importlib
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def normal(value):
    if isinstance(value, bool):
        return value
    if isinstance(value, float):
        return "nan" if math.isnan(value) else float(value) + 0.0
    if hasattr(value, "as_integer_ratio"):
        return float(value)
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(normal(r[i]) for i in order) for r in rows), key=repr)


def main(argv):
    import duckdb

    from urbanflow.session import build_session
    entry = importlib.import_module("__spark_entry__")
    folder = argv[0] if argv else "/root/testdata/sf0.01"
    wanted = argv[1:]
    spark = build_session("local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "12g"})
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{folder}/{name}.parquet'")
    oracles, bad = entry.oracle_sql(), 0
    for name, query in entry.queries().items():
        if wanted and not any(name == w or (w.endswith("*") and name.startswith(w[:-1])) for w in wanted):
            continue
        start = time.time()
        try:
            df = query(spark, folder)
            got_rows, columns = df.collect(), df.columns
        except Exception as error:
            print(f"FAIL  {name}: {str(error)[:600]}")
            bad += 1
            continue
        took = time.time() - start
        if name not in oracles:
            print(f"rows  {name}: {len(got_rows)} rows {took:.1f}s")
            continue
        try:
            result = con.execute(oracles[name])
            want_columns, want_rows = [c[0] for c in result.description], result.fetchall()
        except Exception as error:
            print(f"FAIL  {name}: oracle {str(error)[:600]}")
            bad += 1
            continue
        got, want = rows_of(columns, got_rows), rows_of(want_columns, want_rows)
        types = sorted(columns) == sorted(want_columns)
        if types and got == want and got:
            print(f"ok    {name}: {len(got)} rows {took:.1f}s")
            continue
        bad += 1
        print(f"DIFF  {name}: {len(got)} vs {len(want)} rows; {sorted(columns)} vs {sorted(want_columns)}")
        off = [(g, w) for g, w in zip(got, want) if g != w]
        for g, w in off[:3]:
            print("   spark ", g, "\n   duckdb", w)
        print("   rows off:", len(off))
    print("bad:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
