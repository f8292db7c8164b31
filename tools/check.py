"""Run registered queries and their check SQL side by side and report differences.

usage: python tools/check.py [--sf DIR] [name ...]
"""

from __future__ import annotations

import argparse
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
from hearthline.plans import registry  # noqa: E402
from hearthline.session import build_session  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def canon(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(round(value, 6) + 0.0)
    if isinstance(value, list):
        return "[" + ",".join(canon(v) for v in value) + "]"
    return repr(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(canon(r[i]) for i in order) for r in rows)


def main() -> int:
    parser = argparse.ArgumentParser()
    parser.add_argument("names", nargs="*")
    parser.add_argument("--sf", default="/root/testdata/sf0.01")
    parser.add_argument("--modules", default="")
    args = parser.parse_args()
    if args.modules:
        registry.MODULES = tuple(args.modules.split(","))
    queries, oracles = registry.load()
    names = args.names or list(queries)
    spark = build_session("check", "local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.driver.memory": "12g", "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    })
    spark.sparkContext.setLogLevel("ERROR")
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{args.sf}/{table}.parquet'")
    bad = []
    for name in names:
        try:
            t0 = time.time()
            df = queries[name](spark, args.sf)
            got = [tuple(r) for r in df.collect()]
            t1 = time.time()
            if name not in oracles:
                print(f"rows  {name:28s} {len(got):8d} rows  {t1 - t0:6.2f}s", flush=True)
                continue
            cur = con.execute(oracles[name])
            cols = [d[0] for d in cur.description]
            want = cur.fetchall()
            t2 = time.time()
            if sorted(cols) != sorted(df.columns):
                print(f"COLS  {name}: {sorted(df.columns)} vs {sorted(cols)}", flush=True)
                bad.append(name)
                continue
            a, b = rows_of(df.columns, got), rows_of(cols, want)
            ok = a == b
            print(f"{'ok   ' if ok else 'DIFF '} {name:28s} {len(a):8d} rows  {t1 - t0:6.2f}s  sql {t2 - t1:6.2f}s", flush=True)
            if not ok:
                bad.append(name)
                print("   sql rows:", len(b), "columns:", sorted(cols))
                sa, sb = set(a), set(b)
                for r in [x for x in a if x not in sb][:3]:
                    print("   spark:", str(r)[:400])
                for r in [x for x in b if x not in sa][:3]:
                    print("   sql:  ", str(r)[:400])
        except Exception as exc:  # report and go on with the next query
            bad.append(name)
            print(f"FAIL  {name}: {str(exc)[:900]}", flush=True)
    print("failed:", bad)
    return len(bad)


if __name__ == "__main__":
    sys.exit(main())
