"""Run queries beside their SQL twins: python -m suite.compare [sf] [name-prefix ...]."""

from __future__ import annotations

import sys
import time

import duckdb

from suite.all import ORACLES, QUERIES
from threadloom.session import build_session

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()


def canonical(columns: list[str], rows: list[tuple]) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(repr(r[i]) for i in order) for r in rows))


def main(sf: str, prefixes: list[str]) -> int:
    spark = build_session("compare", 8)
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    bad = 0
    for name, run in QUERIES.items():
        if prefixes and not any(name.startswith(p) for p in prefixes):
            continue
        start = time.time()
        try:
            df = run(spark, sf)
            rows = [tuple(r) for r in df.collect()]
        except Exception as error:  # noqa: BLE001
            bad += 1
            print(f"ERROR {name}: {str(error)[:1500]}", flush=True)
            continue
        mid = time.time()
        if name not in ORACLES:
            print(f"rows  {name}: {len(rows)} rows, {mid - start:.1f}s", flush=True)
            continue
        try:
            cur = con.execute(ORACLES[name])
            columns = [d[0] for d in cur.description]
            twin = cur.fetchall()
        except Exception as error:  # noqa: BLE001
            bad += 1
            print(f"SQL   {name}: {str(error)[:1500]}", flush=True)
            continue
        end = time.time()
        left, right = canonical(df.columns, rows), canonical(columns, twin)
        same = left == right and sorted(df.columns) == sorted(columns)
        bad += not same
        print(f"{'ok   ' if same else 'DIFF '} {name}: {len(rows)} / {len(twin)} rows, spark {mid - start:.1f}s, sql {end - mid:.1f}s", flush=True)
        if not same:
            print("   ", sorted(df.columns), sorted(columns))
            a, b = set(left), set(right)
            for row in sorted(a - b)[:2]:
                print("    spark", str(row)[:600])
            for row in sorted(b - a)[:2]:
                print("    sql  ", str(row)[:600])
    print("problems:", bad)
    return bad


if __name__ == "__main__":
    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    raise SystemExit(main(folder, sys.argv[2:]))
