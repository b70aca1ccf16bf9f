"""Run registered queries in Spark and their SQL in DuckDB on the same tables and compare rows.

    python check_oracle.py [--sf /root/testdata/sf0.01] [name ...]
"""

from __future__ import annotations

import argparse
import math
import time

import duckdb

from mailposture.plans import catalog
from mailposture.plans.tables import BASE
from mailposture.session import local_session


def cell(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return "~"
    if isinstance(value, float):
        return f"{value + 0.0:.6f}"
    return str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(cell(r[i]) for i in order) for r in rows)


def main() -> None:
    parser = argparse.ArgumentParser()
    parser.add_argument("--sf", default="/root/testdata/sf0.01")
    parser.add_argument("names", nargs="*")
    args = parser.parse_args()
    spark = local_session(8)
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for table in BASE:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{args.sf}/{table}.parquet'")
    bad = []
    for name in args.names or catalog.RUN:
        start = time.time()
        try:
            df = catalog.RUN[name](spark, args.sf)
            got = rows_of(df.columns, df.collect())
            took = time.time() - start
            if name not in catalog.SQL:
                print(f"rows  {name:32} {len(got):8} {took:6.2f}s", flush=True)
                continue
            result = con.execute(catalog.SQL[name])
            names = [c[0] for c in result.description]
            want = rows_of(names, result.fetchall())
            same = sorted(df.columns) == sorted(names) and got == want
            print(f"{'ok   ' if same else 'DIFF '} {name:32} {len(got):8} {len(want):8} {took:6.2f}s {time.time() - start - took:6.2f}s", flush=True)
            if not same:
                bad.append(name)
                print("   ", sorted(df.columns), sorted(names))
                for row in list((a, b) for a, b in zip(got, want) if a != b)[:2]:
                    print("   ", *row, sep="\n      ")
        except Exception as error:  # noqa: BLE001
            bad.append(name)
            print(f"ERR   {name:32} {str(error)[:600]}", flush=True)
    print("failed:", bad)


if __name__ == "__main__":
    main()
