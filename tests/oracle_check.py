"""Runs registered queries on Spark and their SQL on DuckDB and compares all rows: python tests/oracle_check.py [sf] [names]."""

from __future__ import annotations

import glob
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def duck(sf_dir: str):
    con = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def rows_of(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(([tuple(r[i] for i in order) for r in data]), key=repr)


def compare(spark, con, name, sf_dir, queries, oracles):
    """(ok, message) for one query."""
    df = queries[name](spark, sf_dir)
    got_cols, got = rows_of(df.columns, df.collect())
    if name not in oracles:
        return len(got) > 0, f"{len(got)} rows, no SQL"
    res = con.execute(oracles[name])
    exp_cols, exp = rows_of([d[0] for d in res.description], res.fetchall())
    if got_cols != exp_cols:
        return False, f"columns {got_cols} {exp_cols}"
    if got != exp:
        bad = [(g, e) for g, e in zip(got, exp) if g != e]
        return False, f"rows {len(got)} {len(exp)}, {len(bad)} differ, first {bad[:1]}"[:1500]
    return True, f"{len(got)} rows"


if __name__ == "__main__":
    from __spark_entry__ import oracle_sql, queries
    from flowloom.session import local_session

    sf_dir = f"/root/testdata/sf{sys.argv[1] if len(sys.argv) > 1 else '0.01'}"
    spark = local_session(8, **{"spark.ui.showConsoleProgress": "false"})
    con, q, o = duck(sf_dir), queries(), oracle_sql()
    failed = []
    for name in sys.argv[2:] or q:
        t = time.time()
        try:
            ok, message = compare(spark, con, name, sf_dir, q, o)
        except Exception as e:  # report and go on
            ok, message = False, f"{type(e).__name__}: {str(e)[:1200]}"
        print("ok  " if ok else "FAIL", name, message, f"{time.time() - t:.1f}s", flush=True)
        if not ok:
            failed.append(name)
    print("failed:", failed)
