"""Compare registered queries with their SQL twins in DuckDB.

Run ``python -m tests.oracle [sf dir] [name ...]`` for one line per query.
"""

from __future__ import annotations

import glob
import math
import os
import sys
import time

import duckdb

DEFAULT_DIR = "/root/testdata/sf0.001"


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def normal(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 9) + 0.0
    if isinstance(value, (list, tuple)):
        return tuple(normal(v) for v in value)
    return value


def key(row):
    return tuple((v is not None, str(v)) for v in row)


def compare(spark, con, name, fn, sql, sf_dir):
    df = fn(spark, sf_dir)
    names = sorted(df.columns)
    mine = sorted((tuple(normal(v) for v in r) for r in df.select(*names).collect()), key=key)
    if sql is None:
        return len(mine), None
    cur = con.execute(sql)
    theirs_names = [d[0] for d in cur.description]
    if sorted(theirs_names) != names:
        return len(mine), f"columns {names} != {sorted(theirs_names)}"
    order = [theirs_names.index(n) for n in names]
    theirs = sorted((tuple(normal(r[i]) for i in order) for r in cur.fetchall()), key=key)
    if len(mine) != len(theirs):
        return len(mine), f"rows {len(mine)} != {len(theirs)}"
    for a, b in zip(mine, theirs):
        if a != b:
            return len(mine), f"{names}: {a} != {b}"
    return len(mine), ""


def main() -> None:
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__ as entry
    from cloudgauge.session import local_session

    args = sys.argv[1:]
    sf_dir = args.pop(0) if args and os.path.isdir(args[0]) else DEFAULT_DIR
    spark, con = local_session(), duck(sf_dir)
    bad = 0
    for name, fn in entry.queries().items():
        if args and not any(a in name for a in args):
            continue
        start = time.time()
        try:
            rows, problem = compare(spark, con, name, fn, entry.oracle_sql().get(name), sf_dir)
        except Exception as error:  # noqa: BLE001 - report and go on
            rows, problem = -1, f"{type(error).__name__}: {str(error)[:600]}"
        verdict = "rows-only" if problem is None else "ok" if problem == "" else "BAD " + problem
        bad += bool(problem)
        print(f"{name:32s} {rows:8d} {time.time() - start:6.2f}s {verdict}", flush=True)
    print(f"{bad} bad")
    spark.stop()


if __name__ == "__main__":
    main()
