"""Run registered queries next to their check SQL: python tests/check_oracle.py [sf] [name...]."""

from __future__ import annotations

import math
import pathlib
import sys
import time
import traceback

import duckdb

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parents[1]))

import __spark_entry__ as entry  # noqa: E402
from tourlog.plans.registry import TABLES  # noqa: E402
from tourlog.session import build_session  # noqa: E402


def canonical(value):
    if value is None:
        return None
    if isinstance(value, bool):
        return value
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 9)
    if isinstance(value, int):
        return float(value)
    if isinstance(value, (list, tuple)):
        return tuple(canonical(v) for v in value)
    return str(value)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(canonical(r[i]) for i in order) for r in rows), key=repr)


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def compare(spark, con, sf_dir, name, fn, sql):
    t0 = time.time()
    df = fn(spark, sf_dir)
    got = df.collect()
    t1 = time.time()
    if sql is None:
        return "rows-only", f"{len(got)} rows", t1 - t0, 0.0
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    want = cur.fetchall()
    t2 = time.time()
    if sorted(names) != sorted(df.columns):
        return "FAIL", f"columns {sorted(df.columns)} != {sorted(names)}", t1 - t0, t2 - t1
    a, b = rows_of(df.columns, got), rows_of(names, want)
    if a == b:
        return ("ok" if a else "EMPTY"), f"{len(a)} rows", t1 - t0, t2 - t1
    sa, sb = set(a), set(b)
    only_a = [r for r in a if r not in sb][:2]
    only_b = [r for r in b if r not in sa][:2]
    return "FAIL", f"{len(a)} vs {len(b)} rows; spark {only_a} oracle {only_b} cols {sorted(names)}", t1 - t0, t2 - t1


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "sf0.01"
    wanted = sys.argv[2:]
    sf_dir = f"/root/testdata/{sf}"
    spark = build_session("check")
    con = connect(sf_dir)
    queries, oracles = entry.queries(), entry.oracle_sql()
    bad = 0
    for name, fn in queries.items():
        if wanted and not any(w in name for w in wanted):
            continue
        try:
            status, detail, ts, td = compare(spark, con, sf_dir, name, fn, oracles.get(name))
        except Exception as exc:  # report and go on with the next query
            status, detail, ts, td = "ERROR", f"{type(exc).__name__}: {str(exc)[:1200]}", 0, 0
            if "-v" in wanted:
                traceback.print_exc()
        bad += status in ("FAIL", "ERROR", "EMPTY")
        print(f"{status:9} {name:36} spark {ts:6.2f}s duck {td:6.2f}s  {detail[:1500]}", flush=True)
    print(f"{bad} bad")
    spark.stop()
    sys.exit(1 if bad else 0)


if __name__ == "__main__":
    main()
