"""Runs queries beside their SQL and reports differences: python tests/compare.py [--sf DIR] [NAME...]."""

from __future__ import annotations

import math
import os
import sys
import time
from collections import Counter
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
sys.path.insert(0, str(Path(__file__).resolve().parent))


def cell(x):
    if isinstance(x, bool) or x is None:
        return x
    if isinstance(x, float):
        return None if math.isnan(x) else float(f"{x:.9g}")
    if hasattr(x, "item"):
        return cell(x.item())
    if isinstance(x, (list, tuple)):
        return tuple(map(cell, x))
    if isinstance(x, int):
        return float(f"{x:.15g}") if abs(x) > 2**53 else x
    if hasattr(x, "tzinfo"):
        return x.replace(tzinfo=None)
    return x


def views(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for p in sorted(Path(sf_dir).glob("*.parquet")):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}{'/*.parquet' if p.is_dir() else ''}'")
    return con


def differences(df, con, sql: str) -> str:
    """What differs between the rows of `df` and of `sql`; empty if nothing does."""
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    want_rows = cur.fetchall()
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} instead of {sorted(names)}"
    order = sorted(names)
    got = Counter(tuple(cell(r[n]) for n in order) for r in df.collect())
    at = [names.index(n) for n in order]
    want = Counter(tuple(cell(r[i]) for i in at) for r in want_rows)
    if got == want:
        return ""
    more, less = got - want, want - got
    return f"{sum(got.values())} rows, SQL {sum(want.values())}; only here {list(more)[:2]}; only SQL {list(less)[:2]}"


if __name__ == "__main__":
    import __spark_entry__ as e
    from siteloom.session import get_spark

    args = sys.argv[1:]
    sf = args[args.index("--sf") + 1] if "--sf" in args else "/root/testdata/sf0.01"
    names = [a for a in args if a != "--sf" and a != sf]
    spark, con, bad = get_spark(), views(sf), 0
    q, s = e.queries(), e.oracle_sql()
    for name in q:
        if names and not any(name.startswith(n) for n in names):
            continue
        t = time.time()
        try:
            if name in s:
                diff = differences(q[name](spark, sf), con, s[name])
            else:
                diff, n = "", q[name](spark, sf).count()
        except Exception as x:  # noqa: BLE001
            diff = f"{type(x).__name__}: {str(x)[:600]}"
        bad += bool(diff)
        print(f"{'BAD ' if diff else 'ok  '} {name} {time.time() - t:.1f}s {'' if name in s else 'no SQL'} {diff}", flush=True)
    print("bad:", bad)
    os._exit(int(bool(bad)))
