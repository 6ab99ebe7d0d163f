"""Run registered queries against their SQL in DuckDB: python tests/check.py [sf] [name-part ...]"""

from __future__ import annotations

import sys
import time
from collections import Counter
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(repr(r[i]) for i in order) for r in rows)


def compare(spark, con, sf_dir, run, sql):
    """None when equal, else a description of the difference."""
    df = run(spark, sf_dir)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if sql is None:
        return None if sum(got.values()) else "no rows"
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    want = rows_of(names, cur.fetchall())
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(names)}"
    if got != want:
        a, b = list((got - want).elements()), list((want - got).elements())
        return f"{sum(got.values())} rows vs {sum(want.values())}; {len(a)} differ\n  spark {sorted(a)[:2]}\n  sql   {sorted(b)[:2]}"
    return None


if __name__ == "__main__":
    from tickloom.registry import oracles, queries
    from tickloom.session import local_session

    sf_dir = f"/root/testdata/sf{sys.argv[1] if len(sys.argv) > 1 else '0.01'}"
    parts = sys.argv[2:]
    spark, con = local_session(), duck(sf_dir)
    sqls = oracles()
    bad = 0
    for name, run in queries().items():
        if parts and not any(p in name for p in parts):
            continue
        t = time.time()
        try:
            diff = compare(spark, con, sf_dir, run, sqls.get(name))
        except Exception as e:
            diff = f"{type(e).__name__}: {str(e)[:1500]}"
        bad += diff is not None
        state = "ok " if diff is None else "BAD"
        print(f"{state} {'sql ' if name in sqls else 'rows'} {name:32s} {time.time() - t:6.1f}s {diff or ''}", flush=True)
    print("bad:", bad)
    sys.exit(bool(bad))
