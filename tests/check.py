"""Compare registered queries with their SQL twins: python tests/check.py [--sf 0.01] [name ...]"""

from __future__ import annotations

import argparse
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def duck(root: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{root}/{t}.parquet')")
    return con


def canon(v):
    if v is None:
        return "~"
    if isinstance(v, bool):
        return str(v).lower()
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v + 0.0:.9g}"
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(canon(x) for x in v) + "]"
    if hasattr(v, "item") and not isinstance(v, str):
        return canon(v.item())
    return str(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(canon(r[i]) for i in order) for r in rows)


def compare(spark, con, root, fn, sql, show=3):
    """Empty string when equal, otherwise what differs."""
    df = fn(spark, root)
    got = rows_of(df.columns, df.collect())
    if sql is None:
        return "", len(got)
    cur = con.execute(sql)
    cols = [d[0] for d in cur.description]
    want = rows_of(cols, cur.fetchall())
    if sorted(cols) != sorted(df.columns):
        return f"columns {sorted(df.columns)} vs {sorted(cols)}", len(got)
    if got != want:
        extra = [r for r in got if r not in set(want)][:show]
        missing = [r for r in want if r not in set(got)][:show]
        return f"rows {len(got)} vs {len(want)}\n   only spark {extra}\n   only sql {missing}", len(got)
    return "", len(got)


def main():
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="0.01")
    ap.add_argument("names", nargs="*")
    args = ap.parse_args()
    from __spark_entry__ import oracle_sql, queries
    from quire.session import local_session

    spark = local_session("8")
    spark.sparkContext.setLogLevel("ERROR")
    root = f"/root/testdata/sf{args.sf}"
    con = duck(root)
    oracles = oracle_sql()
    bad = 0
    for name, fn in queries().items():
        if args.names and not any(name == n or (n.endswith("*") and name.startswith(n[:-1])) for n in args.names):
            continue
        t = time.time()
        try:
            diff, n = compare(spark, con, root, fn, oracles.get(name))
        except Exception as e:  # report and go on
            diff, n = f"{type(e).__name__}: {str(e)[:1500]}", 0
        tag = "rows-only" if name not in oracles else ("ok" if not diff else "DIFF")
        if diff:
            bad += 1
        print(f"{tag:9} {name:28} {n:7} rows {time.time() - t:6.1f}s {diff[:2500]}", flush=True)
    print("failures:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
