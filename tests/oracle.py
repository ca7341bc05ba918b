"""Run a registered query and its SQL on the same tables and compare the rows."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

DATA = "/root/testdata"
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def duck(folder: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def _cell(v):
    if v is None:
        return ("", "NULL")
    if isinstance(v, bool):
        return ("b", v)
    if isinstance(v, float):
        if math.isnan(v):
            return ("f", "nan")
        return ("f", v + 0.0)
    if isinstance(v, int):
        return ("i", v)
    if isinstance(v, (list, tuple)):
        return ("l", tuple(_cell(x) for x in (v.asDict().values() if hasattr(v, "asDict") else v)))
    if isinstance(v, dict):
        return ("l", tuple(_cell(x) for x in v.values()))
    return ("s", str(v))


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted((tuple(_cell(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, con, folder, fn, sql):
    t0 = time.time()
    df = fn(spark, folder)
    got_cols, got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    took = time.time() - t0
    t0 = time.time()
    cur = con.execute(sql)
    cols = [c[0] for c in cur.description]
    want_cols, want = rows_of(cols, cur.fetchall())
    duck_took = time.time() - t0
    problem = None
    if got_cols != want_cols:
        problem = f"columns {got_cols} != {want_cols}"
    elif len(got) != len(want):
        g, w = set(got), set(want)
        problem = f"{len(got)} rows, wanted {len(want)}; only ours {list(g - w)[:2]}; only theirs {list(w - g)[:2]}"
    elif got != want:
        bad = [(a, b) for a, b in zip(got, want) if a != b]
        problem = f"{len(bad)} of {len(got)} rows differ, e.g.\n   {bad[0][0]}\n   {bad[0][1]}"
    return problem, len(got), took, duck_took


if __name__ == "__main__":
    import __spark_entry__ as entry
    from wayloom.session import local_session

    sf = sys.argv[1]
    names = sys.argv[2:]
    spark = local_session("oracle")
    folder = f"{DATA}/sf{sf}"
    con = duck(folder)
    q, o = entry.queries(), entry.oracle_sql()
    for name in names or q:
        try:
            if name in o:
                problem, n, a, b = compare(spark, con, folder, q[name], o[name])
                print(f"{'ok  ' if not problem else 'FAIL'} {name:34s} {n:8d} rows {a:7.2f}s duck {b:6.2f}s {problem or ''}", flush=True)
            else:
                t0 = time.time()
                rows = q[name](spark, folder).collect()
                print(f"rows {name:34s} {len(rows):8d} rows {time.time() - t0:7.2f}s {rows[0] if rows else ''}", flush=True)
        except Exception as err:  # noqa: BLE001
            print(f"ERR  {name}: {str(err)[:1500]}", flush=True)
