"""Compare the named queries with their SQL in DuckDB: python tests/oracle.py SF [module|name ...]"""

from __future__ import annotations

import importlib
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def connect(path: str):
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{path}/{t}.parquet'")
    return con


def cell(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "NULL"
    if isinstance(v, bool) or type(v).__name__ == "bool":
        return str(bool(v))
    if isinstance(v, (int, float)) or hasattr(v, "dtype"):
        x = float(v)
        return repr(x + 0.0)
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(cell, v)) + "]"
    return str(v)


def rows_of(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(cols), sorted(tuple(cell(r[i]) for i in order) for r in rows)


def compare(df, con, sql: str):
    """None when equal, else a short account of the difference."""
    sc, sr = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    dc, dr = rows_of([d[0] for d in cur.description], cur.fetchall())
    if sc != dc:
        return f"columns {sc} != {dc}"
    if sr == dr:
        return None
    a, b = set(sr), set(dr)
    return f"rows {len(sr)} vs {len(dr)}; only spark {sorted(a - b)[:2]}; only sql {sorted(b - a)[:2]}"


def main() -> int:
    from memlake.session import local_session
    from memlake.registry import MODULES
    from memlake.registry.core import QUERIES, SQL, bind
    path, want = f"/root/testdata/sf{sys.argv[1]}", sys.argv[2:]
    names = []
    for m in MODULES:
        if want and m not in want and not any(w not in MODULES for w in want):
            continue
        known = set(QUERIES)
        importlib.import_module(f"memlake.registry.{m}")
        names += [n for n in QUERIES if n not in known and (not want or m in want or n in want)]
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(path)
    bad = 0
    for n in names:
        t0 = time.time()
        try:
            df = bind(QUERIES[n])(spark, path)
            if n in SQL:
                diff = compare(df, con, SQL[n])
            else:
                diff = None if df.count() else "no rows"
        except Exception as e:  # noqa: BLE001
            diff = "ERROR " + str(e)[:600]
        bad += diff is not None
        print(f"{'ok ' if diff is None else 'BAD'} {n} {time.time() - t0:.1f}s {'' if n in SQL else '(rows)'} {diff or ''}", flush=True)
    print(f"{len(names)} queries, {bad} bad")
    return bad


if __name__ == "__main__":
    sys.exit(main())
