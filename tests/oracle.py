"""Compare registered queries with their SQL counterpart in DuckDB.

Run ``python tests/oracle.py sf0.01 [name ...]`` for a table of results.
"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
DATA = os.environ.get("TEST_DATA", "/root/testdata")
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def _cell(v):
    if v is None:
        return None
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, float):
        return "nan" if math.isnan(v) else v
    if isinstance(v, (list, tuple)):
        return tuple(_cell(x) for x in v)
    return v


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda n: columns[n])
    out = [tuple(_cell(r[n]) for n in order) for r in rows]
    return [columns[n] for n in order], sorted(out, key=repr)


def compare(spark, con, fn, sql: str, sf_dir: str) -> str | None:
    """None when equal, otherwise the first difference."""
    start = time.time()
    df = fn(spark, sf_dir)
    sc, mine = _rows(df.columns, df.collect())
    compare.spark_time = time.time() - start
    cur = con.execute(sql)
    dc, theirs = _rows([d[0] for d in cur.description], cur.fetchall())
    if sc != dc:
        return f"columns {sc} != {dc}"
    if len(mine) != len(theirs):
        return f"rows {len(mine)} != {len(theirs)}"
    for a, b in zip(mine, theirs):
        if a != b or [type(x) for x in a] != [type(x) for x in b]:
            return f"spark {a} != duckdb {b}"
    return None


if __name__ == "__main__":
    from steadymap.session import local_session, release_shared
    import __spark_entry__ as entry

    spark = local_session()
    sf_dir = f"{DATA}/{sys.argv[1]}"
    names = sys.argv[2:] or list(entry.queries())
    con = connect(sf_dir)
    bad = 0
    for name in names:
        start = time.time()
        fn, sql = entry.queries()[name], entry.oracle_sql().get(name)
        try:
            if sql is None:
                diff = f"rows only: {fn(spark, sf_dir).count()}"
            else:
                diff = compare(spark, con, fn, sql, sf_dir)
        except Exception as e:  # noqa: BLE001
            diff = f"ERROR {type(e).__name__}: {str(e)[:600]}"
        release_shared()
        bad += bool(diff) and not diff.startswith("rows only")
        print(f"{name:28s} {getattr(compare, 'spark_time', 0):6.2f}s of {time.time() - start:6.2f}s {'ok' if diff is None else diff}", flush=True)
    print("bad:", bad, "of", len(names))
