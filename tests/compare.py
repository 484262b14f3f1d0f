"""Run registered queries and their SQL side by side.  python -m tests.compare SF_DIR [name ...]"""
from __future__ import annotations

import math
import sys
import time
import traceback

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def duck(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    return con


def _plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "NULL"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float):
        return repr(v + 0.0)
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(_plain(x) for x in v) + "]"
    if hasattr(v, "asDict"):
        return "{" + ",".join(_plain(x) for x in v.asDict().values()) + "}"
    if isinstance(v, dict):
        return "{" + ",".join(f"{_plain(a)}:{_plain(b)}" for a, b in sorted(v.items())) + "}"
    return str(v)


def _kind(v):
    return type(v).__name__


def compare(spark, con, name: str, query, sql: str | None, folder: str) -> tuple[bool, str]:
    t = time.time()
    df = query(spark, folder)
    rows = df.collect()
    took = time.time() - t
    plan = df._jdf.queryExecution().executedPlan().toString()
    if "CartesianProduct" in plan or "BroadcastNestedLoopJoin" in plan:
        return False, "the plan pairs whole tables without an equality key"
    if sql is None:
        return True, f"rows {len(rows)} ({took:.2f}s, no SQL)"
    t = time.time()
    res = con.execute(sql)
    names = [d[0] for d in res.description]
    want = res.fetchall()
    sql_took = time.time() - t
    if sorted(names) != sorted(df.columns):
        return False, f"columns {sorted(df.columns)} vs SQL {sorted(names)}"
    cols = sorted(names)
    left = sorted([tuple(_plain(r[c]) for c in cols) for r in rows])
    pos = [names.index(c) for c in cols]
    right = sorted([tuple(_plain(w[i]) for i in pos) for w in want])
    if rows and want:
        for c, i in zip(cols, pos):
            a = next((_kind(r[c]) for r in rows if r[c] is not None), None)
            b = next((_kind(w[i]) for w in want if w[i] is not None), None)
            if a != b and {a, b} != {"Row", "dict"} and None not in (a, b):
                return False, f"type of {c}: {a} vs SQL {b}"
    if len(left) != len(right):
        return False, f"rows {len(left)} vs SQL {len(right)}; first differing: " + str(next(
            ((a, b) for a, b in zip(left, right) if a != b), None))
    bad = [(a, b) for a, b in zip(left, right) if a != b]
    if bad:
        return False, f"{len(bad)} of {len(left)} rows differ, e.g. {cols} {bad[0]}"
    return True, f"rows {len(rows)} ({took:.2f}s, SQL {sql_took:.2f}s)" + (" EMPTY" if not rows else "")


def main(argv: list[str]) -> int:
    import __spark_entry__ as entry
    from pixelquilt.session import local_session
    folder, names = argv[0], argv[1:]
    spark, con = local_session(8), duck(folder)
    queries, oracle = entry.queries(), entry.oracle_sql()
    failed = []
    for name in names or queries:
        try:
            ok, text = compare(spark, con, name, queries[name], oracle.get(name), folder)
        except Exception as e:                      # report and go on
            ok, text = False, f"{type(e).__name__}: {str(e)[:1500]}"
            if names:
                traceback.print_exc(limit=6)
        print(("ok   " if ok else "FAIL ") + f"{name}: {text}", flush=True)
        if not ok:
            failed.append(name)
    print(f"{len(failed)} failed: {failed}")
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
