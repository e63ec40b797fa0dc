"""Compare a registered query with its SQL on the same parquet files."""

from __future__ import annotations

import math
import sys
import time

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con


def _norm(v):
    if isinstance(v, float):
        if math.isnan(v):
            return "NaN"
        return "0.0" if v == 0 else repr(v)
    return str(v)


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(_norm(r[i]) for i in order) for r in rows)


def compare(df, con, sql):
    """Return (ok, message)."""
    cur = con.execute(sql)
    o_names = [d[0] for d in cur.description]
    o_rows = cur.fetchall()
    s_names = df.columns
    s_rows = [tuple(r) for r in df.collect()]
    if sorted(s_names) != sorted(o_names):
        return False, f"columns {sorted(s_names)} vs {sorted(o_names)}"
    if len(s_rows) != len(o_rows):
        return False, f"rows {len(s_rows)} vs {len(o_rows)}"
    a, b = _rows(s_names, s_rows), _rows(o_names, o_rows)
    for x, y in zip(a, b):
        if x != y:
            return False, f"first difference ({sum(p != q for p, q in zip(a, b))} of {len(a)}) {sorted(s_names)}: {x} vs {y}"
    return True, f"{len(a)} rows"


def main(sf: str, names: list[str]):
    from panelweave.session import local_session
    import __spark_entry__ as entry

    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf)
    q, o = entry.queries(), entry.oracle_sql()
    bad = 0
    for name in q:
        if names and not any(name.startswith(n) for n in names):
            continue
        t = time.time()
        try:
            if name in o:
                ok, msg = compare(q[name](spark, sf), con, o[name])
            else:
                ok, msg = True, f"{len(q[name](spark, sf).collect())} rows, no SQL"
        except Exception as e:  # report and go on
            ok, msg = False, f"{type(e).__name__}: {str(e)[:700]}"
        bad += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {name:38s} {time.time() - t:6.2f}s {msg}", flush=True)
    print("failures:", bad)


if __name__ == "__main__":
    main(sys.argv[1], sys.argv[2:])
