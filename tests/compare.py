"""Run registered queries next to their SQL twins: python tests/compare.py SF_DIR [name ...]"""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def canonical(pdf):
    cols = sorted(pdf.columns)

    def cell(v):
        if v is None or str(v) == "<NA>" or (isinstance(v, float) and math.isnan(v)):
            return "null"
        if isinstance(v, (bool,)):
            return str(v)
        if hasattr(v, "tolist"):
            v = v.tolist()
        if isinstance(v, list):
            return str([cell(x) for x in v])
        if isinstance(v, float):
            return repr(float(v) + 0.0)
        return str(v)

    rows = sorted(tuple(cell(v) for v in row) for row in pdf[cols].itertuples(index=False))
    return cols, rows


def kinds(pdf):
    return {c: pdf[c].dtype.kind for c in pdf.columns}


def check(spark, con, name, build, sql, sf_dir):
    t0 = time.time()
    got = build(spark, sf_dir).toPandas()
    took = time.time() - t0
    if sql is None:
        return f"ROWS {name} {len(got)} rows {took:.1f}s"
    want = con.execute(sql).df()
    gc, gr = canonical(got)
    wc, wr = canonical(want)
    if gc != wc:
        return f"FAIL {name} columns {gc} != {wc}"
    if gr != wr:
        bad = [(a, b) for a, b in zip(gr, wr) if a != b][:2]
        return f"FAIL {name} {len(gr)} vs {len(wr)} rows, e.g. {bad} kinds {kinds(got)} {kinds(want)}"
    return f"OK {name} {len(gr)} rows {took:.1f}s"


if __name__ == "__main__":
    import __spark_entry__ as entry
    from framelens.session import local_session

    sf_dir, only = sys.argv[1], sys.argv[2:]
    spark, con = local_session(), duck(sf_dir)
    queries, sqls = entry.queries(), entry.oracle_sql()
    for name, build in queries.items():
        if only and not any(o in name for o in only):
            continue
        try:
            print(check(spark, con, name, build, sqls.get(name), sf_dir), flush=True)
        except Exception as e:  # noqa: BLE001
            print("ERROR", name, str(e)[:600], flush=True)
