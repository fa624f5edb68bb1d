"""Run queries against their SQL: python tests/check.py [sf] [name ...].

WINDOW_LIMIT=0 forces every scan onto tiles.
"""

from __future__ import annotations

import math
import os
import sys
import time
import traceback
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import duckdb  # noqa: E402

import __spark_entry__ as entry  # noqa: E402
from polyview.plans.scan import LIMIT_SETTING  # noqa: E402
from polyview.session import build  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def oracle(sf_dir):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def cell(v):
    if v is None:
        return ""
    if isinstance(v, bool):
        return f"b{v}"
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return repr(v + 0.0)
    return str(v)


def normal(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(cell(r[i]) for i in order) for r in rows)


def compare(spark, con, name, sf_dir):
    """Empty string when rows, columns and types agree; else the first difference."""
    df = entry.queries()[name](spark, sf_dir)
    got = [tuple(r) for r in df.collect()]
    sql = entry.oracle_sql().get(name)
    if sql is None:
        return f"(rows only: {len(got)})" if got else "EMPTY"
    cur = con.execute(sql)
    cols = [d[0] for d in cur.description]
    types = {d[0]: str(d[1]) for d in cur.description}
    want = cur.fetchall()
    if sorted(cols) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(cols)}"
    spark_types = dict(df.dtypes)
    names = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}
    odd = {c: (spark_types[c], types[c]) for c in cols if names.get(spark_types[c]) != types[c]}
    if odd:
        return f"types differ {odd}"
    a, b = normal(df.columns, got), normal(cols, want)
    if a != b:
        only_a = sorted(set(a) - set(b))[:2]
        only_b = sorted(set(b) - set(a))[:2]
        return f"rows {len(a)} vs {len(b)}; spark {only_a} sql {only_b} cols {sorted(cols)}"
    return "" if a else "EMPTY"


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "0.001"
    wanted = sys.argv[2:] or list(entry.queries())
    sf_dir = f"/root/testdata/sf{sf}"
    spark, con = build(), oracle(sf_dir)
    if os.environ.get("WINDOW_LIMIT"):
        spark.conf.set(LIMIT_SETTING, os.environ["WINDOW_LIMIT"])
    bad = 0
    for name in wanted:
        start = time.time()
        try:
            out = compare(spark, con, name, sf_dir)
        except Exception as exc:  # noqa: BLE001
            lines = [line for line in str(exc).splitlines() if line.strip()]
            out = f"ERROR {type(exc).__name__}: " + " | ".join(lines[:4])[:700]
            if "-v" in sys.argv:
                traceback.print_exc()
        ok = out == "" or out.startswith("(rows only")
        bad += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {name} {time.time() - start:.1f}s {out}", flush=True)
    print(f"{len(wanted) - bad}/{len(wanted)} agree")


if __name__ == "__main__":
    main()
