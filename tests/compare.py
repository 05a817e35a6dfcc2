"""Run registered queries beside their DuckDB twins and compare the multisets of rows.

    python tests/compare.py SF_DIR [name ...]
"""

from __future__ import annotations

import math
import sys
import time
from collections import Counter
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

TABLES = (
    "region nation customer supplier part orders lineitem events "
    "documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def cell(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.12g}") + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(cell(x) for x in v)
    return v


def multiset(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple(cell(r[i]) for i in order) for r in rows)


def compare(spark, con, sf_dir, name, fn, sql):
    df = fn(spark, sf_dir)
    got = df.collect()
    if sql is None:
        return len(got), None
    res = con.execute(sql)
    names = [d[0] for d in res.description]
    want = res.fetchall()
    if sorted(df.columns) != sorted(names):
        return len(got), f"columns differ: {sorted(set(df.columns) ^ set(names))}"
    types = {n: t for n, t in df.dtypes}
    kinds = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}
    odd = {d[0]: (types[d[0]], str(d[1])) for d in res.description if kinds.get(types[d[0]]) != str(d[1])}
    a, b = multiset(got, df.columns), multiset(want, names)
    if a != b:
        x, y = list((a - b).items())[:2], list((b - a).items())[:2]
        return len(got), f"rows differ ({sum(a.values())} / {sum(b.values())}; {sum((a - b).values())} off)\n   spark {x}\n   duck  {y}"
    return len(got), f"types {odd}" if odd else ""


if __name__ == "__main__":
    import __spark_entry__ as entry

    from skysieve.session import build_session

    sf_dir, only = sys.argv[1], sys.argv[2:]
    spark = build_session(
        master="local[8]", spark__sql__shuffle__partitions=8, spark__driver__memory="8g",
        spark__ui__showConsoleProgress="false",
    )
    spark.sparkContext.setLogLevel("OFF")
    con = connect(sf_dir)
    twins = entry.oracle_sql()
    bad = 0
    for name, fn in entry.queries().items():
        if only and not any(name.startswith(o) for o in only):
            continue
        t = time.time()
        try:
            n, problem = compare(spark, con, sf_dir, name, fn, twins.get(name))
        except Exception as e:  # report and go on
            n, problem = -1, f"{type(e).__name__}: {str(e)[:600]}"
        state = "rows" if problem is None else "ok" if not problem else "BAD"
        if problem and problem.startswith("types"):
            state = "ok/types"
        bad += state == "BAD"
        print(f"{state:8} {name} {n} {time.time() - t:.2f}s {problem or ''}", flush=True)
    print("bad:", bad)
