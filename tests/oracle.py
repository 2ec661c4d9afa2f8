"""Run queries against their SQL twins: ``python tests/oracle.py [name prefix …]``."""

from __future__ import annotations

import math
import os
import sys
import time
import traceback

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb

SF = os.environ.get("ORACLE_SF", "/root/testdata/sf0.01")
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf: str = SF):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    return v


def rows(cols, data):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(norm(r[i]) for i in order) for r in data]
    return sorted(cols), sorted(out, key=lambda r: tuple((x is None, str(type(x)), x if x is not None else 0) for x in r))


def compare(spark, con, name, fn, sql, sf: str = SF) -> str:
    t = time.time()
    df = fn(spark, sf)
    data = df.collect()
    took = f" spark {time.time() - t:.1f}s"
    got_cols, got = rows(df.columns, [tuple(r) for r in data])
    if sql is None:
        return f"rows only ({len(got)}){took}" if got else "EMPTY"
    cur = con.execute(sql)
    want_cols, want = rows([d[0] for d in cur.description], cur.fetchall())
    if got_cols != want_cols:
        return f"FAIL columns {got_cols} != {want_cols}"
    if not want:
        return "EMPTY"
    if len(got) != len(want):
        return f"FAIL rows {len(got)} != {len(want)}"
    bad = [(a, b) for a, b in zip(got, want) if a != b]
    types = {type(x).__name__ for r in got for x in r} ^ {type(x).__name__ for r in want for x in r}
    if bad:
        return f"FAIL values {len(bad)}/{len(want)}: {bad[:2]}"
    return f"ok ({len(got)}){took}" + (f" types differ {types}" if types else "")


if __name__ == "__main__":
    from __spark_entry__ import oracle_sql, queries
    from vidspark.session import build_session

    spark = build_session("local[8]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false",
                          spark__driver__memory="8g")
    spark.sparkContext.setLogLevel("ERROR")
    con, sqls = connect(), oracle_sql()
    for name, fn in queries().items():
        if sys.argv[1:] and not any(name.startswith(a) for a in sys.argv[1:]):
            continue
        t = time.time()
        try:
            res = compare(spark, con, name, fn, sqls.get(name))
        except Exception as e:
            res = "FAIL " + "".join(traceback.format_exception_only(e))[:700]
        print(f"{name}: {res} {time.time() - t:.1f}s", flush=True)
    spark.stop()
