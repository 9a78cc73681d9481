"""Holds queries() against oracle_sql() run by DuckDB over the same tables: `python tests/oracle.py [SF_DIR] [NAME...]`."""

import math
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import duckdb  # noqa: E402


def views(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for p in sorted(Path(sf_dir).glob("*.parquet")):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}{'/*.parquet' if p.is_dir() else ''}')")
    return con


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    return v


def same(df, con, sql: str) -> tuple[bool, str]:
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    theirs = [dict(zip(names, r)) for r in cur.fetchall()]
    ours = [r.asDict() for r in df.collect()]
    if sorted(names) != sorted(df.columns):
        return False, f"columns {sorted(df.columns)} and {sorted(names)}"
    key = lambda r: repr([norm(r[c]) for c in sorted(names)])
    a, b = sorted(map(key, ours)), sorted(map(key, theirs))
    diff = next(((x, y) for x, y in zip(a, b) if x != y), None)
    return a == b, f"{len(a)} and {len(b)} rows" + (f"; first difference {diff}" if a != b else "")


if __name__ == "__main__":
    from pyspark.sql import SparkSession

    import __spark_entry__ as e

    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    s = SparkSession.builder.master(f"local[{os.environ.get('CPUS', '4')}]").config("spark.sql.shuffle.partitions", "8").config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.driver.memory", "6g").getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    q, o, con = e.queries(), e.oracle_sql(), views(sf)
    for name in sys.argv[2:] or q:
        t = time.time()
        try:
            ok, what = same(q[name](s, sf), con, o[name]) if name in o else (None, f"{q[name](s, sf).count()} rows, no SQL")
        except Exception as x:
            ok, what = False, repr(x)[:1500]
        print(name, {True: "ok", False: "DIFFERENT", None: "-"}[ok], what[:1500], f"{time.time() - t:.1f} s", flush=True)
