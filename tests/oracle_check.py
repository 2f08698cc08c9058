"""Run queries against their SQL oracle: python tests/oracle_check.py [sf] [name ...]"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

import __spark_entry__ as entry  # noqa: E402
from ledgerlake.plans.views import TABLES  # noqa: E402


def norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(repr(v))
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    return v


def oracle_rows(sf_dir: str, sql: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    return names, cur.fetchall()


def compare(spark, sf_dir: str, name: str) -> str | None:
    """None when equal, else what differs."""
    df = entry.queries()[name](spark, sf_dir)
    got = [tuple(norm(v) for v in r) for r in df.collect()]
    if name not in entry.oracle_sql():
        return None if got else "no rows"
    names, rows = oracle_rows(sf_dir, entry.oracle_sql()[name])
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} against {sorted(names)}"
    order_s = [df.columns.index(c) for c in sorted(df.columns)]
    order_d = [names.index(c) for c in sorted(names)]
    a = sorted((tuple(r[i] for i in order_s) for r in got), key=repr)
    b = sorted((tuple(norm(r[i]) for i in order_d) for r in rows), key=repr)
    if len(a) != len(b):
        return f"{len(a)} rows against {len(b)}"
    if not a:
        return "no rows on either side"
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    if bad:
        return f"{len(bad)} of {len(a)} rows differ, columns {sorted(names)}, first: {str(bad[0][0])[:400]} against {str(bad[0][1])[:400]}"
    types = {type(x).__name__ for r in a for x in r} ^ {type(x).__name__ for r in b for x in r}
    return f"types differ: {types}" if types else None


if __name__ == "__main__":
    from ledgerlake.session import build_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    spark = build_session("oracle", "local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "12g"})
    spark.sparkContext.setLogLevel("ERROR")
    bad = 0
    for q in sys.argv[2:] or list(entry.queries()):
        t = time.time()
        try:
            diff = compare(spark, f"/root/testdata/sf{sf}", q)
        except Exception as e:  # noqa: BLE001
            diff = f"{type(e).__name__}: {str(e)[:600]}"
        bad += diff is not None
        print(f"{'ok  ' if diff is None else 'FAIL'} {q} {time.time() - t:.1f}s {diff or ''}", flush=True)
    print("bad:", bad, "of", len(entry.queries()))
