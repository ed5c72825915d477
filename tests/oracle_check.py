"""Compare registered queries with their SQL oracles, the way the gate does: same columns, same rows."""

from __future__ import annotations

import datetime
import decimal
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb

from talkloom.plans.registry import registered
from talkloom.session import build_session

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def norm(v):
    if isinstance(v, bool) or v is None:
        return repr(v)
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return f"{v:.9g}"
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(norm(x) for x in v) + "]"
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return f"{type(v).__name__}:{v}"


def compare(spark, con, sf_dir: str, name: str) -> str:
    fn, sql = registered()[name]
    t0 = time.time()
    df = fn(spark, sf_dir)
    cols = sorted(df.columns)
    rows = sorted([tuple(norm(r[c]) for c in cols) for r in df.collect()])
    t1 = time.time()
    if not sql:
        return f"ROWS-ONLY {len(rows)} rows {t1 - t0:.1f}s" if rows else "ROWS-ONLY EMPTY"
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    want = cur.fetchall()
    t2 = time.time()
    if sorted(names) != cols:
        return f"FAIL columns spark={cols} oracle={sorted(names)}"
    order = [names.index(c) for c in cols]
    expected = sorted([tuple(norm(r[i]) for i in order) for r in want])
    if rows != expected:
        extra = [r for r in rows if r not in set(expected)][:3]
        missing = [r for r in expected if r not in set(rows)][:3]
        return f"FAIL rows spark={len(rows)} oracle={len(expected)} cols={cols}\n   only spark: {str(extra)[:1500]}\n   only oracle: {str(missing)[:1500]}"
    return f"{'ok' if rows else 'EMPTY-MATCH'} {len(rows)} rows spark={t1 - t0:.1f}s duckdb={t2 - t1:.1f}s"


def main() -> None:
    sf_dir = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    spark = build_session(master="local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "12g", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    names = sys.argv[1:] or list(registered())
    bad = 0
    for name in names:
        try:
            result = compare(spark, con, sf_dir, name)
        except Exception as error:  # noqa: BLE001
            result = f"ERROR {type(error).__name__}: {str(error)[:1800]}"
        bad += result.startswith(("FAIL", "ERROR"))
        print(f"{name}: {result}", flush=True)
    print(f"{len(names) - bad}/{len(names)} good")


if __name__ == "__main__":
    main()
