"""Runs queries beside their SQL on one data directory: `python -m tests.oracle SF_DIR [NAME...]`."""

from __future__ import annotations

import math
import sys
import time
from collections import Counter
from pathlib import Path

import duckdb

import __spark_entry__ as entry


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for p in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}{'/*.parquet' if p.is_dir() else ''}')")
    return con


def plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 5) + 0.0
    if isinstance(x, (list, tuple)):
        return tuple(map(plain, x))
    if hasattr(x, "is_finite") or (isinstance(x, int) and not isinstance(x, bool)):
        return float(x)
    return x


def compare(spark, con, sf_dir: str, name: str) -> str:
    """Empty if both give the same rows, else what differs."""
    df = entry.queries()[name](spark, sf_dir)
    cols = sorted(df.columns)
    got = Counter(tuple(map(plain, r)) for r in df.select(*cols).collect())
    rel = con.sql(entry.oracle_sql()[name])
    if sorted(rel.columns) != cols:
        return f"columns {cols} and {sorted(rel.columns)}"
    at = [rel.columns.index(c) for c in cols]
    want = Counter(tuple(plain(r[i]) for i in at) for r in rel.fetchall())
    if got != want:
        return f"rows {sum(got.values())} and {sum(want.values())}; only here {list((got - want).items())[:3]}; only there {list((want - got).items())[:3]}"
    return "" if got else "no rows"


def main(sf_dir: str, names: list[str]) -> None:
    from okrug.session import get_spark

    spark, con = get_spark(cores=8), connect(sf_dir)
    for name in names or entry.queries():
        t = time.time()
        try:
            if name in entry.oracle_sql():
                said = compare(spark, con, sf_dir, name) or "ok"
            else:
                said = f"{entry.queries()[name](spark, sf_dir).count()} rows, no SQL"
        except Exception as e:
            said = f"{type(e).__name__}: {str(e)[:400]}"
        print(f"{name:28} {time.time() - t:6.1f} s  {said}", flush=True)


if __name__ == "__main__":
    main(sys.argv[1], sys.argv[2:])
