"""Compare every query with its SQL in DuckDB: python tests/compare.py SF_DIR [keys...]"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _norm(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value + 0.0)
    if isinstance(value, bool) or value is None:
        return str(value)
    return str(value)


def normalise(columns: list[str], rows) -> tuple[list[str], list[tuple]]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(_norm(row[i]) for i in order) for row in rows)


def difference(spark_df, con, sql: str) -> str | None:
    """None when both hold the same rows."""
    res = con.execute(sql)
    want = normalise([d[0] for d in res.description], res.fetchall())
    got = normalise(spark_df.columns, [tuple(x) for x in spark_df.collect()])
    if got[0] != want[0]:
        return f"columns {got[0]} vs {want[0]}"
    if len(got[1]) != len(want[1]):
        return f"rows {len(got[1])} vs {len(want[1])}"
    bad = [(g, w) for g, w in zip(got[1], want[1]) if g != w]
    return f"{len(bad)} rows differ, first {bad[0]}" if bad else None


def main(sf_dir: str, keys: list[str]) -> None:
    import __spark_entry__ as e
    from tastegrid.session import get_session
    spark, con = get_session(cores=8), connect(sf_dir)
    failed = []
    for key, fn in e.queries().items():
        if keys and key not in keys:
            continue
        start = time.time()
        try:
            df, sql = fn(spark, sf_dir), e.oracle_sql().get(key)
            out = difference(df, con, sql) if sql else None
            note = "ok" if sql else f"rows only: {df.count()}"
        except Exception as err:  # report and go on with the next query
            out, note = f"{type(err).__name__}: {str(err)[:400]}", ""
        if out:
            failed.append(key)
        print(f"{key:28s} {time.time() - start:6.1f}s {out or note}", flush=True)
    print("failed:", failed)


if __name__ == "__main__":
    main(sys.argv[1], sys.argv[2:])
