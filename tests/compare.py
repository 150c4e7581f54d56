"""Compare a registered query with its SQL: python tests/compare.py [sf] [name ...]."""

from __future__ import annotations

import datetime
import decimal
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def oracle_connection(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con


def plain(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return int(v) if v == int(v) and abs(v) < 1e15 else v
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, plain(x)) for k, x in v.items()))
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def difference(spark, sf: str, query, sql: str, con=None) -> str | None:
    """None when the query equals its SQL, else what differs."""
    df = query(spark, sf)
    mine_cols, mine = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cur = (con or oracle_connection(sf)).execute(sql)
    want_cols, want = rows_of([d[0] for d in cur.description], cur.fetchall())
    if mine_cols != want_cols:
        return f"columns {mine_cols} != {want_cols}"
    if len(mine) != len(want):
        return f"{len(mine)} rows != {len(want)}; only mine {sorted(set(mine) - set(want), key=repr)[:3]}; only sql {sorted(set(want) - set(mine), key=repr)[:3]}"
    bad = [(a, b) for a, b in zip(mine, want) if a != b]
    if bad:
        return f"{len(bad)} of {len(mine)} rows differ, first {bad[0]}"
    return None


def main() -> int:
    import __spark_entry__ as entry
    from skysift.session import build_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    names = sys.argv[2:] or list(entry.queries())
    folder = f"/root/testdata/sf{sf}"
    spark = build_session("compare", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
                                                    "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    con = oracle_connection(folder)
    failed = 0
    for name in names:
        started = time.time()
        try:
            sql = entry.oracle_sql().get(name)
            if sql is None:
                text = f"rows only: {entry.queries()[name](spark, folder).count()}"
            else:
                text = difference(spark, folder, entry.queries()[name], sql, con)
        except Exception as e:  # report and go on
            text = f"{type(e).__name__}: {str(e)[:700]}"
        failed += bool(text) and not text.startswith("rows only")
        print(f"{name:32s} {time.time() - started:6.2f}s {text or 'ok'}", flush=True)
    print(f"{len(names) - failed} of {len(names)} ok")
    return failed


if __name__ == "__main__":
    sys.exit(main())
