"""Run registered queries against their SQL and compare the rows."""

from __future__ import annotations

import datetime
import math
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def oracle_rows(sql: str, sf_dir: str) -> tuple[list[str], list[tuple]]:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    cursor = con.execute(sql)
    return [d[0] for d in cursor.description], cursor.fetchall()


def _norm(value):
    if isinstance(value, float) and math.isnan(value):
        return "NaN"
    if isinstance(value, float) and value == 0:
        return 0.0
    if isinstance(value, (datetime.datetime, datetime.date)):
        return value.isoformat()[:10]
    if isinstance(value, (list, tuple)):
        return tuple(_norm(v) for v in value)
    return value


def _ordered(columns: list[str], rows: list[tuple]) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    picked = [tuple(_norm(row[i]) for i in order) for row in rows]
    return sorted(picked, key=lambda row: tuple((v is None, str(type(v)) if not isinstance(v, (int, float)) else "", v if v is not None else 0) if not isinstance(v, float) else (False, "", float(f"{v:.6g}")) for v in row))


def difference(columns_a, rows_a, columns_b, rows_b, *, tolerance: float = 0.0) -> str | None:
    if sorted(columns_a) != sorted(columns_b):
        return f"columns differ: {sorted(columns_a)} / {sorted(columns_b)}"
    if len(rows_a) != len(rows_b):
        return f"row counts differ: {len(rows_a)} / {len(rows_b)}"
    for a, b in zip(_ordered(columns_a, rows_a), _ordered(columns_b, rows_b)):
        for x, y in zip(a, b):
            same = x == y
            if not same and tolerance and isinstance(x, (int, float)) and isinstance(y, (int, float)):
                same = math.isclose(x, y, rel_tol=tolerance, abs_tol=tolerance)
            if not same:
                return f"rows differ: {a} / {b}"
    return None


def check(spark, name: str, fn, sql: str | None, sf_dir: str, tolerance: float = 0.0) -> tuple[str | None, int, float]:
    start = time.time()
    df = fn(spark, sf_dir)
    rows = [tuple(r) for r in df.collect()]
    took = time.time() - start
    if sql is None:
        return None, len(rows), took
    columns, expected = oracle_rows(sql, sf_dir)
    return difference(df.columns, rows, columns, expected, tolerance=tolerance), len(rows), took


if __name__ == "__main__":
    import os

    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__ as entry
    from hearthpanel.session import build_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    only = sys.argv[2].split(",") if len(sys.argv) > 2 else None
    spark = build_session(master="local[8]", conf={"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    queries, oracles = entry.queries(), entry.oracle_sql()
    bad = 0
    for name, fn in queries.items():
        if only and not any(o in name for o in only):
            continue
        try:
            problem, n, took = check(spark, name, fn, oracles.get(name), sf)
        except Exception as error:  # noqa: BLE001
            problem, n, took = f"failed: {str(error)[:1500]}", 0, 0.0
        bad += problem is not None
        kind = "sql" if name in oracles else "rows"
        print(f"{'BAD ' if problem else 'ok  '} {name:32s} {kind:4s} rows={n:6d} {took:6.2f}s {problem or ''}", flush=True)
    print(f"{bad} bad of {len(queries)}")
