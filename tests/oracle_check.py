"""Compare registered queries with their SQL: rows, column names and values."""

from __future__ import annotations

import math
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def _plain(value):
    if isinstance(value, float) and math.isnan(value):
        return None
    return value


def _rows(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(
        (tuple(_plain(r[i]) for i in order) for r in rows), key=lambda t: [(v is None, str(v)) for v in t]
    )


def compare(spark, con, folder: str, query, sql: str) -> dict:
    t0 = time.time()
    df = query(spark, folder)
    ours = df.collect()
    t1 = time.time()
    cursor = con.execute(sql)
    names = [c[0] for c in cursor.description]
    theirs = cursor.fetchall()
    t2 = time.time()
    a, b = _rows(df.columns, ours), _rows(names, theirs)
    diff = [(x, y) for x, y in zip(a, b, strict=False) if x != y]
    return {
        "ok": sorted(df.columns) == sorted(names) and len(a) == len(b) and not diff,
        "columns": (sorted(df.columns), sorted(names)),
        "rows": (len(a), len(b)),
        "diff": diff[:2],
        "n_diff": len(diff),
        "spark_s": round(t1 - t0, 2),
        "sql_s": round(t2 - t1, 2),
    }


if __name__ == "__main__":
    import os
    import sys

    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__ as entry

    from tessera.session import local_session

    folder = sys.argv[1] if "/" in sys.argv[1] else f"/root/testdata/sf{sys.argv[1]}"
    if os.environ.get("PLAIN_SESSION"):  # defaults, another zone
        from pyspark.sql import SparkSession

        spark = (
            SparkSession.builder.master("local[8]").config("spark.ui.enabled", "false")
            .config("spark.ui.showConsoleProgress", "false")
            .config("spark.sql.session.timeZone", "America/Los_Angeles").getOrCreate()
        )
    else:
        spark = local_session(8)
    con = connect(folder)
    oracles = entry.oracle_sql()
    for name, query in entry.queries().items():
        if sys.argv[2:] and name not in sys.argv[2:]:
            continue
        if name not in oracles:
            print("no sql", name, query(spark, folder).collect()[:3], flush=True)
            continue
        try:
            r = compare(spark, con, folder, query, oracles[name])
            print("OK  " if r["ok"] else "DIFF", name, r["rows"], r["spark_s"], r["sql_s"], flush=True)
            if not r["ok"]:
                print("   ", r["columns"], r["n_diff"], str(r["diff"])[:600], flush=True)
        except Exception as e:  # noqa: BLE001
            print("FAIL", name, str(e)[:1000], flush=True)
