"""Run registered queries and their SQL side by side: python tests/compare.py [folder] [query ...]"""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

from hindcast.plans.testdata import ALL_TABLES  # noqa: E402


def open_duckdb(folder: str):
    con = duckdb.connect()
    for name in ALL_TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value + 0.0)
    if isinstance(value, bool) or value is None:
        return str(value)
    return str(value)


def normal(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(plain(r[i]) for i in order) for r in rows)


def compare(spark, con, name, build, sql, folder):
    """None if both sides agree, else what differs."""
    started = time.time()
    df = build(spark, folder)
    rows = df.collect()
    seconds = time.time() - started
    if sql is None:
        return None if rows else "no rows", seconds, len(rows)
    cursor = con.execute(sql)
    expected_columns, expected = normal([d[0] for d in cursor.description], cursor.fetchall())
    columns, found = normal(df.columns, rows)
    if columns != expected_columns:
        return f"columns {columns} != {expected_columns}", seconds, len(rows)
    if found != expected:
        left, right = set(found), set(expected)
        return (
            f"{len(found)} rows != {len(expected)}; only Spark {sorted(left - right)[:2]}; only SQL {sorted(right - left)[:2]}",
            seconds,
            len(rows),
        )
    return None, seconds, len(rows)


if __name__ == "__main__":
    from __spark_entry__ import oracle_sql as oracle
    from __spark_entry__ import queries
    from hindcast.session import session

    QUERIES = queries()

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2:] or list(QUERIES)
    extra = dict(kv.split("=", 1) for kv in os.environ.get("COMPARE_CONF", "").split() if kv)
    spark = session("local[8]", 8, **{"spark.driver.memory": "8g", "spark.ui.showConsoleProgress": "false", **extra})
    spark.sparkContext.setLogLevel("ERROR")
    con, statements = open_duckdb(folder), oracle()
    failed = 0
    for name in wanted:
        try:
            problem, seconds, n = compare(spark, con, name, QUERIES[name], statements.get(name), folder)
        except Exception as error:  # report and go on with the next query
            problem, seconds, n = f"{type(error).__name__}: {str(error)[:1500]}", 0.0, 0
        failed += problem is not None
        kind = "sql" if name in statements else "rows"
        print(f"{'ok  ' if problem is None else 'FAIL'} {name} [{kind}] {n} rows {seconds:.2f}s {problem or ''}"[:2500], flush=True)
    print("failed:", failed)
    sys.exit(1 if failed else 0)
