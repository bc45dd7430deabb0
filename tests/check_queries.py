"""Compare named queries with their SQL on one data folder.

    python tests/check_queries.py [folder] [query ...]
"""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from __spark_entry__ import oracle_sql, queries  # noqa: E402
from tallypost.session import session  # noqa: E402


def expected(sql: str, folder: str):
    con = duckdb.connect()
    for file in Path(folder).glob("*.parquet"):
        con.execute(f"create view {file.stem} as select * from '{file}'")
    cursor = con.execute(sql)
    names = [c[0] for c in cursor.description]
    return names, cursor.fetchall()


def rows_by_name(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(repr(tuple(r[i] for i in order)) for r in rows)


def compare(spark, name: str, folder: str) -> str | None:
    """None when equal, else what differs."""
    df = queries()[name](spark, folder)
    got = [tuple(r) for r in df.collect()]
    names, want = expected(oracle_sql()[name], folder)
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} != {sorted(names)}"
    a, b = rows_by_name(df.columns, got), rows_by_name(names, want)
    if a == b:
        return None
    left, right = sorted(set(a) - set(b))[:3], sorted(set(b) - set(a))[:3]
    return f"rows {len(a)} != {len(b)}; only spark {left}; only sql {right}"


if __name__ == "__main__":
    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001"
    spark = session(
        "local[8]", spark__ui__enabled="false", spark__sql__shuffle__partitions="8", spark__driver__memory="8g",
        spark__ui__showConsoleProgress="false",
    )
    spark.sparkContext.setLogLevel("ERROR")
    failed = 0
    for name in sys.argv[2:] or queries():
        start = time.time()
        try:
            problem = compare(spark, name, folder)
        except Exception as e:  # keep going, report at the end
            problem = f"{type(e).__name__}: {str(e)[:700]}"
        failed += problem is not None
        print(f"{'ok  ' if problem is None else 'FAIL'} {name:26s} {time.time() - start:6.1f}s {problem or ''}", flush=True)
    sys.exit(failed)
