"""Compare every registered query with its SQL on one folder of tables.

    python tests/compare.py /root/testdata/sf0.01 [query ...]
"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def connect(folder: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def _cell(value):
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value + 0.0)
    return str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_cell(r[i]) for i in order) for r in rows)


def difference(con, sql: str, df) -> str | None:
    """None if both sides agree in columns, row count and values."""
    cursor = con.execute(sql)
    names = [c[0] for c in cursor.description]
    expected = cursor.fetchall()
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(names)}"
    left, right = rows_of(df.columns, df.collect()), rows_of(names, expected)
    if len(left) != len(right):
        return f"{len(left)} rows != {len(right)}"
    for a, b in zip(left, right):
        if a != b:
            return f"{str(a)[:300]} != {str(b)[:300]}"
    return None


def main() -> None:
    import __spark_entry__ as entry
    from sitesieve.session import build_session

    spark = build_session(
        spark__master="local[8]", spark__sql__shuffle__partitions="8", spark__driver__memory="12g",
        spark__ui__enabled="false", spark__ui__showConsoleProgress="false",
    )
    spark.sparkContext.setLogLevel("ERROR")
    folder, wanted = sys.argv[1], sys.argv[2:]
    con = connect(folder)
    for name, query in entry.queries().items():
        if wanted and name not in wanted:
            continue
        start = time.time()
        try:
            df = query(spark, folder)
            sql = entry.oracle_sql().get(name)
            if sql is None:
                outcome = f"rows only: {df.count()}"
            else:
                outcome = difference(con, sql, df) or "equal"
        except Exception as error:  # noqa: BLE001 - report and go on
            outcome = f"ERROR {type(error).__name__}: {str(error)[:600]}"
        print(f"{name:26s} {time.time() - start:6.1f}s  {outcome}", flush=True)


if __name__ == "__main__":
    main()
