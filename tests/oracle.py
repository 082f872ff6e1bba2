"""Compare registered queries with their DuckDB twins: same columns, same rows in any order."""

from __future__ import annotations

import datetime
import decimal
import sys
import time
from collections import Counter
from pathlib import Path

import duckdb

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def plain(value):
    if isinstance(value, float):
        return round(value, 6)
    if isinstance(value, decimal.Decimal):
        return float(value)
    if isinstance(value, (bytes, bytearray)):
        return bytes(value).hex()
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return value


def duckdb_connection(sf_dir: str):
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return connection


def compare(spark, connection, name, make, sql, sf_dir) -> str | None:
    """None when equal, else a description of the difference."""
    got = make(spark, sf_dir)
    columns = sorted(got.columns)
    rows = Counter(tuple(plain(r[c]) for c in columns) for r in got.collect())
    cursor = connection.execute(sql)
    names = [d[0] for d in cursor.description]
    if sorted(names) != columns:
        return f"columns {columns} != {sorted(names)}"
    order = [names.index(c) for c in columns]
    expected = Counter(tuple(plain(r[i]) for i in order) for r in cursor.fetchall())
    if rows == expected:
        return None if rows else "no rows on either side"
    only_spark, only_duck = rows - expected, expected - rows
    return (
        f"{sum(rows.values())} rows against {sum(expected.values())}; {columns}\n"
        f"    only spark {sum(only_spark.values())}: {list(only_spark)[:3]}\n"
        f"    only duckdb {sum(only_duck.values())}: {list(only_duck)[:3]}"
    )


def main(patterns: list[str], scale: str) -> int:
    import __spark_entry__ as entry
    from threatloom.session import local_session

    sf_dir = f"/root/testdata/{scale}"
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    connection = duckdb_connection(sf_dir)
    queries, oracle = entry.queries(), entry.oracle_sql()
    failed = 0
    for name, make in queries.items():
        if patterns and not any(name.startswith(p) for p in patterns):
            continue
        started = time.time()
        try:
            if name in oracle:
                problem = compare(spark, connection, name, make, oracle[name], sf_dir)
            else:
                problem = None if make(spark, sf_dir).count() else "no rows"
        except Exception as error:  # report and go on
            problem = f"{type(error).__name__}: {str(error)[:1500]}"
        failed += problem is not None
        label = "ok  " if problem is None else "FAIL"
        checked = "" if name in oracle else " (rows only)"
        print(f"{label} {name}{checked} {time.time() - started:.1f}s {problem or ''}", flush=True)
    print("failed", failed)
    return failed


if __name__ == "__main__":
    scale = "sf0.001"
    arguments = sys.argv[1:]
    if arguments and arguments[0].startswith("sf"):
        scale = arguments.pop(0)
    sys.exit(1 if main(arguments, scale) else 0)
