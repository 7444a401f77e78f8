"""Runs registered queries next to their SQL. Also a command line tool."""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(
            f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')"
        )
    return connection


def _cell(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value)
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(map(_cell, value)) + "]"
    return repr(value)


def _canonical(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_cell(row[i]) for i in order) for row in rows)


def differences(df, sql: str, connection) -> list[str]:
    """Empty when rows, column names and values agree."""
    result = connection.execute(sql)
    names = [d[0] for d in result.description]
    expected = _canonical(names, result.fetchall())
    if sorted(df.columns) != sorted(names):
        return [f"columns {sorted(df.columns)} != {sorted(names)}"]
    actual = _canonical(df.columns, [tuple(r) for r in df.collect()])
    if len(actual) != len(expected):
        return [f"{len(actual)} rows, expected {len(expected)}"]
    return [f"{a} != {b}" for a, b in zip(actual, expected) if a != b][:5]


def main(argv: list[str]) -> int:
    import __spark_entry__ as entry
    from sprintgauge.session import build_session

    sf_dir = f"/root/testdata/{os.environ.get('SF', 'sf0.01')}"
    spark = build_session("local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false",
        "spark.driver.memory": "16g"})
    spark.sparkContext.setLogLevel("ERROR")
    connection = connect(sf_dir)
    bad = 0
    oracles = entry.oracle_sql()
    for name, query in entry.queries().items():
        if argv and name not in argv:
            continue
        start = time.time()
        try:
            df = query(spark, sf_dir)
            if name in oracles:
                found = differences(df, oracles[name], connection)
                status = "ok" if not found else "DIFF " + " | ".join(x[:400] for x in found[:2])
                bad += bool(found)
            else:
                status = f"rows {df.count()}"
        except Exception as error:  # noqa: BLE001 - report and go on
            bad += 1
            status = f"ERROR {type(error).__name__} {str(error)[:600]}"
        print(f"{name:26s} {time.time() - start:6.1f}s {status}", flush=True)
    print("bad:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
