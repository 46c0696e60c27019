"""Order-insensitive comparison of a Spark result with DuckDB SQL over the same tables."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb
import pandas as pd

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def database(folder: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for table in TABLES:
        connection.sql(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{folder}/{table}.parquet')")
    return connection


def canonical(frame: pd.DataFrame) -> list[tuple]:
    def cell(v):
        if v is None or v is pd.NaT or (isinstance(v, float) and math.isnan(v)):
            return "NULL"
        if isinstance(v, pd.Timestamp):
            return v.isoformat()
        return repr(v.item() if hasattr(v, "item") else v)

    frame = frame[sorted(frame.columns)]
    return sorted(tuple(cell(v) for v in row) for row in frame.astype(object).itertuples(index=False))


def difference(actual: pd.DataFrame, expected: pd.DataFrame) -> str | None:
    if sorted(actual.columns) != sorted(expected.columns):
        return f"columns {sorted(actual.columns)} vs {sorted(expected.columns)}"
    if len(actual) != len(expected):
        return f"rows {len(actual)} vs {len(expected)}"
    a, e = canonical(actual), canonical(expected)
    wrong = [(x, y) for x, y in zip(a, e) if x != y]
    return f"{len(wrong)} rows differ, first {wrong[0]}" if wrong else None


def main(folder: str, *names: str) -> None:
    from __spark_entry__ import oracle_sql, queries

    from stormframe.session import local_session

    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    connection = database(folder)
    sql = oracle_sql()
    for name, query in queries().items():
        if names and name not in names:
            continue
        start = time.time()
        try:
            actual = query(spark, folder).toPandas()
            took = time.time() - start
            if name in sql:
                verdict = difference(actual, connection.sql(sql[name]).df()) or "ok"
            else:
                verdict = "no SQL"
        except Exception as error:  # report every query
            took, verdict, actual = time.time() - start, f"ERROR {str(error)[:600]}", []
        print(f"{name:32s} {took:6.2f}s {len(actual):8d} rows  {verdict}", flush=True)


if __name__ == "__main__":
    main(*sys.argv[1:])
