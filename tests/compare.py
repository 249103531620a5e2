"""Compare queries with their SQL on DuckDB. Run as a script: ``compare.py FOLDER [NAME ...]``."""

from __future__ import annotations

import math
import os
import sys
import time
from collections import Counter

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()

TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


def database(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(round(value, 9) + 0.0)
    if isinstance(value, bool) or value is None:
        return value
    return str(value)


def difference(con, frame, statement: str) -> str | None:
    """What differs between a DataFrame and a statement; None when nothing does."""
    result = con.execute(statement)
    names = [column[0] for column in result.description]
    expected_rows = result.fetchall()
    if sorted(names) != sorted(frame.columns):
        return f"columns {sorted(frame.columns)} != {sorted(names)}"
    order = sorted(names)
    kinds = dict(frame.dtypes)
    at = [names.index(name) for name in order]
    expected = Counter(tuple(_plain(row[i]) for i in at) for row in expected_rows)
    rows = frame.select(*[f"`{name}`" for name in order]).collect()
    actual = Counter(tuple(_plain(value) for value in row) for row in rows)
    types = {row[0]: row[1] for row in con.execute(f"DESCRIBE {statement}").fetchall()}
    for name in order:
        if TYPES.get(kinds[name]) != types[name]:
            return f"type of {name}: {kinds[name]} != {types[name]}"
    if expected != actual:
        missing, extra = list((expected - actual).items())[:3], list((actual - expected).items())[:3]
        return f"{len(rows)} rows, SQL {len(expected_rows)}\n  only SQL   {missing}\n  only Spark {extra}"
    return None


def main() -> None:
    here = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    sys.path.insert(0, here)
    import __spark_entry__ as entry

    from wardline.session import build_session

    folder, names = sys.argv[1], sys.argv[2:]
    spark = build_session(master="local[8]", **{
        "spark.ui.enabled": "false", "spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    con, oracle, bad = database(folder), entry.oracle_sql(), 0
    for name, run in entry.queries().items():
        if names and name not in names:
            continue
        started = time.time()
        try:
            frame = run(spark, folder)
            if name in oracle:
                problem = difference(con, frame, oracle[name])
                note = "ok" if problem is None else problem
            else:
                problem, note = None, f"rows only: {frame.count()}"
        except Exception as error:
            problem = note = f"{type(error).__name__}: {str(error)[:1500]}"
        bad += problem is not None
        print(f"{'' if problem is None else 'FAIL '}{name:28s} {time.time() - started:6.2f}s {note}", flush=True)
    print(f"{bad} failing")


if __name__ == "__main__":
    main()
