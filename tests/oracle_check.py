"""Compare queries with their SQL twins: ``python tests/oracle_check.py [names...]``."""

from __future__ import annotations

import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()
DATA = os.environ.get("CHECK_DIR", "/root/testdata/sf0.01")


def duck(folder: str = DATA):
    import duckdb

    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(
            f"create view {table} as select * from read_parquet('{folder}/{table}.parquet')"
        )
    return connection


def _cell(value):
    import datetime
    import decimal
    import math

    if value is None:
        return None
    if isinstance(value, bool):
        return value
    if isinstance(value, float):
        return None if math.isnan(value) else repr(value)
    if isinstance(value, int):
        return repr(value)
    if isinstance(value, decimal.Decimal):
        return str(value)
    if isinstance(value, datetime.datetime):
        return value.isoformat()
    if isinstance(value, (list, tuple)):
        return tuple(_cell(v) for v in value)
    return str(value)


def compare(df, connection, sql: str) -> list[str]:
    """Differences between a Spark result and an SQL result; empty when equal."""
    names = sorted(df.columns)
    left = [tuple(_cell(row[n]) for n in names) for row in df.collect()]
    result = connection.execute(sql)
    columns = [d[0] for d in result.description]
    kinds = {d[0]: str(d[1]) for d in result.description}
    if sorted(columns) != names:
        return [f"columns {names} != {sorted(columns)}"]
    order = [columns.index(n) for n in names]
    right = [tuple(_cell(row[i]) for i in order) for row in result.fetchall()]
    problems = []
    if len(left) != len(right):
        problems.append(f"rows {len(left)} != {len(right)}")
    spark_kinds = dict(df.dtypes)
    pairs = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
             "boolean": "BOOLEAN", "date": "DATE"}
    for n in names:
        want = pairs.get(spark_kinds[n])
        if want and kinds[n] != want:
            problems.append(f"type of {n}: {spark_kinds[n]} vs {kinds[n]}")
    key = lambda row: tuple((c is not None, str(c)) for c in row)
    left.sort(key=key)
    right.sort(key=key)
    if left != right:
        different = [(a, b) for a, b in zip(left, right, strict=False) if a != b]
        problems.append(f"{len(different)} rows differ, first {names}: {different[:2]}")
    return problems


def main() -> None:
    from saleslode.catalogue import all_oracles, all_queries
    from saleslode.session import local_session

    spark = local_session("check")
    spark.sparkContext.setLogLevel("ERROR")
    queries, oracles = all_queries(), all_oracles()
    names = [n for n in queries if not sys.argv[1:] or any(a in n for a in sys.argv[1:])]
    connection = duck()
    bad = 0
    for name in names:
        start = time.time()
        try:
            df = queries[name](spark, DATA)
            if name in oracles:
                problems = compare(df, connection, oracles[name])
            else:
                problems = [] if df.count() >= 0 else ["no rows"]
        except Exception as error:  # noqa: BLE001
            problems = [f"{type(error).__name__}: {str(error)[:1500]}"]
        status = "ok  " if not problems else "FAIL"
        note = "" if name in oracles else " (rows only)"
        bad += bool(problems)
        print(f"{status} {name}{note} {time.time() - start:.2f}s", *problems, sep="\n     "
              if problems else "", flush=True)
    unknown = set(oracles) - set(queries)
    print(f"{len(names)} queries, {bad} bad, oracles without query: {sorted(unknown)}")


if __name__ == "__main__":
    main()
