"""Run a query and its SQL counterpart and compare the rows."""

from __future__ import annotations

import math
import os

import duckdb
from pyspark.sql import DataFrame

TABLES = """region nation customer supplier part orders lineitem events documents embeddings
pages benchmark labels conversations""".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    db = duckdb.connect()
    for name in TABLES:
        path = os.path.join(sf_dir, f"{name}.parquet")
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return db


def _plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else float(f"{value:.12g}")
    return value


def _key(row):
    return tuple((v is None, str(type(v).__name__), str(v)) for v in row)


def rows_of(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_plain(row[i]) for i in order) for row in rows), key=_key)


def expected(db, sql: str) -> tuple[list[str], list[tuple], list[str]]:
    result = db.execute(sql)
    columns = [d[0] for d in result.description]
    types = [str(d[1]) for d in result.description]
    return columns, rows_of(columns, result.fetchall()), types


def differences(got: DataFrame, db, sql: str) -> list[str]:
    columns, want, types = expected(db, sql)
    problems = []
    if sorted(columns) != sorted(got.columns):
        return [f"columns {sorted(got.columns)} instead of {sorted(columns)}"]
    kinds = {"string": "VARCHAR", "bigint": "BIGINT", "double": "DOUBLE", "boolean": "BOOLEAN", "int": "INTEGER",
             "timestamp_ntz": "TIMESTAMP"}
    have_types = {c: kinds.get(t, t) for c, t in got.dtypes}
    for c, t in zip(columns, types):
        if have_types[c] != t:
            problems.append(f"column {c} is {have_types[c]} instead of {t}")
    have = rows_of(got.columns, got.collect())
    if len(have) != len(want):
        problems.append(f"{len(have)} rows instead of {len(want)}")
    if have != want:
        only_have = set(have) - set(want)
        only_want = set(want) - set(have)
        problems.append(f"rows differ: {len(only_have)} unexpected, {len(only_want)} missing")
        problems += [f"  got  {r}"[:600] for r in sorted(only_have, key=_key)[:3]]
        problems += [f"  want {r}"[:600] for r in sorted(only_want, key=_key)[:3]]
    return problems
