"""Run a report in Spark and its SQL in DuckDB and compare the rows."""

from __future__ import annotations

import glob
import os
from collections import Counter
from decimal import Decimal

import duckdb

KINDS = {
    "bigint": "BIGINT",
    "int": "INTEGER",
    "double": "DOUBLE",
    "string": "VARCHAR",
    "date": "DATE",
    "boolean": "BOOLEAN",
}


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET threads = 4")
    for path in glob.glob(f"{folder}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def _plain(value):
    if isinstance(value, Decimal):
        return float(value)
    return value


def differences(df, con: duckdb.DuckDBPyConnection, sql: str, some: bool = False) -> list[str]:
    """What is not equal: columns, types, number of rows, values; ``some`` asks for rows."""
    problems = []
    con.execute(sql)
    theirs = {d[0]: i for i, d in enumerate(con.description)}
    rows = con.fetchall()
    kinds = dict(zip(theirs, [str(r[1]) for r in con.execute(f"DESCRIBE {sql}").fetchall()]))
    ours = {f.name: f.dataType.simpleString() for f in df.schema}
    if set(ours) != set(theirs):
        return [f"columns {sorted(ours)} and {sorted(theirs)}"]
    names = sorted(ours)
    for name in names:
        if KINDS.get(ours[name]) != kinds[name]:
            problems.append(f"type of {name}: {ours[name]} and {kinds[name]}")
    mine = Counter(tuple(_plain(r[n]) for n in names) for r in df.collect())
    other = Counter(tuple(_plain(r[theirs[n]]) for n in names) for r in rows)
    if sum(mine.values()) != sum(other.values()):
        problems.append(f"rows {sum(mine.values())} and {sum(other.values())}")
    if some and not mine:
        problems.append("no rows")
    if mine != other:
        left, right = list((mine - other).items()), list((other - mine).items())
        problems.append(f"{len(left)} rows differ; ours {left[:2]}, theirs {right[:2]}")
    return problems
