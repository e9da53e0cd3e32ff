"""Compare an analysis with its SQL, the way the acceptance check does."""

from __future__ import annotations

import glob
import os

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in glob.glob(os.path.join(sf_dir, "*.parquet")):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def _canonical(value):
    if isinstance(value, bool) or value is None:
        return repr(value)
    if isinstance(value, float):
        return f"{value:.6g}"
    return str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_canonical(row[i]) for i in order) for row in rows)


def differences(df, sql: str, con) -> list[str]:
    got = rows_of(df.columns, df.collect())
    result = con.execute(sql)
    columns = [d[0] for d in result.description]
    want = rows_of(columns, result.fetchall())
    problems = []
    if sorted(df.columns) != sorted(columns):
        problems.append(f"columns {sorted(df.columns)} != {sorted(columns)}")
    if len(got) != len(want):
        problems.append(f"rows {len(got)} != {len(want)}")
    if got != want and not problems:
        for g, w in zip(got, want):
            if g != w:
                problems.append(f"got {g} want {w}")
                break
    elif problems:
        gs, ws = set(got), set(want)
        problems.append(f"only spark: {sorted(gs - ws)[:3]} only sql: {sorted(ws - gs)[:3]}")
    kinds = {c: t for c, t in df.dtypes}
    sql_types = {d[0]: str(d[1]) for d in result.description}
    for c in kinds:
        if sql_types.get(c) == "HUGEINT" or (sql_types.get(c) == "INTEGER") != (kinds[c] == "int"):
            problems.append(f"type of {c}: {kinds[c]} / {sql_types.get(c)}")
    return problems
