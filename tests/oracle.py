"""DuckDB beside Spark: the same rows, column by column, in any order."""

from __future__ import annotations

import duckdb

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations clicks sales sale_lines clients client_changes vendors items stamps".split()


def connect(sf: str = SF) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con


def plain(v):
    if isinstance(v, float):
        return repr(v)
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(plain, v)) + "]"
    return str(v)


def same(df, sql: str, con: duckdb.DuckDBPyConnection) -> None:
    found = con.execute(sql)
    names = sorted(c[0] for c in found.description)
    assert names == sorted(df.columns)
    at = [[c[0] for c in found.description].index(n) for n in names]
    want = sorted(tuple(plain(row[i]) for i in at) for row in found.fetchall())
    got = sorted(tuple(plain(row[n]) for n in names) for row in df.collect())
    assert got == want
