"""Comparison of a Spark result with DuckDB SQL on the same Parquet tables, rows in any order."""

from __future__ import annotations

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{sf_dir}/{t}.parquet"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def plain(v):
    if v is None or v != v:
        return None
    if isinstance(v, (list, tuple)) or type(v).__name__ == "ndarray":
        return tuple(plain(x) for x in v)
    if isinstance(v, float):
        return round(v, 6)
    return v


def rows(columns, records):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in records), key=lambda r: tuple((v is None, str(v)) for v in r))


def differences(df, sql: str, sf_dir: str):
    got = connection(sf_dir).execute(sql)
    names = [d[0] for d in got.description]
    want = rows(names, got.fetchall())
    have = rows(df.columns, [tuple(r) for r in df.collect()])
    assert sorted(names) == sorted(df.columns)
    assert len(want) == len(have), (len(want), len(have))
    return [(a, b) for a, b in zip(want, have, strict=True) if a != b]
