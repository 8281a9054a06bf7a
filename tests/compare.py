from __future__ import annotations

import os

import duckdb
from pyspark.sql import DataFrame

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        c.execute(f"create view {t} as select * from '{path}/*.parquet'" if os.path.isdir(path) else f"create view {t} as select * from '{path}'")
    return c


def _plain(v: object) -> object:
    return round(v, 6) if isinstance(v, float) else v


def same(df: DataFrame, c: duckdb.DuckDBPyConnection, sql: str) -> None:
    columns = sorted(df.columns)
    got = sorted((tuple(_plain(x) for x in r) for r in df.select(*columns).collect()), key=repr)
    done = c.execute(sql)
    names = [d[0] for d in done.description]
    assert sorted(names) == columns
    at = [names.index(k) for k in columns]
    want = sorted((tuple(_plain(r[i]) for i in at) for r in done.fetchall()), key=repr)
    assert got == want
