"""Compares rows with those DuckDB gives for the same tables."""

import math
import os

import duckdb


def connect(sf_dir):
    c = duckdb.connect()
    c.execute("SET threads TO 2")
    for name in os.listdir(sf_dir):
        path = f"{sf_dir}/{name}"
        files = f"{path}/*.parquet" if os.path.isdir(path) else path
        c.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{files}'")
    return c


def _plain(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    norm = lambda v: None if v is None or isinstance(v, float) and math.isnan(v) else round(v, 9) if isinstance(v, float) else v
    return sorted((tuple(norm(r[i]) for i in order) for r in rows), key=lambda r: tuple((v is not None, str(v)) for v in r))


def assert_same(df, sql, c):
    result = c.execute(sql)
    names = [d[0] for d in result.description]
    assert sorted(df.columns) == sorted(names)
    assert _plain([tuple(r) for r in df.collect()], df.columns) == _plain(result.fetchall(), names)
