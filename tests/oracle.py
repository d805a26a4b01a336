"""Runs a query's SQL in DuckDB and compares rows without order."""

import math

import duckdb

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def connection(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _cell(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return ""
    return repr(round(v, 9) + 0.0) if isinstance(v, float) else str(v)


def rows(columns, values):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return [columns[i] for i in order], sorted(tuple(_cell(r[i]) for i in order) for r in values)


def assert_same(df, con, sql):
    want = con.sql(sql)
    got, wanted = rows(df.columns, [tuple(r) for r in df.collect()]), rows(want.columns, want.fetchall())
    assert got == wanted, (len(got[1]), len(wanted[1]), [x for x in wanted[1] if x not in set(got[1])][:3])
