"""Compare a registered query with its SQL in DuckDB."""

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return ""
    if isinstance(v, float):
        return repr(v + 0.0)
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, int):
        return repr(float(v))
    return str(v)


def same(spark, query, sql, sf_dir):
    df = query(spark, sf_dir)
    names = sorted(df.columns)
    got = sorted(tuple(plain(r[n]) for n in names) for r in df.collect())
    table = connect(sf_dir).execute(sql).to_arrow_table()
    assert sorted(table.column_names) == names
    want = sorted(tuple(plain(r[n]) for n in names) for r in table.to_pylist())
    assert got == want
