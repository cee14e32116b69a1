"""Holds a query against SQL on the same tables."""

import os


def duck(sf_dir):
    import glob

    import duckdb

    con = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


def plain(v):
    if isinstance(v, float):
        return round(v, 6)
    return v.hex() if isinstance(v, (bytes, bytearray)) else v


def same_as_sql(spark, sf_dir, query, sql):
    """The query's rows and column names are those of its SQL."""
    df = query(spark, sf_dir)
    cur = duck(sf_dir).execute(sql)
    names = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(names)
    columns = sorted(names)
    at = [names.index(c) for c in columns]
    expected = sorted(tuple(str(plain(r[i])) for i in at) for r in cur.fetchall())
    got = sorted(tuple(str(plain(r[c])) for c in columns) for r in df.collect())
    assert got == expected
