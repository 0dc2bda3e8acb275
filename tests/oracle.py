"""Comparison of Spark results with DuckDB's on the same tables."""

import os

import duckdb

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect():
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        if os.path.exists(f"{DATA}/{t}.parquet"):
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


def plain(value):
    return repr(round(value, 6)) if isinstance(value, float) else str(value)


def same(df, sql, connection=None):
    columns = sorted(df.columns)
    ours = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    cursor = (connection or connect()).execute(sql)
    names = [d[0] for d in cursor.description]
    theirs = sorted(tuple(plain(r[names.index(c)]) for c in sorted(names)) for r in cursor.fetchall())
    assert columns == sorted(names)
    assert ours == theirs
