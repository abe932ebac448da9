"""A query against its SQL: equal rows in any order, floats to five places."""

import math

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(x):
    if x is None or x is pd.NaT or x is pd.NA or isinstance(x, float) and math.isnan(x):
        return None
    if isinstance(x, float):
        return round(x, 5)
    if hasattr(x, "year"):
        return str(pd.Timestamp(x))
    return x.item() if hasattr(x, "item") else x


def rows(df):
    names = sorted(df.columns)
    return names, sorted((tuple(map(plain, r)) for r in df[names].itertuples(index=False)), key=str)


def same(spark, data, query, sql):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    got = rows(query(spark, data).toPandas().astype(object))
    want = rows(con.execute(sql).df().astype(object))
    assert got[0] == want[0]
    assert [tuple(float(x) if isinstance(x, int) and not isinstance(x, bool) else x for x in r) for r in got[1]] == [tuple(float(x) if isinstance(x, int) and not isinstance(x, bool) else x for x in r) for r in want[1]]
