"""Runs a query and its statement over the same tables and compares rows."""

import math

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(d):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{d}/{t}.parquet'")
    return con


def rows(df):
    def plain(v):
        if v is None or v is pd.NaT or v is pd.NA or isinstance(v, float) and math.isnan(v):
            return None
        if isinstance(v, (int, float)) and not isinstance(v, bool):  # columns with NULL come as floats from one side
            return float(f"{v:.12g}") if isinstance(v, int) or v.is_integer() else float(f"{v:.9g}")
        return str(v.tolist()) if hasattr(v, "tolist") else v

    df = df[sorted(df.columns)]
    return sorted(repr([plain(v) for v in r]) for r in df.astype(object).itertuples(index=False, name=None))


def same(spark, d, query, statement):
    a, b = query(spark, d).toPandas(), connect(d).execute(statement).df()
    assert sorted(a.columns) == sorted(b.columns)
    assert rows(a) == rows(b)
