"""Compares a Spark query with DuckDB on the same Parquet tables."""

import duckdb
import numpy as np
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


def plain(df):
    """Columns in order of name, numbers as floats, missing values as one mark, rows sorted."""
    out = pd.DataFrame(index=df.index)
    for c in sorted(df.columns):
        col = df[c].astype(object)
        out[c] = [("null" if x is None or x is pd.NA or (isinstance(x, float) and np.isnan(x)) else str(x) if isinstance(x, (bool, np.bool_, str)) else float(x)) for x in col]
    return sorted(map(tuple, out.values.tolist()), key=str)


def same(spark_df, sql, connection):
    got, want = spark_df.toPandas(), connection.sql(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    a, b = plain(got), plain(want)
    assert len(a) == len(b)
    assert a == b, next((x, y) for x, y in zip(a, b) if x != y)
