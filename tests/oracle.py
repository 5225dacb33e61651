"""Compare a query's rows with its SQL on DuckDB, as the driver does: columns by name, rows in any order."""

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sql, sf_dir):
    import glob, os

    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        con.sql(f"create view {t} as select * from '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return con.sql(sql).df()


def rows(df: pd.DataFrame):
    df = df[sorted(df.columns)]
    cell = lambda x: None if x is None or x is pd.NA or x is pd.NaT or (isinstance(x, float) and x != x) else round(x, 9) if isinstance(x, float) else x
    return sorted((tuple(cell(int(x) if isinstance(x, float) and x == int(x) else x) if not (isinstance(x, float) and x != x) else None for x in r) for r in df.itertuples(index=False, name=None)), key=repr)


def same(spark_df, sql, sf_dir):
    got, want = spark_df.toPandas(), duck(sql, sf_dir)
    assert sorted(got.columns) == sorted(want.columns)
    a, b = rows(got), rows(want)
    assert len(a) == len(b), (len(a), len(b))
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    assert not bad, bad[:3]
    return len(a)
