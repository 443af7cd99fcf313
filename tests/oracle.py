"""Runs a query's SQL in DuckDB and compares rows, as the driver does."""

import duckdb
import numpy as np
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def frame_of_sql(sql: str, sf_dir: str) -> pd.DataFrame:
    con = duckdb.connect(config={"max_temp_directory_size": "2GB"})
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con.execute(sql).df()


def _sorted(df: pd.DataFrame) -> pd.DataFrame:
    exact = [c for c in sorted(df.columns) if df[c].dtype.kind != "f"]
    rest = [c for c in sorted(df.columns) if c not in exact]
    return df.sort_values(exact + rest, ignore_index=True, key=lambda c: c if c.dtype.kind != "O" else c.map(str))


def assert_same(df, sql: str, sf_dir: str) -> None:
    mine, theirs = df.toPandas(), frame_of_sql(sql, sf_dir)
    assert sorted(mine.columns) == sorted(theirs.columns)
    assert len(mine) == len(theirs)
    mine, theirs = _sorted(mine), _sorted(theirs)
    for c in mine.columns:
        a, b = mine[c], theirs[c]
        if a.dtype.kind == "f" or b.dtype.kind == "f":
            assert np.isclose(a.to_numpy(float), b.to_numpy(float), rtol=1e-9, atol=2e-6, equal_nan=True).all(), c
        elif a.dtype.kind == "O":
            assert (a.isna() == b.isna()).all() and (a.map(str) == b.map(str))[a.notna()].all(), c
        else:
            assert (a == b).all(), c
