"""Compares a query with its SQL in DuckDB: columns, kinds, rows in any order."""

import duckdb
import numpy as np
import pandas as pd

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def database(sf_dir):
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def tidy(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if pd.api.types.is_datetime64_any_dtype(df[c]) or df[c].map(type).astype(str).str.contains("date").any():
            df[c] = pd.to_datetime(df[c]).dt.strftime("%F %T.%f")
        elif pd.api.types.is_numeric_dtype(df[c]) and not pd.api.types.is_bool_dtype(df[c]):
            df[c] = df[c].astype(float).round(4)
    return df.astype(object).where(df.notna(), None).sort_values(list(df.columns), key=lambda s: s.map(str), ignore_index=True)


def assert_same(frame, sql, con):
    got, want = tidy(frame.toPandas()), tidy(con.sql(sql).df())
    assert list(got.columns) == list(want.columns)
    assert len(got) == len(want), (len(got), len(want))
    for c in got.columns:
        a, b = got[c], want[c]
        same = [x == y or (isinstance(x, float) and isinstance(y, float) and np.isclose(x, y, rtol=1e-6, atol=1e-3)) for x, y in zip(a, b, strict=True)]
        assert all(same), (c, [(x, y) for x, y, s in zip(a, b, same, strict=True) if not s][:5])
