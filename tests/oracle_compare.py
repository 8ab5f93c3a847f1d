"""Compare a Spark result with DuckDB's on the same parquet tables."""

from __future__ import annotations

import duckdb
import numpy as np
import pandas as pd

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf[sorted(pdf.columns)].copy()
    for c in pdf.columns:
        s = pdf[c]
        if pd.api.types.is_float_dtype(s):
            pdf[c] = s.round(5)
        elif pd.api.types.is_datetime64_any_dtype(s):
            pdf[c] = pd.to_datetime(s).dt.tz_localize(None).astype("datetime64[us]")
        elif s.dtype == object:
            pdf[c] = s.map(lambda v: tuple(v) if isinstance(v, (list, np.ndarray)) else v)
    pdf = pdf.astype({c: "object" for c in pdf.columns if pdf[c].dtype == object})
    return pdf.sort_values(list(pdf.columns), na_position="first", key=lambda s: s.astype(str)).reset_index(drop=True)


def compare(spark_df, con, sql: str):
    s = spark_df.toPandas()
    d = con.execute(sql).df()
    assert sorted(s.columns) == sorted(d.columns), (sorted(s.columns), sorted(d.columns))
    assert len(s) == len(d), (len(s), len(d))
    a, b = _norm(s), _norm(d)
    for c in a.columns:
        x, y = a[c], b[c]
        if pd.api.types.is_float_dtype(x) or pd.api.types.is_float_dtype(y):
            xv = pd.to_numeric(x, errors="coerce").to_numpy(float)
            yv = pd.to_numeric(y, errors="coerce").to_numpy(float)
            ok = np.isclose(xv, yv, rtol=1e-6, atol=1e-5, equal_nan=True)
            assert ok.all(), (c, a[~ok].head(), b[~ok].head())
        else:
            xs = x.astype(str).tolist()
            ys = y.astype(str).tolist()
            bad = [i for i in range(len(xs)) if xs[i] != ys[i]]
            assert not bad, (c, [(xs[i], ys[i]) for i in bad[:5]])
    return len(s)
