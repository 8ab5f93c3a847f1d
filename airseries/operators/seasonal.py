"""Splits, baselines, error metrics and autocorrelation.

Everything is keyed by location: one plan evaluates every series.  Row
positions come from ``row_number`` over the location's hourly series (bounded
by the hours in its span).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from airseries.operators.chunks import CHUNK_ROWS, lag_products
from airseries.session import cut_lineage


def with_position(df: DataFrame, key: str = "location", ts: str = "timestamp") -> DataFrame:
    """rn = 1-based chronological position, n = rows of the series."""
    return (df.withColumn("rn", F.row_number().over(Window.partitionBy(key).orderBy(ts)))
            .withColumn("n", F.count(F.lit(1)).over(Window.partitionBy(key))))


def split_80_20(df: DataFrame, frac: float = 0.8, key: str = "location", ts: str = "timestamp") -> DataFrame:
    """is_train = rn <= floor(frac * n)."""
    p = with_position(df, key, ts)
    return p.withColumn("split_idx", F.floor(F.lit(frac) * F.col("n")).cast("bigint")) \
            .withColumn("is_train", F.col("rn") <= F.col("split_idx"))


def holdout_last(df: DataFrame, k: int = 168, key: str = "location", ts: str = "timestamp") -> DataFrame:
    """is_test = among the last ``k`` rows."""
    p = with_position(df, key, ts)
    return p.withColumn("is_test", F.col("rn") > F.col("n") - F.lit(k))


def expanding_folds(df: DataFrame, n_splits: int = 3, key: str = "location", ts: str = "timestamp") -> DataFrame:
    """Expanding-window folds; test size = n div (splits + 1); train = every earlier row.

    One output row per (input row, fold it belongs to) with role 'train'/'test'.
    """
    p = with_position(df, key, ts).withColumn("_ts", F.floor(F.col("n") / F.lit(n_splits + 1)))
    folds = F.sequence(F.lit(0), F.lit(n_splits - 1))
    x = p.withColumn("fold", F.explode(folds))
    start = F.col("n") - (F.lit(n_splits) - F.col("fold")) * F.col("_ts")
    role = (F.when(F.col("rn") <= start, F.lit("train"))
            .when(F.col("rn") <= start + F.col("_ts"), F.lit("test")))
    return x.withColumn("role", role).where(F.col("role").isNotNull()).drop("_ts")


def seasonal_naive(df: DataFrame, col: str = "P2", season_hours: int = 24, frac: float = 0.8,
                   key: str = "location", ts: str = "timestamp") -> DataFrame:
    """M6 + J3 + W14: test-row prediction = train value at t - 24 h when that
    timestamp is in train (its value, even NULL), else the mean of the last 24
    train rows."""
    s = split_80_20(df.select(key, ts, col), frac, key, ts)
    last24 = (F.col("is_train") & (F.col("rn") > F.col("split_idx") - F.lit(season_hours)))
    s = s.withColumn("_fallback", F.avg(F.when(last24, F.col(col))).over(Window.partitionBy(key)))
    train = s.where("is_train").select(F.col(key).alias("_k"), F.col(ts).alias("_t"), F.col(col).alias("_v"))
    test = s.where(~F.col("is_train"))
    j = test.join(train, (test[key] == train["_k"])
                  & (train["_t"] == test[ts] - F.expr(f"INTERVAL {int(season_hours)} HOURS")), "left")
    pred = F.when(F.col("_t").isNotNull(), F.col("_v")).otherwise(F.col("_fallback"))
    return j.select(key, ts, F.col(col).alias("actual"), pred.alias("predicted"))


def error_metrics(pred: DataFrame, actual: str = "actual", predicted: str = "predicted",
                  key: str = "location") -> DataFrame:
    """MAE, RMSE and population std of residuals over rows where both exist."""
    e = F.col(actual) - F.col(predicted)
    return pred.where(e.isNotNull()).groupBy(key).agg(
        F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(F.pow(e, 2))).alias("rmse"),
        F.stddev_pop(e).alias("residual_std"), F.count(F.lit(1)).alias("n_eval"))


def improvement_pct(base_mae: Column, model_mae: Column) -> Column:
    """Relative improvement of a model over a baseline, in percent."""
    return (base_mae - model_mae) / base_mae * F.lit(100.0)


def acf(df: DataFrame, col: str = "P2", nlags: int = 48, key: str = "location",
        ts: str = "timestamp", chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Biased autocorrelation for lags 0..nlags with Bartlett 95 % half-bands.

    NULL rows are dropped first (positions close up).  Lag products are summed
    over chunks with halos, so no window holds a whole series.
    """
    # Read for the mean, the counts and the products: computed once.
    x = cut_lineage(df.where(F.col(col).isNotNull()).select(key, ts, col))
    mean = x.groupBy(F.col(key).alias("_k")).agg(F.avg(col).alias("_m"))
    x = x.join(mean, F.col(key).eqNullSafe(F.col("_k"))).select(key, ts, (F.col(col) - F.col("_m")).alias("_c"))
    agg = lag_products(x, "_c", nlags, key, ts, chunk_rows)
    arr = F.transform("s", lambda v: F.coalesce(v, F.lit(0.0)) / F.get("s", F.lit(0)))
    out = agg.select(key, "n", F.posexplode(arr).alias("lag", "acf"))
    # Bartlett: var_k = (1 + 2 * sum_{j=1}^{k-1} acf_j^2) / n for k >= 1.
    wcum = Window.partitionBy(key).orderBy("lag").rowsBetween(Window.unboundedPreceding, -1)
    sq = F.when(F.col("lag") >= 1, F.col("acf") * F.col("acf")).otherwise(F.lit(0.0))
    out = out.withColumn("_sq", sq).withColumn("_cum", F.coalesce(F.sum("_sq").over(wcum), F.lit(0.0)))
    band = F.when(F.col("lag") == 0, F.lit(0.0)).otherwise(
        F.lit(1.96) * F.sqrt((F.lit(1.0) + F.lit(2.0) * F.col("_cum")) / F.col("n")))
    return out.select(key, F.col("lag").cast("bigint").alias("lag"), "acf", band.alias("band"), "n")


def _levinson(pdf: pd.DataFrame) -> pd.DataFrame:
    """Levinson-Durbin recursion on one location's ACF (nlags + 1 values)."""
    pdf = pdf.sort_values("lag")
    r = pdf["acf"].to_numpy(dtype=float)
    n_obs = int(pdf["n"].iloc[0])
    p = len(r) - 1
    pacf = np.zeros(p + 1)
    pacf[0] = 1.0
    phi = np.zeros(p + 1)
    sigma = r[0]
    for k in range(1, p + 1):
        if sigma == 0 or not np.isfinite(sigma):
            pacf[k:] = np.nan
            break
        acc = r[k] - np.dot(phi[1:k], r[1:k][::-1])
        a = acc / sigma
        new = phi.copy()
        new[k] = a
        new[1:k] = phi[1:k] - a * phi[1:k][::-1]
        phi = new
        sigma = sigma * (1 - a * a)
        pacf[k] = a
    band = np.where(np.arange(p + 1) == 0, 0.0, 1.96 / np.sqrt(max(n_obs, 1)))
    return pd.DataFrame({"location": pdf["location"].iloc[0], "lag": np.arange(p + 1, dtype="int64"),
                         "pacf": pacf, "band": band})


def pacf(acf_df: DataFrame, key: str = "location") -> DataFrame:
    """Partial autocorrelation via Levinson-Durbin on each location's ACF.

    Input is the ACF table (nlags + 1 rows per location), so each Python group
    holds ~49 numbers regardless of the raw volume.
    """
    return (acf_df.select(F.col(key).alias("location"), "lag", "acf", "n")
            .groupBy("location")
            .applyInPandas(_levinson, "location long, lag long, pacf double, band double"))
