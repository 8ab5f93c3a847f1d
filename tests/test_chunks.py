"""Chunked windows against plain ones, and the plan that they make."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from airseries.operators import chunks as CH
from airseries.operators import features as FE
from airseries.operators import fusion as FU
from airseries.operators import seasonal as S

T0 = dt.datetime(2024, 1, 1)


def _series(spark, seed=0):
    rng = np.random.default_rng(seed)
    rows = []
    for loc, n in ((1, 400), (2, 37), (3, 1), (4, 60)):
        t = np.cumsum(rng.integers(1, 9000, n))
        for i in range(n):
            gap = rng.random() < 0.4 or loc == 4 and i < 55 or loc == 2 and 5 < i < 30
            rows.append((loc, T0 + dt.timedelta(seconds=int(t[i])), None if gap else float(rng.normal())))
    return spark.createDataFrame(rows, "location BIGINT, timestamp TIMESTAMP_NTZ, P2 DOUBLE").repartition(5)


def _rows(df):
    def fix(v):
        return None if v is None else round(v, 9) if isinstance(v, float) else v
    return sorted((tuple(fix(v) for v in r) for r in df.collect()), key=str)


@pytest.mark.parametrize("chunk_rows", [24, 50, 1000])
def test_lags_and_rolling(spark, chunk_rows):
    df = _series(spark)
    assert _rows(CH.add_lags(df, ["P2"], [1, 2, 24], chunk_rows=chunk_rows)) == _rows(FE.add_lags(df, ["P2"], [1, 2, 24]))
    plain = FE.rolling(df, "P2", 24).drop("P2_band_lo", "P2_band_hi")
    assert _rows(CH.rolling(df, "P2", 24, chunk_rows=chunk_rows)) == _rows(plain)


@pytest.mark.parametrize("chunk_rows", [1, 3, 10, 1000])
@pytest.mark.parametrize("method", ["linear", "time"])
def test_interpolation(spark, chunk_rows, method):
    df = _series(spark, 1)
    assert _rows(CH.interpolate(df, "P2", method=method, chunk_rows=chunk_rows)) == _rows(FE.interpolate(df, "P2", method=method))


def test_a_halo_longer_than_a_chunk_is_refused(spark):
    with pytest.raises(ValueError):
        CH.add_lags(_series(spark), ["P2"], [24], chunk_rows=10)


def test_acf_over_chunks_equals_numpy(spark):
    df = _series(spark, 2).where("location IN (1, 2)")
    got = {(r["location"], r["lag"]): r["acf"] for r in S.acf(df, "P2", 12, chunk_rows=12).collect()}
    for loc in (1, 2):
        v = np.array([r["P2"] for r in df.where(F.col("location") == loc).orderBy("timestamp").collect() if r["P2"] is not None])
        c = v - v.mean()
        for k in range(13):
            assert got[loc, k] == pytest.approx((c[:max(len(c) - k, 0)] * c[k:]).sum() / (c * c).sum(), abs=1e-12)


def test_no_window_holds_a_whole_series(spark):
    import re
    plan = S.acf(_series(spark), "P2", 48)._jdf.queryExecution().executedPlan().toString()
    for part, order in re.findall(r"Window \[.*?\], \[([^\]]*)\](?:, \[([^\]]*)\])?", plan):
        if re.fullmatch(r"location#\d+L?", part):  # only summaries: one row per day, or per lag
            assert re.match(r"(_sub|lag)#", order), (part, order)
    assert "_chunk" in plan


def test_group_means_fill_gaps(spark):
    rows = [(1, "m", 1.0), (1, "m", None), (1, "m", 3.0), (2, "m", None), (None, "m", None), (None, "m", 5.0)]
    df = spark.createDataFrame(rows, "location BIGINT, month STRING, P2 DOUBLE")
    got = sorted(_rows(FU.mean_impute(df, ["P2"])), key=str)
    assert got == sorted([(1, "m", 1.0), (1, "m", 2.0), (1, "m", 3.0), (2, "m", None), (None, "m", 5.0), (None, "m", 5.0)], key=str)
