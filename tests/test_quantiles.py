"""Distributed selection against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from airseries.operators import quantiles as Q


def _frame(spark, groups):
    rows = [(k, float(v)) for k, vs in groups.items() for v in vs]
    return spark.createDataFrame(rows, "g STRING, v DOUBLE").repartition(6)


@pytest.mark.parametrize("final_rows,buckets", [(100_000, 4096), (5, 8), (1, 2)])
def test_quantiles_equal_numpy(spark, final_rows, buckets):
    rng = np.random.default_rng(0)
    groups = {"normal": rng.normal(size=700), "copies": [3.0] * 400 + [4.0] * 3, "one": [2.5], "two": [1.0, 2.0],
              "wide": np.concatenate([rng.normal(size=50), [1e300, -1e300, 1e-300]]), "hot": rng.integers(0, 9, 3000),
              "near": [1.0, np.nextafter(1.0, 2.0), np.nextafter(1.0, 0.0)] * 7, "zero": [0.0, -0.0, 0.0],
              "huge": [-1.7e308, 1.7e308, 0.0, 5.0]}
    probs = [0.0, 0.1, 0.25, 0.5, 0.75, 0.99, 1.0]
    got = {r["g"]: r for r in Q.exact_quantiles(_frame(spark, groups), ["g"], "v", probs,
                                                final_rows=final_rows, buckets=buckets).collect()}
    assert set(got) == set(groups)
    for g, vs in groups.items():
        assert got[g]["n"] == len(vs)
        if g != "huge":  # the difference of its neighbours overflows in numpy
            assert np.allclose(got[g]["q"], np.quantile(vs, probs), rtol=1e-12, atol=0), g
        assert got[g]["q"][0] == min(vs) and got[g]["q"][-1] == max(vs)


def test_nulls_and_empty(spark):
    df = spark.createDataFrame([("a", None), ("a", float("nan")), (None, 1.0), (None, 3.0)], "g STRING, v DOUBLE")
    got = {r["g"]: (r["n"], r["q"]) for r in Q.exact_quantiles(df, ["g"], "v", [0.5]).collect()}
    assert got == {None: (2, [2.0])}
    assert Q.exact_quantiles(df.where("false"), ["g"], "v", [0.5]).count() == 0


def test_no_group_is_gathered(spark):
    df = spark.range(50_000).select((F.col("id") % 3 == 0).alias("g"), F.sin("id").alias("v"))
    got = {r["g"]: r["q"] for r in Q.exact_quantiles(df, ["g"], "v", [0.25, 0.5], final_rows=100).collect()}
    v = np.sin(np.arange(50_000))
    for g in (True, False):
        assert np.allclose(got[g], np.quantile(v[(np.arange(50_000) % 3 == 0) == g], [0.25, 0.5]), rtol=1e-9)
