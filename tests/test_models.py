"""Sparse changepoints, the model registry and boosted trees against independent computations."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from airseries.operators import forecast as FC
from airseries.sources import sinks
from tests.conftest import SF001

T0 = dt.datetime(2024, 1, 1)


def _objective(gram, moment, ridge, l1, b):
    return 0.5 * b @ gram @ b - moment @ b + 0.5 * (ridge * b * b).sum() + (l1 * np.abs(b)).sum()


@pytest.mark.parametrize("seed", range(6))
def test_sparse_solution_is_the_minimum(seed):
    rng = np.random.default_rng(seed)
    n, d = 200, 12
    x = rng.normal(size=(n, d)) @ rng.normal(size=(d, d))
    if seed == 5:
        x[:, 7] = 0.0  # a column without any spread
    y = x[:, :3] @ np.array([1.0, -2.0, 0.5]) + rng.normal(size=n)
    gram, moment = x.T @ x, x.T @ y
    ridge, l1 = np.full(d, 0.5), np.zeros(d)
    ridge[4:10], l1[4:10] = 0.0, [40.0, 40.0, 5.0, 40.0, 400.0, 1.0]
    got = FC.sparse_solution(gram, moment, ridge, l1)
    slope = gram @ got - moment + ridge * got
    scale = np.abs(moment).max()
    for j in range(d):
        if l1[j] and got[j] == 0:
            assert abs(slope[j]) <= l1[j] + 1e-7 * scale
        else:
            assert abs(slope[j] + l1[j] * np.sign(got[j])) <= 1e-7 * scale
    best = _objective(gram, moment, ridge, l1, got)
    for _ in range(200):
        assert _objective(gram, moment, ridge, l1, got + rng.normal(size=d) * 10.0 ** rng.uniform(-6, 0)) >= best - 1e-9 * abs(best)


def _fit(spark, trend, spec):
    rng = np.random.default_rng(1)
    rows = [("k", T0 + dt.timedelta(hours=i), float(trend(i / 2000) + 0.3 * np.sin(2 * np.pi * i / 24) + rng.normal(0, 0.05)))
            for i in range(2000)]
    df = spark.createDataFrame(rows, "model_key STRING, ds TIMESTAMP_NTZ, y DOUBLE")
    return np.array(FC.fit_additive(df, spec).first()["coef"])


def test_hinges_are_zero_without_breaks_and_found_with_one(spark):
    spec = FC.AdditiveSpec([])
    straight = _fit(spark, lambda t: 5 + t, spec)[2:27]
    assert (straight == 0).sum() >= 23
    broken = _fit(spark, lambda t: 5 + 20 * max(0.0, t - 0.4), spec)[2:27]
    on = np.flatnonzero(broken)
    assert 0 < len(on) < 13
    where = (0.8 * (on + 1) / 25 * np.abs(broken[on])).sum() / np.abs(broken[on]).sum()
    assert abs(where - 0.4) < 0.1


def test_a_model_without_optimum_is_reported(spark):
    rng = np.random.default_rng(2)
    df = spark.createDataFrame([("k", T0 + dt.timedelta(hours=i), float(5 + rng.normal())) for i in range(500)],
                               "model_key STRING, ds TIMESTAMP_NTZ, y DOUBLE")
    spec = FC.AdditiveSpec([])
    sums = FC.normal_equations(df, FC._stats(df, spec, "ds", "y"), spec)
    model = FC.fit_additive(df, spec)
    assert FC.optimality(model, sums, spec).where(~F.col("satisfied")).count() == 0
    moved = model.withColumn("coef", F.transform("coef", lambda c, i: F.when(i == 3, c + 0.2).otherwise(c)))
    assert FC.optimality(moved, sums, spec).where(~F.col("satisfied")).count() > 0


def test_registry_key_follows_content(spark, tmp_path):
    data = f"{tmp_path}/data"
    spark.range(5).write.parquet(data)
    a = sinks.model_path(spark, "m", [data], {"x": 1})
    assert a == sinks.model_path(spark, "m", [data], {"x": 1})
    assert a != sinks.model_path(spark, "m", [data], {"x": 2})
    spark.range(5).write.mode("append").parquet(data)
    assert a != sinks.model_path(spark, "m", [data], {"x": 1})


def test_only_an_absent_model_is_fitted(spark, tmp_path):
    fits = []

    def fit():
        fits.append(1)
        return spark.range(len(fits))

    path = f"{tmp_path}/model"
    assert [sinks.load_or_fit(spark, path, fit, force).count() for force in (False, False, True, False)] == [1, 1, 2, 2]
    broken = tmp_path / "broken"
    broken.mkdir()
    (broken / "part-0.parquet").write_bytes(b"not a parquet file at all")
    with pytest.raises(Exception):
        sinks.load_or_fit(spark, str(broken), fit).count()
    assert len(fits) == 2


def test_a_model_is_kept_whole_or_not_at_all(spark, tmp_path, monkeypatch):
    path = f"{tmp_path}/models/m"

    def cut_off(*_):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(sinks, "rename_new", cut_off)
        with pytest.raises(KeyboardInterrupt):
            sinks.load_or_fit(spark, path, lambda: spark.range(3))
    assert sinks.load_or_fit(spark, path, lambda: spark.range(4)).count() == 4

    raced = f"{tmp_path}/models/raced"

    def slower():  # another run finishes its fit first
        assert sinks.load_or_fit(spark, raced, lambda: spark.range(1)).count() == 1
        return spark.range(2)

    assert sinks.load_or_fit(spark, raced, slower).count() == 1
    assert not list((tmp_path / "models").glob("raced.*"))


def test_model_queries(spark):
    got = {r["request"]: r["fits"] for r in E.queries()["model_reuse"](spark, SF001).collect()}
    assert got == {"first": 1, "again": 1, "other parameters": 2, "new data": 3, "forced": 4}


# --- boosted trees ------------------------------------------------------------------

def _brute_boost(x, y, train, edges, rounds, depth, eta, l2):
    """Second-order boosting on sorted thresholds, row by row in plain Python."""
    base = y[train].mean()
    pred = np.full(len(y), base)
    for _ in range(rounds):
        g = pred - y

        def grow(rows, level):
            gs, n = g[rows].sum(), len(rows)
            best = (1e-6, None)
            if level < depth:
                for f in range(x.shape[1]):
                    for e in edges[f]:
                        left = rows[x[rows, f] <= e]
                        if 1 <= len(left) <= n - 1:
                            gl = g[left].sum()
                            gain = round(gl ** 2 / (len(left) + l2) + (gs - gl) ** 2 / (n - len(left) + l2) - gs ** 2 / (n + l2), 6)
                            if gain > best[0]:
                                best = (gain, (f, e))
            if best[1] is None:
                return lambda r: -eta * gs / (n + l2)
            f, e = best[1]
            a, b = grow(rows[x[rows, f] <= e], level + 1), grow(rows[x[rows, f] > e], level + 1)
            return lambda r: a(r) if r[f] <= e else b(r)

        tree = grow(np.flatnonzero(train), 0)
        pred = pred + np.array([tree(r) for r in x])
    return pred


def _table(spark, n=160, seed=0):
    rng = np.random.default_rng(seed)
    x = np.column_stack([rng.normal(size=n), rng.integers(0, 4, n), np.round(rng.normal(size=n), 1)]).astype(float)
    y = np.sin(2 * x[:, 0]) + x[:, 1] - 0.3 * x[:, 2] + rng.normal(size=n) * 0.1
    seg = (np.arange(n) >= 0.75 * n).astype(int)
    rows = [(i, *map(float, r), float(v), int(s)) for i, (r, v, s) in enumerate(zip(x, y, seg))]
    return x, y, seg, spark.createDataFrame(rows, "id LONG, a DOUBLE, b DOUBLE, c DOUBLE, y DOUBLE, seg INT").repartition(3)


@pytest.mark.parametrize("partition_rows", [1_000_000, 100])
def test_boosting_equals_brute_force(spark, partition_rows):
    """Inside one task, and over partitions with a job per level."""
    from airseries.operators import boosting as B
    x, y, seg, df = _table(spark)
    specs = [B.Boosting("one", rounds=6, depth=3, eta=0.3, score_at=(6,)),
             B.Boosting("two", rounds=4, depth=2, eta=0.1, l2=5.0, score_at=(2, 4))]
    trees, scores = B.fit(df, ["a", "b", "c"], "y", "seg", ["id"], specs, bins=16, partition_rows=partition_rows)
    trees.cache()
    edges = B.bin_edges(df.where("seg = 0"), ["a", "b", "c"], 16)
    err = {(r["model"], r["rounds"]): (r["mae"], r["n"]) for r in scores.collect()}
    assert set(err) == {("one", 6), ("two", 2), ("two", 4)}
    for spec in specs:
        nodes = trees.where(F.col("model") == spec.name).collect()
        got = {r["id"]: (r["p"], r["q"]) for r in df.select(
            "id", B.predicted(nodes, ["a", "b", "c"]).alias("p"), F.expr(B.compiled(nodes, {c: c for c in "abc"})).alias("q")).collect()}
        for rounds in (spec.rounds, *spec.score_at):
            want = _brute_boost(x, y, seg == 0, [edges[f] for f in "abc"], rounds, spec.depth, spec.eta, spec.l2)
            if rounds == spec.rounds:
                assert all(abs(got[i][0] - w) < 1e-9 and abs(got[i][1] - w) < 1e-9 for i, w in enumerate(want))
            assert err[spec.name, rounds] == (pytest.approx(np.abs(want - y)[seg == 1].mean()), int((seg == 1).sum()))


def test_models_together_equal_models_alone(spark):
    from airseries.operators import boosting as B
    _, _, _, df = _table(spark, seed=3)
    specs = [B.Boosting("a", rounds=5, depth=3), B.Boosting("b", rounds=3, depth=4, eta=0.1, subsample=0.6)]
    both = B.fit(df, ["a", "b", "c"], "y", "seg", ["id"], specs)[0].collect()
    for s in specs:
        alone = B.fit(df, ["a", "b", "c"], "y", "seg", ["id"], [s], partition_rows=60)[0].collect()
        mine = [r for r in both if r["model"] == s.name]
        key = lambda r: (r["tree"], r["level"], r["node"])
        assert [(key(r), r["feature"], r["threshold"]) for r in sorted(mine, key=key)] \
            == [(key(r), r["feature"], r["threshold"]) for r in sorted(alone, key=key)]


def test_boosting_of_awkward_tables(spark):
    from airseries.operators import boosting as B
    schema = "id LONG, a DOUBLE, y DOUBLE, seg INT"
    spec = [B.Boosting("m", rounds=2, score_at=(2,))]
    assert B.fit(spark.createDataFrame([], schema), ["a"], "y", "seg", ["id"], spec)[0].count() == 0
    same = spark.createDataFrame([(i, 1.0, 2.0, 0) for i in range(9)] + [(9, None, 1.0, 0), (10, 1.0, None, 0)], schema)
    trees, scores = B.fit(same, ["a"], "y", "seg", ["id"], spec)
    assert [(r["feature"], r["value"], r["rows"]) for r in trees.collect()] == [(None, 0.0, 9.0)] * 2
    assert [(r["mae"], r["n"]) for r in scores.collect()] == [(None, 0)]


def test_expanding_segments_follow_the_splits(spark):
    from airseries.operators import trees as TR
    rows = [(0, T0 + dt.timedelta(hours=i), float(i)) for i in range(30)] + [(1, T0 + dt.timedelta(hours=i), 1.0) for i in range(3)]
    df = spark.createDataFrame(rows, "location INT, timestamp TIMESTAMP_NTZ, P2 DOUBLE")
    got = [r["_segment"] for r in TR.expanding_segments(df, 3).where("location = 0").orderBy("timestamp").collect()]
    assert got == [0] * 6 + [1] * 6 + [2] * 6 + [3] * 6      # 24 training rows, folds of 6
