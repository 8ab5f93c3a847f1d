"""Recursive multi-step forecasting and the additive regression model.

* ``recursive_forecast``: every location's last values become an array
  (bounded by ``max(50, horizon)`` <= 720 entries), and the step loop runs as
  one ``aggregate`` higher-order function in the JVM, parallel over locations.
* ``fit_additive``: trend with hinge changepoints + daily/weekly Fourier terms
  + standardised lag regressors, fitted on sufficient statistics: normal priors
  are ridge terms, the changepoints' Laplace prior is an L1 term solved by
  coordinate descent, so most hinges are exactly zero.  Partial X'X / X'y are summed per Spark partition (numpy inside
  ``mapInPandas``), combined by a distributed ``groupBy``, and only the d x d
  system (d = 47) reaches Python for the solve, so the raw rows never gather
  in one task whatever the group size.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from airseries.session import cut_lineage
from airseries.functions.constants import (
    CHANGEPOINT_PRIOR_SCALE, CI_GROWTH, CI_GROWTH_CAP, CI_Z, MAE_QUALITY, RESIDUAL_STD_FROM_MAE,
    TREND_BAND_PCT, TREND_LABELS,
)

# --------------------------------------------------------------- intervals
def ci_half_width(step0: Column, residual_std: Column) -> Column:
    """1.96 * sigma * (1 + 0.04 * min(i, 100)), i from 0."""
    return F.lit(CI_Z) * residual_std * (F.lit(1.0) + F.lit(CI_GROWTH) * F.least(step0, F.lit(CI_GROWTH_CAP)))


def trend_class(pred_mean: Column, current_mean: Column) -> Column:
    """STRUCT<icon, label, color>; +-5 % of the current mean; zero current -> stable."""
    pct = F.when(current_mean == F.lit(0.0), F.lit(0.0)).otherwise(
        (pred_mean - current_mean) / current_mean * F.lit(100.0))
    up, down, flat = [F.struct(F.lit(a).alias("icon"), F.lit(b).alias("label"), F.lit(c).alias("color"))
                      for a, b, c in TREND_LABELS]
    return F.when(pct > F.lit(float(TREND_BAND_PCT)), up).when(pct < F.lit(-float(TREND_BAND_PCT)), down) \
            .otherwise(flat)


def mae_quality(mae: Column) -> Column:
    """Model-quality label from the MAE."""
    expr = None
    for bound, label in MAE_QUALITY:
        if bound is None:
            return expr.otherwise(F.lit(label))
        cond = mae < F.lit(float(bound))
        expr = F.when(cond, F.lit(label)) if expr is None else expr.when(cond, F.lit(label))
    return expr


# --------------------------------------------------------------- history
def history_arrays(series: DataFrame, value_col: str, keep: int, key: str = "location",
                   ts: str = "timestamp") -> DataFrame:
    """W11 + X36 input: last ``keep`` rows per location as an oldest-first array.

    NULLs are forward-filled first (the original passed NaN into the model).
    """
    w_ff = Window.partitionBy(key).orderBy(ts).rowsBetween(Window.unboundedPreceding, 0)
    w_desc = Window.partitionBy(key).orderBy(F.col(ts).desc())
    tail = (series.select(key, ts, value_col)
            .withColumn("_v", F.last(value_col, ignorenulls=True).over(w_ff))
            .withColumn("_k", F.row_number().over(w_desc))
            .where(F.col("_k") <= F.lit(keep)))
    return (tail.groupBy(key)
            .agg(F.max(ts).alias("last_ts"),
                 F.array_sort(F.collect_list(F.struct(F.col(ts).alias("t"), F.col("_v").alias("v")))).alias("_h"))
            .select(key, "last_ts", F.transform("_h", lambda s: s["v"]).alias("hist")))


def _lag_value(acc: Column, lag: int) -> Column:
    """K-th from the end, or the latest value when the history is shorter."""
    return F.when(F.size(acc) >= F.lit(lag), F.element_at(acc, -lag)).otherwise(F.element_at(acc, -1))


def recursive_forecast(hist: DataFrame, horizon: int, base_fn, lag_weights: dict,
                       residual_std: Column, key: str = "location") -> DataFrame:
    """M4: y_i = max(0, base(ts_i) + sum_l w_l * lag_l), fed back step by step.

    ``base_fn(ts_column) -> Column`` gives the part that depends on time only;
    ``lag_weights`` maps lag -> Column/float.  Output: one row per step with
    the widening interval (X19, X20).
    """
    steps = F.sequence(F.lit(1), F.lit(horizon))
    base = F.transform(steps, lambda i: base_fn(F.col("last_ts") + F.make_dt_interval(hours=i)))
    w = {int(l): (v if isinstance(v, Column) else F.lit(float(v))) for l, v in lag_weights.items()}

    # The time-only part is carried in the fold state, so it is evaluated once
    # per location (an outer column referenced inside the lambda could be
    # inlined by the optimizer and recomputed at every step).
    def step(acc, i):
        vals = acc["v"]
        y = F.element_at(acc["b"], i + 1)
        for lag, wl in w.items():
            y = y + wl * _lag_value(vals, lag)
        return F.struct(acc["b"].alias("b"), F.array_append(vals, F.greatest(F.lit(0.0), y)).alias("v"))

    init = F.struct(base.cast("array<double>").alias("b"), F.col("hist").cast("array<double>").alias("v"))
    out = (hist.withColumn("_path", F.aggregate(F.sequence(F.lit(0), F.lit(horizon - 1)), init, step)["v"])
           .withColumn("_pred", F.slice("_path", -horizon, horizon))
           .select(key, "last_ts", F.posexplode("_pred").alias("step0", "predicted"), residual_std.alias("_rs")))
    ci = ci_half_width(F.col("step0"), F.col("_rs"))
    return out.select(
        key, (F.col("step0") + 1).cast("bigint").alias("step"),
        (F.col("last_ts") + F.make_dt_interval(hours=F.col("step0") + 1)).alias("timestamp"),
        "predicted",
        F.greatest(F.lit(0.0), F.col("predicted") - ci).alias("lower"),
        (F.col("predicted") + ci).alias("upper"))


def residual_std_or_default(residual_std, mae) -> Column:
    """sigma defaults to 1.2 * MAE."""
    return F.coalesce(residual_std, F.lit(RESIDUAL_STD_FROM_MAE) * mae)


# --------------------------------------------------------- additive model
def _secs(c) -> Column:
    return F.unix_micros(c.cast("timestamp")).cast("double") / F.lit(1e6)


def _fourier_terms(secs: Column, period_days: float, order: int):
    days = secs / F.lit(86400.0)
    out = []
    for k in range(1, order + 1):
        ang = F.lit(2.0 * math.pi * k / period_days) * days
        out += [F.sin(ang), F.cos(ang)]
    return out


class AdditiveSpec:
    """Column layout: [1, t, 25 hinges, daily 2*do, weekly 2*wo, lags...]."""

    def __init__(self, lag_cols, n_changepoints=25, changepoint_range=0.8, daily_order=4,
                 weekly_order=3, changepoint_scale=CHANGEPOINT_PRIOR_SCALE, season_scale=10.0,
                 reg_scale=10.0, trend_scale=5.0, noise_var=0.01):
        self.lag_cols = list(lag_cols)
        self.n_cp, self.cp_range = n_changepoints, changepoint_range
        self.do, self.wo = daily_order, weekly_order
        self.scales = (trend_scale, changepoint_scale, season_scale, reg_scale)
        self.noise_var = noise_var

    @property
    def d(self):
        return 2 + self.n_cp + 2 * self.do + 2 * self.wo + len(self.lag_cols)

    def penalties(self) -> tuple[np.ndarray, np.ndarray]:
        """Weights of the ridge terms per row, and of the changepoints' L1 terms per square root of rows.

        The slope that noise alone gives a hinge grows with that root, a real break's with the
        rows: whatever the length of a series, breaks are found and noise stays at zero.
        """
        ts, cs, ss, rs = self.scales
        sc = ([ts, ts] + [np.inf] * self.n_cp + [ss] * (2 * self.do + 2 * self.wo) + [rs] * len(self.lag_cols))
        l1 = np.zeros(self.d)
        l1[2:2 + self.n_cp] = self.noise_var / cs
        return self.noise_var / np.square(np.array(sc, dtype=float)), l1

    def time_part(self, secs: Column, t0: Column, t1: Column, cps: Column):
        """Columns that depend on time only (intercept, trend, hinges, seasonality)."""
        t = (secs - t0) / F.greatest(t1 - t0, F.lit(1.0))
        hinges = [F.greatest(F.lit(0.0), t - F.element_at(cps, j)) for j in range(1, self.n_cp + 1)]
        return ([F.lit(1.0), t] + hinges + _fourier_terms(secs, 1.0, self.do)
                + _fourier_terms(secs, 7.0, self.wo))


def _stats(train: DataFrame, spec: AdditiveSpec, ts: str, y: str) -> DataFrame:
    """Per model key: time range, changepoint positions, lag standardisation, y scale.

    One partial/final aggregate per key, no window: a pooled model over every
    location is as cheap as a per-location one.  Changepoints sit uniformly in
    scaled time over the first ``cp_range`` of the history (for a regular
    hourly series this is the row-uniform placement of the published model).
    """
    secs = _secs(F.col(ts))
    aggs = [F.min(secs).alias("t0"), F.max(secs).alias("t1"), F.count(F.lit(1)).alias("n_train"),
            F.max(F.abs(F.col(y))).alias("y_scale")]
    for c in spec.lag_cols:
        aggs += [F.avg(c).alias(f"mu_{c}"), F.stddev_pop(c).alias(f"sd_{c}")]
    st = train.groupBy("model_key").agg(*aggs)
    cps = F.array(*[F.lit(spec.cp_range * j / spec.n_cp) for j in range(1, spec.n_cp + 1)]).cast("array<double>")
    return (st.withColumn("cps", cps)
            .withColumn("y_scale", F.when(F.col("y_scale") > 0, F.col("y_scale")).otherwise(F.lit(1.0)))
            .withColumn("lag_mu", F.array(*[F.col(f"mu_{c}") for c in spec.lag_cols]).cast("array<double>"))
            .withColumn("lag_sd", F.array(*[F.when(F.col(f"sd_{c}") > 0, F.col(f"sd_{c}")).otherwise(F.lit(1.0))
                                            for c in spec.lag_cols]).cast("array<double>"))
            .select("model_key", "t0", "t1", "n_train", "y_scale", "cps", "lag_mu", "lag_sd"))


def design(df: DataFrame, stats: DataFrame, spec: AdditiveSpec, ts: str) -> DataFrame:
    """Attach the model's scaling row and build the design array ``x``."""
    j = df.join(stats, "model_key", "inner")
    tp = spec.time_part(_secs(F.col(ts)), F.col("t0"), F.col("t1"), F.col("cps"))
    lags = [(F.col(c) - F.element_at("lag_mu", i + 1)) / F.element_at("lag_sd", i + 1)
            for i, c in enumerate(spec.lag_cols)]
    return j.withColumn("x", F.array(*tp, *lags))


def _partial_sums(d: int):
    """Per-partition X'X / X'y for rows sorted by model key within the
    partition: one d x d accumulator at a time, flushed when the key changes,
    so memory stays O(d^2) however many keys a partition holds."""
    def fn(batches):
        key, xtx, xty, n = None, None, None, 0

        def flush():
            vals = np.concatenate([xtx.ravel(), xty, [float(n)]])
            return pd.DataFrame({"model_key": key, "idx": np.arange(len(vals), dtype="int64"), "v": vals})

        for pdf in batches:
            if pdf.empty:
                continue
            for k, g in pdf.groupby("model_key", sort=False):
                if k != key:
                    if key is not None:
                        yield flush()
                    key, xtx, xty, n = k, np.zeros((d, d)), np.zeros(d), 0
                X = np.vstack(g["x"].to_numpy()).astype(float)
                yv = g["ys"].to_numpy(dtype=float)
                xtx += X.T @ X
                xty += X.T @ yv
                n += len(g)
        if key is not None:
            yield flush()
    return fn


def sparse_solution(gram: np.ndarray, moment: np.ndarray, ridge: np.ndarray, l1: np.ndarray,
                    sweeps: int = 5_000) -> np.ndarray:
    """argmin 1/2 b'(gram + diag(ridge))b - moment'b + sum(l1 |b|), with exact zeros where ``l1`` holds.

    The coefficients without ``l1`` are eliminated (a linear solve), coordinate
    descent with soft thresholds runs on the others, and once their signs have
    settled the active ones are solved for exactly.
    """
    quad = gram + np.diag(ridge)
    sparse = l1 > 0
    if not sparse.any():
        return np.linalg.solve(quad, moment)
    free = ~sparse
    inner = np.linalg.solve(quad[np.ix_(free, free)], np.column_stack([quad[np.ix_(free, sparse)], moment[free]]))
    s = quad[np.ix_(sparse, sparse)] - quad[np.ix_(sparse, free)] @ inner[:, :-1]
    c = moment[sparse] - quad[np.ix_(sparse, free)] @ inner[:, -1]
    lam, diag = l1[sparse], np.diag(s)
    usable = diag > 1e-12 * max(diag.max(initial=0.0), 1e-300)
    delta = np.zeros(len(c))

    def exact(delta):
        on = delta != 0
        out = np.zeros_like(delta)
        if on.any():
            out[on] = np.linalg.lstsq(s[np.ix_(on, on)], c[on] - lam[on] * np.sign(delta[on]), rcond=None)[0]
        slope = c - s @ out
        fits = (np.sign(out[on]) == np.sign(delta[on])).all() and (np.abs(slope[~on]) <= lam[~on] * (1 + 1e-9)).all()
        return out if fits else None

    for sweep in range(sweeps):
        largest = 0.0
        for j in np.flatnonzero(usable):
            pull = c[j] - s[j] @ delta + diag[j] * delta[j]
            new = np.sign(pull) * max(abs(pull) - lam[j], 0.0) / diag[j]
            largest, delta[j] = max(largest, abs(new - delta[j])), new
        if sweep % 20 == 19 or largest == 0.0:
            polished = exact(delta)
            if polished is not None:
                delta = polished
                break
    beta = np.empty(len(moment))
    beta[sparse] = delta
    beta[free] = inner[:, -1] - inner[:, :-1] @ delta
    return beta


def _solver(spec: AdditiveSpec):
    d = spec.d
    ridge, l1 = spec.penalties()

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        v = pdf.sort_values("idx")["v"].to_numpy(dtype=float)
        n = max(v[-1], 1.0)
        beta = sparse_solution(v[: d * d].reshape(d, d), v[d * d: d * d + d], ridge * n, l1 * math.sqrt(n))
        return pd.DataFrame({"model_key": [pdf["model_key"].iloc[0]], "coef": [beta.tolist()]})
    return solve


def normal_equations(train: DataFrame, stats: DataFrame, spec: AdditiveSpec, y: str = "y", ts: str = "ds") -> DataFrame:
    """(model_key, idx, v): X'X row by row (d * d), then X'y (d), then n; partial sums per partition, then per key."""
    x = (design(train, stats, spec, ts)
         .select("model_key", "x", (F.col(y) / F.col("y_scale")).alias("ys")))
    partial = (x.sortWithinPartitions("model_key")
               .mapInPandas(_partial_sums(spec.d), "model_key string, idx long, v double"))
    return partial.groupBy("model_key", "idx").agg(F.sum("v").alias("v"))


def fit_additive(train: DataFrame, spec: AdditiveSpec, y: str = "y", ts: str = "ds") -> DataFrame:
    """M2: one coefficient vector per ``model_key``; returns the model table
    (model_key, coef, t0, t1, n_train, y_scale, cps, lag_mu, lag_sd)."""
    # The training frame feeds two passes (scaling statistics, then the sums);
    # materialise it once instead of recomputing the hourly plan twice.
    train = cut_lineage(train.select("model_key", ts, y, *spec.lag_cols))
    stats = _stats(train, spec, ts, y)
    summed = normal_equations(train, stats, spec, y, ts)
    coefs = summed.groupBy("model_key").applyInPandas(_solver(spec), "model_key string, coef array<double>")
    # The model table is tiny (one row per key) and reused by prediction and
    # recursion: materialise it once in the shared checkpoint folder so later
    # plans neither refit nor carry the fitting lineage.
    return cut_lineage(coefs.join(stats, "model_key", "inner"))


def optimality(model: DataFrame, sums: DataFrame, spec: AdditiveSpec, tolerance: float = 1e-7) -> DataFrame:
    """Per model and coefficient: is the condition of the optimum met?

    The slope of the squared error plus ridge must vanish; a hinge has it equal
    to its L1 weight against its sign, or within that weight where it is zero.
    """
    d = spec.d
    ridge, l1 = (F.array(*[F.lit(float(x)) for x in v]) for v in spec.penalties())
    n = sums.where(F.col("idx") == d * d + d).select("model_key", F.col("v").alias("n"))
    gram = sums.where(F.col("idx") < d * d).select("model_key", F.expr(f"cast(idx div {d} as int)").alias("i"),
                                                   F.expr(f"cast(idx % {d} as int)").alias("j"), "v")
    moment = sums.where((F.col("idx") >= d * d) & (F.col("idx") < d * d + d)).select(
        "model_key", (F.col("idx") - d * d).cast("int").alias("i"), F.col("v").alias("xy"))
    fit = (gram.join(model.select("model_key", "coef"), "model_key")
           .groupBy("model_key", "i").agg(F.sum(F.col("v") * F.get("coef", F.col("j"))).alias("xb")))
    j = fit.join(moment, ["model_key", "i"]).join(n, "model_key").join(model.select("model_key", "coef"), "model_key")
    beta, lam = F.get("coef", F.col("i")), F.get(l1, F.col("i")) / F.sqrt("n")
    slope = (F.col("xb") - F.col("xy")) / F.col("n") + F.get(ridge, F.col("i")) * beta
    violation = F.when(beta == 0, F.greatest(F.abs(slope) - lam, F.lit(0.0))).otherwise(F.abs(slope + lam * F.signum(beta)))
    return j.select("model_key", F.col("i").cast("long").alias("coefficient"), (lam > 0).alias("is_changepoint"),
                    (beta == 0).alias("is_zero"), slope.alias("slope"), (violation <= tolerance).alias("satisfied"))


def predict_additive(df: DataFrame, model: DataFrame, spec: AdditiveSpec, ts: str = "ds") -> DataFrame:
    """M3: yhat = y_scale * (x . coef) for rows whose model_key has a model."""
    d = design(df, model, spec, ts)
    dot = F.aggregate(F.zip_with("x", "coef", lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    return d.withColumn("yhat", dot * F.col("y_scale")).drop("x", "t0", "t1", "cps", "lag_mu", "lag_sd",
                                                             "coef", "y_scale", "n_train")


def additive_base_and_weights(spec: AdditiveSpec, lags: list[int]):
    """Split a fitted model into a time-only base function and per-lag weights
    (Columns over the joined model row) for :func:`recursive_forecast`."""
    n_time = 2 + spec.n_cp + 2 * spec.do + 2 * spec.wo

    def base_fn(ts_col):
        tp = spec.time_part(_secs(ts_col), F.col("t0"), F.col("t1"), F.col("cps"))
        s = F.lit(0.0)
        for j, term in enumerate(tp):
            s = s + F.element_at("coef", j + 1) * term
        for i in range(len(spec.lag_cols)):
            s = s - F.element_at("coef", n_time + i + 1) * F.element_at("lag_mu", i + 1) / F.element_at("lag_sd", i + 1)
        return s * F.col("y_scale")

    weights = {lag: F.element_at("coef", n_time + i + 1) / F.element_at("lag_sd", i + 1) * F.col("y_scale")
               for i, lag in enumerate(lags)}
    return base_fn, weights


def importance(model: DataFrame, spec: AdditiveSpec) -> DataFrame:
    """M14 + X38: standardised lag coefficients as (feature, importance) rows."""
    n_time = 2 + spec.n_cp + 2 * spec.do + 2 * spec.wo
    m = F.map_from_arrays(F.array(*[F.lit(c) for c in spec.lag_cols]),
                          F.array(*[F.abs(F.element_at("coef", n_time + i + 1)) * F.col("y_scale")
                                    for i in range(len(spec.lag_cols))]))
    return model.select("model_key", F.explode(m).alias("feature", "importance"))
