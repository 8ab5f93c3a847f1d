"""Forecast queries."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from airseries.functions.constants import MAE_QUALITY, TARGET_LAGS
from airseries.operators import forecast as FC
from airseries.operators import hourly as H
from airseries.operators import seasonal as S
from airseries.operators.features import add_features, next_row_target
from airseries.operators.filters import last_n_hours
from airseries.plans.oracle import features_cte, hourly_chain, hourly_cte, lineitem_readings_cte, pivot_cte, r6
from airseries.plans.registry import register
from airseries.session import cut_lineage
from airseries.sources import sinks
from airseries.sources.readings import events_readings, lineitem_wide_readings

# Fixed coefficients of the SQL-checkable recursion (a test vehicle, not a fitted model).
FIXED_BASE = 2.0
FIXED_WEIGHTS = {1: 0.5, 2: 0.2, 3: 0.1, 4: 0.05, 5: 0.05, 24: 0.05}
FIXED_MAE = 2.5
HORIZON = 24


def _hourly(spark, sf_dir):
    return H.hourly_wide(events_readings(spark, sf_dir))


def _fixed_forecast(spark, sf_dir):
    hist = FC.history_arrays(_hourly(spark, sf_dir), "P2", max(50, HORIZON))
    rs = FC.residual_std_or_default(F.lit(None).cast("double"), F.lit(FIXED_MAE))
    return FC.recursive_forecast(hist, HORIZON, lambda ts: F.lit(FIXED_BASE), FIXED_WEIGHTS, rs)


def _lag_sql(lag: int) -> str:
    return f"(CASE WHEN len(hs) >= {lag} THEN hs[-{lag}] ELSE hs[-1] END)"


_STEP = " + ".join([f"{FIXED_BASE}"] + [f"{w} * {_lag_sql(l)}" for l, w in FIXED_WEIGHTS.items()])
_RS = 1.2 * FIXED_MAE
_FIXED_SQL_CTES = f"""
ff AS (SELECT location, timestamp, last_value(P2 IGNORE NULLS) OVER
         (PARTITION BY location ORDER BY timestamp ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS v FROM h),
tl AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY location ORDER BY timestamp DESC) AS k FROM ff)
       WHERE k <= {max(50, HORIZON)}),
hist AS (SELECT location, max(timestamp) AS last_ts, list(v ORDER BY timestamp) AS hs FROM tl GROUP BY location),
rec(location, last_ts, step, hs) AS (
  SELECT location, last_ts, 0, hs FROM hist
  UNION ALL
  SELECT location, last_ts, step + 1, list_append(hs, greatest(0.0, {_STEP})) FROM rec WHERE step < {HORIZON}),
fc AS (SELECT location, CAST(step AS BIGINT) AS step, last_ts + step * INTERVAL 1 HOUR AS timestamp,
              hs[-1] AS predicted, 1.96 * {_RS} * (1 + 0.04 * least(step - 1, 100)) AS ci
       FROM rec WHERE step >= 1)"""


@register("forecast_fixed_coefs", f"""
WITH RECURSIVE {hourly_chain()}, {_FIXED_SQL_CTES}
SELECT location, step, timestamp, {r6('predicted', 'predicted')}, {r6('greatest(0.0, predicted - ci)', 'lower')},
       {r6('predicted + ci', 'upper')} FROM fc
""")
def forecast_fixed_coefs(spark, sf_dir):
    """M4 + X19 + X20 + X36 + X37: 24-step recursion with fixed coefficients, every location."""
    return _fixed_forecast(spark, sf_dir)


@register("trend_label", f"""
WITH RECURSIVE {hourly_chain()}, {_FIXED_SQL_CTES},
pm AS (SELECT location, avg(predicted) AS pred_mean FROM fc GROUP BY location),
cm AS (SELECT location, avg(P2) AS current_mean FROM
         (SELECT *, max(timestamp) OVER (PARTITION BY location) AS mx FROM h) WHERE timestamp >= mx - INTERVAL 24 HOUR
       GROUP BY location),
j AS (SELECT pm.location, pred_mean, current_mean,
             CASE WHEN current_mean = 0 THEN 0 ELSE (pred_mean - current_mean) / current_mean * 100 END AS pct
      FROM pm JOIN cm ON pm.location = cm.location)
SELECT location, {r6('pred_mean', 'pred_mean')}, {r6('current_mean', 'current_mean')},
       CASE WHEN pct > 5 THEN 'hausse' WHEN pct < -5 THEN 'baisse' ELSE 'stable' END AS trend
FROM j
""")
def trend_label(spark, sf_dir):
    """M5 + X26: mean forecast vs the mean of the last 24 h."""
    pm = _fixed_forecast(spark, sf_dir).groupBy("location").agg(F.avg("predicted").alias("pred_mean"))
    cm = last_n_hours(_hourly(spark, sf_dir), 24).groupBy("location").agg(F.avg("P2").alias("current_mean"))
    j = pm.join(cm, "location")
    return j.select("location", "pred_mean", "current_mean",
                    FC.trend_class(F.col("pred_mean"), F.col("current_mean")).getField("label").alias("trend"))


# ------------------------------------------------------------ fitted models
# Models are fitted on the dense multi-year lineitem series (one value per
# location-day); the events series has P2 in only ~40 % of hours, so almost no
# row carries all six lags.
def _model_series(spark, sf_dir):
    return H.hourly_wide(lineitem_wide_readings(spark, sf_dir), value_types=["P2", "temperature", "humidity"])


def _training(spark, sf_dir, target="P2", extra=(), feats=None):
    """M1 frame with a per-location model key (``feats``: a precomputed feature table)."""
    lags = TARGET_LAGS[target]
    f = feats if feats is not None else add_features(_model_series(spark, sf_dir))
    t = next_row_target(f, target, list(lags) + list(extra))
    return t.withColumn("model_key", F.concat(F.lit(target + "@"), F.col("location").cast("string")))


def _holdout_fit(spark, sf_dir, spec, target="P2", extra=(), training=None, reuse_as=None):
    """Fit on all but the last 168 rows of every series, score those rows.

    ``reuse_as`` names a saved model (M15): a later request for the same data
    and parameters reuses it instead of refitting."""
    t = training if training is not None else _training(spark, sf_dir, target, extra)
    t = S.holdout_last(t, 168, ts="ds")
    fit = lambda: FC.fit_additive(t.where(~F.col("is_test")), spec)
    if reuse_as:
        path = sinks.model_path(spark, f"additive-{reuse_as}", [f"{sf_dir}/lineitem.parquet"], vars(spec))
        model = sinks.load_or_fit(spark, path, fit)
    else:
        model = fit()
    test = FC.predict_additive(t.where("is_test"), model, spec)
    return model, test


def _metrics(test, spec, model):
    e = F.col("y") - F.col("yhat")
    m = test.groupBy("model_key", "location").agg(
        F.avg(F.abs(e)).alias("mae"), F.stddev_pop(e).alias("residual_std"),
        F.array_sort(F.collect_list(F.struct("ds", "y", "yhat"))).alias("_ev"))
    imp = (FC.importance(model, spec).groupBy("model_key")
           .agg(F.map_from_entries(F.collect_list(F.struct("feature", "importance"))).alias("importance")))
    return (m.join(imp, "model_key", "left")
            .select("model_key", "location", "mae", "residual_std",
                    F.create_map(F.lit("changepoint_prior_scale"), F.lit(spec.scales[1])).alias("best_params"),
                    "importance",
                    F.transform("_ev", lambda s: s["y"]).alias("test_actual"),
                    F.transform("_ev", lambda s: s["yhat"]).alias("test_predicted"),
                    FC.mae_quality(F.col("mae")).alias("quality")))


def _plain_fit(spark, sf_dir):
    """The additive model without regressors over the whole hourly series, with its sums."""
    spec = FC.AdditiveSpec([])
    t = cut_lineage(_model_series(spark, sf_dir).where(F.col("P2").isNotNull()).select(
        F.col("location").cast("string").alias("model_key"), F.col("timestamp").alias("ds"), F.col("P2").alias("y")))
    stats = FC._stats(t, spec, "ds", "y")
    return spec, t, stats, FC.normal_equations(t, stats, spec)


def _design_sql() -> str:
    """The design row of ``_plain_fit`` as a DuckDB list (t: scaled time, days: days since the epoch)."""
    spec = FC.AdditiveSpec([])
    cols = ["1.0", "t"] + [f"greatest(0.0, t - {spec.cp_range * j / spec.n_cp!r})" for j in range(1, spec.n_cp + 1)]
    for period, order in ((1.0, spec.do), (7.0, spec.wo)):
        for k in range(1, order + 1):
            cols += [f"{f}(2 * pi() * {k} / {period} * days)" for f in ("sin", "cos")]
    return "[" + ", ".join(cols) + "]"


_PLAIN_SQL = f"""
WITH {lineitem_readings_cte()}, {pivot_cte(types=['P2'])}, {hourly_cte(types=['P2'])},
s AS (SELECT location, P2, epoch(timestamp) AS e, min(epoch(timestamp)) OVER w AS lo, max(epoch(timestamp)) OVER w AS hi,
             max(abs(P2)) OVER w AS top FROM h WHERE P2 IS NOT NULL WINDOW w AS (PARTITION BY location)),
q AS (SELECT location, CASE WHEN top > 0 THEN P2 / top ELSE P2 END AS y, (e - lo) / greatest(hi - lo, 1.0) AS t, e / 86400.0 AS days FROM s),
x AS (SELECT location, y, {_design_sql()} AS x FROM q)
"""


@register("additive_normal_equations", _PLAIN_SQL + f"""
SELECT CAST(location AS VARCHAR) AS model_key, CAST(i.i * {FC.AdditiveSpec([]).d} + j.j AS BIGINT) AS idx,
       round(sum(x[i.i + 1] * x[j.j + 1]), 6) AS v
FROM x, range({FC.AdditiveSpec([]).d}) i(i), range({FC.AdditiveSpec([]).d}) j(j) GROUP BY location, i.i, j.j
UNION ALL
SELECT CAST(location AS VARCHAR), CAST({FC.AdditiveSpec([]).d ** 2} + i.i AS BIGINT), round(sum(x[i.i + 1] * y), 6)
FROM x, range({FC.AdditiveSpec([]).d}) i(i) GROUP BY location, i.i
UNION ALL
SELECT CAST(location AS VARCHAR), CAST({FC.AdditiveSpec([]).d ** 2 + FC.AdditiveSpec([]).d} AS BIGINT), CAST(count(*) AS DOUBLE) FROM x GROUP BY 1
""")
def additive_normal_equations(spark, sf_dir):
    """M2: the sums X'X, X'y and n that the additive model is solved from, per location."""
    return _plain_fit(spark, sf_dir)[3]


@register("changepoint_optimality", _PLAIN_SQL + f"""
SELECT CAST(location AS VARCHAR) AS model_key, CAST(c AS BIGINT) AS coefficient, c BETWEEN 2 AND 26 AS is_changepoint,
       TRUE AS satisfied
FROM (SELECT DISTINCT location FROM x), range({FC.AdditiveSpec([]).d}) r(c)
""")
def changepoint_optimality(spark, sf_dir):
    """M2: the optimum's condition of every coefficient (subgradient for changepoints), from the distributed sums."""
    spec, t, _, sums = _plain_fit(spark, sf_dir)
    return FC.optimality(FC.fit_additive(t, spec), sums, spec).select(
        "model_key", "coefficient", "is_changepoint", "satisfied")


@register("additive_fit")
def additive_fit(spark, sf_dir):
    """M1 + M2 + M3 + M16 + X27: per-location additive model, last-168 hold-out metrics record."""
    spec = FC.AdditiveSpec(TARGET_LAGS["P2"])
    model, test = _holdout_fit(spark, sf_dir, spec, reuse_as="p2-default")
    return _metrics(test, spec, model)


@register("importance")
def importance(spark, sf_dir):
    """M14 + X38: standardised lag importances as rows, sorted ascending per model."""
    spec = FC.AdditiveSpec(TARGET_LAGS["P2"])
    t = _training(spark, sf_dir)
    return FC.importance(FC.fit_additive(t, spec), spec)


@register("forecast_24h")
def forecast_24h(spark, sf_dir):
    """M4 + M15: per-location model, 24-step recursive forecast with intervals."""
    spec = FC.AdditiveSpec(TARGET_LAGS["P2"])
    model, test = _holdout_fit(spark, sf_dir, spec, reuse_as="p2-default")
    err = test.groupBy("model_key").agg(F.avg(F.abs(F.col("y") - F.col("yhat"))).alias("mae"),
                                        F.stddev_pop(F.col("y") - F.col("yhat")).alias("rstd"))
    hist = FC.history_arrays(_model_series(spark, sf_dir), "P2", max(50, 24)) \
             .withColumn("model_key", F.concat(F.lit("P2@"), F.col("location").cast("string")))
    j = hist.join(model.join(err, "model_key"), "model_key")
    base_fn, weights = FC.additive_base_and_weights(spec, [1, 2, 3, 4, 5, 24])
    return FC.recursive_forecast(j, 24, base_fn, weights, FC.residual_std_or_default(F.col("rstd"), F.col("mae")))


@register("forecast_transfer")
def forecast_transfer(spark, sf_dir):
    """J9 + Q24: one model fitted on the training location (0) applied to every location, 168 steps."""
    spec = FC.AdditiveSpec(TARGET_LAGS["P2"])
    t = _training(spark, sf_dir).where(F.col("location") == 0).withColumn("model_key", F.lit("P2"))
    model = FC.fit_additive(t, spec)
    hist = FC.history_arrays(_model_series(spark, sf_dir), "P2", max(50, 168))
    # The model table holds one row per target: a proven size bound, so broadcast.
    j = hist.withColumn("model_key", F.lit("P2")).join(F.broadcast(model), "model_key")
    base_fn, weights = FC.additive_base_and_weights(spec, [1, 2, 3, 4, 5, 24])
    return FC.recursive_forecast(j, 168, base_fn, weights, FC.residual_std_or_default(F.lit(None), F.lit(FIXED_MAE)))


@register("exog_variants")
def exog_variants(spark, sf_dir):
    """M7 + A33: additive model with weather regressors vs the seasonal-naive baseline."""
    naive = S.error_metrics(S.seasonal_naive(_model_series(spark, sf_dir), "P2")).select(
        "location", F.col("mae").alias("naive_mae"))
    out = None
    # One feature table shared by the variants; each variant keeps its own
    # complete-row filter and next-row target (M1 semantics per regressor set).
    feats = cut_lineage(add_features(_model_series(spark, sf_dir)))
    for name, extra in [("temp_humidity", ["temperature", "humidity"]), ("temp", ["temperature"]),
                        ("humidity", ["humidity"])]:
        spec = FC.AdditiveSpec(TARGET_LAGS["P2"] + extra)
        training = _training(spark, sf_dir, extra=extra, feats=feats)
        model, test = _holdout_fit(spark, sf_dir, spec, extra=extra, training=training)
        m = test.groupBy("location").agg(F.avg(F.abs(F.col("y") - F.col("yhat"))).alias("model_mae")) \
                .withColumn("variant", F.lit(name))
        out = m if out is None else out.unionByName(m)
    return (out.join(naive, "location", "left")
            .withColumn("improvement_pct", S.improvement_pct(F.col("naive_mae"), F.col("model_mae"))))


@register("fourier_variants")
def fourier_variants(spark, sf_dir):
    """M8: daily order 10 / weekly order 15 vs the default 4 / 3."""
    out = None
    training = cut_lineage(_training(spark, sf_dir))  # identical frame for both variants
    for name, (do, wo) in [("default", (4, 3)), ("high", (10, 15))]:
        spec = FC.AdditiveSpec(TARGET_LAGS["P2"], daily_order=do, weekly_order=wo)
        _, test = _holdout_fit(spark, sf_dir, spec, training=training)
        e = F.col("y") - F.col("yhat")
        m = test.groupBy("location").agg(F.avg(F.abs(e)).alias("mae"),
                                         F.sqrt(F.avg(F.pow(e, 2))).alias("rmse")).withColumn("variant", F.lit(name))
        out = m if out is None else out.unionByName(m)
    return out


# ------------------------------------- additive models that SQL can solve
# Up to four coefficients, so that the oracle solves the normal equations by
# determinants: one lag (M2), a weather regressor (M7), a weekly term (M8).
def _small(lag_cols, weekly_order=0):
    return FC.AdditiveSpec(lag_cols, n_changepoints=0, daily_order=0, weekly_order=weekly_order)


SMALL_MODELS = {"lag": _small(["P2_lag_1"]), "lag_temperature": _small(["P2_lag_1", "temperature"]),
                "lag_humidity": _small(["P2_lag_1", "humidity"]), "weekly": _small([], weekly_order=1)}


def _small_training(spark, sf_dir, feats, spec):
    extra = [c for c in spec.lag_cols if c not in TARGET_LAGS["P2"]]
    return _training(spark, sf_dir, extra=extra, feats=feats)


def _determinant(rows: list[list[str]]) -> str:
    if len(rows) == 1:
        return rows[0][0]
    return "(" + " ".join(f"{'-' if j % 2 else '+'} {x} * {_determinant([r[:j] + r[j + 1:] for r in rows[1:]])}"
                          for j, x in enumerate(rows[0])) + ")"


def _small_sql(name: str, train: str = "is_train") -> str:
    """CTEs of one small model: {name}_x (design rows), {name}_b (coefficients), {name}_p (predictions of all rows)."""
    spec = SMALL_MODELS[name]
    extra = [c for c in spec.lag_cols if c not in TARGET_LAGS["P2"]]
    d, ridge = spec.d, spec.penalties()[0]
    full = " AND ".join(f"{c} IS NOT NULL" for c in ["P2", *TARGET_LAGS["P2"], *extra])
    x = ["1.0", "(epoch(ds) - t0) / greatest(t1 - t0, 1.0)"]
    x += [f"{f}(2 * pi() * {k} / 7.0 * epoch(ds) / 86400.0)" for k in range(1, spec.wo + 1) for f in ("sin", "cos")]
    x += [f"({c} - mu_{c}) / sd_{c}" for c in spec.lag_cols]
    scaling = "".join(f", avg({c}) AS mu_{c}, CASE WHEN stddev_pop({c}) > 0 THEN stddev_pop({c}) ELSE 1.0 END AS sd_{c}"
                      for c in spec.lag_cols)
    sums = ", ".join([f"sum(x{i} * x{j}) + {float(ridge[i]) if i == j else 0.0!r} * count(*) AS s{min(i, j)}{max(i, j)}"
                      for i in range(d) for j in range(i, d)] + [f"sum(x{i} * y / y_scale) AS v{i}" for i in range(d)])
    quad = [[f"s{min(i, j)}{max(i, j)}" for j in range(d)] for i in range(d)]
    solved = ", ".join(f"{_determinant([[f'v{i}' if j == k else quad[i][j] for j in range(d)] for i in range(d)])} "
                       f"/ {_determinant(quad)} AS b{k}" for k in range(d))
    keep = ", ".join(["t0", "t1", "y_scale", *(f"{a}_{c}" for c in spec.lag_cols for a in ("mu", "sd"))])
    return f"""
{name}_m AS (SELECT * FROM (SELECT location, timestamp AS ds, lead(P2, 1) OVER w AS y, {', '.join(dict.fromkeys(['P2', *spec.lag_cols]))}
             FROM f WHERE {full} WINDOW w AS (PARTITION BY location ORDER BY timestamp)) WHERE y IS NOT NULL),
{name}_h AS (SELECT *, row_number() OVER (PARTITION BY location ORDER BY ds) <= count(*) OVER (PARTITION BY location) - 168 AS is_train
             FROM {name}_m),
{name}_s AS (SELECT location, min(epoch(ds)) AS t0, max(epoch(ds)) AS t1, count(*) AS n_train,
                    CASE WHEN max(abs(y)) > 0 THEN max(abs(y)) ELSE 1.0 END AS y_scale{scaling}
             FROM {name}_h WHERE {train} GROUP BY location),
{name}_x AS (SELECT h.location, ds, y, is_train, n_train, {', '.join(f'{e} AS x{i}' for i, e in enumerate(x))}, {keep}
             FROM {name}_h h JOIN {name}_s USING (location)),
{name}_q AS (SELECT location, n_train, {keep}, {sums} FROM {name}_x WHERE {train} GROUP BY ALL),
{name}_b AS (SELECT location, n_train, {keep}, {solved} FROM {name}_q),
{name}_p AS (SELECT x.location, x.ds, x.y, x.is_train, b.n_train, b.y_scale * ({' + '.join(f'b{i} * x{i}' for i in range(d))}) AS yhat
             FROM {name}_x x JOIN {name}_b b USING (location))"""


_SMALL_CHAIN = f"WITH RECURSIVE {lineitem_readings_cte(wide=True)}, {pivot_cte()}, {hourly_cte()}, {features_cte()},"
_QUALITY_SQL = "CASE " + " ".join(f"WHEN mae < {bound} THEN '{label}'" if bound is not None else f"ELSE '{label}'"
                                  for bound, label in MAE_QUALITY) + " END"


@register("small_models", _SMALL_CHAIN + ",".join(_small_sql(name) for name in SMALL_MODELS) + f""",
ps AS (SELECT *, row_number() OVER (PARTITION BY location ORDER BY timestamp) AS rn, count(*) OVER (PARTITION BY location) AS n FROM h),
pf AS (SELECT *, avg(CASE WHEN rn <= floor(0.8 * n) AND rn > floor(0.8 * n) - 24 THEN P2 END) OVER (PARTITION BY location) AS fb FROM ps),
nv AS (SELECT e.location, avg(abs(e.P2 - CASE WHEN t.timestamp IS NOT NULL THEN t.P2 ELSE e.fb END)) AS naive_mae
       FROM pf e LEFT JOIN pf t ON t.location = e.location AND t.timestamp = e.timestamp - INTERVAL 24 HOUR AND t.rn <= floor(0.8 * t.n)
       WHERE e.rn > floor(0.8 * e.n) GROUP BY 1),
mt AS ({' UNION ALL '.join(f"""SELECT '{name}' AS variant, location, n_train, avg(abs(y - yhat)) AS mae,
       sqrt(avg((y - yhat) * (y - yhat))) AS rmse, stddev_pop(y - yhat) AS residual_std
       FROM {name}_p WHERE NOT is_train GROUP BY ALL""" for name in SMALL_MODELS)})
SELECT variant, location, CAST(n_train AS BIGINT) AS n_train, {r6('mae', 'mae')}, {r6('rmse', 'rmse')}, {r6('residual_std', 'residual_std')},
       {_QUALITY_SQL} AS quality, {r6('naive_mae', 'naive_mae')}, {r6('(naive_mae - mae) / naive_mae * 100', 'improvement_pct')}
FROM mt LEFT JOIN nv USING (location)
""")
def small_models(spark, sf_dir):
    """M2 + M3 + M7 + M8 + A33 + X27: additive models of few terms (lag, weather, weekly), fitted per
    location, errors on the last 168 rows beside the seasonal-naive baseline."""
    naive = S.error_metrics(S.seasonal_naive(_model_series(spark, sf_dir), "P2")).select("location", F.col("mae").alias("naive_mae"))
    feats = cut_lineage(add_features(_model_series(spark, sf_dir)))
    out = None
    for name, spec in SMALL_MODELS.items():
        model, test = _holdout_fit(spark, sf_dir, spec, training=_small_training(spark, sf_dir, feats, spec))
        m = (S.error_metrics(test, "y", "yhat").drop("n_eval").withColumn("variant", F.lit(name))
             .withColumn("model_key", F.concat(F.lit("P2@"), F.col("location").cast("string")))
             .join(model.select("model_key", "n_train"), "model_key").drop("model_key"))
        out = m if out is None else out.unionByName(m)
    return (out.withColumn("quality", FC.mae_quality(F.col("mae"))).join(naive, "location", "left")
            .withColumn("improvement_pct", S.improvement_pct(F.col("naive_mae"), F.col("mae"))))


@register("small_model_record", _SMALL_CHAIN + _small_sql("lag_temperature") + f"""
SELECT location, CAST(row_number() OVER (PARTITION BY location ORDER BY ds) AS BIGINT) AS point, ds,
       {r6('y', 'actual')}, {r6('yhat', 'predicted')} FROM lag_temperature_p WHERE NOT is_train
""")
def small_model_record(spark, sf_dir):
    """M1 + M3 + M16: the evaluation record of a fitted model: actual and predicted value of each hold-out row."""
    spec = SMALL_MODELS["lag_temperature"]
    model, test = _holdout_fit(spark, sf_dir, spec,
                               training=_small_training(spark, sf_dir, add_features(_model_series(spark, sf_dir)), spec))
    record = _metrics(test, spec, model)
    points = record.select("location", F.posexplode(F.arrays_zip("test_actual", "test_predicted")).alias("i", "p"))
    times = test.select("location", "ds", (F.row_number().over(
        Window.partitionBy("location").orderBy("ds")) - 1).alias("i"))
    return points.join(times, ["location", "i"]).select(
        "location", (F.col("i") + 1).alias("point"), "ds", F.col("p.test_actual").alias("actual"), F.col("p.test_predicted").alias("predicted"))


@register("small_model_importance", _SMALL_CHAIN + _small_sql("lag_temperature") + f"""
SELECT 'P2@' || CAST(location AS VARCHAR) AS model_key, 'P2_lag_1' AS feature, {r6('abs(b2) * y_scale', 'importance')} FROM lag_temperature_b
UNION ALL
SELECT 'P2@' || CAST(location AS VARCHAR), 'temperature', {r6('abs(b3) * y_scale', 'importance')} FROM lag_temperature_b
""")
def small_model_importance(spark, sf_dir):
    """M14 + X38: standardised importances of a fitted model as rows."""
    spec = SMALL_MODELS["lag_temperature"]
    model, _ = _holdout_fit(spark, sf_dir, spec,
                            training=_small_training(spark, sf_dir, add_features(_model_series(spark, sf_dir)), spec))
    return FC.importance(model, spec)


_TRANSFER_STEPS = 168


@register("small_model_transfer", _SMALL_CHAIN + _small_sql("lag", train="location = 0") + f""",
ff AS (SELECT location, timestamp, last_value(P2 IGNORE NULLS) OVER
         (PARTITION BY location ORDER BY timestamp ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS v FROM h),
la AS (SELECT location, max(timestamp) AS last_ts, arg_max(v, timestamp) AS v FROM ff GROUP BY location),
rec(location, last_ts, step, v) AS (
  SELECT location, last_ts, 0, v FROM la
  UNION ALL
  SELECT r.location, r.last_ts, r.step + 1, greatest(0.0, y_scale * (b0
         + b1 * (epoch(r.last_ts + (r.step + 1) * INTERVAL 1 HOUR) - t0) / greatest(t1 - t0, 1.0) + b2 * (r.v - mu_P2_lag_1) / sd_P2_lag_1))
  FROM rec r, lag_b WHERE r.step < {_TRANSFER_STEPS}),
fc AS (SELECT location, CAST(step AS BIGINT) AS step, last_ts + step * INTERVAL 1 HOUR AS timestamp, v AS predicted,
              1.96 * {_RS} * (1 + 0.04 * least(step - 1, 100)) AS ci FROM rec WHERE step > 0)
SELECT location, step, timestamp, {r6('predicted', 'predicted')}, {r6('greatest(0.0, predicted - ci)', 'lower')},
       {r6('predicted + ci', 'upper')} FROM fc
""")
def small_model_transfer(spark, sf_dir):
    """J9 + M2 + M4: the model fitted on location 0 forecasts every location, 168 steps."""
    spec = SMALL_MODELS["lag"]
    t = _small_training(spark, sf_dir, add_features(_model_series(spark, sf_dir)), spec)
    model = FC.fit_additive(t.where(F.col("location") == 0).withColumn("model_key", F.lit("P2")), spec)
    hist = FC.history_arrays(_model_series(spark, sf_dir), "P2", _TRANSFER_STEPS)
    # The model table holds one row: a proven size bound, so broadcast.
    j = hist.withColumn("model_key", F.lit("P2")).join(F.broadcast(model), "model_key")
    base_fn, weights = FC.additive_base_and_weights(spec, [1])
    return FC.recursive_forecast(j, _TRANSFER_STEPS, base_fn, weights, FC.residual_std_or_default(F.lit(None), F.lit(FIXED_MAE)))
