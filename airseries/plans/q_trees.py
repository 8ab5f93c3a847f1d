"""Boosted-tree queries; seed fixed.

The dense multi-year lineitem series is used (one value per location-day), as
for the additive model."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from airseries.operators import boosting as B
from airseries.operators import hourly as H
from airseries.operators import seasonal as S
from airseries.operators import trees as TR
from airseries.plans.oracle import hourly_cte, lineitem_readings_cte, pivot_cte, r6
from airseries.plans.registry import register
from airseries.session import cut_lineage
from airseries.sources import sinks
from airseries.sources.readings import lineitem_wide_readings

LAGS5 = [f"P2_lag_{n}" for n in TR.NOTEBOOK_LAGS]
ALL_FEATS = ["humidity", "temperature", "heure", "jour_semaine_num", "periode_num"] + LAGS5
REC_FEATS = LAGS5 + ["heure", "jour_semaine_num"]
LAG_MODEL = B.Boosting("lags", rounds=100, depth=3)
FEATURE_MODEL = B.Boosting("features", rounds=150, depth=4)


def _path(spark, sf_dir, name, params):
    """Where a model of this data and these parameters is kept."""
    return sinks.model_path(spark, f"gbt-{name}", [f"{sf_dir}/lineitem.parquet"], params)


def _series(spark, sf_dir):
    h = H.hourly_wide(lineitem_wide_readings(spark, sf_dir), value_types=["P2", "temperature", "humidity"])
    return TR.tree_features(h)


def _naive(spark, sf_dir):
    return S.error_metrics(S.seasonal_naive(_series(spark, sf_dir), "P2")).select("location", F.col("mae").alias("naive_mae"))


def _with_baseline(spark, sf_dir, pred, name):
    m = S.error_metrics(pred).select("location", F.col("mae").alias("model_mae"), "rmse", "n_eval")
    return (m.join(_naive(spark, sf_dir), "location", "left").withColumn("model", F.lit(name))
            .withColumn("improvement_pct", S.improvement_pct(F.col("naive_mae"), F.col("model_mae"))))


def _lag_model(spark, sf_dir):
    return TR.one_step_eval(_series(spark, sf_dir), LAGS5, LAG_MODEL, model_path=_path(spark, sf_dir, "lags", vars(LAG_MODEL)))


def _feature_model(spark, sf_dir):
    return TR.one_step_eval(_series(spark, sf_dir), ALL_FEATS, FEATURE_MODEL,
                            model_path=_path(spark, sf_dir, "features", vars(FEATURE_MODEL)))


def _recursive_vs_one_step(rec, one):
    mr = rec.groupBy("location").agg(F.avg(F.abs(F.col("actual") - F.col("predicted"))).alias("mae_recursive"),
                                     F.count(F.lit(1)).alias("n_steps"))
    mo = S.error_metrics(one).select("location", F.col("mae").alias("mae_one_step"))
    return mr.join(mo, "location").withColumn("ratio", F.col("mae_recursive") / F.col("mae_one_step"))


def _grid(spark, sf_dir):
    """The grid's scores, kept like a model: the tuned queries reuse them."""
    path = _path(spark, sf_dir, "grid", TR.PARAM_GRID | {"features": REC_FEATS})
    return sinks.load_or_fit(spark, path, lambda: TR.grid_search(cut_lineage(_series(spark, sf_dir)), REC_FEATS).coalesce(1))


def _tuned(spark, sf_dir):
    spec = TR.winner(_grid(spark, sf_dir))
    series = cut_lineage(_series(spark, sf_dir))
    trees, one = TR.one_step_eval(series, REC_FEATS, spec, model_path=_path(spark, sf_dir, "tuned", vars(spec)))
    return series, trees, one


@register("gbt_lags")
def gbt_lags(spark, sf_dir):
    """M9 + A33: 100 trees, depth 3 on the five P2 lags; MAE vs seasonal naive."""
    return _with_baseline(spark, sf_dir, _lag_model(spark, sf_dir)[1], "gbt_lags")


@register("gbt_features")
def gbt_features(spark, sf_dir):
    """M10 + X31-X33: 150 trees, depth 4 on lags + calendar + weather."""
    return _with_baseline(spark, sf_dir, _feature_model(spark, sf_dir)[1], "gbt_features")


#: Features in SQL, over the hourly series with its window ``w``.
_FEATURE_SQL = {f"P2_lag_{n}": f"lag(P2, {n}) OVER w" for n in TR.NOTEBOOK_LAGS} | {
    "humidity": "humidity", "temperature": "temperature", "heure": "CAST(hour(timestamp) AS DOUBLE)",
    "jour_semaine_num": "CAST(isodow(timestamp) - 1 AS DOUBLE)",
    "periode_num": "CASE WHEN isodow(timestamp) >= 6 THEN 1.0 ELSE 0.0 END"}


def _rows_sql(features, n_splits: int = 0) -> str:
    """Complete rows ``tr`` of the training part with their segment, and the bin edges ``ed`` of the features."""
    types = ["P2", "temperature", "humidity"]
    size = f"floor(m / {n_splits + 1})"
    first = f"(m - {size} * {n_splits})"
    return f"""
{lineitem_readings_cte(wide=True)}, {pivot_cte(types=types)}, {hourly_cte(types=types)},
ln AS (SELECT location, timestamp, P2, {', '.join(f'{_FEATURE_SQL[f]} AS f{i}' for i, f in enumerate(features))},
              row_number() OVER w AS rn, count(*) OVER (PARTITION BY location) AS n
       FROM h WINDOW w AS (PARTITION BY location ORDER BY timestamp)),
tp AS (SELECT *, row_number() OVER (PARTITION BY location ORDER BY timestamp) AS k, count(*) OVER (PARTITION BY location) AS m
       FROM ln WHERE rn <= floor(n * 0.8)),
tr AS (SELECT row_number() OVER () AS id, P2 AS y, {', '.join(f'f{i}' for i in range(len(features)))},
              CASE WHEN k <= {first} OR {size} = 0 THEN 0 ELSE ceil((k - {first}) / {size}) END AS seg
       FROM tp WHERE P2 IS NOT NULL AND {' AND '.join(f'f{i} IS NOT NULL' for i in range(len(features)))}),
fv AS ({' UNION ALL '.join(f"SELECT id, seg, {i} AS fi, '{f}' AS f, f{i} AS x FROM tr" for i, f in enumerate(features))}),
sv AS (SELECT fi, x, row_number() OVER (PARTITION BY fi ORDER BY x) - 1 AS k, count(*) OVER (PARTITION BY fi) AS c
       FROM fv WHERE seg <= {max(n_splits - 1, 0)}),
ed AS (SELECT DISTINCT fi, x AS edge FROM sv WHERE k IN (SELECT floor(i * (c - 1) / {B.BINS}) FROM range(1, {B.BINS}) t(i))),
md AS (SELECT m, avg(y) AS base FROM tr, range({max(n_splits, 1)}) f(m) WHERE seg <= m GROUP BY m),
g0 AS (SELECT id, m, y, base - y AS g, seg <= m AS fit, seg = m + 1 AS scored, 0 AS node FROM tr, md WHERE seg <= m + 1)"""


def _level_sql(level: int) -> str:
    """Best split of every node of a level, per model ``m``, and the rows' nodes below it."""
    return f""",
t{level} AS (SELECT m, node, sum(g) AS g, count(*) AS n FROM g{level} WHERE fit GROUP BY 1, 2),
c{level} AS (SELECT g.m, g.node, v.fi, v.f, e.edge, sum(g.g) AS gl, count(*) AS nl
             FROM g{level} g JOIN fv v USING (id) JOIN ed e ON e.fi = v.fi AND v.x <= e.edge WHERE g.fit GROUP BY 1, 2, 3, 4, 5),
s{level} AS (SELECT c.m, c.node, c.fi, c.f, c.edge,
                    gl * gl / (nl + 1) + (t.g - gl) * (t.g - gl) / (t.n - nl + 1) - t.g * t.g / (t.n + 1) AS gain
             FROM c{level} c JOIN t{level} t USING (m, node) WHERE t.n - nl >= 1),
b{level} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY m, node ORDER BY round(gain, 6) DESC, fi, edge) AS r
             FROM s{level} WHERE gain > 1e-6) WHERE r = 1),
g{level + 1} AS (SELECT g.* REPLACE (2 * g.node + CASE WHEN v.x > b.edge THEN 1 ELSE 0 END AS node)
                 FROM g{level} g JOIN b{level} b USING (m, node) JOIN fv v ON v.id = g.id AND v.fi = b.fi)"""


def _tree_sql(features, depth: int, n_splits: int = 0) -> str:
    """CTEs of the first tree of every model: t (nodes), b (splits) and g (rows) of each level."""
    return ("WITH RECURSIVE " + _rows_sql(features, n_splits) + "".join(_level_sql(k) for k in range(depth)) + f""",
t{depth} AS (SELECT m, node, sum(g) AS g, count(*) AS n FROM g{depth} WHERE fit GROUP BY 1, 2),
b{depth} AS (SELECT * FROM b{depth - 1} WHERE false)""")


def _node_sql(level: int) -> str:
    return (f"SELECT CAST({level} AS BIGINT) AS level, CAST(t.node AS BIGINT) AS node, b.f AS feature, {r6('b.edge', 'threshold')}, "
            f"{r6('b.gain', 'gain')}, CAST(t.n AS DOUBLE) AS rows, "
            f"CASE WHEN b.f IS NULL THEN round(-0.3 * t.g / (t.n + 1), 6) END AS value "
            f"FROM t{level} t LEFT JOIN b{level} b USING (m, node)")


def _first_tree(trees):
    return trees.where("tree = 0").select("level", "node", "feature", "threshold", "gain", "rows", "value")


@register("gbt_first_tree", _tree_sql(LAGS5, 3) + " " + " UNION ALL ".join(_node_sql(k) for k in range(4)))
def gbt_first_tree(spark, sf_dir):
    """M9: the first tree of the lag model: splits, gains, leaf values."""
    return _first_tree(_lag_model(spark, sf_dir)[0])


@register("gbt_features_first_tree", _tree_sql(ALL_FEATS, 4) + " " + " UNION ALL ".join(_node_sql(k) for k in range(5)))
def gbt_features_first_tree(spark, sf_dir):
    """M10 + X31-X33: the first tree of the model on lags, calendar and weather."""
    return _first_tree(_feature_model(spark, sf_dir)[0])


@register("gbt_first_tree_importance", _tree_sql(LAGS5, 3) + f""",
mg AS (SELECT f, avg(gain) AS g FROM ({' UNION ALL '.join(f'SELECT f, gain FROM b{k}' for k in range(3))}) GROUP BY f)
SELECT n.f AS feature, {r6('coalesce(g / (SELECT sum(g) FROM mg), 0)', 'importance')}
FROM (VALUES {', '.join(f"('{f}')" for f in LAGS5)}) n(f) LEFT JOIN mg USING (f)
""")
def gbt_first_tree_importance(spark, sf_dir):
    """Importances of the lag model cut after its first tree."""
    return B.importance(_lag_model(spark, sf_dir)[0].where("tree = 0"), LAGS5)


def _leaves_sql(depth: int) -> str:
    """``lv``: value of each leaf of the first tree and, per lag, the open and closed end of the rows it holds."""
    leaves = " UNION ALL ".join(f"SELECT {k} AS level, t.node, -0.3 * t.g / (t.n + 1) AS value FROM t{k} t "
                                f"LEFT JOIN b{k} b USING (m, node) WHERE b.f IS NULL" for k in range(depth + 1))
    ends = " UNION ALL ".join(f"SELECT l.level, l.node, b.fi, b.edge, (l.node >> (l.level - {k + 1})) % 2 = 1 AS above "
                              f"FROM lf l JOIN b{k} b ON l.level > {k} AND b.node = l.node >> (l.level - {k})" for k in range(depth))
    inf = "CAST('Infinity' AS DOUBLE)"
    cut = ", ".join(f"coalesce(max(edge) FILTER (WHERE fi = {i} AND above), -{inf}) AS lo{i}, "
                    f"coalesce(min(edge) FILTER (WHERE fi = {i} AND NOT above), {inf}) AS hi{i}" for i in range(len(LAGS5)))
    return f"""
lf AS ({leaves}),
ends AS ({ends}),
lv AS (SELECT lf.level, lf.node, any_value(value) AS value, {cut} FROM lf LEFT JOIN ends USING (level, node) GROUP BY 1, 2)"""


_IN_LEAF = " AND ".join(f"r.f{i} > lv.lo{i} AND r.f{i} <= lv.hi{i}" for i in range(len(LAGS5)))
_LAST = ", ".join(f"CASE WHEN len(hs) >= {n} THEN hs[-{n}] ELSE hs[{-1 if n < 24 else 1}] END AS f{i}"
                  for i, n in enumerate(TR.NOTEBOOK_LAGS))


@register("first_tree_recursion", _tree_sql(LAGS5, 3) + "," + _leaves_sql(3) + f""",
te AS (SELECT location, P2 AS y, rn - floor(n * 0.8) AS step, * EXCLUDE (location, P2) FROM ln WHERE rn > floor(n * 0.8)),
one AS (SELECT location, avg(abs(y - (base + value))) AS mae_one_step FROM te r JOIN lv ON {_IN_LEAF}, md
        WHERE y IS NOT NULL GROUP BY 1),
hist AS (SELECT location, list(P2 ORDER BY timestamp) AS hs FROM ln WHERE rn <= floor(n * 0.8) AND rn > floor(n * 0.8) - 200 GROUP BY 1),
rec(location, step, hs) AS (
  SELECT location, 0, hs FROM hist
  UNION ALL
  SELECT r.location, r.step + 1, list_append(r.hs, greatest(0.0, base + lv.value))
  FROM (SELECT *, {_LAST} FROM rec WHERE step < 168) r JOIN lv ON {_IN_LEAF}, md),
mr AS (SELECT te.location, avg(abs(y - hs[-1])) AS mae_recursive, CAST(count(*) AS BIGINT) AS n_steps
       FROM te JOIN rec ON rec.location = te.location AND rec.step = te.step GROUP BY 1)
SELECT location, {r6('mae_recursive', 'mae_recursive')}, n_steps, {r6('mae_one_step', 'mae_one_step')},
       {r6('mae_recursive / mae_one_step', 'ratio')} FROM mr JOIN one USING (location)
""")
def first_tree_recursion(spark, sf_dir):
    """M9 + M13 + A38: the lag model cut after its first tree: recursive 168-step and one-step errors."""
    series = _series(spark, sf_dir)
    trees, one = TR.one_step_eval(series, LAGS5, LAG_MODEL, model_path=_path(spark, sf_dir, "lags", vars(LAG_MODEL)), rounds=1)
    return _recursive_vs_one_step(TR.recursive_eval(series, trees.where("tree = 0").collect()), one)


#: A grid whose every model can be followed in SQL (fixed values): one round each.
SMALL_GRID = {"max_depth": [1, 2], "n_estimators": [1], "learning_rate": [0.1, 0.3], "subsample": [1.0]}


def _scored_sql(depth: int) -> str:
    """Scored rows with the value of their leaf in a tree of ``depth`` levels, step 1."""
    return " UNION ALL ".join(
        f"SELECT {depth} AS depth, g.m, g.y, -t.g / (t.n + 1) AS value FROM g{k} g JOIN t{k} t USING (m, node) "
        + (f"LEFT JOIN b{k} b USING (m, node) WHERE g.scored AND b.f IS NULL" if k < depth else "WHERE g.scored")
        for k in range(depth + 1))


@register("grid_first_round", _tree_sql(LAGS5, 2, n_splits=3) + f""",
sc AS ({' UNION ALL '.join(_scored_sql(d) for d in SMALL_GRID['max_depth'])}),
fold AS (SELECT depth, eta, m, avg(abs(y - (base + eta * value))) AS mae
         FROM sc JOIN md USING (m), (VALUES {', '.join(f'({e})' for e in SMALL_GRID['learning_rate'])}) e(eta) GROUP BY 1, 2, 3),
mean AS (SELECT depth, eta, avg(mae) AS mean_mae, count(*) AS n_folds FROM fold GROUP BY 1, 2)
SELECT CAST(depth AS BIGINT) AS max_depth, CAST(1 AS BIGINT) AS n_estimators, CAST(eta AS DOUBLE) AS learning_rate,
       CAST(1.0 AS DOUBLE) AS subsample, {r6('mean_mae', 'mean_mae')}, CAST(n_folds AS BIGINT) AS n_folds,
       CAST(row_number() OVER (ORDER BY mean_mae, depth, eta) AS BIGINT) AS rank FROM mean
""")
def grid_first_round(spark, sf_dir):
    """A grid of one-round models over three expanding folds, ranked by mean MAE."""
    return TR.grid_search(cut_lineage(_series(spark, sf_dir)), LAGS5, grid=SMALL_GRID)


@register("grid_search")
def grid_search(spark, sf_dir):
    """16 parameter sets x 3 expanding folds on lags + hour + weekday, ranked by mean MAE."""
    return _grid(spark, sf_dir)


@register("tuned_eval")
def tuned_eval(spark, sf_dir):
    """M12 + A33: errors per location of the seasonal-naive baseline, the plain lag model and the
    grid's winner, and of the winner over the last week."""
    _, _, tuned = _tuned(spark, sf_dir)
    plain = S.error_metrics(_lag_model(spark, sf_dir)[1]).select("location", F.col("mae").alias("plain_mae"))
    mae = S.error_metrics(tuned).select("location", F.col("mae").alias("tuned_mae"))
    k = F.row_number().over(Window.partitionBy("location").orderBy(F.col("timestamp").desc()))
    week = S.error_metrics(tuned.withColumn("_k", k).where(F.col("_k") <= 168).drop("_k")).select(
        "location", F.col("mae").alias("tuned_mae_last_week"))
    out = _naive(spark, sf_dir).join(plain, "location").join(mae, "location").join(week, "location")
    return (out.withColumn("plain_vs_naive_pct", S.improvement_pct(F.col("naive_mae"), F.col("plain_mae")))
            .withColumn("tuned_vs_naive_pct", S.improvement_pct(F.col("naive_mae"), F.col("tuned_mae")))
            .withColumn("tuned_vs_plain_pct", S.improvement_pct(F.col("plain_mae"), F.col("tuned_mae"))))


@register("recursive_eval")
def recursive_eval(spark, sf_dir):
    """M13 + A38: recursive 168-step evaluation of the tuned model vs its one-step MAE, per location."""
    series, trees, one = _tuned(spark, sf_dir)
    return _recursive_vs_one_step(TR.recursive_eval(series, trees.collect()), one)


@register("gbt_importance")
def gbt_importance(spark, sf_dir):
    """Feature importances of the lag model."""
    return B.importance(_lag_model(spark, sf_dir)[0], LAGS5)
