"""Boosted trees on lag / calendar / weather features.

* Models are those of :mod:`airseries.operators.boosting`, with the defaults of
  the original's library (step 0.3, L2 weight 1).  One model is shared by all
  locations (Q24); rows are pooled, the per-location 80/20 split is kept.
* Grid search (M11) advances every (parameter set, expanding fold) pair in the
  same jobs.  The tuned model (M12, M13) is the grid's winner, refitted on the
  whole training part.
* Recursive evaluation (M13) runs in the JVM: the fitted ensemble is compiled
  into a native ``CASE`` expression inside one ``aggregate`` fold per location,
  for all locations at once.
"""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from airseries.functions.constants import DAY_MAP, PARAM_GRID, PERIOD_MAP
from airseries.functions.timefns import day_name, hour_of_day, period_label
from airseries.operators import boosting as B
from airseries.operators.seasonal import split_80_20
from airseries.sources import sinks

NOTEBOOK_LAGS = [1, 2, 3, 24, 168]


def _map(d: dict, c: Column) -> Column:
    return F.element_at(F.create_map(*[x for k, v in d.items() for x in (F.lit(k), F.lit(v))]), c)


def tree_features(series: DataFrame, target: str = "P2", lags=NOTEBOOK_LAGS, key: str = "location",
                  ts: str = "timestamp") -> DataFrame:
    """Lags by row, hour, X33 day number (unmatched -> 0), X31 period code."""
    w = Window.partitionBy(key).orderBy(ts)
    d = series.withColumns({f"{target}_lag_{n}": F.lag(target, n).over(w) for n in lags})
    return d.withColumns({
        "heure": hour_of_day(ts).cast("double"),
        "jour_semaine_num": F.coalesce(_map(DAY_MAP, day_name(ts)), F.lit(0)).cast("double"),
        "periode_num": _map(PERIOD_MAP, period_label(ts)).cast("double"),
    })


def fit_or_load(spark: SparkSession, path: str | None, fit, force: bool = False) -> DataFrame:
    """M15 for trees: the table of trees kept at ``path`` (see ``sinks.model_path``), else fitted and kept."""
    return sinks.load_or_fit(spark, path, fit, force) if path else fit()


def one_step_eval(series: DataFrame, features, spec: B.Boosting, label: str = "P2", model_path: str | None = None,
                  rounds: int | None = None):
    """Fit on every location's first 80 %, score the last 20 % with true lags (by the first ``rounds`` trees)."""
    s = split_80_20(series).withColumn("_segment", F.when(F.col("is_train"), 0).otherwise(1))
    trees = fit_or_load(series.sparkSession, model_path, lambda: B.fit(
        s, list(features), label, "_segment", ["location", "timestamp"], [spec])[0])
    nodes = trees.where(F.col("model") == spec.name).collect()  # rounds x 2^(depth + 1) rows at most
    test = s.where(~F.col("is_train")).where(F.col(label).isNotNull()).dropna(subset=list(features))
    return trees, test.select("location", "timestamp", F.col(label).alias("actual"),
                              B.predicted(nodes, list(features), rounds).alias("predicted"))


def expanding_segments(series: DataFrame, n_splits: int) -> DataFrame:
    """Training rows with ``_segment``: fold k learns from segments 0 .. k and is scored on k + 1."""
    w = Window.partitionBy("location")
    s = split_80_20(series).where("is_train").drop("rn", "n")
    s = s.withColumn("_rn", F.row_number().over(w.orderBy("timestamp"))).withColumn("_n", F.count(F.lit(1)).over(w))
    size = F.floor(F.col("_n") / F.lit(n_splits + 1))
    first = F.col("_n") - size * F.lit(n_splits)
    # Segment 0 takes the remainder, as expanding splits do; a series shorter than the splits is all segment 0.
    return s.withColumn("_segment", F.when((F.col("_rn") <= first) | (size == 0), 0).otherwise(
        F.ceil((F.col("_rn") - first) / size)).cast("int")).drop("_rn", "_n")


def grid_specs(grid=PARAM_GRID, n_splits: int = 3) -> dict[str, tuple[int, dict, B.Boosting]]:
    """Model name -> (fold, parameters, spec); numbers of trees share one model and are scored on the way."""
    out, most = {}, max(grid["n_estimators"])
    others = [k for k in grid if k != "n_estimators"]
    for values in product(*[grid[k] for k in others]):
        p = dict(zip(others, values))
        for fold in range(n_splits):
            name = "-".join(map(str, [*values, fold]))
            out[name] = fold, p, B.Boosting(name, most, p["max_depth"], p["learning_rate"], p["subsample"],
                                            train_upto=fold, score_at=tuple(grid["n_estimators"]))
    return out


def grid_search(series: DataFrame, features, label: str = "P2", grid=PARAM_GRID, n_splits: int = 3) -> DataFrame:
    """Every parameter combination x expanding fold, mean MAE per combination, best first."""
    spark = series.sparkSession
    specs = grid_specs(grid, n_splits)
    _, scores = B.fit(expanding_segments(series, n_splits), list(features), label, "_segment", ["location", "timestamp"],
                      [s for _, _, s in specs.values()])
    names = ["max_depth", "learning_rate", "subsample"]
    of = spark.createDataFrame([(name, fold, *[p[k] for k in names]) for name, (fold, p, _) in specs.items()],
                               "model STRING, fold INT, max_depth INT, learning_rate DOUBLE, subsample DOUBLE")
    return (scores.join(of, "model").groupBy("max_depth", F.col("rounds").alias("n_estimators"), "learning_rate", "subsample")
            .agg(F.avg("mae").alias("mean_mae"), F.count("fold").alias("n_folds"))
            # 16 rows: a global ordering window is harmless here.
            .withColumn("rank", F.row_number().over(Window.orderBy(
                "mean_mae", "max_depth", "n_estimators", "learning_rate", "subsample"))))


def winner(scores: DataFrame, name: str = "tuned") -> B.Boosting:
    """The spec of the best row of :func:`grid_search`, to be fitted on the whole training part."""
    best = scores.where("rank = 1").first()
    return B.Boosting(name, best["n_estimators"], best["max_depth"], best["learning_rate"], best["subsample"])


def recursive_eval(series: DataFrame, nodes: list, target: str = "P2", history: int = 200, n_eval: int = 168,
                   key: str = "location", ts: str = "timestamp") -> DataFrame:
    """Recursive prediction over the first ``n_eval`` test rows of every
    location, seeded with the last ``history`` training values.  Lags 24/168
    fall back to the *oldest* value when the history is short (notebook
    variant of Q22); hour and weekday come from the real test timestamps.
    ``nodes`` are the rows of one model's trees."""
    s = split_80_20(series.select(key, ts, target))
    w_desc = Window.partitionBy(key).orderBy(F.col(ts).desc())
    hist = (s.where("is_train").withColumn("_k", F.row_number().over(w_desc)).where(F.col("_k") <= history)
            .groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(ts).alias("t"), F.col(target).alias("v"))))
                              .alias("_h")))
    test = (s.where(~F.col("is_train")).where(F.col("rn") <= F.col("split_idx") + n_eval)
            .groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(ts).alias("t"), F.col(target).alias("v"))))
                              .alias("_t")))
    j = hist.join(test, key).select(key, F.transform("_h", lambda x: x["v"]).alias("hist"), "_t")

    def lag(k, fallback):
        return f"CASE WHEN size(acc) >= {k} THEN element_at(acc, -{k}) ELSE element_at(acc, {fallback}) END"

    names = {f"{target}_lag_{n}": f"f.l{n}" for n in NOTEBOOK_LAGS} | {"heure": "f.h", "jour_semaine_num": "f.w"}
    lags = ", ".join(f"{lag(n, -1 if n < 24 else 1)} AS l{n}" for n in NOTEBOOK_LAGS)
    at = "element_at(_t, i + 1).t"
    feats = f"struct({lags}, CAST(hour({at}) AS DOUBLE) AS h, CAST(weekday({at}) AS DOUBLE) AS w)"
    # The feature struct is bound once, then the compiled ensemble is evaluated on it.
    step = f"element_at(transform(array({feats}), f -> {B.compiled(nodes, names)}), 1)"
    path = F.expr(f"aggregate(sequence(0, size(_t) - 1), CAST(hist AS ARRAY<DOUBLE>), "
                  f"(acc, i) -> array_append(acc, greatest(0D, {step})))")
    out = j.withColumn("_p", F.slice(path, -1 * F.size("_t"), F.size("_t")))
    e = out.select(key, "_t", F.posexplode("_p").alias("idx", "predicted"))
    row = F.element_at(F.col("_t"), F.col("idx") + 1)
    return e.select(key, (F.col("idx") + 1).cast("bigint").alias("step"), row["t"].alias(ts),
                    row["v"].alias("actual"), "predicted")
