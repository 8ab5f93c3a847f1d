"""Baseline, split and autocorrelation queries."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from airseries.operators import hourly as H
from airseries.operators import seasonal as S
from airseries.plans.oracle import hourly_chain, r6
from airseries.plans.registry import register
from airseries.sources.readings import events_readings


def _hourly(spark, sf_dir):
    return H.hourly_wide(events_readings(spark, sf_dir))


_POS = """s AS (SELECT location, timestamp, P2, row_number() OVER (PARTITION BY location ORDER BY timestamp) AS rn,
                  count(*) OVER (PARTITION BY location) AS n FROM h)"""

_NAIVE = f"""{_POS},
s2 AS (SELECT *, CAST(floor(0.8 * n) AS BIGINT) AS split_idx FROM s),
s3 AS (SELECT *, rn <= split_idx AS is_train,
              avg(CASE WHEN rn <= split_idx AND rn > split_idx - 24 THEN P2 END) OVER (PARTITION BY location) AS fb
       FROM s2),
tr AS (SELECT location, timestamp, P2 FROM s3 WHERE is_train),
te AS (SELECT * FROM s3 WHERE NOT is_train),
pr AS (SELECT te.location, te.timestamp, te.P2 AS actual,
              CASE WHEN tr.timestamp IS NOT NULL THEN tr.P2 ELSE te.fb END AS predicted
       FROM te LEFT JOIN tr ON te.location = tr.location AND tr.timestamp = te.timestamp - INTERVAL 24 HOUR)"""


@register("seasonal_naive", f"""
WITH {hourly_chain()}, {_NAIVE}
SELECT location, timestamp, {r6('actual', 'actual')}, {r6('predicted', 'predicted')} FROM pr
""")
def seasonal_naive(spark, sf_dir):
    """M6 + J3 + W8 + W14: 24 h seasonal-naive predictions on the 20 % test split."""
    return S.seasonal_naive(_hourly(spark, sf_dir), "P2")


_METRICS = """SELECT location, {mae}, {rmse}, {std}, CAST(count(*) AS BIGINT) AS n_eval
FROM {src} WHERE actual - predicted IS NOT NULL GROUP BY location"""


@register("error_metrics", f"""
WITH {hourly_chain()}, {_NAIVE}
""" + _METRICS.format(mae=r6('avg(abs(actual - predicted))', 'mae'),
                      rmse=r6('sqrt(avg(pow(actual - predicted, 2)))', 'rmse'),
                      std=r6('stddev_pop(actual - predicted)', 'residual_std'), src="pr"))
def error_metrics(spark, sf_dir):
    """MAE / RMSE / residual std of the seasonal-naive baseline."""
    return S.error_metrics(S.seasonal_naive(_hourly(spark, sf_dir), "P2"))


@register("error_metrics_last_week", f"""
WITH {hourly_chain()}, {_NAIVE},
lw AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY location ORDER BY timestamp DESC) AS k FROM pr) WHERE k <= 168)
""" + _METRICS.format(mae=r6('avg(abs(actual - predicted))', 'mae'),
                      rmse=r6('sqrt(avg(pow(actual - predicted, 2)))', 'rmse'),
                      std=r6('stddev_pop(actual - predicted)', 'residual_std'), src="lw"))
def error_metrics_last_week(spark, sf_dir):
    """S9 + W11: baseline errors over the last 168 evaluation rows."""
    p = S.seasonal_naive(_hourly(spark, sf_dir), "P2")
    k = F.row_number().over(Window.partitionBy("location").orderBy(F.col("timestamp").desc()))
    return S.error_metrics(p.withColumn("_k", k).where(F.col("_k") <= 168).drop("_k"))


@register("eval_first_200", f"""
WITH {hourly_chain()}, {_NAIVE},
f AS (SELECT *, row_number() OVER (PARTITION BY location ORDER BY timestamp) AS idx FROM pr)
SELECT location, CAST(idx AS BIGINT) AS idx, timestamp, {r6('actual', 'actual')}, {r6('predicted', 'predicted')}
FROM f WHERE idx <= 200
""")
def eval_first_200(spark, sf_dir):
    """M16 + S7: first 200 evaluation points (actual, predicted) per location."""
    p = S.seasonal_naive(_hourly(spark, sf_dir), "P2")
    idx = F.row_number().over(Window.partitionBy("location").orderBy("timestamp"))
    return p.withColumn("idx", idx).where(F.col("idx") <= 200) \
            .select("location", "idx", "timestamp", "actual", "predicted")


@register("holdout_168", f"""
WITH {hourly_chain()}, {_POS}
SELECT location, CAST(count(*) AS BIGINT) AS n_test, min(timestamp) AS test_start, max(timestamp) AS test_end,
       {r6('avg(P2)', 'test_mean')} FROM s WHERE rn > n - 168 GROUP BY location
""")
def holdout_168(spark, sf_dir):
    """The last 168 rows of every series."""
    h = S.holdout_last(_hourly(spark, sf_dir), 168).where("is_test")
    return h.groupBy("location").agg(F.count(F.lit(1)).alias("n_test"), F.min("timestamp").alias("test_start"),
                                      F.max("timestamp").alias("test_end"), F.avg("P2").alias("test_mean"))


@register("split_80_20", f"""
WITH {hourly_chain()}, {_POS}, s2 AS (SELECT *, CAST(floor(0.8 * n) AS BIGINT) AS split_idx FROM s)
SELECT location, CAST(any_value(n) AS BIGINT) AS n, any_value(split_idx) AS split_idx,
  CAST(count(*) FILTER (WHERE rn <= split_idx) AS BIGINT) AS n_train,
  CAST(count(*) FILTER (WHERE rn > split_idx) AS BIGINT) AS n_test,
  max(timestamp) FILTER (WHERE rn <= split_idx) AS train_end, min(timestamp) FILTER (WHERE rn > split_idx) AS test_start
FROM s2 GROUP BY location
""")
def split_80_20(spark, sf_dir):
    """Chronological 80/20 split per location."""
    s = S.split_80_20(_hourly(spark, sf_dir))
    return s.groupBy("location").agg(
        F.first("n").alias("n"), F.first("split_idx").alias("split_idx"),
        F.count_if(F.col("is_train")).alias("n_train"), F.count_if(~F.col("is_train")).alias("n_test"),
        F.max(F.when(F.col("is_train"), F.col("timestamp"))).alias("train_end"),
        F.min(F.when(~F.col("is_train"), F.col("timestamp"))).alias("test_start"))


@register("ts_folds", f"""
WITH {hourly_chain()}, {_POS},
x AS (SELECT s.*, f.fold, n // 4 AS ts_ FROM s CROSS JOIN range(0, 3) f(fold)),
y AS (SELECT *, CASE WHEN rn <= n - (3 - fold) * ts_ THEN 'train'
                     WHEN rn <= n - (3 - fold) * ts_ + ts_ THEN 'test' END AS role FROM x)
SELECT location, CAST(fold AS BIGINT) AS fold, role, CAST(count(*) AS BIGINT) AS rows,
       min(timestamp) AS first_ts, max(timestamp) AS last_ts
FROM y WHERE role IS NOT NULL GROUP BY 1, 2, 3
""")
def ts_folds(spark, sf_dir):
    """Three expanding-window folds per location."""
    f = S.expanding_folds(_hourly(spark, sf_dir), 3)
    return f.groupBy("location", "fold", "role").agg(
        F.count(F.lit(1)).alias("rows"), F.min("timestamp").alias("first_ts"), F.max("timestamp").alias("last_ts"))


_ACF_CTES = f"""{hourly_chain()},
x AS (SELECT location, P2 - avg(P2) OVER (PARTITION BY location) AS c,
             row_number() OVER (PARTITION BY location ORDER BY timestamp) AS rn FROM h WHERE P2 IS NOT NULL),
nn AS (SELECT location, count(*) AS n FROM x GROUP BY location),
sk AS (SELECT a.location, k.lag, sum(a.c * b.c) AS s FROM x a CROSS JOIN range(0, 49) k(lag)
       JOIN x b ON b.location = a.location AND b.rn = a.rn + k.lag GROUP BY 1, 2),
full_ AS (SELECT nn.location, k.lag, nn.n, coalesce(sk.s, 0) AS s FROM nn CROSS JOIN range(0, 49) k(lag)
          LEFT JOIN sk ON sk.location = nn.location AND sk.lag = k.lag),
a AS (SELECT location, lag, n, s / first_value(s) OVER (PARTITION BY location ORDER BY lag) AS acf FROM full_),
b AS (SELECT *, coalesce(sum(CASE WHEN lag >= 1 THEN acf * acf ELSE 0 END) OVER
        (PARTITION BY location ORDER BY lag ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cum FROM a)"""

# Levinson-Durbin as a recursive CTE over each location's ACF list (r[1] = lag 0).
_LD_A = "((r[k+2] - list_sum(list_transform(range(1, k + 1), lambda i: phi[i] * r[k+2-i]))) / sigma)"
_PACF_SQL = f"""
WITH RECURSIVE {_ACF_CTES},
rl AS (SELECT location, list(acf ORDER BY lag) AS r, any_value(n) AS n FROM b GROUP BY location),
ld(location, k, phi, sigma, pk, r, n) AS (
  SELECT location, 1, [r[2] / r[1]], r[1] * (1 - (r[2] / r[1]) * (r[2] / r[1])), r[2] / r[1], r, n FROM rl
  UNION ALL
  SELECT location, k + 1,
         list_append(list_transform(range(1, k + 1), lambda j: phi[j] - {_LD_A} * phi[k+1-j]), {_LD_A}),
         sigma * (1 - {_LD_A} * {_LD_A}), {_LD_A}, r, n
  FROM ld WHERE k < len(r) - 1)
SELECT location, CAST(0 AS BIGINT) AS lag, CAST(1.0 AS DOUBLE) AS pacf, CAST(0.0 AS DOUBLE) AS band FROM rl
UNION ALL
SELECT location, CAST(k AS BIGINT) AS lag, {r6('pk', 'pacf')}, {r6('1.96 / sqrt(n)', 'band')} FROM ld
"""


@register("acf_48", f"""
WITH {_ACF_CTES}
SELECT location, CAST(lag AS BIGINT) AS lag, {r6('acf', 'acf')},
       {r6('CASE WHEN lag = 0 THEN 0 ELSE 1.96 * sqrt((1 + 2 * cum) / n) END', 'band')}, CAST(n AS BIGINT) AS n
FROM b
""")
def acf_48(spark, sf_dir):
    """Autocorrelation of P2, lags 0..48, with Bartlett bands."""
    return S.acf(_hourly(spark, sf_dir), "P2", 48)


@register("pacf_48", _PACF_SQL)
def pacf_48(spark, sf_dir):
    """Partial autocorrelation (Levinson-Durbin per location on the ACF table)."""
    return S.pacf(S.acf(_hourly(spark, sf_dir), "P2", 48))
