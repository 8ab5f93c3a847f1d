"""Exploration queries."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from airseries.operators import explore as X
from airseries.operators import hourly as H
from airseries.operators import quantiles as Q
from airseries.operators.features import add_features
from airseries.plans.oracle import features_cte, hourly_chain, lineitem_readings_cte, pivot_cte, hourly_cte, r6, readings_cte, to_double_sql
from airseries.plans.registry import register
from airseries.sources.readings import events_readings, lineitem_readings

HCOLS = ["P0", "P1", "P2", "humidity", "temperature"]
FEAT = f"{hourly_chain()}, {features_cte()}"


def _hourly(spark, sf_dir):
    return H.hourly_wide(events_readings(spark, sf_dir))


def _feat(spark, sf_dir):
    return add_features(_hourly(spark, sf_dir))


@register("selection_stats", f"""
WITH {hourly_chain()}
SELECT location, {r6('avg(P2)', 'mean')}, {r6('min(P2)', 'min')}, {r6('max(P2)', 'max')} FROM h GROUP BY location
""")
def selection_stats(spark, sf_dir):
    """mean/min/max of the selection."""
    return X.selection_stats(_hourly(spark, sf_dir), "P2")


@register("series_stats", f"""
WITH {hourly_chain()}
SELECT location, {r6('avg(P2)', 'mean')}, {r6('stddev_samp(P2)', 'std')}, {r6('min(P2)', 'min')},
       {r6('max(P2)', 'max')}, {r6('quantile_cont(P2, 0.5)', 'median')},
       {r6('quantile_cont(P2, 0.25)', 'q1')}, {r6('quantile_cont(P2, 0.75)', 'q3')}
FROM h GROUP BY location
""")
def series_stats(spark, sf_dir):
    """Exact series statistics per location."""
    return X.series_stats(_hourly(spark, sf_dir), "P2")


_DESC_UNION = " UNION ALL ".join(f"SELECT location, '{c}' AS measure, {c} AS value FROM h" for c in HCOLS)


@register("describe_numeric", f"""
WITH {hourly_chain()}, u AS ({_DESC_UNION})
SELECT location, measure, CAST(count(value) AS BIGINT) AS count, {r6('avg(value)', 'mean')},
  {r6('stddev_samp(value)', 'std')}, {r6('min(value)', 'min')}, {r6('quantile_cont(value, 0.25)', 'p25')},
  {r6('quantile_cont(value, 0.5)', 'p50')}, {r6('quantile_cont(value, 0.75)', 'p75')}, {r6('max(value)', 'max')}
FROM u GROUP BY location, measure
""")
def describe_numeric(spark, sf_dir):
    """describe() of the five measures per location."""
    return X.describe(_hourly(spark, sf_dir), HCOLS)


def _box_sql(by: str) -> str:
    return f"""
WITH {FEAT},
v AS (SELECT location, {by} AS k, P2 FROM f WHERE P2 IS NOT NULL),
q AS (SELECT location, k, quantile_cont(P2, 0.25) AS q1, quantile_cont(P2, 0.5) AS med,
             quantile_cont(P2, 0.75) AS q3 FROM v GROUP BY 1, 2),
j AS (SELECT v.location, v.k, v.P2, q.q1, q.med, q.q3,
             v.P2 >= q.q1 - 1.5 * (q.q3 - q.q1) AND v.P2 <= q.q3 + 1.5 * (q.q3 - q.q1) AS inside
      FROM v JOIN q ON v.location = q.location AND v.k = q.k)
SELECT location, k AS {by}, {r6('any_value(q1)', 'q1')}, {r6('any_value(med)', 'median')}, {r6('any_value(q3)', 'q3')},
  {r6('min(P2) FILTER (WHERE inside)', 'whisker_lo')}, {r6('max(P2) FILTER (WHERE inside)', 'whisker_hi')},
  CAST(count(*) FILTER (WHERE NOT inside) AS BIGINT) AS n_outliers, CAST(count(*) AS BIGINT) AS n,
  {r6('any_value(q3) - any_value(q1)', 'iqr')}
FROM j GROUP BY location, k
"""


@register("box_by_hour", _box_sql("heure"))
def box_by_hour(spark, sf_dir):
    """Box statistics of P2 by hour of day."""
    return X.box_stats(_feat(spark, sf_dir), "P2", "heure")


@register("box_by_day", _box_sql("jour_semaine"))
def box_by_day(spark, sf_dir):
    """Box statistics of P2 by weekday."""
    return X.box_stats(_feat(spark, sf_dir), "P2", "jour_semaine")


_RAW_Q = f"""
WITH {readings_cte()},
v AS (SELECT value_type, CAST(location AS BIGINT) % 2 = 0 AS even, {to_double_sql('value')} AS x FROM r WHERE location IS NOT NULL),
q AS (SELECT value_type, even, quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.5) AS med, quantile_cont(x, 0.75) AS q3
      FROM v WHERE x IS NOT NULL GROUP BY 1, 2),
j AS (SELECT v.*, q1, med, q3, x BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) AS inside
      FROM v JOIN q ON v.value_type = q.value_type AND v.even = q.even WHERE x IS NOT NULL)
"""


def _raw_values(spark, sf_dir):
    """Raw readings: value type, whether the site's number is even, value."""
    return events_readings(spark, sf_dir).where(F.col("location").isNotNull()).select(
        "value_type", (F.col("location") % 2 == 0).alias("even"), H.to_double("value").alias("x"))


@register("raw_stats_by_type", _RAW_Q + f"""
SELECT value_type, even, CAST(count(*) AS BIGINT) AS n, {r6('avg(x)', 'mean')}, {r6('stddev_samp(x)', 'std')},
  {r6('min(x)', 'min')}, {r6('any_value(q1)', 'q1')}, {r6('any_value(med)', 'median')}, {r6('any_value(q3)', 'q3')},
  {r6('max(x)', 'max')} FROM j GROUP BY 1, 2
""")
def raw_stats_by_type(spark, sf_dir):
    """A15 + A16 on the raw readings, exact, by distributed selection."""
    return Q.raw_stats(_raw_values(spark, sf_dir), ["value_type", "even"], "x")


@register("raw_box_by_type", _RAW_Q + f"""
SELECT value_type, even, {r6('any_value(q1)', 'q1')}, {r6('any_value(med)', 'median')}, {r6('any_value(q3)', 'q3')},
  {r6('min(x) FILTER (WHERE inside)', 'whisker_lo')}, {r6('max(x) FILTER (WHERE inside)', 'whisker_hi')},
  CAST(count(*) FILTER (WHERE NOT inside) AS BIGINT) AS n_outliers, CAST(count(*) AS BIGINT) AS n FROM j GROUP BY 1, 2
""")
def raw_box_by_type(spark, sf_dir):
    """A17 on the raw readings, exact, by distributed selection (buckets small enough here to take two passes)."""
    return Q.raw_box(_raw_values(spark, sf_dir), ["value_type", "even"], "x", final_rows=200)


@register("histogram_50", f"""
WITH {hourly_chain()},
v AS (SELECT location, P2, min(P2) OVER (PARTITION BY location) AS mn, max(P2) OVER (PARTITION BY location) AS mx
      FROM h WHERE P2 IS NOT NULL),
b AS (SELECT *, CASE WHEN mx > mn THEN least(CAST(floor((P2 - mn) / ((mx - mn) / 50.0)) AS BIGINT) + 1, 50) ELSE 1 END AS bin,
             (mx - mn) / 50.0 AS width FROM v)
SELECT location, CAST(bin AS BIGINT) AS bin, CAST(count(*) AS BIGINT) AS count,
       {r6('any_value(mn + (bin - 1) * width)', 'lo')}, {r6('any_value(mn + bin * width)', 'hi')}
FROM b GROUP BY location, bin
""")
def histogram_50(spark, sf_dir):
    """50 equal-width bins of P2 per location."""
    return X.histogram(_hourly(spark, sf_dir), "P2", 50)


_PAIRS = list(combinations(HCOLS, 2))
_CORR_UNION = " UNION ALL ".join(
    f"SELECT location, '{a}' AS col_a, '{b}' AS col_b, {r6(f'corr({a}, {b})', 'corr')} FROM h GROUP BY location"
    for a, b in _PAIRS)


@register("corr_matrix", f"WITH {hourly_chain()} {_CORR_UNION}")
def corr_matrix(spark, sf_dir):
    """Pairwise-complete correlation of the five measures."""
    return X.corr_matrix(_hourly(spark, sf_dir), HCOLS)


_LAGS = [f"P2_lag_{n}" for n in (1, 2, 3, 4, 5, 24)]
_CL_UNION = " UNION ALL ".join(
    f"SELECT location, '{c}' AS feature, {r6(f'corr(P2, {c})', 'corr')} FROM f GROUP BY location" for c in _LAGS)


@register("corr_lags", f"WITH {FEAT} {_CL_UNION}")
def corr_lags(spark, sf_dir):
    """Correlation of P2 with each of its lags."""
    return X.corr_with(_feat(spark, sf_dir), "P2", _LAGS)


@register("value_freq_top10", f"""
WITH {FEAT},
c AS (SELECT location, heure, count(*) AS cnt FROM f GROUP BY 1, 2),
rr AS (SELECT *, cnt * 100.0 / sum(cnt) OVER (PARTITION BY location) AS pct,
             row_number() OVER (PARTITION BY location ORDER BY cnt DESC, heure) AS rk FROM c)
SELECT location, heure, CAST(cnt AS BIGINT) AS count, {r6('pct', 'pct')}, CAST(rk AS BIGINT) AS rank FROM rr WHERE rk <= 10
""")
def value_freq_top10(spark, sf_dir):
    """Ten most frequent hours of day per location with percent."""
    return X.value_freq(_feat(spark, sf_dir), "heure", 10)


_NULL_UNION = " UNION ALL ".join(
    f"SELECT '{c}' AS measure, CAST(count(*) FILTER (WHERE {c} IS NULL) AS BIGINT) AS n_null, count(*) AS n FROM h"
    for c in HCOLS)


@register("null_profile", f"""
WITH {hourly_chain()}, u AS ({_NULL_UNION})
SELECT measure, n_null, {r6('n_null * 100.0 / n', 'pct')} FROM u WHERE n_null > 0
""")
def null_profile(spark, sf_dir):
    """NULL count/percent per measure of the hourly table."""
    return X.null_profile(_hourly(spark, sf_dir), HCOLS)


_DCOLS = ["location", "value_type", "sensor_id", "value"]
_DIST_UNION = " UNION ALL ".join(
    f"SELECT '{c}' AS measure, CAST(count(DISTINCT {c}) AS BIGINT) AS n_distinct FROM r" for c in _DCOLS)


@register("distinct_profile", f"WITH {readings_cte()} {_DIST_UNION}")
def distinct_profile(spark, sf_dir):
    """Distinct values per column of the raw readings."""
    return X.distinct_profile(events_readings(spark, sf_dir), _DCOLS)


@register("duplicate_count", f"""
WITH {readings_cte()},
g AS (SELECT location, value_type, value, count(*) AS c FROM r GROUP BY ALL)
SELECT CAST(sum(c - 1) AS BIGINT) AS n_duplicates, CAST(count(*) AS BIGINT) AS n_distinct FROM g
""")
def duplicate_count(spark, sf_dir):
    """Duplicated (location, value_type, value) rows of the raw readings."""
    return X.duplicate_count(events_readings(spark, sf_dir), ["location", "value_type", "value"])


@register("hour_profile", f"""
WITH {FEAT} SELECT location, heure, {r6('avg(P2)', 'mean')} FROM f GROUP BY location, heure
""")
def hour_profile(spark, sf_dir):
    """Mean P2 by hour of day per location."""
    return X.hour_profile(_feat(spark, sf_dir), "P2")


@register("global_profile", f"""
WITH {FEAT}, hp AS (SELECT location, heure, avg(P2) AS mean FROM f GROUP BY location, heure)
SELECT CAST(location AS VARCHAR) AS location, heure, {r6('mean', 'mean')} FROM hp
UNION ALL
SELECT 'global' AS location, heure, {r6('avg(mean)', 'mean')} FROM hp GROUP BY heure
""")
def global_profile(spark, sf_dir):
    """A12 + U3: per-location hour profiles and their unweighted global mean."""
    return X.global_profile(X.hour_profile(_feat(spark, sf_dir), "P2"))


@register("peak_hours", f"""
WITH {FEAT}, hp AS (SELECT location, heure, avg(P2) AS mean FROM f GROUP BY location, heure),
q AS (SELECT * FROM hp WHERE mean IS NOT NULL)
SELECT location, arg_min(heure, (-mean, heure)) AS peak_hour, {r6('max(mean)', 'peak_mean')},
       arg_min(heure, (mean, heure)) AS low_hour, {r6('min(mean)', 'low_mean')}
FROM q GROUP BY location
""")
def peak_hours(spark, sf_dir):
    """Hour of the peak and of the trough (ties -> earliest)."""
    return X.peak_hours(X.hour_profile(_feat(spark, sf_dir), "P2"))


@register("period_mean", f"""
WITH {FEAT} SELECT location, periode, {r6('avg(P2)', 'mean')} FROM f GROUP BY location, periode
""")
def period_mean(spark, sf_dir):
    """Mean P2 on weekdays vs weekend."""
    return X.period_mean(_feat(spark, sf_dir), "P2")


@register("heatmap", f"""
WITH {FEAT},
d AS (SELECT location, heure, P2, CASE jour_semaine WHEN 'Monday' THEN 'Lun' WHEN 'Tuesday' THEN 'Mar'
        WHEN 'Wednesday' THEN 'Mer' WHEN 'Thursday' THEN 'Jeu' WHEN 'Friday' THEN 'Ven'
        WHEN 'Saturday' THEN 'Sam' WHEN 'Sunday' THEN 'Dim' END AS jour_fr FROM f)
SELECT location, jour_fr, heure, {r6('avg(P2)', 'mean')},
  CAST(list_position(['Lun', 'Mar', 'Mer', 'Jeu', 'Ven', 'Sam', 'Dim'], jour_fr) AS BIGINT) AS day_rank
FROM d GROUP BY location, jour_fr, heure
""")
def heatmap(spark, sf_dir):
    """A10: weekday x hour mean of P2 (long form with Monday-first rank)."""
    return X.heatmap(_feat(spark, sf_dir), "P2")


@register("distinct_months", f"""
WITH {lineitem_readings_cte()}, {pivot_cte(types=['P2'])}, {hourly_cte(types=['P2'])}
SELECT location, CAST(count(DISTINCT month(timestamp)) AS BIGINT) AS n_months,
       CAST(count(DISTINCT date_trunc('month', timestamp)) AS BIGINT) AS n_year_months FROM h GROUP BY location
""")
def distinct_months(spark, sf_dir):
    """Distinct calendar months of the multi-year series."""
    return X.distinct_months(H.hourly_wide(lineitem_readings(spark, sf_dir), value_types=["P2"]))


@register("readings_by_type", f"""
WITH {readings_cte()} SELECT value_type, CAST(count(*) AS BIGINT) AS n FROM r GROUP BY value_type
""")
def readings_by_type(spark, sf_dir):
    """raw readings per value type."""
    return events_readings(spark, sf_dir).groupBy("value_type").agg(F.count(F.lit(1)).alias("n"))


_CAT_UNION = " UNION ALL ".join(
    f"SELECT location, '{c}' AS measure, CAST({c} AS VARCHAR) AS value FROM f" for c in ["jour_semaine", "periode"])


@register("describe_categorical", f"""
WITH {FEAT}, u AS ({_CAT_UNION}),
c AS (SELECT location, measure, value, count(*) AS cnt FROM u WHERE value IS NOT NULL GROUP BY 1, 2, 3)
SELECT location, measure, CAST(sum(cnt) AS BIGINT) AS count, CAST(count(*) AS BIGINT) AS "unique",
       arg_min(value, (-cnt, value)) AS top, CAST(max(cnt) AS BIGINT) AS freq
FROM c GROUP BY location, measure
""")
def describe_categorical(spark, sf_dir):
    """A15 (include='all'): count / unique / top / freq of the calendar labels."""
    return X.describe_categorical(_feat(spark, sf_dir), ["jour_semaine", "periode"])
