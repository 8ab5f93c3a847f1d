"""Core queries: hourly pivot, eligibility, manifests, filters, AQI."""

from __future__ import annotations

from pyspark.sql import functions as F

from airseries.functions.aqi import aqi, aqi_category, aqi_category_sql, aqi_sql, who_exceedance
from airseries.functions.timefns import floor_day
from airseries.operators import filters, hourly as H
from airseries.operators.features import add_features
from airseries.plans.oracle import (
    features_cte, hourly_chain, hourly_cte, pivot_cte, r6, readings_cte,
)
from airseries.plans.registry import register
from airseries.plans.snapshot import aqi_snapshot
from airseries.sources.dimension import dim_values_sql, fixture_dim
from airseries.sources.readings import events_readings

HOURLY_COLS = ["P0", "P1", "P2", "humidity", "temperature"]


def _hourly(spark, sf_dir, dense=True):
    return H.hourly_wide(events_readings(spark, sf_dir, dense))


def _r6_all(cols):
    return ", ".join(r6(c, c) for c in cols)


# ------------------------------------------------------------------ hourly
@register("hourly_wide", f"""
WITH {hourly_chain()}
SELECT location, timestamp, {_r6_all(HOURLY_COLS)} FROM h
""")
def hourly_wide(spark, sf_dir):
    """A2+A4: first-in-file-order pivot, then unweighted hourly mean."""
    return _hourly(spark, sf_dir)


@register("hourly_wide_sparse", f"""
WITH {readings_cte(False)}, {pivot_cte()}, {hourly_cte()}
SELECT location, timestamp, {_r6_all(HOURLY_COLS)} FROM h
""")
def hourly_wide_sparse(spark, sf_dir):
    """A2+A4 with one location per user (many sparse series)."""
    return _hourly(spark, sf_dir, dense=False)


@register("eligible_locations", f"""
WITH {readings_cte(False)}
SELECT location, CAST(count(DISTINCT date_trunc('hour', timestamp)) AS BIGINT) AS n_hours
FROM r WHERE location IS NOT NULL GROUP BY location
HAVING count(DISTINCT date_trunc('hour', timestamp)) >= 60
""")
def eligible_locations(spark, sf_dir):
    """Sparse series with >= 60 distinct hours."""
    return H.eligible_locations(events_readings(spark, sf_dir, dense=False), min_hours=60)


@register("location_manifest", f"""
WITH {hourly_chain()},
c AS (SELECT *, count(*) OVER (PARTITION BY location) AS n FROM h)
SELECT location, CAST(count(*) AS BIGINT) AS rows, min(timestamp) AS start, max(timestamp) AS "end"
FROM c WHERE n >= 24 GROUP BY location
""")
def location_manifest(spark, sf_dir):
    """A29 after F14: rows/start/end of each published series."""
    return H.manifest(H.min_rows(_hourly(spark, sf_dir)))


@register("location_profile", f"""
WITH {readings_cte()}
SELECT location, CAST(count(*) AS BIGINT) AS rows,
       CAST(count(DISTINCT sensor_id) AS BIGINT) AS n_sensors,
       string_agg(DISTINCT value_type, ',' ORDER BY value_type) AS value_types
FROM r GROUP BY location
""")
def location_profile(spark, sf_dir):
    """Rows, sensors, value types per location."""
    return (H.location_profile(events_readings(spark, sf_dir))
            .withColumn("value_types", F.array_join("value_types", ",")))


@register("coverage", f"""
WITH {hourly_chain()}
SELECT location, CAST(count(*) AS BIGINT) AS n_points,
       CAST(floor((epoch_us(max(timestamp)) - epoch_us(min(timestamp))) / 86400000000) AS BIGINT) AS span_days,
       round(count(*) / (floor((epoch_us(max(timestamp)) - epoch_us(min(timestamp))) / 86400000000) + 1), 6) AS points_per_day
FROM h GROUP BY location
""")
def coverage(spark, sf_dir):
    """Span in whole days and points per day."""
    return H.coverage(_hourly(spark, sf_dir))


# ----------------------------------------------------------------- filters
@register("last_n_hours", f"""
WITH {hourly_chain()},
c AS (SELECT *, max(timestamp) OVER (PARTITION BY location) AS mx FROM h)
SELECT location, timestamp, {_r6_all(HOURLY_COLS)} FROM c WHERE timestamp >= mx - INTERVAL 24 HOUR
""")
def last_n_hours(spark, sf_dir):
    """last 24 h per location, inclusive of max - 24 h."""
    return filters.last_n_hours(_hourly(spark, sf_dir), 24)


@register("date_range", f"""
WITH {hourly_chain()}
SELECT location, timestamp, {_r6_all(HOURLY_COLS)} FROM h
WHERE timestamp >= TIMESTAMP '2024-01-08 00:00:00' AND timestamp <= TIMESTAMP '2024-01-15 00:00:00' + INTERVAL 1 DAY
""")
def date_range(spark, sf_dir):
    """F8: 2024-01-08 .. 2024-01-15, end day inclusive up to next midnight."""
    return filters.date_range(_hourly(spark, sf_dir), "2024-01-08", "2024-01-15")


@register("date_cutoff_raw", f"""
WITH {readings_cte()}
SELECT location, value_type, CAST(count(*) AS BIGINT) AS n FROM r
WHERE timestamp >= TIMESTAMP '2024-01-08 00:00:00' GROUP BY location, value_type
""")
def date_cutoff_raw(spark, sf_dir):
    """F1 + F4: raw rows at/after the cutoff, counted per location and type."""
    r = filters.date_cutoff(events_readings(spark, sf_dir), "2024-01-08")
    return r.groupBy("location", "value_type").agg(F.count(F.lit(1)).alias("n"))


@register("day_type", f"""
WITH {hourly_chain()}, {features_cte()}
SELECT location, timestamp, periode, {r6('P2', 'P2')} FROM f WHERE periode = 'weekend'
""")
def day_type(spark, sf_dir):
    """weekend rows of the feature series."""
    f = add_features(_hourly(spark, sf_dir))
    return filters.day_type(f, "weekend").select("location", "timestamp", "periode", "P2")


@register("min_rows_per_location", f"""
WITH {readings_cte(False)}, {pivot_cte()}, {hourly_cte()},
c AS (SELECT *, count(*) OVER (PARTITION BY location) AS n FROM h)
SELECT location, CAST(count(*) AS BIGINT) AS rows FROM c WHERE n >= 24 GROUP BY location
""")
def min_rows_per_location(spark, sf_dir):
    """sparse series with at least 24 hourly rows."""
    h = H.min_rows(_hourly(spark, sf_dir, dense=False), 24)
    return h.groupBy("location").agg(F.count(F.lit(1)).alias("rows"))


@register("same_day", f"""
WITH {hourly_chain()}
SELECT location, timestamp, {r6('P2', 'P2')} FROM h WHERE CAST(timestamp AS DATE) = DATE '2024-01-10'
""")
def same_day(spark, sf_dir):
    """one calendar day."""
    return filters.same_day(_hourly(spark, sf_dir), "2024-01-10").select("location", "timestamp", "P2")


# --------------------------------------------------------------------- AQI
@register("aqi_points", f"""
WITH {readings_cte()},
v AS (SELECT ord, value_type, TRY_CAST(value AS DOUBLE) AS c FROM r WHERE value_type IN ('P2', 'P1'))
SELECT ord, value_type, round(c, 6) AS value,
       CASE WHEN value_type = 'P2' THEN {aqi_sql('c', 'PM2.5')} ELSE {aqi_sql('c', 'PM10')} END AS aqi,
       CASE WHEN value_type = 'P2' THEN {aqi_category_sql(aqi_sql('c', 'PM2.5'))}
            ELSE {aqi_category_sql(aqi_sql('c', 'PM10'))} END AS label
FROM v
""")
def aqi_points(spark, sf_dir):
    """X18 + X23 on every raw PM reading, band gaps included."""
    r = events_readings(spark, sf_dir).where(F.col("value_type").isin("P2", "P1"))
    c = F.col("value").try_cast("double")
    idx = F.when(F.col("value_type") == "P2", aqi(c, "PM2.5")).otherwise(aqi(c, "PM10"))
    return (r.select("ord", "value_type", c.alias("value"), idx.alias("aqi"))
            .withColumn("label", aqi_category("aqi").getField("label")))


def _snap_sql(col: str, substance: str) -> str:
    return f"""
WITH {hourly_chain()},
c AS (SELECT location, timestamp, {col} AS v, max(timestamp) OVER (PARTITION BY location) AS mx,
             count(*) OVER (PARTITION BY location) AS n FROM h),
m AS (SELECT location, avg(v) AS mean_value FROM c
      WHERE n >= 24 AND timestamp >= mx - INTERVAL 24 HOUR GROUP BY location),
j AS (SELECT m.location, dim.name, dim.lat, dim.lon, {aqi_sql('m.mean_value', substance)} AS aqi
      FROM m JOIN {dim_values_sql()} ON m.location = dim.location)
SELECT location AS loc_id, name, round(lat, 6) AS lat, round(lon, 6) AS lon, aqi,
       {aqi_category_sql('aqi', 'label')} AS label, {aqi_category_sql('aqi', 'color')} AS color
FROM j
"""


_SNAP_SQL = _snap_sql("P2", "PM2.5")


@register("aqi_snapshot", _SNAP_SQL)
def aqi_snapshot_q(spark, sf_dir):
    """A36 (flagship): AQI of the last-24 h mean for every known location."""
    return aqi_snapshot(_hourly(spark, sf_dir), fixture_dim(spark), "PM2.5")


@register("guideline_exceedance", f"""
WITH {hourly_chain()},
d AS (SELECT location, date_trunc('day', timestamp) AS day, avg(P2) AS pm25, avg(P1) AS pm10 FROM h GROUP BY 1, 2)
SELECT location, day, round(pm25, 6) AS pm25, round(pm10, 6) AS pm10,
       pm25 > 15 AS pm25_exceeds, pm10 > 45 AS pm10_exceeds FROM d
""")
def guideline_exceedance(spark, sf_dir):
    """Daily means against the 24 h guidelines (strict >)."""
    h = _hourly(spark, sf_dir)
    d = h.groupBy("location", floor_day("timestamp").alias("day")).agg(
        F.avg("P2").alias("pm25"), F.avg("P1").alias("pm10"))
    return d.select("location", "day", "pm25", "pm10",
                    who_exceedance("pm25", "PM2.5").alias("pm25_exceeds"),
                    who_exceedance("pm10", "PM10").alias("pm10_exceeds"))


@register("aqi_snapshot_pm10", _snap_sql("P1", "PM10"))
def aqi_snapshot_pm10(spark, sf_dir):
    """A36 for PM10 (P1, PM10 bands): AQI of the last-24 h mean for every known location."""
    return aqi_snapshot(_hourly(spark, sf_dir), fixture_dim(spark), "PM10")
