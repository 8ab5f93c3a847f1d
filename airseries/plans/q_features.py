"""Feature queries: lags, targets, rolling, interpolation, calendar, parsing."""

from __future__ import annotations

from pyspark.sql import functions as F

from airseries.functions import timefns as TF
from airseries.functions.constants import LAGS, TARGET_LAGS
from airseries.operators import chunks as CH
from airseries.operators import features as FE
from airseries.operators import hourly as H
from airseries.plans.oracle import features_cte, hourly_chain, hourly_cte, lineitem_readings_cte, pivot_cte, r6
from airseries.plans.registry import register
from airseries.sources.readings import events_readings, events_readings_sql, lineitem_readings, table

LAG_COLS = [f"{v}_lag_{n}" for v in ("P0", "P1", "P2") for n in LAGS]
BASE = ["P0", "P1", "P2", "humidity", "temperature"]


def _hourly(spark, sf_dir):
    return H.hourly_wide(events_readings(spark, sf_dir))


def _feat(spark, sf_dir):
    return FE.add_features(_hourly(spark, sf_dir))


_ALL = ", ".join(r6(c, c) for c in BASE + LAG_COLS)


@register("lags_all", f"""
WITH {hourly_chain()}, {features_cte()}
SELECT location, timestamp, heure, jour_semaine, periode, {_ALL} FROM f
""")
def lags_all(spark, sf_dir):
    """W1 + F11 + W3 + calendar: the processing run's full feature table."""
    return _feat(spark, sf_dir)


_P2L = TARGET_LAGS["P2"]


@register("next_hour_target", f"""
WITH {lineitem_readings_cte()}, {pivot_cte()}, {hourly_cte()}, {features_cte()},
b AS (SELECT * FROM f WHERE {' AND '.join(c + ' IS NOT NULL' for c in _P2L + ['P2'])}),
t AS (SELECT location, timestamp AS ds, lead(P2, 1) OVER (PARTITION BY location ORDER BY timestamp) AS y,
             {', '.join(_P2L)} FROM b)
SELECT location, ds, {r6('y', 'y')}, {', '.join(r6(c, c) for c in _P2L)} FROM t WHERE y IS NOT NULL
""")
def next_hour_target(spark, sf_dir):
    """M1: complete rows only, then y = next surviving row's P2, ds naive (multi-year series)."""
    f = FE.add_features(H.hourly_wide(lineitem_readings(spark, sf_dir)))
    return FE.next_row_target(f, "P2", _P2L).select("location", "ds", "y", *_P2L)


_LONG_SQL = f"""
WITH r AS (SELECT * REPLACE (CAST(0 AS BIGINT) AS location) FROM ({events_readings_sql()})), {pivot_cte()}
"""
#: Small enough that the query's series has many chunks; ``chunks.CHUNK_ROWS`` is the working size.
_CHUNK = 1000


def _long_series(spark, sf_dir):
    """All raw readings as one sensor: a row per timestamp, far more than an hourly series has."""
    r = events_readings(spark, sf_dir).withColumn("location", F.lit(0).cast("bigint"))
    return H.pivot_first(r)


@register("lags_long_series", _LONG_SQL + f"""
SELECT location, timestamp, {r6('P2', 'P2')}, {', '.join(r6(f'lag(P2, {n}) OVER w', f'P2_lag_{n}') for n in (1, 5, 24))},
       {r6('avg(P2) OVER w24', 'P2_roll_mean')}, {r6('stddev_samp(P2) OVER w24', 'P2_roll_std')}
FROM p WINDOW w AS (PARTITION BY location ORDER BY timestamp),
              w24 AS (PARTITION BY location ORDER BY timestamp ROWS BETWEEN 23 PRECEDING AND CURRENT ROW)
""")
def lags_long_series(spark, sf_dir):
    """W1 + W5 + W6 over chunks with halos: equal to the plain windows over the whole series."""
    p = _long_series(spark, sf_dir).select("location", "timestamp", "P2")
    out = CH.rolling(CH.add_lags(p, ["P2"], [1, 5, 24], chunk_rows=_CHUNK), "P2", 24, chunk_rows=_CHUNK)
    return out.select("location", "timestamp", "P2", "P2_lag_1", "P2_lag_5", "P2_lag_24", "P2_roll_mean", "P2_roll_std")


@register("interp_long_series", _LONG_SQL + f""",
s0 AS (SELECT location, timestamp, P2, P0, CAST(row_number() OVER w AS DOUBLE) AS n, CAST(epoch_us(timestamp) AS DOUBLE) AS t
       FROM p WINDOW w AS (PARTITION BY location ORDER BY timestamp)),
s1 AS (SELECT *, {', '.join(f"last_value(CASE WHEN {c} IS NOT NULL THEN {x} END IGNORE NULLS) OVER f AS {c}_a{x}, "
                           f"first_value(CASE WHEN {c} IS NOT NULL THEN {x} END IGNORE NULLS) OVER b AS {c}_b{x}, "
                           f"last_value({c} IGNORE NULLS) OVER f AS {c}_av, first_value({c} IGNORE NULLS) OVER b AS {c}_bv"
                           for c, x in (('P2', 'n'), ('P0', 't')))}
       FROM s0 WINDOW f AS (PARTITION BY location ORDER BY timestamp ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
                      b AS (PARTITION BY location ORDER BY timestamp ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT location, timestamp, {', '.join(r6(f"CASE WHEN {c} IS NOT NULL THEN {c} WHEN {c}_a{x} IS NULL THEN NULL "
       f"WHEN {c}_b{x} IS NULL THEN {c}_av ELSE {c}_av + ({c}_bv - {c}_av) * ({x} - {c}_a{x}) / ({c}_b{x} - {c}_a{x}) END", c)
       for c, x in (('P2', 'n'), ('P0', 't')))} FROM s1
""")
def interp_long_series(spark, sf_dir):
    """W3 + W4 over chunks with carried neighbours: P2 by position, P0 by elapsed time."""
    p = _long_series(spark, sf_dir).select("location", "timestamp", "P2", "P0")
    return CH.interpolate(CH.interpolate(p, "P2", chunk_rows=_CHUNK), "P0", method="time", chunk_rows=_CHUNK)


@register("rolling_24", f"""
WITH {hourly_chain()},
g AS (SELECT location, timestamp, P2,
        avg(P2) OVER w AS m, stddev_samp(P2) OVER w AS s FROM h
      WINDOW w AS (PARTITION BY location ORDER BY timestamp ROWS BETWEEN 23 PRECEDING AND CURRENT ROW))
SELECT location, timestamp, {r6('P2', 'P2')}, {r6('m', 'P2_roll_mean')}, {r6('s', 'P2_roll_std')},
       {r6('m - s', 'P2_band_lo')}, {r6('m + s', 'P2_band_hi')} FROM g
""")
def rolling_24(spark, sf_dir):
    """24-row rolling mean, sample std and +-1 sigma band of P2."""
    return FE.rolling(_hourly(spark, sf_dir).select("location", "timestamp", "P2"), "P2", 24)


def _interp_sql(pos_expr: str) -> str:
    return f"""
WITH {hourly_chain()},
s0 AS (SELECT location, timestamp, P2, CAST({pos_expr} AS DOUBLE) AS pos FROM h),
s1 AS (SELECT *,
  last_value(CASE WHEN P2 IS NOT NULL THEN pos END IGNORE NULLS) OVER (PARTITION BY location ORDER BY timestamp ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS a_p,
  last_value(P2 IGNORE NULLS) OVER (PARTITION BY location ORDER BY timestamp ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS a_v,
  first_value(CASE WHEN P2 IS NOT NULL THEN pos END IGNORE NULLS) OVER (PARTITION BY location ORDER BY timestamp ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS b_p,
  first_value(P2 IGNORE NULLS) OVER (PARTITION BY location ORDER BY timestamp ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS b_v
  FROM s0)
SELECT location, timestamp,
  {r6("CASE WHEN P2 IS NOT NULL THEN P2 WHEN a_p IS NULL THEN NULL WHEN b_p IS NULL THEN a_v ELSE a_v + (b_v - a_v) * (pos - a_p) / (b_p - a_p) END", "P2")}
FROM s1
"""


@register("interp_linear", _interp_sql("row_number() OVER (PARTITION BY location ORDER BY timestamp)"))
def interp_linear(spark, sf_dir):
    """P2 gaps filled linearly by row position."""
    h = _hourly(spark, sf_dir).select("location", "timestamp", "P2")
    return FE.interpolate(h, "P2", method="linear")


@register("interp_time", _interp_sql("epoch_us(timestamp)"))
def interp_time(spark, sf_dir):
    """P2 gaps filled by elapsed time."""
    h = _hourly(spark, sf_dir).select("location", "timestamp", "P2")
    return FE.interpolate(h, "P2", method="time")


@register("temperature_sanitised", f"""
WITH {hourly_chain()}, {features_cte()}
SELECT location, timestamp, {r6('temperature', 'temperature')} FROM f
""")
def temperature_sanitised(spark, sf_dir):
    """F11 + W3: > 60 -> NULL, then linear interpolation."""
    h = _hourly(spark, sf_dir).select("location", "timestamp", "temperature")
    return FE.clean_temperature(h)


@register("calendar_features", f"""
WITH {hourly_chain()}
SELECT location, timestamp,
  CAST(hour(timestamp) AS BIGINT) AS heure, dayname(timestamp) AS jour_semaine,
  CASE WHEN isodow(timestamp) >= 6 THEN 'weekend' ELSE 'semaine' END AS periode,
  CAST(year(timestamp) AS BIGINT) AS year, CAST(month(timestamp) AS BIGINT) AS month,
  CAST(day(timestamp) AS BIGINT) AS day, CAST(isodow(timestamp) - 1 AS BIGINT) AS weekday,
  isodow(timestamp) >= 6 AS is_weekend,
  CASE dayname(timestamp) WHEN 'Monday' THEN 'Lun' WHEN 'Tuesday' THEN 'Mar' WHEN 'Wednesday' THEN 'Mer'
    WHEN 'Thursday' THEN 'Jeu' WHEN 'Friday' THEN 'Ven' WHEN 'Saturday' THEN 'Sam' ELSE 'Dim' END AS jour_fr,
  CAST(timestamp AS DATE) AS date
FROM h
""")
def calendar_features(spark, sf_dir):
    """Calendar columns of the hourly series."""
    h = _hourly(spark, sf_dir).select("location", "timestamp")
    return FE.add_calendar(h).withColumns({
        "year": F.year("timestamp"), "month": F.month("timestamp"), "day": F.dayofmonth("timestamp"),
        "weekday": TF.weekday_mon0("timestamp"), "is_weekend": TF.is_weekend("timestamp"),
        "jour_fr": TF.day_fr(F.col("jour_semaine")), "date": F.to_date("timestamp"),
    })


@register("parse_times", """
SELECT event_id,
  CAST(ts AS TIMESTAMP) - INTERVAL 2 HOUR AS parsed_utc,
  CAST(to_timestamp(CAST(floor(epoch_us(ts) / 1000000) AS BIGINT)) AS TIMESTAMP) AS from_seconds,
  date_trunc('hour', CAST(ts AS TIMESTAMP)) AS hour
FROM events
""")
def parse_times(spark, sf_dir):
    """ISO-8601 text with offset -> UTC; unix seconds -> timestamp; hour floor."""
    ev = table(spark, sf_dir, "events")
    iso = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("+02:00"))
    secs = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1_000_000)).cast("bigint")
    return ev.select("event_id", TF.parse_iso(iso).alias("parsed_utc"),
                     TF.from_unix_seconds(secs).alias("from_seconds"),
                     TF.floor_hour("ts").alias("hour"))
