"""Fusion queries.  Readings use hour-truncated timestamps so
several sensors share a timestamp (FIXTURES.md section 2)."""

from __future__ import annotations

from pyspark.sql import functions as F

from airseries.functions.constants import NUMERIC_COLS
from airseries.functions.timefns import floor_hour
from airseries.operators import filters, fusion as FU
from airseries.plans.oracle import r6, to_double_sql
from airseries.plans.registry import register
from airseries.sources.readings import events_readings, events_readings_sql


def _hr(spark, sf_dir):
    return events_readings(spark, sf_dir).withColumn("timestamp", floor_hour("timestamp"))


def _ids_str(c="sensor_ids"):
    return F.array_join(F.transform(F.col(c), lambda x: x.cast("string")), ",")


_R_HOUR = (f"r AS (SELECT location, sensor_id, date_trunc('hour', timestamp) AS timestamp, value_type, value, ord "
           f"FROM ({events_readings_sql()}))")
_PS = ("ps AS (SELECT location, timestamp, sensor_id, "
       + ", ".join(f"arg_min(x, ord) FILTER (WHERE value_type = '{t}') AS {t}" for t in NUMERIC_COLS)
       + f" FROM (SELECT *, {to_double_sql('value')} AS x FROM r) WHERE x IS NOT NULL AND location IS NOT NULL "
       "GROUP BY 1, 2, 3)")
_C = ("c AS (SELECT location, timestamp, list_sort(list(DISTINCT CAST(sensor_id AS BIGINT))) AS ids, "
      + ", ".join(f"arg_min({t}, CAST(sensor_id AS BIGINT)) FILTER (WHERE {t} IS NOT NULL) AS {t}" for t in NUMERIC_COLS)
      + " FROM ps GROUP BY 1, 2)")
_PAIRS = (
    "n AS (SELECT *, date_trunc('month', timestamp) AS month, "
    "row_number() OVER (PARTITION BY location, date_trunc('month', timestamp) ORDER BY timestamp) AS rn FROM c), "
    "g AS (SELECT location, month, CAST((rn - 1) // 2 AS BIGINT) AS pair, count(*) AS cnt, "
    "min(timestamp) AS t1, max(timestamp) AS t2, flatten(list(ids ORDER BY rn)) AS ids, "
    + ", ".join(f"arg_min({t}, rn) FILTER (WHERE {t} IS NOT NULL) AS {t}" for t in NUMERIC_COLS)
    + " FROM n GROUP BY 1, 2, 3), "
    "pr AS (SELECT location, month, pair, make_timestamp((epoch_us(t1) + epoch_us(t2)) // 2) AS timestamp, ids, "
    + ", ".join(NUMERIC_COLS) + " FROM g WHERE cnt = 2)")
_VALS = ", ".join(r6(t, t) for t in NUMERIC_COLS)


@register("sensors_per_timestamp", f"""
WITH {_R_HOUR},
t AS (SELECT location, timestamp, count(DISTINCT sensor_id) AS n FROM r GROUP BY 1, 2)
SELECT location, CAST(count(*) AS BIGINT) AS n_timestamps, CAST(count(*) FILTER (WHERE n > 1) AS BIGINT) AS n_multi_sensor,
       CAST(max(n) AS BIGINT) AS max_sensors FROM t GROUP BY location
""")
def sensors_per_timestamp(spark, sf_dir):
    """Sensors sharing each (hour-truncated) timestamp."""
    return FU.sensors_per_timestamp(_hr(spark, sf_dir))


@register("coalesce_by_timestamp", f"""
WITH {_R_HOUR}, {_PS}, {_C}
SELECT location, timestamp, array_to_string(ids, ',') AS sensor_ids, {_VALS} FROM c
""")
def coalesce_by_timestamp(spark, sf_dir):
    """A3 + A26: per-sensor pivot, then one row per timestamp with the sensor list."""
    c = FU.coalesce_by_timestamp(FU.pivot_by_sensor(_hr(spark, sf_dir)))
    return c.withColumn("sensor_ids", _ids_str())


@register("midpoint_pairs", f"""
WITH {_R_HOUR}, {_PS}, {_C}, {_PAIRS}
SELECT location, month, pair, timestamp, array_to_string(ids, ',') AS sensor_ids, {_VALS} FROM pr
""")
def midpoint_pairs(spark, sf_dir):
    """W9 + X16 + X34: consecutive pairs per (location, month) at the midpoint time."""
    c = FU.coalesce_by_timestamp(FU.pivot_by_sensor(_hr(spark, sf_dir)))
    return FU.pair_consecutive(c).withColumn("sensor_ids", _ids_str())


@register("mean_impute", f"""
WITH {_R_HOUR}, {_PS}, {_C}, {_PAIRS}
SELECT location, month, pair, timestamp,
  {", ".join(r6(f"coalesce({t}, avg({t}) OVER (PARTITION BY location, month))", t) for t in NUMERIC_COLS)}
FROM pr
""")
def mean_impute(spark, sf_dir):
    """Pairs with remaining gaps filled by the (location, month) mean."""
    c = FU.coalesce_by_timestamp(FU.pivot_by_sensor(_hr(spark, sf_dir)))
    return FU.mean_impute(FU.pair_consecutive(c)).drop("sensor_ids")


@register("drop_duplicates", f"""
WITH {_R_HOUR},
d AS (SELECT DISTINCT location, sensor_id, timestamp, value_type, value FROM r WHERE value_type IS DISTINCT FROM 'P0')
SELECT location, value_type, CAST(count(*) AS BIGINT) AS n FROM d GROUP BY 1, 2
""")
def drop_duplicates(spark, sf_dir):
    """F3 + F5 + U5: drop one value type (NULL kept), the order column, exact duplicates."""
    r = filters.exclude_value_type(_hr(spark, sf_dir), "P0").drop("ord", "Colonne1", "Unnamed: 0")
    return r.dropDuplicates().groupBy("location", "value_type").agg(F.count(F.lit(1)).alias("n"))
