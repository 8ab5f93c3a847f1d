"""Capture-time fusion.

* ``sensors_per_timestamp``: how many sensors share each timestamp.
* ``coalesce_by_timestamp``: per (location, timestamp, sensor) first parsable
  value per type, then one row per timestamp with the first non-null value in
  sensor order and the sorted distinct sensor list.
* ``pair_consecutive``: rows 2k, 2k+1 of each (location, month) in time order
  become one row at the midpoint; a trailing odd row is dropped.  Row numbers
  are computed in two levels (per-day counts -> prefix offsets -> numbering
  inside the day), so a hot location-month is spread over its days rather than
  sorted in one task.
* ``mean_impute``: remaining NULLs take the (location, month) column mean.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from airseries.functions.constants import NUMERIC_COLS
from airseries.functions.timefns import midpoint
from airseries.operators.hourly import to_double


def sensors_per_timestamp(readings: DataFrame) -> DataFrame:
    """Per location, distinct timestamps and those reported by more than one sensor."""
    per_ts = (readings.groupBy("location", "timestamp")
              .agg(F.countDistinct("sensor_id").alias("n_sensors")))
    return per_ts.groupBy("location").agg(
        F.count(F.lit(1)).alias("n_timestamps"),
        F.count_if(F.col("n_sensors") > 1).alias("n_multi_sensor"),
        F.max("n_sensors").alias("max_sensors"))


def pivot_by_sensor(readings: DataFrame, value_types=NUMERIC_COLS) -> DataFrame:
    """A3: (location, timestamp, sensor) -> first *parsable* value per type in file order."""
    aggs = [F.expr(f"min_by(_v, ord) FILTER (WHERE value_type = '{t}')").alias(t) for t in value_types]
    return (readings.withColumn("_v", to_double("value"))
            .where(F.col("_v").isNotNull() & F.col("location").isNotNull())
            .groupBy("location", "timestamp", "sensor_id").agg(*aggs))


def coalesce_by_timestamp(per_sensor: DataFrame, value_types=NUMERIC_COLS) -> DataFrame:
    """One row per (location, timestamp); sensors in numeric order; ARRAY<BIGINT> ids."""
    sid = F.col("sensor_id").cast("bigint")
    aggs = [F.min_by(F.col(t), F.when(F.col(t).isNotNull(), sid)).alias(t) for t in value_types]
    return (per_sensor.groupBy("location", "timestamp")
            .agg(F.array_sort(F.collect_set(sid)).alias("sensor_ids"), *aggs))


def numbered(df: DataFrame, group_cols, order_col: str = "timestamp",
             sub_expr=None, name: str = "rn") -> DataFrame:
    """Dense 1-based row number of ``order_col`` inside ``group_cols``, in two levels.

    ``sub_expr`` (default: the calendar day of ``order_col``) splits each group
    into ordered sub-buckets; per-sub-bucket counts and their running offsets
    are a small aggregate, and the final numbering only sorts within a
    sub-bucket.  ``order_col`` must be unique within a group.
    """
    sub = sub_expr if sub_expr is not None else F.to_date(F.col(order_col))
    g = list(group_cols)
    d = df.withColumn("_sub", sub)
    counts = d.groupBy(*g, "_sub").agg(F.count(F.lit(1)).alias("_cnt"))
    w_off = Window.partitionBy(*g).orderBy("_sub").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("_off", F.coalesce(F.sum("_cnt").over(w_off), F.lit(0))).drop("_cnt")
    w_in = Window.partitionBy(*g, "_sub").orderBy(order_col)
    return (d.join(offsets, g + ["_sub"], "inner")
            .withColumn(name, F.col("_off") + F.row_number().over(w_in))
            .drop("_sub", "_off"))


def pair_consecutive(fused: DataFrame, value_types=NUMERIC_COLS, group_cols=("location", "month")) -> DataFrame:
    """Fuse rows two by two inside each (location, month)."""
    g = list(group_cols)
    d = fused
    if "month" in g and "month" not in fused.columns:
        d = d.withColumn("month", F.date_trunc("month", F.col("timestamp")).cast("timestamp_ntz"))
    d = numbered(d, g).withColumn("pair", F.floor((F.col("rn") - 1) / 2).cast("bigint"))
    first_non_null = [F.min_by(F.col(t), F.when(F.col(t).isNotNull(), F.col("rn"))).alias(t)
                      for t in value_types]
    ids = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("rn", "sensor_ids"))),
                                lambda s: s["sensor_ids"]))
    out = (d.groupBy(*g, "pair")
           .agg(F.count(F.lit(1)).alias("_n"), F.min("timestamp").alias("_t1"),
                F.max("timestamp").alias("_t2"), ids.alias("sensor_ids"), *first_non_null)
           .where(F.col("_n") == 2))
    return (out.withColumn("timestamp", midpoint("_t1", "_t2"))
            .drop("_n", "_t1", "_t2"))


def mean_impute(df: DataFrame, value_types=NUMERIC_COLS, group_cols=("location", "month")) -> DataFrame:
    """NULL -> column mean of the group; an all-NULL column stays NULL."""
    # Means are a grouped aggregate joined back (one row per group), so a group's rows never meet in one task.
    keys = {g: f"_of_{g}" for g in group_cols}
    means = df.groupBy(*[F.col(g).alias(k) for g, k in keys.items()]).agg(*[F.avg(t).alias(f"_m_{t}") for t in value_types])
    same = reduce(lambda a, b: a & b, [F.col(g).eqNullSafe(F.col(k)) for g, k in keys.items()])
    filled = df.join(means, same).withColumns({t: F.coalesce(F.col(t), F.col(f"_m_{t}")) for t in value_types})
    return filled.select(*df.columns)
