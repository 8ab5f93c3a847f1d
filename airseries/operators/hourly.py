"""Long readings -> wide hourly series per location (pivot + two-level mean).

Plan shape: filter (pushed to the scan) -> partial HashAggregate on
(location, timestamp) -> exchange -> final aggregate -> partial HashAggregate on
(location, hour) -> exchange -> final.  Both levels pre-aggregate map-side, so
the raw volume never crosses the network; the second key (location, hour)
spreads even a location holding a third of all rows over its hours.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from airseries.functions.constants import MIN_HOURS, MIN_ROWS_PER_LOCATION, NUMERIC_COLS
from airseries.functions.timefns import floor_hour


def to_double(c):
    """Tolerant numeric coercion: unparsable -> NULL, NaN -> NULL."""
    x = (F.col(c) if isinstance(c, str) else c).try_cast("double")
    return F.nanvl(x, F.lit(None).cast("double"))


def distinct_hours(readings: DataFrame) -> DataFrame:
    """A1: exact number of distinct clock hours per location."""
    return (readings.where(F.col("location").isNotNull())
            .groupBy("location")
            .agg(F.countDistinct(floor_hour("timestamp")).alias("n_hours")))


def eligible_locations(readings: DataFrame, min_hours: int = MIN_HOURS) -> DataFrame:
    """Locations with at least ``min_hours`` distinct hours (desc by count)."""
    return (distinct_hours(readings)
            .where(F.col("n_hours") >= F.lit(min_hours))
            .orderBy(F.col("n_hours").desc(), F.col("location")))


def keep_eligible(readings: DataFrame, min_hours: int = MIN_HOURS,
                  locations: list[int] | None = None) -> DataFrame:
    """Restrict readings to eligible (or explicitly listed) locations."""
    if locations is not None:
        return readings.where(F.col("location").isin([int(x) for x in locations]))
    keep = distinct_hours(readings).where(F.col("n_hours") >= F.lit(min_hours)).select("location")
    # One row per location: AQE broadcasts it when its runtime size allows;
    # otherwise the semi join is a sort-merge join whose skewed partitions
    # (a location holding a third of the rows) AQE splits.
    return readings.join(keep, "location", "left_semi")


def pivot_first(readings: DataFrame, keys=("location", "timestamp"),
                value_types=NUMERIC_COLS) -> DataFrame:
    """A2/A3: one row per key, first non-null value per type in file order.

    'First' = smallest ``ord`` among non-null values; the text is coerced to a
    number only afterwards, so an unparsable first value gives NULL.  The key
    skeleton comes from non-null rows of *any* type, so an hour with only an
    unused type still yields an all-NULL row.
    """
    # Coercing before the aggregate is equivalent (the text that wins is the
    # one with the smallest ord; min_by keeps its NULL when it does not parse)
    # and keeps the aggregation buffer fixed-width, so the plan is a
    # partial + final HashAggregate rather than a sort-based aggregate.
    aggs = [F.expr(f"min_by(_v, ord) FILTER (WHERE value_type = '{t}')").alias(t)
            for t in value_types]
    return (readings.where(F.col("value").isNotNull() & F.col("location").isNotNull())
            .withColumn("_v", to_double("value"))
            .groupBy(*keys).agg(*aggs))


def hourly_mean(wide: DataFrame, value_cols=NUMERIC_COLS, key: str = "location") -> DataFrame:
    """A4: unweighted mean per (location, clock hour)."""
    return (wide.groupBy(key, floor_hour("timestamp").alias("timestamp"))
            .agg(*[F.avg(c).alias(c) for c in value_cols]))


def hourly_wide(readings: DataFrame, value_types=NUMERIC_COLS) -> DataFrame:
    """A2 + A4: readings -> (location, timestamp, P0, P1, P2, humidity, temperature)."""
    return hourly_mean(pivot_first(readings, value_types=value_types), value_types)


def min_rows(hourly: DataFrame, n: int = MIN_ROWS_PER_LOCATION) -> DataFrame:
    """keep locations with at least ``n`` hourly rows."""
    w = Window.partitionBy("location")
    return (hourly.withColumn("_n", F.count(F.lit(1)).over(w))
            .where(F.col("_n") >= F.lit(n)).drop("_n"))


def manifest(series: DataFrame) -> DataFrame:
    """Rows, first and last timestamp per location."""
    return series.groupBy("location").agg(
        F.count(F.lit(1)).alias("rows"),
        F.min("timestamp").alias("start"),
        F.max("timestamp").alias("end"),
    )


def location_profile(readings: DataFrame) -> DataFrame:
    """Rows, distinct sensors and value types per location."""
    return readings.groupBy("location").agg(
        F.count(F.lit(1)).alias("rows"),
        F.countDistinct("sensor_id").alias("n_sensors"),
        F.array_sort(F.collect_set("value_type")).alias("value_types"),
    )


def coverage(series: DataFrame) -> DataFrame:
    """Span in whole days and points per day, per location."""
    span_days = F.floor(
        (F.unix_micros(F.max("timestamp").cast("timestamp"))
         - F.unix_micros(F.min("timestamp").cast("timestamp"))) / F.lit(86_400_000_000)
    ).cast("bigint")
    return (series.groupBy("location")
            .agg(F.count(F.lit(1)).alias("n_points"), span_days.alias("span_days"))
            .withColumn("points_per_day",
                        F.col("n_points") / (F.col("span_days") + F.lit(1))))
