"""Air-quality snapshot of every location in one job (flagship plan).

readings -> hourly wide -> locations with >= 24 rows -> last 24 h per location
-> mean -> index -> category -> inner join with the (broadcast, constant)
site dimension.  The reference re-reads one file per location in a loop; here
location is a grouping key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from airseries.functions.aqi import aqi, aqi_category, substance_column
from airseries.functions.constants import MIN_ROWS_PER_LOCATION
from airseries.operators.hourly import hourly_wide


def aqi_snapshot(hourly: DataFrame, dim: DataFrame, substance: str = "PM2.5",
                 hours: int = 24, min_rows: int = MIN_ROWS_PER_LOCATION) -> DataFrame:
    col = substance_column(substance)
    w = Window.partitionBy("location")
    recent = (hourly.select("location", "timestamp", col)
              .withColumn("_mx", F.max("timestamp").over(w))
              .withColumn("_n", F.count(F.lit(1)).over(w))
              .where(F.col("_n") >= F.lit(min_rows))
              .where(F.col("timestamp") >= F.col("_mx") - F.expr(f"INTERVAL {int(hours)} HOURS")))
    # The window always holds the latest row, so the whole-series fallback of
    # the original (used only for an empty window) can never trigger.
    means = recent.groupBy("location").agg(F.avg(col).alias("mean_value"))
    idx = aqi(F.col("mean_value"), substance)
    cat = aqi_category(F.col("aqi"))
    return (means.join(F.broadcast(dim), "location", "inner")
            .withColumn("aqi", idx)
            .select(F.col("location").alias("loc_id"), "name", "lat", "lon", "aqi",
                    cat.getField("label").alias("label"),
                    cat.getField("color").alias("color")))


def aqi_snapshot_from_readings(readings: DataFrame, dim: DataFrame, substance: str = "PM2.5") -> DataFrame:
    return aqi_snapshot(hourly_wide(readings), dim, substance)
