"""Location dimension (D6): a constant, size-bounded table, safe to broadcast."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from airseries.functions.constants import SENSOR_LOCATIONS

DIM_SCHEMA = "location BIGINT, name STRING, lat DOUBLE, lon DOUBLE"

# Six invented sites for the fixture mapping (location = user_id % 6).
FIXTURE_SITES = [
    (0, "North Gate", -1.250, 36.800),
    (1, "River Park", -1.275, 36.830),
    (2, "Market Hall", -1.300, 36.815),
    (3, "Hill Station", -1.295, 36.790),
    (4, "East Yard", -1.265, 36.845),
    (5, "Lake Side", -1.320, 36.805),
]


def location_dim(spark: SparkSession, sites=None) -> DataFrame:
    """Dimension DataFrame; default = the application's six sites."""
    rows = [F.struct(F.lit(int(a)).cast("bigint").alias("location"), F.lit(b).alias("name"),
                     F.lit(float(c)).alias("lat"), F.lit(float(d)).alias("lon"))
            for a, b, c, d in (sites or SENSOR_LOCATIONS)]
    # Built from literals on the JVM (a LocalRelation), no Python round trip.
    return spark.range(1).select(F.inline(F.array(*rows)))


def fixture_dim(spark: SparkSession) -> DataFrame:
    return location_dim(spark, FIXTURE_SITES)


def dim_values_sql(sites=FIXTURE_SITES) -> str:
    vals = ", ".join(f"(CAST({a} AS BIGINT), '{b}', CAST({c} AS DOUBLE), CAST({d} AS DOUBLE))"
                     for a, b, c, d in sites)
    return f"(VALUES {vals}) AS dim(location, name, lat, lon)"


def with_location_label(df: DataFrame, dim: DataFrame) -> DataFrame:
    """J1 (left form): attach the site name, defaulting to 'Location <id>'."""
    return (df.join(F.broadcast(dim.select("location", "name")), "location", "left")
            .withColumn("label", F.coalesce(F.col("name"),
                                            F.concat(F.lit("Location "), F.col("location").cast("string"))))
            .drop("name"))
