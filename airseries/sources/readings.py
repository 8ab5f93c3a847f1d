"""Long-format readings: the canonical input of every operator.

Schema (fixed): location BIGINT, sensor_id STRING, timestamp TIMESTAMP_NTZ,
value_type STRING, value STRING, ord BIGINT (file order; ties broken by it).

``events_readings`` maps the driver's ``events`` table onto that schema; CSV
landing files are read by :mod:`airseries.sources.csv_raw`.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# event_type -> value_type used by the fixture mapping
EVENT_VALUE_TYPES = {
    "view": "P2",
    "click": "P1",
    "purchase": "P0",
    "signup": "humidity",
    "error": "temperature",
}

N_DENSE_LOCATIONS = 6


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def _value_type_expr(col: str = "event_type"):
    pairs = []
    for k, v in EVENT_VALUE_TYPES.items():
        pairs += [F.lit(k), F.lit(v)]
    return F.element_at(F.create_map(*pairs), F.col(col))


def events_readings(spark: SparkSession, sf_dir: str, dense: bool = True) -> DataFrame:
    """events -> readings.  ``dense``: location = user_id % 6, else user_id."""
    ev = table(spark, sf_dir, "events")
    loc = (F.col("user_id") % N_DENSE_LOCATIONS) if dense else F.col("user_id")
    return ev.select(
        loc.cast("bigint").alias("location"),
        F.col("user_id").cast("string").alias("sensor_id"),
        F.col("ts").cast("timestamp_ntz").alias("timestamp"),
        _value_type_expr().alias("value_type"),
        F.col("value").cast("string").alias("value"),
        F.col("event_id").cast("bigint").alias("ord"),
    )


def lineitem_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Multi-year series: location = l_suppkey % 6, P2 = l_quantity at l_shipdate."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        (F.col("l_suppkey") % N_DENSE_LOCATIONS).cast("bigint").alias("location"),
        F.col("l_suppkey").cast("string").alias("sensor_id"),
        F.col("l_shipdate").cast("timestamp_ntz").alias("timestamp"),
        F.lit("P2").alias("value_type"),
        F.col("l_quantity").cast("string").alias("value"),
        # (orderkey, linenumber, partkey, suppkey) is the unique row key; the
        # packing fits BIGINT for the fixture scales (real landing files get
        # their file-order key from csv_raw instead).
        (((F.col("l_orderkey") * 8 + F.col("l_linenumber")) * 1048576 + F.col("l_partkey")) * 4096
         + F.col("l_suppkey")).cast("bigint").alias("ord"),
    )


def lineitem_wide_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dense multi-year series with weather-like covariates, for model fitting:
    P2 = l_quantity, temperature = 100 * l_discount, humidity = 100 * l_tax."""
    base = lineitem_readings(spark, sf_dir)
    li = table(spark, sf_dir, "lineitem")
    extra = li.select(
        (F.col("l_suppkey") % N_DENSE_LOCATIONS).cast("bigint").alias("location"),
        F.col("l_suppkey").cast("string").alias("sensor_id"),
        F.col("l_shipdate").cast("timestamp_ntz").alias("timestamp"),
        F.expr("stack(2, 'temperature', CAST(l_discount * 100 AS STRING), 'humidity', CAST(l_tax * 100 AS STRING))")
        .alias("value_type", "value"),
        (((F.col("l_orderkey") * 8 + F.col("l_linenumber")) * 1048576 + F.col("l_partkey")) * 4096
         + F.col("l_suppkey")).cast("bigint").alias("ord"),
    )
    return base.unionByName(extra)


# SQL text of the same mapping, for oracles and SQL users.
def events_readings_sql(dense: bool = True) -> str:
    arms = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in EVENT_VALUE_TYPES.items())
    loc = f"user_id % {N_DENSE_LOCATIONS}" if dense else "user_id"
    return (
        f"SELECT CAST({loc} AS BIGINT) AS location, CAST(user_id AS VARCHAR) AS sensor_id, "
        f"CAST(ts AS TIMESTAMP) AS timestamp, CASE event_type {arms} END AS value_type, "
        f"CAST(value AS VARCHAR) AS value, CAST(event_id AS BIGINT) AS ord FROM events"
    )


def lineitem_readings_sql() -> str:
    return (
        f"SELECT CAST(l_suppkey % {N_DENSE_LOCATIONS} AS BIGINT) AS location, "
        "CAST(l_suppkey AS VARCHAR) AS sensor_id, CAST(l_shipdate AS TIMESTAMP) AS timestamp, "
        "'P2' AS value_type, CAST(l_quantity AS VARCHAR) AS value, "
        "CAST(((l_orderkey * 8 + l_linenumber) * 1048576 + l_partkey) * 4096 + l_suppkey AS BIGINT) AS ord "
        "FROM lineitem"
    )


def lineitem_wide_readings_sql() -> str:
    base = lineitem_readings_sql()
    return " UNION ALL ".join([base, *(
        base.replace("'P2' AS", f"'{name}' AS").replace("CAST(l_quantity AS", f"CAST(l_{column} * 100 AS")
        for name, column in (("temperature", "discount"), ("humidity", "tax")))])
