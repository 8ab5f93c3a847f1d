"""Source / sink queries.  Each writes landing or output
files derived from the driver tables into the shared scratch folder (under
``spark.checkpoint.dir``), reads them back and returns a result comparable
with the direct plan."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from airseries.operators import hourly as H
from airseries.operators.features import add_features
from airseries.plans import q_core  # noqa: F401  (registers the oracle entries reused below)
from airseries.plans.oracle import features_cte, hourly_chain, r6, readings_cte
from airseries.plans.registry import ORACLE, register
from airseries.session import scratch_path
from airseries.sources import csv_raw, sinks
from airseries.sources.landing import landed_files
from airseries.sources.readings import events_readings, table


def _scratch(spark, name):
    return scratch_path(spark, f"{name}-{uuid.uuid4().hex[:12]}")


def _land_events(spark, sf_dir):
    """Write the events readings as two exports with different headers (one with a junk column)."""
    base = _scratch(spark, "landing")
    r = events_readings(spark, sf_dir)
    early = r.where(F.col("timestamp") < F.lit("2024-01-15").cast("timestamp_ntz"))
    late = r.where(F.col("timestamp") >= F.lit("2024-01-15").cast("timestamp_ntz"))
    csv_raw.write_readings_csv(early, f"{base}/2024_01_a")
    csv_raw.write_readings_csv(late, f"{base}/2024_01_b",
                               columns=["timestamp", "value", "value_type", "location", "sensor_id", "sensor_type"],
                               junk=True)
    return base


@register("csv_round_trip", ORACLE["hourly_wide"])
def csv_round_trip(spark, sf_dir):
    """SC1-SC5 + U1: mixed-header ';' files -> readings -> hourly wide (equals hourly_wide)."""
    base = _land_events(spark, sf_dir)
    return H.hourly_wide(csv_raw.read_raw(spark, base, cutoff_year=2024))


@register("csv_mixed_headers", f"""
WITH {readings_cte()}
SELECT location, value_type, CAST(count(*) AS BIGINT) AS n, min(timestamp) AS first_ts FROM r GROUP BY 1, 2
""")
def csv_mixed_headers(spark, sf_dir):
    """SC1 + X7 + X17: every row survives the round trip with its type, location and UTC time."""
    base = _land_events(spark, sf_dir)
    r = csv_raw.read_raw(spark, base)
    return r.groupBy("location", "value_type").agg(F.count(F.lit(1)).alias("n"), F.min("timestamp").alias("first_ts"))


_P2L = [f"P2_lag_{n}" for n in (1, 2, 3, 4, 5, 24)]


@register("parquet_series_location", f"""
WITH {hourly_chain()}, {features_cte()}
SELECT location, timestamp, heure, {r6('P2', 'P2')}, {r6('temperature', 'temperature')},
       {', '.join(r6(c, c) for c in _P2L)} FROM f WHERE location = 3
""")
def parquet_series_location(spark, sf_dir):
    """SC9 + SC6 + SC18: features written partitioned by location, one location read back (pruned)."""
    path = _scratch(spark, "series")
    sinks.write_series(add_features(H.hourly_wide(events_readings(spark, sf_dir))), path)
    s = sinks.read_series(spark, path, location=3)
    return s.select(F.col("location").cast("bigint").alias("location"), "timestamp", "heure", "P2",
                    "temperature", *_P2L)


@register("manifest_json", ORACLE["location_manifest"])
def manifest_json(spark, sf_dir):
    """SC10 + SC8 + X39: manifest written as JSON and read back typed."""
    path = _scratch(spark, "manifest")
    sinks.write_manifest(H.min_rows(H.hourly_wide(events_readings(spark, sf_dir))), path)
    return sinks.read_manifest(spark, path).select("location", "rows", "start", "end")


@register("export_two_columns", f"""
WITH {hourly_chain()}
SELECT location, CAST(timestamp AS VARCHAR) AS "Date", round(P2, 6) AS "Valeur" FROM h
""")
def export_two_columns(spark, sf_dir):
    """SC13: two renamed columns of every location exported as CSV, a folder each, read back as text."""
    path = _scratch(spark, "export")
    h = H.hourly_wide(events_readings(spark, sf_dir))
    sinks.export_two_columns(h.withColumn("timestamp", F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss")),
                             "timestamp", "P2", path, by="location")
    back = spark.read.option("header", True).schema("Date STRING, Valeur STRING, location BIGINT").csv(path)
    return back.select("location", "Date", F.col("Valeur").cast("double").alias("Valeur"))


@register("landed_file_gate", f"""
WITH {readings_cte()}
SELECT '2024_01_a' AS folder, TRUE AS valid, CAST(NULL AS BIGINT) AS bytes FROM r WHERE timestamp < TIMESTAMP '2024-01-15' HAVING count(*) > 0
UNION ALL SELECT '2024_01_b', TRUE, NULL FROM r WHERE timestamp >= TIMESTAMP '2024-01-15' HAVING count(*) > 0
UNION ALL SELECT 'html_pages', NOT bool_and(lower(html[1:256]) LIKE '%<!doctype html%' OR lower(html[1:256]) LIKE '%<html%'),
                 CAST(sum(strlen(html) + 1) AS BIGINT) FROM pages WHERE html IS NOT NULL
UNION ALL SELECT 'small', FALSE, CAST(strlen(min(url)) + 1 AS BIGINT) FROM pages
""")
def landed_file_gate(spark, sf_dir):
    """SC16: landed files that hold HTML or fewer than 100 bytes are rejected."""
    base = _land_events(spark, sf_dir)
    pages = table(spark, sf_dir, "pages")
    pages.where(F.col("html").isNotNull()).select("html").coalesce(1).write.mode("overwrite").text(f"{base}/html_pages")
    pages.agg(F.min("url").alias("u")).write.mode("overwrite").text(f"{base}/small")
    files = landed_files(spark, base).withColumn("folder", F.element_at(F.split("path", "/"), -2))
    return files.groupBy("folder", "valid").agg(F.sum("length").alias("length")).select(
        "folder", "valid", F.when(F.col("folder").isin("html_pages", "small"), F.col("length")).alias("bytes"))


@register("bucketed_series_lags", f"""
WITH {hourly_chain()}
SELECT location, timestamp, {r6('P2', 'P2')},
       {r6('lag(P2, 1) OVER (PARTITION BY location ORDER BY timestamp)', 'P2_lag_1')},
       {r6('lag(P2, 24) OVER (PARTITION BY location ORDER BY timestamp)', 'P2_lag_24')}
FROM h
""")
def bucketed_series_lags(spark, sf_dir):
    """SC9 (bucketed form): hourly series published bucketed by location; lag windows
    over the table need no exchange."""
    from airseries.operators.features import add_lags
    name = f"airseries_hourly_{uuid.uuid4().hex[:12]}"
    t = sinks.write_bucketed_series(H.hourly_wide(events_readings(spark, sf_dir)).select("location", "timestamp", "P2"),
                                    name, _scratch(spark, "bucketed"), n_buckets=4)
    return add_lags(t, ["P2"], [1, 24]).select("location", "timestamp", "P2", "P2_lag_1", "P2_lag_24")
