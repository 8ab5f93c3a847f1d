"""Streaming queries.  Landing files are written
from the events table into the shared scratch folder; streams run with
``availableNow`` and their sinks are read back as batch DataFrames."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from airseries.operators import hourly as H
from airseries.plans import q_core  # noqa: F401  (registers the oracle entries reused below)
from airseries.plans.oracle import hourly_chain, hourly_cte, pivot_cte, r6, readings_cte
from airseries.plans.registry import ORACLE, register
from airseries.session import scratch_path
from airseries.sources import csv_raw
from airseries.sources.readings import events_readings, events_readings_sql
from airseries.streaming import streams as ST

_CANON = ["sensor_id", "sensor_type", "location", "timestamp", "value_type", "value"]


def _dirs(spark, name):
    """Landing folder, readings table and a base for sinks and checkpoints."""
    base = scratch_path(spark, f"{name}-{uuid.uuid4().hex[:12]}")
    return f"{base}/landing", f"{base}/readings", base


def _span(r, lo=None, hi=None):
    if lo is not None:
        r = r.where(F.col("timestamp") >= F.lit(lo).cast("timestamp_ntz"))
    if hi is not None:
        r = r.where(F.col("timestamp") < F.lit(hi).cast("timestamp_ntz"))
    return r


def _land(spark, sf_dir, landing, part: str, lo=None, hi=None, columns=_CANON, junk=False):
    csv_raw.write_readings_csv(_span(events_readings(spark, sf_dir), lo, hi), f"{landing}/{part}", columns=columns, junk=junk)


@register("stream_incremental", f"""
WITH {readings_cte()}
SELECT location, value_type, CAST(count(*) AS BIGINT) AS n FROM r GROUP BY 1, 2
""")
def stream_incremental(spark, sf_dir):
    """ST1: two scheduled runs over a growing landing folder; the second reads only the new files."""
    landing, readings, base = _dirs(spark, "st1")
    _land(spark, sf_dir, landing, "part1", hi="2024-01-15")
    ST.land_new_files(spark, landing, readings, f"{base}/ckpt")
    _land(spark, sf_dir, landing, "part2", lo="2024-01-15")
    ST.land_new_files(spark, landing, readings, f"{base}/ckpt")
    return spark.read.parquet(readings).groupBy("location", "value_type").agg(F.count(F.lit(1)).alias("n"))


@register("stream_mixed_headers", f"""
WITH {readings_cte()}
SELECT CAST(epoch AS BIGINT) AS epoch, location, sensor_id, timestamp, value_type, value
FROM (SELECT *, CASE WHEN timestamp < TIMESTAMP '2024-01-20' THEN 0 ELSE 1 END AS epoch FROM r)
""")
def stream_mixed_headers(spark, sf_dir):
    """ST1: files of three header orders, one with a junk column, land over two runs; every
    reading arrives under its own column name, in the run that its file landed before."""
    landing, readings, base = _dirs(spark, "st1h")
    _land(spark, sf_dir, landing, "part1", hi="2024-01-10")
    _land(spark, sf_dir, landing, "part2", lo="2024-01-10", hi="2024-01-20",
          columns=["timestamp", "value", "value_type", "location", "sensor_id", "sensor_type"], junk=True)
    ST.land_new_files(spark, landing, readings, f"{base}/ckpt")
    _land(spark, sf_dir, landing, "part3", lo="2024-01-20", columns=["value_type", "sensor_id", "value", "location", "timestamp"])
    ST.land_new_files(spark, landing, readings, f"{base}/ckpt")
    return spark.read.schema(ST.READINGS_SCHEMA).parquet(readings).select(
        "epoch", "location", "sensor_id", "timestamp", "value_type", "value")


@register("stream_hourly", f"""
WITH {hourly_chain()}
SELECT location, timestamp, {', '.join(r6(c, c) for c in ['P0', 'P1', 'P2', 'humidity', 'temperature'])} FROM h
WHERE timestamp + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 2 HOUR
""")
def stream_hourly(spark, sf_dir):
    """ST2: event-time hourly means with a 2-hour watermark (append mode): every hour
    closed by the watermark equals the batch hourly series."""
    landing, readings, base = _dirs(spark, "st2")
    _land(spark, sf_dir, landing, "part1")
    ST.land_new_files(spark, landing, readings, f"{base}/ckpt")
    ST.run_available_now(ST.hourly_stream(ST.ingest_stream(spark, readings)), f"{base}/sink", f"{base}/ckpt_hourly")
    return spark.read.parquet(f"{base}/sink")


@register("stream_hourly_order", f"""
WITH r0 AS ({events_readings_sql()}),
r AS (SELECT * REPLACE (CASE WHEN timestamp < TIMESTAMP '2024-01-15' THEN CAST(CAST(value AS DOUBLE) + 1000 AS VARCHAR) ELSE value END
      AS value) FROM r0),
{pivot_cte()}, {hourly_cte()}
SELECT location, timestamp, {', '.join(r6(c, c) for c in ['P0', 'P1', 'P2', 'humidity', 'temperature'])} FROM h
WHERE timestamp + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 16 DAY
""")
def stream_hourly_order(spark, sf_dir):
    """ST2: readings arrive twice, in the second micro-batch from a file that sorts before the
    first one's: the value that is first in file order wins, as in the batch series."""
    landing, readings, base = _dirs(spark, "st2o")
    r = events_readings(spark, sf_dir)

    def run():
        ST.land_new_files(spark, landing, readings, f"{base}/ckpt")
        ST.run_available_now(ST.hourly_stream(ST.ingest_stream(spark, readings), watermark="16 days"),
                             f"{base}/sink", f"{base}/ckpt_hourly")

    csv_raw.write_readings_csv(_span(r, hi="2024-01-15"), f"{landing}/part1", columns=_CANON, name="b_first_to_arrive")
    run()
    early = _span(r, hi="2024-01-15").withColumn("value", (F.col("value").cast("double") + 1000).cast("string"))
    csv_raw.write_readings_csv(early, f"{landing}/part2", columns=_CANON, name="a_first_in_order")
    csv_raw.write_readings_csv(_span(r, lo="2024-01-15"), f"{landing}/part3", columns=_CANON, name="c_rest")
    run()
    return spark.read.parquet(f"{base}/sink")


@register("stream_late_fix", ORACLE["hourly_wide"])
def stream_late_fix(spark, sf_dir):
    """ST3: a late file for an already published month is merged into the stored first values
    and rewrites only the touched partitions."""
    landing, readings, base = _dirs(spark, "st3")
    handler = ST.late_fix_batch(spark, f"{base}/first_values", f"{base}/hourly")

    def run():
        ST.land_new_files(spark, landing, readings, f"{base}/ckpt")
        ST.run_batches(ST.ingest_stream(spark, readings), handler, f"{base}/ckpt_fix")

    _land(spark, sf_dir, landing, "part1", hi="2024-01-20")
    run()
    _land(spark, sf_dir, landing, "part2", lo="2024-01-20")
    run()
    return spark.read.parquet(f"{base}/hourly").select(F.col("location").cast("bigint").alias("location"), "timestamp",
                                                       "P0", "P1", "P2", "humidity", "temperature")


@register("stream_retrain", f"""
WITH {readings_cte()}
SELECT location, CAST(count(DISTINCT date_trunc('hour', timestamp)) AS BIGINT) AS n_hours, CAST(1 AS BIGINT) AS epoch,
       CAST(2 AS BIGINT) AS n_retrains
FROM r WHERE location IS NOT NULL GROUP BY location
""")
def stream_retrain(spark, sf_dir):
    """ST4: the batch step (eligibility table) runs only for runs that find new files: two of three here."""
    landing, readings, base = _dirs(spark, "st4")
    out = f"{base}/eligible"
    runs = []

    def step(batch, epoch_id):
        runs.append(epoch_id)
        (H.distinct_hours(spark.read.parquet(readings)).withColumn("epoch", F.lit(epoch_id))
         .write.mode("overwrite").parquet(out))

    def run():
        ST.land_new_files(spark, landing, readings, f"{base}/ckpt")
        ST.run_batches(ST.ingest_stream(spark, readings), ST.retrain_on_new_data(step), f"{base}/ckpt_train")

    _land(spark, sf_dir, landing, "part1", hi="2024-01-15")
    run()
    run()  # finds no new file: no retraining
    _land(spark, sf_dir, landing, "part2", lo="2024-01-15")
    run()
    return spark.read.parquet(out).withColumn("n_retrains", F.lit(len(runs)))
