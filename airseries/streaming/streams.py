"""Structured Streaming counterparts of the polling loop (ST1-ST4).

The original re-ran the whole batch every 20-30 minutes.  Here a landing
folder becomes a table of readings, file by file, and everything else follows
that table:

* ST1 ``land_new_files``: a text file stream over the landing folder.  Exports
  differ in column order and carry junk columns, so no schema is bound by
  position: in every micro-batch the first line of each new file is learned
  into a layout table (one row per file), lines are split by ``from_csv`` and
  every column is taken from the position its file's header gives it.  Each
  micro-batch is one ``epoch=`` folder of the readings table, written at most
  once whatever restarts in between.  ``ingest_stream`` streams that table.
* ST2 ``hourly_stream``: two chained streaming aggregations: the first value in
  *file order* (smallest ``ord``, not first to arrive) per (location,
  timestamp, type), then the hourly mean.  Append mode emits an hour once the
  watermark passes it.
* ST3 ``late_fix_batch``: a ``foreachBatch`` that merges the micro-batch into a
  stored table of first values and republishes the touched (location, month)
  partitions.  The table is partitioned by month and a hash of the location,
  so a late file reads and rewrites its own partitions only.
* ST4 ``retrain_on_new_data``: a ``foreachBatch`` that calls a batch step only
  when the micro-batch is non-empty.
"""

from __future__ import annotations

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from airseries.functions.constants import NUMERIC_COLS
from airseries.operators.hourly import hourly_mean, to_double
from airseries.sources.csv_raw import CANONICAL, canonical_readings, clean_header

#: ``ord`` sorts as the batch reader sorts: file name, path, split offset, line of the split.
ORD_SCHEMA = "struct<file:string,path:string,block:bigint,line:bigint>"
READINGS_SCHEMA = ("location BIGINT, sensor_id STRING, sensor_type STRING, timestamp TIMESTAMP_NTZ, value_type STRING, "
                   f"value STRING, ord {ORD_SCHEMA}, epoch BIGINT")
STORE_SCHEMA = (f"location BIGINT, timestamp TIMESTAMP_NTZ, value_type STRING, ord {ORD_SCHEMA}, value STRING, "
                "month STRING, shard INT")
#: Folders a month of the first-value table is cut into (by location).
STORE_SHARDS = 16


def read_or_none(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame | None:
    """The Parquet table at ``path``; None where there is none (any other error is raised)."""
    try:
        found = spark.read.parquet(path)
        return spark.read.schema(schema).parquet(path) if schema else found
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None


# --- ST1: landing files of any layout -> readings ------------------------------------

def _lines(spark: SparkSession, landing_dir: str, pattern: str, max_files_per_trigger: int | None) -> DataFrame:
    reader = spark.readStream.format("text")
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    raw = reader.load(f"{landing_dir.rstrip('/')}/{pattern}" if pattern else landing_dir)
    return raw.select("value", F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_path").alias("path"),
                      F.col("_metadata.file_block_start").alias("block"))


def learn_layouts(lines: DataFrame) -> DataFrame:
    """(path, first_line, header): the first line of each file, an aggregate with one row per file and task."""
    return (lines.where(F.col("block") == 0).groupBy("path")
            .agg(F.min("line").alias("first_line"), F.min_by("value", "line").alias("header")))


def _fields(text: str, width: int) -> Column:
    """The ``width`` first fields of a ';'-separated line."""
    schema = ", ".join(f"c{i} STRING" for i in range(width))
    row = F.from_csv(F.col(text), schema, {"sep": ";", "mode": "PERMISSIVE"})
    return F.array(*(row.getField(f"c{i}") for i in range(width)))


def readings_of_lines(lines: DataFrame, layouts: DataFrame) -> DataFrame:
    """Lines -> canonical readings by each file's own header.

    Lines with a field beyond their header are dropped, short ones padded with
    NULL, columns the file does not have are NULL, others are ignored.
    """
    columns = F.size(F.split("header", ";"))
    width = layouts.agg(F.max(columns)).first()[0]
    if width is None:
        return lines.sparkSession.createDataFrame([], READINGS_SCHEMA).drop("epoch")
    names = F.transform(_fields("header", width), clean_header)
    layouts = layouts.select("path", "first_line", columns.alias("columns"), names.alias("names"))
    body = lines.join(layouts, "path").where(
        (F.col("value") != "") & ((F.col("block") != 0) | (F.col("line") != F.col("first_line"))))
    split = body.withColumn("fields", _fields("value", width + 1))
    split = split.where(F.get("fields", F.col("columns")).isNull())
    at = {c: F.array_position("names", F.lit(c)) for c in CANONICAL}
    raw = split.select(*(F.when(p > 0, F.get("fields", (p - 1).cast("int"))).alias(c) for c, p in at.items()),
                       F.struct("file", "path", "block", "line").alias("ord"))
    return canonical_readings(raw)


def land_new_files(spark: SparkSession, landing_dir: str, readings_dir: str, checkpoint: str,
                   max_files_per_trigger: int | None = None, pattern: str = "*/*.csv") -> None:
    """ST1: one scheduled run: files that no run has seen become epochs of the readings table.

    ``readings_dir`` is the table; the layouts stand beside it in ``<readings_dir>_layouts``.
    """
    out, layouts_dir = readings_dir.rstrip("/"), f"{readings_dir.rstrip('/')}_layouts"

    def handle(batch: DataFrame, epoch: int) -> None:
        if read_or_none(spark, f"{out}/epoch={epoch}") is not None:
            return  # written by a run that stopped before its checkpoint
        here = f"{layouts_dir}/epoch={epoch}"
        batch = batch.withColumn("line", F.monotonically_increasing_id())  # follows the lines of a split
        learn_layouts(batch).write.mode("overwrite").parquet(here)
        layouts = spark.read.schema("path STRING, first_line BIGINT, header STRING").parquet(here)
        readings_of_lines(batch, layouts).write.mode("overwrite").parquet(f"{out}/epoch={epoch}")

    (_lines(spark, landing_dir, pattern, max_files_per_trigger).writeStream.foreachBatch(handle)
     .option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination())


def ingest_stream(spark: SparkSession, readings_dir: str) -> DataFrame:
    """The readings table as a stream; a checkpoint remembers what was consumed."""
    return spark.readStream.schema(READINGS_SCHEMA).parquet(readings_dir)


def run_available_now(df: DataFrame, sink_path: str, checkpoint: str, fmt: str = "parquet",
                      mode: str = "append") -> None:
    """Drain everything available, then stop (a scheduled run)."""
    q = (df.writeStream.format(fmt).outputMode(mode).option("path", sink_path)
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()


def run_batches(df: DataFrame, handler, checkpoint: str) -> None:
    """Drain everything available through a ``foreachBatch`` handler, then stop."""
    (df.writeStream.foreachBatch(handler).option("checkpointLocation", checkpoint)
     .trigger(availableNow=True).start().awaitTermination())


# --- ST2: hourly series --------------------------------------------------------------

def hourly_stream(readings: DataFrame, watermark: str = "2 hours", value_types=NUMERIC_COLS) -> DataFrame:
    """ST2: (location, hour) means per type, emitted when the watermark passes the hour.

    A duplicate that arrives later but stands earlier in file order wins, as
    long as the watermark has not passed its timestamp.
    """
    r = (readings.where(F.col("value").isNotNull() & F.col("location").isNotNull())
         .withColumn("timestamp", F.col("timestamp").cast("timestamp"))
         .withWatermark("timestamp", watermark)
         .withColumn("_v", to_double("value")))
    firsts = [F.expr(f"min_by(_v, ord) FILTER (WHERE value_type = '{t}')").alias(t) for t in value_types]
    wide = r.groupBy("location", "timestamp").agg(*firsts)
    return (wide.groupBy("location", F.window("timestamp", "1 hour").alias("w"))
            .agg(*[F.avg(t).alias(t) for t in value_types])
            .select("location", F.col("w.start").cast("timestamp_ntz").alias("timestamp"), *value_types))


# --- ST3: late corrections -----------------------------------------------------------

def _month(c: str = "timestamp") -> Column:
    return F.date_format(c, "yyyy-MM")


def _only(parts: list) -> Column:
    """A condition on the partition columns alone, so that the scan lists nothing else."""
    months: dict[str, list[int]] = {}
    for p in parts:
        months.setdefault(p["month"], []).append(p["shard"])
    each = [(F.col("month") == m) & F.col("shard").isin(sorted(s)) for m, s in sorted(months.items())]
    return reduce(lambda a, b: a | b, each, F.lit(False))


def first_values(readings: DataFrame) -> DataFrame:
    """The reading with the smallest ``ord`` per (location, timestamp, type), with its partition."""
    r = readings.where(F.col("value").isNotNull() & F.col("location").isNotNull() & F.col("timestamp").isNotNull())
    return (r.groupBy("location", "timestamp", "value_type").agg(F.min(F.struct("ord", "value")).alias("f"))
            .select("location", "timestamp", "value_type", "f.ord", "f.value", _month().alias("month"),
                    F.pmod(F.xxhash64("location"), F.lit(STORE_SHARDS)).cast("int").alias("shard")))


def merge_first_values(spark: SparkSession, batch: DataFrame, store: str) -> list:
    """Merge readings into the first-value table; returns the (month, shard) partitions touched.

    Merging is a minimum, so a repeated batch changes nothing.
    """
    new = first_values(batch)
    parts = new.select("month", "shard").distinct().collect()  # calendar months x STORE_SHARDS at most
    if not parts:
        return parts
    old = read_or_none(spark, store, STORE_SCHEMA)
    merged = new if old is None else first_values(
        old.where(_only(parts)).select("location", "timestamp", "value_type", "ord", "value")
        .unionByName(new.select("location", "timestamp", "value_type", "ord", "value")))
    (merged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("month", "shard").parquet(store))
    return parts


def stored_hourly(spark: SparkSession, store: str, parts: list, keys: DataFrame) -> DataFrame:
    """The hourly series of ``keys`` (location, month) from the partitions ``parts`` of the first-value table."""
    rows = spark.read.schema(STORE_SCHEMA).parquet(store).where(_only(parts)).join(keys, ["location", "month"], "left_semi")
    # One row per (location, timestamp, type) already: max only picks it.
    wide = rows.withColumn("_v", to_double("value")).groupBy("location", "timestamp").agg(
        *[F.max(F.when(F.col("value_type") == t, F.col("_v"))).alias(t) for t in NUMERIC_COLS])
    return hourly_mean(wide)


def late_fix_batch(spark: SparkSession, store: str, out_path: str):
    """ST3: foreachBatch handler: merge, then republish exactly the touched (location, month) partitions."""
    def handle(batch: DataFrame, epoch_id: int) -> None:
        parts = merge_first_values(spark, batch, store)
        if not parts:
            return
        keys = (batch.where(F.col("location").isNotNull() & F.col("timestamp").isNotNull())
                .select("location", _month().alias("month")).distinct())
        h = stored_hourly(spark, store, parts, keys).withColumn("month", _month())
        (h.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("location", "month").parquet(out_path))
    return handle


def retrain_on_new_data(step):
    """ST4: foreachBatch handler that runs ``step(batch)`` only for non-empty micro-batches."""
    def handle(batch: DataFrame, epoch_id: int) -> None:
        if not batch.isEmpty():
            step(batch, epoch_id)
    return handle
