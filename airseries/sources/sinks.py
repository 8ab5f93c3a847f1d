"""Sinks (SC9-SC11, SC13, SC17) and the reuse-or-refit policy."""

from __future__ import annotations

import hashlib
import json
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from airseries.operators.hourly import manifest
from airseries.session import shared_root
from airseries.sources.state_log import rename_new


def write_series(features: DataFrame, path: str, fmt: str = "parquet") -> None:
    """SC9: one output, partitioned by location (readers prune partitions)."""
    features.write.mode("overwrite").partitionBy("location").format(fmt).save(path)


def read_series(spark: SparkSession, path: str, location: int | None = None) -> DataFrame:
    """SC6/SC18: read the published series; a location filter prunes to one folder."""
    df = spark.read.parquet(path)
    return df.where(F.col("location") == F.lit(location)) if location is not None else df


def with_fallback(primary: DataFrame, legacy: DataFrame, key: str = "location") -> DataFrame:
    """SC7: legacy rows only for keys the primary source does not have."""
    return primary.unionByName(legacy.join(primary.select(key).distinct(), key, "left_anti"),
                               allowMissingColumns=True)


def write_manifest(series: DataFrame, path: str) -> None:
    """SC10: rows / start / end per location as JSON lines."""
    # JSON lines, one part file per task: no single task holds every location.
    (manifest(series).withColumn("file", F.concat(F.lit("location="), F.col("location").cast("string")))
     .write.mode("overwrite").json(path))


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """SC8: the manifest back as a typed table."""
    schema = "location BIGINT, rows BIGINT, start TIMESTAMP_NTZ, `end` TIMESTAMP_NTZ, file STRING"
    return spark.read.schema(schema).option("timestampNTZFormat", "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]").json(path)


def export_families(families: dict[str, DataFrame], path: str) -> None:
    """SC11: several tables x location x month in one partitioned write."""
    out = None
    for fam, df in families.items():
        d = (df.withColumn("family", F.lit(fam))
             .withColumn("month", F.date_format("timestamp", "yyyy-MM")))
        out = d if out is None else out.unionByName(d, allowMissingColumns=True)
    out.write.mode("overwrite").partitionBy("family", "location", "month").parquet(path)


def export_two_columns(df: DataFrame, ts_col: str, value_col: str, path: str,
                       names=("Date", "Valeur"), by: str | None = None) -> None:
    """SC13: two columns, renamed, as CSV with header; one folder per value of ``by``."""
    columns = [F.col(ts_col).alias(names[0]), F.col(value_col).alias(names[1])]
    out = df.select(*columns, *([by] if by else [])).write.mode("overwrite").option("header", True)
    (out.partitionBy(by) if by else out).csv(path)


def save_table(df: DataFrame, path: str, replace: bool = False) -> bool:
    """SC17: persist a model / metrics table in one step: written aside, then renamed.

    A run that stops before the rename leaves nothing at ``path``.  If another run
    was first, its table stays and this returns False, unless ``replace`` is set.
    """
    spark = df.sparkSession
    aside = f"{path.rstrip('/')}.{uuid.uuid4().hex}"
    df.write.parquet(aside)
    if replace:
        old = spark._jvm.org.apache.hadoop.fs.Path(path)
        old.getFileSystem(spark._jsc.hadoopConfiguration()).delete(old, True)
    return rename_new(spark, aside, path)


def content_key(spark: SparkSession, inputs: list[str], params: dict) -> str:
    """Key of a model by content: its parameters and the name, size and time of every input file.

    Files are listed by Spark (no content is read); a sum of hashes stands for
    the list, so it needs no order and no row reaches the driver.
    """
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(inputs)
             .select(F.xxhash64("path", "length", F.unix_micros("modificationTime")).cast("decimal(38,0)").alias("h")))
    row = files.agg(F.count(F.lit(1)).alias("n"), F.sum("h").alias("h")).first()
    text = json.dumps({"files": [row["n"], str(row["h"])], "params": params}, sort_keys=True, default=str)
    return hashlib.sha256(text.encode()).hexdigest()[:24]


def model_path(spark: SparkSession, name: str, inputs: list[str], params: dict | None = None) -> str:
    """Where the model ``name`` of these inputs and parameters is kept, in the shared folder, across sessions.

    New data or other parameters are another path, so a stale model is never found.
    """
    return f"{shared_root(spark).rstrip('/')}/models/{name}-{content_key(spark, inputs, params or {})}"


def is_absent(e: AnalysisException) -> bool:
    return e.getCondition() == "PATH_NOT_FOUND"


def load_or_fit(spark: SparkSession, path: str, fit, force: bool = False) -> DataFrame:
    """Reuse the persisted table when present, else (or with ``force``) fit, save and return it.

    Only a path that does not exist counts as absent; a table that cannot be read is an error.
    Of runs that fit at the same time the first to finish is kept, and all return its table.
    """
    if not force:
        try:
            return spark.read.parquet(path)
        except AnalysisException as e:
            if not is_absent(e):
                raise
    save_table(fit(), path, replace=force)
    return spark.read.parquet(path)


def write_bucketed_series(series: DataFrame, table: str, path: str, n_buckets: int,
                          key: str = "location", ts: str = "timestamp") -> DataFrame:
    """Publish the hourly series bucketed (and sorted) by location as an external
    table, so every later per-location window or join reads co-located data
    without an exchange.  ``n_buckets`` should follow the data size
    (e.g. hourly volume / 128 MB), not the cluster size."""
    (series.write.mode("overwrite").bucketBy(n_buckets, key).sortBy(key, ts)
     .option("path", path).saveAsTable(table))
    return series.sparkSession.table(table)
