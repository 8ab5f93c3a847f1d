"""Helpers shared by the training-data operators."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from airseries.session import checkpoint_dir

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

#: White space of the operators' word rule ``[^\x20\x09-\x0D]+`` (fixed value).
SPACE_CLASS = r"[\x20\x09-\x0D]+"


def ready(spark: SparkSession) -> SparkSession:
    """Session settings the operators need; safe to call again and again.

    Arrow batches are bounded by rows (long texts) so that a Python worker
    holds a few MB at a time, and the workers find this package by path.
    """
    env = spark.sparkContext.environment
    known = env.get("PYTHONPATH", os.environ.get("PYTHONPATH", ""))
    if ROOT not in known.split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, known) if x)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "512")
    return spark


#: Run folders that are open, the innermost last.
_RUNS: list[str] = []


@contextmanager
def run_folder(spark: SparkSession) -> Iterator[str]:
    """While it is open, all tables that operators write in between lie below one folder, removed at its end.

    A result that is read lazily must be written elsewhere before::

        with run_folder(spark):
            exact_dedup.drop_exact_duplicates(docs).write.parquet(path)
    """
    folder = f"{checkpoint_dir(spark).rstrip('/')}/llm-run-{uuid.uuid4().hex[:12]}"
    _RUNS.append(folder)
    try:
        yield folder
    finally:
        _RUNS.remove(folder)
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below ``spark.checkpoint.dir`` (or the open run folder), which all executors share."""
    top = _RUNS[-1] if _RUNS else checkpoint_dir(spark).rstrip("/")
    return f"{top}/llm-{name}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    Cuts the lineage: a lost executor costs a re-read, never a recomputation.
    """
    path = shared_folder(df.sparkSession, name)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the two columns the text operators read; null text is empty."""
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"),
                       F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(c, upper, upper.lower())


def join_groups(rows: DataFrame, groups: DataFrame, keys: list[str], size: str,
                parts: int = 1000) -> DataFrame:
    """Left join of ``rows`` with one row per key in ``groups``, safe for hot keys.

    ``size`` is the column of ``groups`` that counts its rows. Groups that hold
    over 1/``parts`` of all rows are fewer than ``parts`` whatever the input,
    so they are broadcast and their rows never meet in one task; all other
    rows take the shuffle join. ``rows`` and ``groups`` should be written
    tables, as both are read twice.
    """
    total = groups.agg(F.coalesce(F.sum(size), F.lit(0)).alias("n")).first()["n"]
    least = max(int(total) // parts, 1000)
    hot = F.broadcast(groups.where(F.col(size) > least).withColumn("__hot", F.lit(True)))
    marked = rows.join(hot.select(*keys, "__hot"), keys, "left")
    cold = marked.where(F.col("__hot").isNull()).drop("__hot").join(
        groups.where(F.col(size) <= least), keys, "left")
    return rows.join(hot, keys).drop("__hot").select(cold.columns).unionByName(cold)


#: Ids that are broadcast at most; one id is 8 bytes.
BROADCAST_IDS = 4_000_000


def only_listed(docs: DataFrame, ids: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` whose id is in ``ids`` (one column ``doc_id``, null ids match nothing).

    A counted list of up to ``BROADCAST_IDS`` ids goes to the texts; a longer one is joined by shuffle.
    """
    listed = ids.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("__listed")).distinct()
    if listed.count() <= BROADCAST_IDS:
        listed = F.broadcast(listed)
    return docs.join(listed, F.col(f"`{id_col}`").cast("long") == F.col("__listed"), "left_semi")
