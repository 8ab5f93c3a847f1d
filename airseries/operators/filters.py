"""Row filters on series (F1-F13).  All are plain predicates Catalyst can push down."""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from airseries.functions.constants import TEMPERATURE_MAX


def _ts_lit(v):
    if isinstance(v, str):
        v = _dt.datetime.fromisoformat(v)
    if isinstance(v, _dt.date) and not isinstance(v, _dt.datetime):
        v = _dt.datetime(v.year, v.month, v.day)
    return F.lit(v).cast("timestamp_ntz")


def date_cutoff(df: DataFrame, cutoff, col: str = "timestamp") -> DataFrame:
    """keep rows at or after ``cutoff``."""
    return df.where(F.col(col) >= _ts_lit(cutoff))


def last_n_hours(df: DataFrame, n: int = 24, by: str = "location") -> DataFrame:
    """rows with timestamp >= (series max - n hours), per location, inclusive."""
    w = Window.partitionBy(by)
    return (df.withColumn("_mx", F.max("timestamp").over(w))
            .where(F.col("timestamp") >= F.col("_mx") - F.expr(f"INTERVAL {int(n)} HOURS"))
            .drop("_mx"))


def date_range(df: DataFrame, start, end, col: str = "timestamp") -> DataFrame:
    """F8: start <= ts <= end + 1 day (closed: next midnight is included)."""
    s = _ts_lit(start)
    e = _ts_lit(end) + F.expr("INTERVAL 1 DAY")
    return df.where((F.col(col) >= s) & (F.col(col) <= e))


def day_type(df: DataFrame, kind: str = "all", col: str = "periode") -> DataFrame:
    """'all', 'weekday' (semaine) or 'weekend'."""
    if kind == "all":
        return df
    label = {"weekday": "semaine", "semaine": "semaine", "weekend": "weekend"}[kind]
    return df.where(F.col(col) == F.lit(label))


def same_day(df: DataFrame, day, col: str = "timestamp") -> DataFrame:
    """rows of one calendar day."""
    d = F.lit(_dt.date.fromisoformat(day) if isinstance(day, str) else day)
    return df.where(F.to_date(F.col(col)) == d)


def exclude_value_type(readings: DataFrame, value_type: str = "noise_Leq") -> DataFrame:
    """drop one value type; rows with a NULL type are kept."""
    return readings.where(~F.col("value_type").eqNullSafe(F.lit(value_type)))


def sanitize_temperature(df: DataFrame, col: str = "temperature",
                         limit: float = TEMPERATURE_MAX) -> DataFrame:
    """values above the limit become NULL."""
    return df.withColumn(col, F.when(F.col(col) > F.lit(limit), F.lit(None).cast("double"))
                         .otherwise(F.col(col)))
