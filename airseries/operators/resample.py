"""Calendar resampling with empty buckets.

Bucket means are computed with a partial/final aggregate on (location, bucket);
the calendar grid per location is ``explode(sequence(first, last, step))`` of
the per-location bounds, left-joined to the means.  The grid grows with the
time span only, never with the raw volume.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from airseries.functions.timefns import floor_day, floor_hour, floor_month, week_ending_monday

FREQS = {
    "hour": (floor_hour, "INTERVAL 1 HOUR"),
    "day": (floor_day, "INTERVAL 1 DAY"),
    "week_mon": (week_ending_monday, "INTERVAL 7 DAYS"),
    "month": (floor_month, "INTERVAL 1 MONTH"),
}


def bucket_of(freq: str, ts: str = "timestamp") -> Column:
    return FREQS[freq][0](ts)


def densify(means: DataFrame, key: str, bucket: str, step: str) -> DataFrame:
    """Add the empty buckets between each key's first and last bucket."""
    bounds = means.groupBy(key).agg(F.min(bucket).alias("_lo"), F.max(bucket).alias("_hi"))
    grid = bounds.select(key, F.explode(F.sequence("_lo", "_hi", F.expr(step))).alias(bucket))
    return grid.join(means, [key, bucket], "left")


def resample_mean(series: DataFrame, freq: str, value_cols, key: str = "location",
                  ts: str = "timestamp", dense: bool = True) -> DataFrame:
    """Mean per (key, bucket); ``dense`` adds empty buckets as NULL rows."""
    fn, step = FREQS[freq]
    means = (series.groupBy(key, fn(ts).alias(ts))
             .agg(*[F.avg(c).alias(c) for c in value_cols]))
    return densify(means, key, ts, step) if dense else means
