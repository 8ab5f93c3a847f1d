"""Exploratory statistics per location.

Statistics run on the hourly series, whose size per location is bounded by the
clock hours in the span (<= 8,784 per year) however many raw rows a location
has; exact quantiles (``percentile``) therefore hold at most that many values
per group.  Everything is one grouped plan over all locations.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from airseries.functions.timefns import day_fr, day_rank_fr


def _quartiles(v):
    return F.percentile(v, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))


def selection_stats(df: DataFrame, col: str, key: str = "location") -> DataFrame:
    """Mean / min / max of the selection."""
    return df.groupBy(key).agg(F.avg(col).alias("mean"), F.min(col).alias("min"), F.max(col).alias("max"))


def series_stats(df: DataFrame, col: str, key: str = "location") -> DataFrame:
    """Mean, sample std, min, max, median, Q1, Q3 (linear interpolation, exact)."""
    return (df.groupBy(key)
            .agg(F.avg(col).alias("mean"), F.stddev_samp(col).alias("std"),
                 F.min(col).alias("min"), F.max(col).alias("max"), _quartiles(col).alias("_q"))
            .select(key, "mean", "std", "min", "max",
                    F.col("_q")[1].alias("median"), F.col("_q")[0].alias("q1"), F.col("_q")[2].alias("q3")))


def describe(df: DataFrame, cols, key: str = "location") -> DataFrame:
    """count/mean/std/min/25%/50%/75%/max per (location, measure), long form."""
    long = df.unpivot([key], list(cols), "measure", "value")
    return (long.groupBy(key, "measure")
            .agg(F.count("value").alias("count"), F.avg("value").alias("mean"),
                 F.stddev_samp("value").alias("std"), F.min("value").alias("min"),
                 _quartiles("value").alias("_q"), F.max("value").alias("max"))
            .select(key, "measure", "count", "mean", "std", "min",
                    F.col("_q")[0].alias("p25"), F.col("_q")[1].alias("p50"),
                    F.col("_q")[2].alias("p75"), "max"))


def describe_categorical(df: DataFrame, cols, key: str = "location") -> DataFrame:
    """A15 (all-columns variant): count, unique, top (most frequent; ties -> smallest value), freq."""
    long = df.select(key, *[F.col(c).cast("string").alias(c) for c in cols]).unpivot([key], list(cols), "measure", "value")
    counts = long.where(F.col("value").isNotNull()).groupBy(key, "measure", "value").agg(F.count(F.lit(1)).alias("_c"))
    return counts.groupBy(key, "measure").agg(
        F.sum("_c").alias("count"), F.count(F.lit(1)).alias("unique"),
        F.min_by("value", F.struct(-F.col("_c"), F.col("value"))).alias("top"),
        F.max("_c").alias("freq"))


def box_stats(df: DataFrame, col: str, by: str, key: str = "location") -> DataFrame:
    """Quartiles, 1.5 IQR fences, whiskers (extreme values inside the fences), outliers."""
    w = Window.partitionBy(key, by)
    q = (df.where(F.col(col).isNotNull())
         .withColumn("_q", _quartiles(col).over(w)))
    q1, med, q3 = F.col("_q")[0], F.col("_q")[1], F.col("_q")[2]
    lo = q1 - F.lit(1.5) * (q3 - q1)
    hi = q3 + F.lit(1.5) * (q3 - q1)
    v = F.col(col)
    inside = (v >= lo) & (v <= hi)
    return (q.groupBy(key, by)
            .agg(F.first(q1).alias("q1"), F.first(med).alias("median"), F.first(q3).alias("q3"),
                 F.min(F.when(inside, v)).alias("whisker_lo"), F.max(F.when(inside, v)).alias("whisker_hi"),
                 F.count_if(~inside).alias("n_outliers"), F.count(F.lit(1)).alias("n"))
            .withColumn("iqr", F.col("q3") - F.col("q1")))


def histogram(df: DataFrame, col: str, bins: int = 50, key: str = "location") -> DataFrame:
    """Equal-width bins between each location's min and max; the max lands in the last bin."""
    w = Window.partitionBy(key)
    v = F.col(col)
    d = (df.where(v.isNotNull())
         .withColumn("_mn", F.min(v).over(w)).withColumn("_mx", F.max(v).over(w)))
    width = (F.col("_mx") - F.col("_mn")) / F.lit(float(bins))
    b = F.when(F.col("_mx") > F.col("_mn"),
               F.least(F.floor((v - F.col("_mn")) / width).cast("bigint") + 1, F.lit(bins).cast("bigint"))
               ).otherwise(F.lit(1).cast("bigint"))
    return (d.withColumn("bin", b).groupBy(key, "bin")
            .agg(F.count(F.lit(1)).alias("count"),
                 F.first(F.col("_mn") + (F.col("bin") - 1) * width).alias("lo"),
                 F.first(F.col("_mn") + F.col("bin") * width).alias("hi")))


def corr_matrix(df: DataFrame, cols, key: str = "location") -> DataFrame:
    """Pairwise-complete Pearson correlation of every column pair, long form."""
    pairs = list(combinations(cols, 2))
    wide = df.groupBy(key).agg(*[F.corr(a, b).alias(f"{a}__{b}") for a, b in pairs])
    stack = ", ".join(f"'{a}', '{b}', `{a}__{b}`" for a, b in pairs)
    return wide.select(key, F.expr(f"stack({len(pairs)}, {stack}) AS (col_a, col_b, corr)"))


def corr_with(df: DataFrame, target: str, others, key: str = "location") -> DataFrame:
    """Correlation of the target with each other column (e.g. its lags)."""
    wide = df.groupBy(key).agg(*[F.corr(target, o).alias(o) for o in others])
    stack = ", ".join(f"'{o}', `{o}`" for o in others)
    return wide.select(key, F.expr(f"stack({len(others)}, {stack}) AS (feature, corr)"))


def value_freq(df: DataFrame, col: str, top: int = 10, key: str = "location") -> DataFrame:
    """Value counts with share of rows, top-k per location (count desc, value asc)."""
    counts = df.groupBy(key, col).agg(F.count(F.lit(1)).alias("count"))
    w_all = Window.partitionBy(key)
    w = Window.partitionBy(key).orderBy(F.col("count").desc(), F.col(col))
    return (counts.withColumn("pct", F.col("count") / F.sum("count").over(w_all) * F.lit(100.0))
            .withColumn("rank", F.row_number().over(w))
            .where(F.col("rank") <= F.lit(top)))


def null_profile(df: DataFrame, cols) -> DataFrame:
    """NULL count and percent per column, only columns with NULLs."""
    n = F.count(F.lit(1))
    wide = df.agg(n.alias("_n"), *[F.count_if(F.col(c).isNull()).alias(c) for c in cols])
    stack = ", ".join(f"'{c}', `{c}`" for c in cols)
    return (wide.select("_n", F.expr(f"stack({len(cols)}, {stack}) AS (measure, n_null)"))
            .where(F.col("n_null") > 0)
            .select("measure", "n_null", (F.col("n_null") / F.col("_n") * F.lit(100.0)).alias("pct")))


def distinct_profile(df: DataFrame, cols) -> DataFrame:
    """Distinct non-null values per column."""
    wide = df.agg(*[F.countDistinct(c).alias(c) for c in cols])
    stack = ", ".join(f"'{c}', `{c}`" for c in cols)
    return wide.select(F.expr(f"stack({len(cols)}, {stack}) AS (measure, n_distinct)"))


def duplicate_count(df: DataFrame, subset=None) -> DataFrame:
    """Rows minus distinct rows (NULL-safe: NULLs compare equal, as in pandas)."""
    cols = list(subset or df.columns)
    g = df.groupBy(*cols).agg(F.count(F.lit(1)).alias("_c"))
    return g.agg(F.sum(F.col("_c") - 1).alias("n_duplicates"), F.count(F.lit(1)).alias("n_distinct"))


def hour_profile(df: DataFrame, col: str, key: str = "location", hour: str = "heure") -> DataFrame:
    """Mean per hour of day."""
    return df.groupBy(key, hour).agg(F.avg(col).alias("mean"))


def global_profile(profile: DataFrame, key: str = "location", hour: str = "heure") -> DataFrame:
    """A12 + U3: per-location profiles plus a 'global' row = mean of the location means."""
    g = profile.groupBy(hour).agg(F.avg("mean").alias("mean")).withColumn(key, F.lit("global"))
    return profile.withColumn(key, F.col(key).cast("string")).unionByName(g)


def peak_hours(profile: DataFrame, key: str = "location", hour: str = "heure") -> DataFrame:
    """Hour of the highest and lowest mean; ties -> earliest hour."""
    return profile.where(F.col("mean").isNotNull()).groupBy(key).agg(
        F.min_by(hour, F.struct(-F.col("mean"), F.col(hour))).alias("peak_hour"),
        F.max(F.col("mean")).alias("peak_mean"),
        F.min_by(hour, F.struct(F.col("mean"), F.col(hour))).alias("low_hour"),
        F.min(F.col("mean")).alias("low_mean"))


def period_mean(df: DataFrame, col: str, key: str = "location", period: str = "periode") -> DataFrame:
    """Mean by weekday/weekend."""
    return df.groupBy(key, period).agg(F.avg(col).alias("mean"))


def heatmap(df: DataFrame, col: str, key: str = "location") -> DataFrame:
    """A10 long form: (location, French day, Monday-first rank, hour) -> mean."""
    d = df.withColumn("jour_fr", day_fr(F.col("jour_semaine")))
    return (d.groupBy(key, "jour_fr", "heure").agg(F.avg(col).alias("mean"))
            .withColumn("day_rank", day_rank_fr(F.col("jour_fr"))))


def heatmap_wide(df: DataFrame, col: str, key: str = "location") -> DataFrame:
    """A10 wide form: one row per (location, day), 24 hour columns, Monday-first order."""
    d = df.withColumn("jour_fr", day_fr(F.col("jour_semaine")))
    return (d.groupBy(key, "jour_fr").pivot("heure", list(range(24))).agg(F.avg(col))
            .withColumn("day_rank", day_rank_fr(F.col("jour_fr")))
            .orderBy(key, "day_rank"))


def distinct_months(df: DataFrame, key: str = "location", ts: str = "timestamp") -> DataFrame:
    """Distinct calendar months (seasonality hint)."""
    return df.groupBy(key).agg(F.countDistinct(F.month(ts)).alias("n_months"),
                               F.countDistinct(F.date_trunc("month", ts)).alias("n_year_months"))
