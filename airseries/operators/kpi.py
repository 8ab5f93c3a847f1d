"""Period-over-period KPIs (A14, J7, W12, X6, X21) for every location at once.

Daily: last calendar day vs the calendar day before it (absent -> NULL deltas).
Weekly: the last 7 dense daily means vs the 7 before (8-13 buckets: the 7
ending one bucket earlier, overlapping; fewer: none).  4-weekly: the last 4
week-ending-Monday means vs the 4 before (5-7 buckets: 4 ending one earlier).
Fewer than 2 buckets -> no row.  Current/previous are conditional aggregates
of one pass, no self-join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from airseries.functions.timefns import day_month_label, day_month_year_label
from airseries.operators.resample import resample_mean

KPI_COLS = ["min", "mean", "max", "min_delta", "min_delta_pct", "mean_delta", "mean_delta_pct",
            "max_delta", "max_delta_pct", "period_label"]


def variation(current: Column, previous: Column):
    """(delta, pct); NULL when previous is NULL, NaN or 0."""
    ok = previous.isNotNull() & ~F.isnan(previous) & (previous != F.lit(0.0))
    delta = F.when(ok, current - previous)
    return delta, F.when(ok, (current - previous) / previous * F.lit(100.0))


def _pack(df: DataFrame, key: str) -> DataFrame:
    cols = [F.col(key), F.col("c_min").alias("min"), F.col("c_mean").alias("mean"),
            F.col("c_max").alias("max")]
    for s in ("min", "mean", "max"):
        d, p = variation(F.col(f"c_{s}"), F.col(f"p_{s}"))
        cols += [d.alias(f"{s}_delta"), p.alias(f"{s}_delta_pct")]
    return df.select(*cols, "period_label")


def daily_kpis(series: DataFrame, particle: str, key: str = "location", ts: str = "timestamp") -> DataFrame:
    """Last calendar day vs the previous calendar day."""
    days = (series.groupBy(key, F.to_date(ts).alias("d"))
            .agg(F.min(particle).alias("mn"), F.max(particle).alias("mx"),
                 F.sum(particle).alias("sm"), F.count(particle).alias("cnt")))
    days = days.withColumn("d1", F.max("d").over(Window.partitionBy(key)))
    cur = F.col("d") == F.col("d1")
    prev = F.col("d") == F.date_sub(F.col("d1"), 1)

    def pick(cond, c):
        return F.max(F.when(cond, F.col(c)))

    agg = days.groupBy(key).agg(
        pick(cur, "mn").alias("c_min"), pick(cur, "mx").alias("c_max"),
        (pick(cur, "sm") / pick(cur, "cnt")).alias("c_mean"),
        pick(prev, "mn").alias("p_min"), pick(prev, "mx").alias("p_max"),
        (pick(prev, "sm") / pick(prev, "cnt")).alias("p_mean"),
        day_month_year_label(F.max("d1")).alias("period_label"),
    )
    return _pack(agg, key)


def bucket_kpis(buckets: DataFrame, particle: str, k_cur: int, key: str = "location",
                ts: str = "timestamp") -> DataFrame:
    """Last ``k_cur`` dense buckets vs the previous block (W12 + Q14/Q15)."""
    w_desc = Window.partitionBy(key).orderBy(F.col(ts).desc())
    b = (buckets.withColumn("k", F.row_number().over(w_desc))
         .withColumn("n", F.count(F.lit(1)).over(Window.partitionBy(key)))
         .where(F.col("n") >= F.lit(2)))
    k, n = F.col("k"), F.col("n")
    cur = k <= F.lit(k_cur)
    prev = (F.when(n >= F.lit(2 * k_cur), k.between(k_cur + 1, 2 * k_cur))
            .when(n >= F.lit(k_cur + 1), k.between(2, k_cur + 1))
            .otherwise(F.lit(False)))
    v = F.col(particle)
    agg = b.groupBy(key).agg(
        F.min(F.when(cur, v)).alias("c_min"), F.avg(F.when(cur, v)).alias("c_mean"),
        F.max(F.when(cur, v)).alias("c_max"),
        F.min(F.when(prev, v)).alias("p_min"), F.avg(F.when(prev, v)).alias("p_mean"),
        F.max(F.when(prev, v)).alias("p_max"),
        F.min(F.when(cur, F.col(ts))).alias("_s"), F.max(F.when(cur, F.col(ts))).alias("_e"),
    ).withColumn("period_label", F.concat(day_month_label(F.col("_s")), F.lit(" - "),
                                          day_month_label(F.col("_e"))))
    return _pack(agg, key)


def calculate_kpis(series: DataFrame, particle: str = "P2", timeframe: str = "D",
                   key: str = "location", ts: str = "timestamp") -> DataFrame:
    """'D', 'W' or 'M' for every location of ``series``."""
    if timeframe == "D":
        return daily_kpis(series, particle, key, ts)
    if timeframe == "W":
        return bucket_kpis(resample_mean(series, "day", [particle], key, ts), particle, 7, key, ts)
    if timeframe == "M":
        return bucket_kpis(resample_mean(series, "week_mon", [particle], key, ts), particle, 4, key, ts)
    raise ValueError("timeframe must be 'D', 'W' or 'M'")
