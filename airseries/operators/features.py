"""Per-location window features: lags, interpolation, rolling statistics, calendar.

All windows share ``PARTITION BY location ORDER BY timestamp`` so Catalyst
plans one exchange and one sort for the whole feature set.  Windows run on the
hourly series, which is bounded by the number of clock hours in the span
(8,784 per location-year) whatever the raw volume, so a hot location cannot
blow up one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from airseries.functions.constants import LAG_VARIABLES, LAGS, TEMPERATURE_MAX
from airseries.functions.timefns import day_name, hour_of_day, period_label


def series_window(by: str = "location", order: str = "timestamp"):
    return Window.partitionBy(by).orderBy(order)


def add_lags(df: DataFrame, variables=LAG_VARIABLES, lags=LAGS, by: str = "location") -> DataFrame:
    """Lag by row (previous present hour), not by clock hour."""
    w = series_window(by)
    cols = {f"{v}_lag_{n}": F.lag(v, n).over(w) for v in variables if v in df.columns for n in lags}
    return df.withColumns(cols)


def add_calendar(df: DataFrame, ts: str = "timestamp") -> DataFrame:
    """heure, jour_semaine (English name), periode (weekend/semaine)."""
    return df.withColumns({
        "heure": hour_of_day(ts).cast("bigint"),
        "jour_semaine": day_name(ts),
        "periode": period_label(ts),
    })


def interpolate(df: DataFrame, col: str, by: str = "location", order: str = "timestamp",
                method: str = "linear") -> DataFrame:
    """Fill NULLs of ``col`` between known neighbours.

    ``linear``: weights by row position; ``time``: by elapsed time.  Leading
    NULLs stay NULL; trailing NULLs take the last known value.  The 'next known'
    value comes from a running frame over the reversed order (O(n) per
    partition), never from an unbounded-following frame.
    """
    if method == "linear":
        pos = F.row_number().over(Window.partitionBy(by).orderBy(order)).cast("double")
    elif method == "time":
        pos = F.unix_micros(F.col(order).cast("timestamp")).cast("double")
    else:
        raise ValueError("method must be 'linear' or 'time'")
    known = F.when(F.col(col).isNotNull(), F.struct(F.col("_pos").alias("p"), F.col(col).alias("v")))
    w_fwd = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    w_bwd = Window.partitionBy(by).orderBy(F.col(order).desc()).rowsBetween(Window.unboundedPreceding, 0)
    out = (df.withColumn("_pos", pos)
           .withColumn("_a", F.last(known, ignorenulls=True).over(w_fwd))
           .withColumn("_b", F.last(known, ignorenulls=True).over(w_bwd)))
    a_p, a_v = F.col("_a.p"), F.col("_a.v")
    b_p, b_v = F.col("_b.p"), F.col("_b.v")
    filled = (F.when(F.col(col).isNotNull(), F.col(col))
              .when(F.col("_a").isNull(), F.lit(None).cast("double"))
              .when(F.col("_b").isNull(), a_v)
              .otherwise(a_v + (b_v - a_v) * (F.col("_pos") - a_p) / (b_p - a_p)))
    return out.withColumn(col, filled).drop("_pos", "_a", "_b")


def clean_temperature(df: DataFrame, col: str = "temperature", by: str = "location",
                      limit: float = TEMPERATURE_MAX) -> DataFrame:
    """F11 + W3: > limit -> NULL, then linear interpolation by position."""
    df = df.withColumn(col, F.when(F.col(col) > F.lit(limit), F.lit(None).cast("double"))
                       .otherwise(F.col(col)))
    return interpolate(df, col, by)


def add_features(hourly: DataFrame, by: str = "location") -> DataFrame:
    """The processing run's feature step: calendar, sanitised temperature, 18 lags.

    Lags (on P0/P1/P2) are added before the temperature interpolation so the
    ascending-order windows share one sort and only the reversed 'next known
    value' window needs a second one.
    """
    out = add_lags(add_calendar(hourly), by=by)
    if "temperature" in out.columns:
        out = clean_temperature(out, by=by)
    return out


def rolling(df: DataFrame, col: str, n: int = 24, by: str = "location") -> DataFrame:
    """Rolling mean and sample std over the last ``n`` rows (min 1 row),
    plus the +-1 sigma band."""
    w = series_window(by).rowsBetween(-(n - 1), 0)
    return df.withColumns({
        f"{col}_roll_mean": F.avg(col).over(w),
        f"{col}_roll_std": F.stddev_samp(col).over(w),
    }).withColumns({
        f"{col}_band_lo": F.col(f"{col}_roll_mean") - F.col(f"{col}_roll_std"),
        f"{col}_band_hi": F.col(f"{col}_roll_mean") + F.col(f"{col}_roll_std"),
    })


def next_row_target(df: DataFrame, target: str, lag_cols: list[str], by: str = "location") -> DataFrame:
    """M1 (W2 + F12 + X14): drop rows with NULL lags/target, then y = next row's target.

    The lead is taken *after* the filter, matching the original, so y is the
    next surviving row's value.
    """
    base = df.dropna(subset=list(lag_cols) + [target])
    w = series_window(by)
    return (base.withColumn("ds", F.col("timestamp").cast("timestamp_ntz"))
            .withColumn("y", F.lead(target, 1).over(w))
            .where(F.col("y").isNotNull()))


def col_or_null(df: DataFrame, name: str) -> Column:
    return F.col(name) if name in df.columns else F.lit(None).cast("double")
