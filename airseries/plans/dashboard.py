"""Dashboard tables (entry B) and the batch processing run (entry A) as plans.

Each builder returns lazy DataFrames for *every* location; a UI would filter
one location, which Catalyst pushes down to the scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from airseries.functions.aqi import aqi, aqi_category, substance_column, who_exceedance, who_threshold
from airseries.functions.constants import MIN_HOURS, MIN_ROWS_PER_LOCATION
from airseries.operators import explore as X
from airseries.operators import filters, hourly as H
from airseries.operators.features import add_features
from airseries.operators.kpi import calculate_kpis
from airseries.plans.snapshot import aqi_snapshot


def processed_series(readings: DataFrame, min_hours: int = MIN_HOURS, locations=None,
                     min_rows: int = MIN_ROWS_PER_LOCATION, cutoff: str | None = None) -> DataFrame:
    """Entry A: cutoff -> eligible locations -> hourly wide -> >= 24 rows -> features."""
    r = filters.date_cutoff(readings, cutoff) if cutoff else readings
    r = H.keep_eligible(r, min_hours, locations)
    return add_features(H.min_rows(H.hourly_wide(r), min_rows))


def current_tiles(series: DataFrame, substance: str = "PM2.5", hours: int | None = 24,
                  day_kind: str = "all", date_from=None, date_to=None) -> DataFrame:
    """Entry B headline: filtered mean/min/max, its AQI and category, guideline check."""
    col = substance_column(substance)
    f = series
    if hours:
        f = filters.last_n_hours(f, hours)
    elif date_from is not None and date_to is not None:
        f = filters.date_range(f, date_from, date_to)
    f = filters.day_type(f, day_kind)
    t = X.selection_stats(f, col)
    cat = aqi_category(F.col("aqi"))
    return (t.withColumn("aqi", aqi(F.col("mean"), substance))
            .withColumn("label", cat.getField("label")).withColumn("color", cat.getField("color"))
            .withColumn("exceeds", who_exceedance(F.col("mean"), substance))
            .withColumn("threshold", F.lit(who_threshold(substance))))


def dashboard_tables(series: DataFrame, dim: DataFrame, substance: str = "PM2.5", hours: int = 24,
                     timeframe: str = "D") -> dict[str, DataFrame]:
    col = substance_column(substance)
    return {
        "current": current_tiles(series, substance, hours),
        "map": aqi_snapshot(series, dim, substance),
        "kpis": calculate_kpis(series, col, timeframe),
        "heatmap": X.heatmap(series, col),
        "export": series.select("location", F.col("timestamp").alias("Date"), F.col(col).alias("Valeur")),
    }
