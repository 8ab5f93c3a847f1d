"""Row windows over series longer than a task.

A window ``PARTITION BY location`` sorts a whole series in one task; that holds
for hourly series, not for a sensor with a reading per second.  Here a series
is cut into chunks of ``chunk_rows`` consecutive rows.  Rows are numbered in two levels
(counts per day, then inside a day), so no task sees more than a day or a chunk:

* lags and rolling frames: each chunk gets the few rows before it (or after it)
  as a halo, which is dropped again;
* interpolation: one small row per chunk carries its first and last known value,
  a prefix pass over these rows gives every chunk the last known value before it and
  the next one after it;
* autocorrelation: lag products are summed per chunk, and the sums added up.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from airseries.operators.fusion import numbered

CHUNK_ROWS = 100_000


def chunked(df: DataFrame, by: str = "location", order: str = "timestamp", chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """``df`` with ``_rn`` (1, 2, ... in the series) and ``_chunk``."""
    return numbered(df, [by], order, name="_rn").withColumn("_chunk", F.expr(f"(_rn - 1) div {int(chunk_rows)}"))


def with_halo(df: DataFrame, before: int = 0, after: int = 0, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Rows of :func:`chunked` plus copies of the last ``before`` rows of the chunk before and the
    first ``after`` rows of the chunk behind; copies have ``_halo`` set."""
    if max(before, after) > chunk_rows:
        raise ValueError("a halo reaches into the neighbouring chunk only: chunk_rows must not be smaller")
    at = (F.col("_rn") - 1) % chunk_rows
    homes = F.array(
        F.struct(F.col("_chunk").alias("chunk"), F.lit(False).alias("halo")),
        F.when(at >= chunk_rows - before, F.struct((F.col("_chunk") + 1).alias("chunk"), F.lit(True).alias("halo"))),
        F.when((at < after) & (F.col("_chunk") > 0), F.struct((F.col("_chunk") - 1).alias("chunk"), F.lit(True).alias("halo"))))
    return (df.withColumn("_home", F.explode(F.filter(homes, lambda h: h.isNotNull())))
            .withColumn("_chunk", F.col("_home.chunk")).withColumn("_halo", F.col("_home.halo")).drop("_home"))


def _inside(by: str):
    return Window.partitionBy(by, "_chunk").orderBy("_rn")


def add_lags(df: DataFrame, variables, lags, by: str = "location", order: str = "timestamp",
             chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Lag by row, as ``features.add_lags``."""
    rows = with_halo(chunked(df, by, order, chunk_rows), before=max(lags), chunk_rows=chunk_rows)
    w = _inside(by)
    out = rows.withColumns({f"{v}_lag_{n}": F.lag(v, n).over(w) for v in variables for n in lags})
    return out.where(~F.col("_halo")).drop("_halo", "_chunk", "_rn")


def rolling(df: DataFrame, col: str, n: int = 24, by: str = "location", order: str = "timestamp",
            chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Mean and sample std of the last ``n`` rows."""
    rows = with_halo(chunked(df, by, order, chunk_rows), before=n - 1, chunk_rows=chunk_rows)
    w = _inside(by).rowsBetween(-(n - 1), 0)
    out = rows.withColumns({f"{col}_roll_mean": F.avg(col).over(w), f"{col}_roll_std": F.stddev_samp(col).over(w)})
    return out.where(~F.col("_halo")).drop("_halo", "_chunk", "_rn")


def interpolate(df: DataFrame, col: str, by: str = "location", order: str = "timestamp", method: str = "linear",
                chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """As ``features.interpolate``: by row position or by elapsed time; leading NULLs stay, trailing ones
    take the last known value."""
    rows = chunked(df, by, order, chunk_rows)
    if method == "linear":
        pos: Column = F.col("_rn").cast("double")
    elif method == "time":
        pos = F.unix_micros(F.col(order).cast("timestamp")).cast("double")
    else:
        raise ValueError("method must be 'linear' or 'time'")
    known = F.when(F.col(col).isNotNull(), F.struct(F.col("_pos").alias("p"), F.col(col).cast("double").alias("v")))
    rows = rows.withColumn("_pos", pos).withColumn("_known", known)
    ends = rows.groupBy(by, "_chunk").agg(F.min_by("_known", F.when(F.col(col).isNotNull(), F.col("_rn"))).alias("_first"),
                                          F.max_by("_known", F.when(F.col(col).isNotNull(), F.col("_rn"))).alias("_last"))
    w = Window.partitionBy(by).orderBy("_chunk")
    down = Window.partitionBy(by).orderBy(F.col("_chunk").desc())
    upto = (Window.unboundedPreceding, -1)
    carries = ends.select(by, "_chunk", F.last("_last", ignorenulls=True).over(w.rowsBetween(*upto)).alias("_before"),
                          F.last("_first", ignorenulls=True).over(down.rowsBetween(*upto)).alias("_after"))
    inside = _inside(by).rowsBetween(Window.unboundedPreceding, 0)
    back = Window.partitionBy(by, "_chunk").orderBy(F.col("_rn").desc()).rowsBetween(Window.unboundedPreceding, 0)
    out = rows.withColumn("_a", F.last("_known", ignorenulls=True).over(inside)) \
              .withColumn("_b", F.last("_known", ignorenulls=True).over(back)) \
              .join(carries, [by, "_chunk"])
    a, b = F.coalesce("_a", "_before"), F.coalesce("_b", "_after")
    a_p, a_v, b_p, b_v = a["p"], a["v"], b["p"], b["v"]
    filled = (F.when(F.col(col).isNotNull(), F.col(col)).when(a.isNull(), F.lit(None).cast("double"))
              .when(b.isNull(), a_v).otherwise(a_v + (b_v - a_v) * (F.col("_pos") - a_p) / (b_p - a_p)))
    return out.withColumn(col, filled).select(*df.columns)


def lag_products(x: DataFrame, value: str, nlags: int, by: str, order: str, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """by, n, ``s``: for k = 0 .. nlags the sum of value times the value k rows later, each chunk by itself."""
    rows = with_halo(chunked(x, by, order, chunk_rows), after=nlags, chunk_rows=chunk_rows)
    w = _inside(by)
    rows = rows.withColumns({f"_l{k}": F.lead(value, k).over(w) for k in range(1, nlags + 1)}).where(~F.col("_halo"))
    sums = [F.sum(F.col(value) * F.col(value))] + [F.sum(F.col(value) * F.col(f"_l{k}")) for k in range(1, nlags + 1)]
    return rows.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.array(*sums).alias("s"))
