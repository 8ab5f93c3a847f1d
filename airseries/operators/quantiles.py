"""Exact quantiles by distributed selection (A15-A17 on raw volumes).

``percentile`` keeps every distinct value of a group in one buffer.  Here only
counts travel: the range of a group is cut into equal buckets, every partition
counts its rows per bucket, and the bucket that holds a wanted rank is the
group's next, narrower range.  Once that bucket is small (or holds a single value) its
few rows are ranked exactly.  Each pass is one scan with a partial aggregate;
a group that holds a third of all rows costs no more shuffle than any other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from airseries.session import cut_lineage

#: Buckets a range is cut into, and rows of a bucket that are ranked directly.
BUCKETS, FINAL_ROWS = 4096, 100_000
_LARGEST = 1.7976931348623157e308


def _bucket(v: Column, lo: Column, hi: Column, buckets: int) -> Column:
    """0 .. buckets - 1, never falling with ``v``; ``lo`` and ``hi`` fall into different buckets."""
    def half(c):  # halves cannot overflow
        return F.greatest(F.least(c, F.lit(_LARGEST)), F.lit(-_LARGEST)) / 2
    width = half(hi) - half(lo)
    inside = F.floor((half(v) - half(lo)) / F.nullif(width, F.lit(0.0)) * buckets)
    return (F.when(v == hi, F.lit(buckets - 1)).when(v == lo, F.lit(0))
            .otherwise(F.least(F.coalesce(inside, F.lit(0)), F.lit(buckets - 1)))).cast("int")


def order_statistics(df: DataFrame, keys: list[str], value: str, ranks, buckets: int = BUCKETS,
                     final_rows: int = FINAL_ROWS) -> DataFrame:
    """(k, n, rank, v): the values at 0-based ranks of each group, ``k`` a struct of the keys.

    ``ranks`` maps the column ``n`` (rows of the group) to an array of ranks.  NULL and NaN values do not count.
    """
    rows = df.select(F.struct(*keys).alias("k"), F.col(value).cast("double").alias("v")).where(
        F.col("v").isNotNull() & ~F.isnan("v"))
    ends = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    open_ = cut_lineage(ends.withColumn("rank", F.explode(F.array_distinct(ranks(F.col("n"))))).select(
        "k", "n", "rank", "lo", "hi", F.lit(0).cast("long").alias("before"), F.col("n").alias("rows")))
    done = None
    while True:
        single, small = F.col("lo") == F.col("hi"), F.col("rows") <= final_rows
        part = open_.where(single).select("k", "n", "rank", F.col("lo").alias("v"))
        ends_here = open_.where(~single & small)
        node = ends_here.select(F.col("k").alias("of"), "lo", "hi", "before").distinct()
        inside = rows.join(node, (F.col("k") == F.col("of")) & F.col("v").between(F.col("lo"), F.col("hi")))
        place = F.row_number().over(Window.partitionBy("of", "lo", "hi").orderBy("v")) - 1 + F.col("before")
        ranked = inside.select("of", "lo", "hi", F.col("v").alias("found"), place.alias("place"))
        picked = ends_here.withColumnsRenamed({"lo": "l", "hi": "h"}).join(
            ranked, (F.col("k") == F.col("of")) & (F.col("l") == F.col("lo")) & (F.col("h") == F.col("hi"))
            & (F.col("rank") == F.col("place"))).select("k", "n", "rank", F.col("found").alias("v"))
        part = part.unionByName(picked)
        done = part if done is None else done.unionByName(part)
        wide = open_.where(~single & ~small)
        if wide.isEmpty():
            return done
        node = wide.select(F.col("k").alias("of"), "lo", "hi", "before").distinct()
        counted = (rows.join(node, (F.col("k") == F.col("of")) & F.col("v").between(F.col("lo"), F.col("hi")))
                   .groupBy("of", "lo", "hi", "before", _bucket(F.col("v"), F.col("lo"), F.col("hi"), buckets).alias("b"))
                   .agg(F.count(F.lit(1)).alias("rows"), F.min("v").alias("new_lo"), F.max("v").alias("new_hi")))
        earlier = Window.partitionBy("of", "lo", "hi").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
        counted = counted.withColumn("first", F.col("before") + F.coalesce(F.sum("rows").over(earlier), F.lit(0)))
        next_ = wide.select("k", "n", "rank", F.col("lo").alias("l"), F.col("hi").alias("h")).join(
            counted, (F.col("k") == F.col("of")) & (F.col("l") == F.col("lo")) & (F.col("h") == F.col("hi"))
            & (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("first") + F.col("rows")))
        open_ = cut_lineage(next_.select("k", "n", "rank", F.col("new_lo").alias("lo"), F.col("new_hi").alias("hi"),
                                         F.col("first").alias("before"), "rows"))


def exact_quantiles(df: DataFrame, keys: list[str], value: str, probs: list[float], **options) -> DataFrame:
    """keys, n and ``q``: the quantiles ``probs`` of each group, linear between neighbours as in pandas."""
    def ranks(n):
        at = [F.lit(float(p)) * (n - 1) for p in probs]
        return F.array(*[f(x).cast("long") for x in at for f in (F.floor, F.ceil)])

    found = order_statistics(df, keys, value, ranks, **options).groupBy("k").agg(
        F.max("n").alias("n"), F.map_from_entries(F.collect_list(F.struct("rank", "v"))).alias("at"))  # 2 a quantile
    def one(p):
        x = F.lit(float(p)) * (F.col("n") - 1)
        lo = F.element_at("at", F.floor(x).cast("long"))
        hi = F.element_at("at", F.ceil(x).cast("long"))
        return lo + (hi - lo) * (x - F.floor(x))
    return found.select("k.*", "n", F.array(*[one(p) for p in probs]).alias("q"))


def _with_quartiles(df: DataFrame, keys: list[str], value: str, **options) -> DataFrame:
    """Rows (k, v) beside their group's quartiles; the group table is broadcast or split by AQE as its size allows."""
    q = exact_quantiles(df, keys, value, [0.25, 0.5, 0.75], **options).select(
        F.struct(*keys).alias("of"), F.get("q", F.lit(0)).alias("q1"), F.get("q", F.lit(1)).alias("median"),
        F.get("q", F.lit(2)).alias("q3"))
    rows = df.select(F.struct(*keys).alias("k"), F.col(value).cast("double").alias("v")).where(
        F.col("v").isNotNull() & ~F.isnan("v"))
    return rows.join(q, F.col("k") == F.col("of")).drop("of")


def raw_stats(df: DataFrame, keys: list[str], value: str, **options) -> DataFrame:
    """A15/A16 on raw rows: count, mean, sample std, min, quartiles, max per group."""
    r = _with_quartiles(df, keys, value, **options)
    return r.groupBy("k").agg(
        F.count("v").alias("n"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("std"), F.min("v").alias("min"),
        F.max("q1").alias("q1"), F.max("median").alias("median"), F.max("q3").alias("q3"), F.max("v").alias("max")
    ).select("k.*", "n", "mean", "std", "min", "q1", "median", "q3", "max")


def raw_box(df: DataFrame, keys: list[str], value: str, **options) -> DataFrame:
    """A17 on raw rows: quartiles, whiskers (extreme values inside 1.5 IQR), outliers per group."""
    r = _with_quartiles(df, keys, value, **options)
    iqr = F.col("q3") - F.col("q1")
    inside = F.col("v").between(F.col("q1") - 1.5 * iqr, F.col("q3") + 1.5 * iqr)
    return r.groupBy("k").agg(
        F.max("q1").alias("q1"), F.max("median").alias("median"), F.max("q3").alias("q3"),
        F.min(F.when(inside, F.col("v"))).alias("whisker_lo"), F.max(F.when(inside, F.col("v"))).alias("whisker_hi"),
        F.count_if(~inside).alias("n_outliers"), F.count(F.lit(1)).alias("n")
    ).select("k.*", "q1", "median", "q3", "whisker_lo", "whisker_hi", "n_outliers", "n")
