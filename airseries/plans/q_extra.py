"""Remaining inventory rows: processing run, dashboard tiles, labels, samples,
row-complete correlation, wide heatmap, notebook calendar, listing JSON,
family export, source fallback, model reuse."""

from __future__ import annotations

import uuid
from itertools import combinations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from airseries.functions.aqi import aqi_category_sql, aqi_sql
from airseries.functions.timefns import day_name, period_label
from airseries.operators import explore as X
from airseries.operators import forecast as FC
from airseries.operators import hourly as H
from airseries.operators.features import add_features
from airseries.plans import dashboard as D
from airseries.plans.oracle import features_cte, hourly_chain, hourly_cte, lineitem_readings_cte, pivot_cte, r6, readings_cte
from airseries.plans.q_misc import pages_listing
from airseries.plans.registry import register
from airseries.session import scratch_path
from airseries.sources import landing as L
from airseries.sources import sinks
from airseries.sources.dimension import FIXTURE_SITES, location_dim, with_location_label
from airseries.sources.readings import events_readings, lineitem_readings

HCOLS = ["P0", "P1", "P2", "humidity", "temperature"]


def _hourly(spark, sf_dir):
    return H.hourly_wide(events_readings(spark, sf_dir))


def _scratch(spark, name):
    return scratch_path(spark, f"{name}-{uuid.uuid4().hex[:12]}")


_P2L = [f"P2_lag_{n}" for n in (1, 2, 3, 4, 5, 24)]


@register("processed_series", f"""
WITH {readings_cte()},
el AS (SELECT location FROM r WHERE location IS NOT NULL AND timestamp >= TIMESTAMP '2024-01-01 00:00:00'
       GROUP BY location HAVING count(DISTINCT date_trunc('hour', timestamp)) >= 645),
r2 AS (SELECT * FROM r WHERE timestamp >= TIMESTAMP '2024-01-01 00:00:00' AND location IN (SELECT location FROM el)),
{pivot_cte(src='r2')}, {hourly_cte(name='h0')},
h AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY location) AS n_ FROM h0) WHERE n_ >= 24),
{features_cte()}
SELECT location, timestamp, heure, jour_semaine, periode, {r6('P2', 'P2')}, {r6('temperature', 'temperature')},
       {', '.join(r6(c, c) for c in _P2L)} FROM f
""")
def processed_series(spark, sf_dir):
    """Entry A (SC1 -> F1 -> A1/F15 -> A2 -> A4 -> F14 -> features): locations with >= 645 hours."""
    f = D.processed_series(events_readings(spark, sf_dir), min_hours=645, cutoff="2024-01-01")
    return f.select("location", "timestamp", "heure", "jour_semaine", "periode", "P2", "temperature", *_P2L)


@register("dashboard_current", f"""
WITH {hourly_chain()},
c AS (SELECT *, max(timestamp) OVER (PARTITION BY location) AS mx FROM h),
t AS (SELECT location, avg(P2) AS mean, min(P2) AS mn, max(P2) AS mxv FROM c
      WHERE timestamp >= mx - INTERVAL 24 HOUR GROUP BY location)
SELECT location, {r6('mean', 'mean')}, {r6('mn', 'min')}, {r6('mxv', 'max')}, {aqi_sql('mean')} AS aqi,
       {aqi_category_sql(aqi_sql('mean'), 'label')} AS label, {aqi_category_sql(aqi_sql('mean'), 'color')} AS color,
       mean > 15 AS exceeds, CAST(15 AS DOUBLE) AS threshold FROM t
""")
def dashboard_current(spark, sf_dir):
    """Entry B tiles (F7 + A9 + X18 + X23 + X24): last-24 h mean/min/max, AQI, category, guideline."""
    return D.current_tiles(_hourly(spark, sf_dir), "PM2.5", 24)


_KNOWN = FIXTURE_SITES[:4]
_DIM4 = ", ".join(f"(CAST({a} AS BIGINT), '{b}')" for a, b, _, _ in _KNOWN)


@register("location_labels", f"""
WITH {hourly_chain()},
m AS (SELECT location, CAST(count(*) AS BIGINT) AS rows FROM h GROUP BY location)
SELECT m.location, rows, coalesce(d.name, 'Location ' || CAST(m.location AS VARCHAR)) AS label
FROM m LEFT JOIN (VALUES {_DIM4}) d(location, name) ON m.location = d.location
""")
def location_labels(spark, sf_dir):
    """J1 (left form): selector labels with a default for sites without coordinates."""
    m = _hourly(spark, sf_dir).groupBy("location").agg(F.count(F.lit(1)).alias("rows"))
    return with_location_label(m, location_dim(spark, _KNOWN))


_PAIRS = list(combinations(HCOLS, 2))
_CC_UNION = " UNION ALL ".join(
    f"SELECT location, '{a}' AS col_a, '{b}' AS col_b, {r6(f'corr({a}, {b})', 'corr')} FROM hc GROUP BY location"
    for a, b in _PAIRS)


@register("corr_matrix_complete", f"""
WITH {hourly_chain()}, hc AS (SELECT * FROM h WHERE {' AND '.join(c + ' IS NOT NULL' for c in HCOLS)})
{_CC_UNION}
""")
def corr_matrix_complete(spark, sf_dir):
    """F13 + A19 (row-complete variant): rows with any NULL measure dropped first."""
    return X.corr_matrix(_hourly(spark, sf_dir).dropna("any", subset=HCOLS), HCOLS)


_HW = ", ".join(r6(f"avg(P2) FILTER (WHERE heure = {h})", f"`{h}`") for h in range(24))


@register("heatmap_wide", f"""
WITH {hourly_chain()}, {features_cte()},
d AS (SELECT location, heure, P2, CASE jour_semaine WHEN 'Monday' THEN 'Lun' WHEN 'Tuesday' THEN 'Mar'
        WHEN 'Wednesday' THEN 'Mer' WHEN 'Thursday' THEN 'Jeu' WHEN 'Friday' THEN 'Ven'
        WHEN 'Saturday' THEN 'Sam' WHEN 'Sunday' THEN 'Dim' END AS jour_fr FROM f)
SELECT location, jour_fr, {_HW.replace('`', '"')},
  CAST(list_position(['Lun', 'Mar', 'Mer', 'Jeu', 'Ven', 'Sam', 'Dim'], jour_fr) AS BIGINT) AS day_rank
FROM d GROUP BY location, jour_fr
""")
def heatmap_wide(spark, sf_dir):
    """A10 wide form: one row per (location, day), 24 hour columns."""
    return X.heatmap_wide(add_features(_hourly(spark, sf_dir)), "P2")


@register("head_tail", f"""
WITH {hourly_chain()},
k AS (SELECT *, row_number() OVER (PARTITION BY location ORDER BY timestamp) AS a,
             row_number() OVER (PARTITION BY location ORDER BY timestamp DESC) AS b FROM h)
SELECT location, timestamp, CASE WHEN a <= 5 THEN 'head' ELSE 'tail' END AS part, {r6('P2', 'P2')}
FROM k WHERE a <= 5 OR b <= 5
""")
def head_tail(spark, sf_dir):
    """S3: first and last five rows of every series."""
    h = _hourly(spark, sf_dir)
    a = F.row_number().over(Window.partitionBy("location").orderBy("timestamp"))
    b = F.row_number().over(Window.partitionBy("location").orderBy(F.col("timestamp").desc()))
    k = h.withColumn("_a", a).withColumn("_b", b).where((F.col("_a") <= 5) | (F.col("_b") <= 5))
    return k.select("location", "timestamp",
                    F.when(F.col("_a") <= 5, F.lit("head")).otherwise(F.lit("tail")).alias("part"), "P2")


@register("distinct_locations", f"""
WITH {readings_cte(False)} SELECT DISTINCT location FROM r WHERE location IS NOT NULL
""")
def distinct_locations(spark, sf_dir):
    """Sorted distinct locations (one location per user)."""
    r = events_readings(spark, sf_dir, dense=False)
    return r.where(F.col("location").isNotNull()).select("location").distinct().orderBy("location")


@register("calendar_notebook", f"""
WITH {hourly_chain()}
SELECT location, timestamp, CAST(year(timestamp) AS BIGINT) AS annee, CAST(month(timestamp) AS BIGINT) AS mois,
  CAST(day(timestamp) AS BIGINT) AS jour, CAST(hour(timestamp) AS BIGINT) AS heure, dayname(timestamp) AS jour_semaine,
  CASE WHEN isodow(timestamp) >= 6 THEN 'Week-end' ELSE 'Semaine' END AS periode FROM h
""")
def calendar_notebook(spark, sf_dir):
    """X10 + X11 + X25 (notebook vocabulary): year, month, day, hour, day name, Week-end/Semaine."""
    h = _hourly(spark, sf_dir).select("location", "timestamp")
    return h.select("location", "timestamp", F.year("timestamp").alias("annee"), F.month("timestamp").alias("mois"),
                    F.dayofmonth("timestamp").alias("jour"), F.hour("timestamp").alias("heure"),
                    day_name("timestamp").alias("jour_semaine"),
                    period_label("timestamp", "notebook").alias("periode"))


@register("listing_json", """
SELECT 'res-' || CAST(page_id AS VARCHAR) AS id, regexp_extract(html, '<title>(.*?)</title>', 1) AS name, url,
  CAST(page_id AS BIGINT) AS position
FROM pages WHERE upper(coalesce(CASE regexp_extract(url, '/([a-z]{2})/', 1) WHEN 'en' THEN 'CSV' WHEN 'fr' THEN 'csv'
  WHEN 'de' THEN 'json' END, '')) = 'CSV'
""")
def listing_json(spark, sf_dir):
    """SC14 + X39: listing documents landed as JSON, read back, resources inlined, CSV kept."""
    path = _scratch(spark, "listing")
    lst = pages_listing(spark, sf_dir)
    cols = [c for c in lst.columns if c != "page_id"]
    # The listing is paged: one document per 50 resources, so no group grows with the listing.
    docs = lst.groupBy(F.floor(F.col("page_id") / 50).alias("page")).agg(
        F.collect_list(F.struct(*cols)).alias("resources"))
    docs.select(F.lit(True).alias("success"), F.struct("resources").alias("result")) \
        .write.mode("overwrite").json(path)
    raw = spark.read.json(path)
    res = L.csv_resources(L.resources_from_json(raw))
    return res.select("id", "name", "url", F.col("position").cast("bigint").alias("position"))


@register("export_families", f"""
WITH {hourly_chain()},
fam AS (SELECT 'hourly' AS family, location, strftime(timestamp, '%Y-%m') AS month FROM h
        UNION ALL SELECT 'raw' AS family, location, strftime(timestamp, '%Y-%m') AS month FROM p)
SELECT family, location, month, CAST(count(*) AS BIGINT) AS rows FROM fam GROUP BY 1, 2, 3
""")
def export_families(spark, sf_dir):
    """SC11: two tables x location x month exported in one partitioned write, counted back."""
    path = _scratch(spark, "families")
    p = H.pivot_first(events_readings(spark, sf_dir))
    sinks.export_families({"hourly": H.hourly_mean(p), "raw": p}, path)
    back = spark.read.parquet(path)
    return back.groupBy("family", F.col("location").cast("bigint").alias("location"),
                        F.col("month").cast("string").alias("month")).agg(F.count(F.lit(1)).alias("rows"))


@register("series_fallback", f"""
WITH {hourly_chain()}
SELECT location, CASE WHEN location <= 3 THEN 'primary' ELSE 'legacy' END AS source,
       CAST(count(*) AS BIGINT) AS rows FROM h GROUP BY 1, 2
""")
def series_fallback(spark, sf_dir):
    """SC7: legacy rows are used only for locations the primary output lacks."""
    h = _hourly(spark, sf_dir)
    primary = h.where(F.col("location") <= 3).withColumn("source", F.lit("primary"))
    legacy = h.withColumn("source", F.lit("legacy"))
    u = sinks.with_fallback(primary, legacy)
    return u.groupBy("location", "source").agg(F.count(F.lit(1)).alias("rows"))


@register("model_reuse", f"""
WITH {lineitem_readings_cte()}, {pivot_cte(types=['P2'])}, {hourly_cte(types=['P2'])}
SELECT request, CAST(fits AS BIGINT) AS fits, CAST((SELECT count(DISTINCT location) FROM h WHERE P2 IS NOT NULL) AS BIGINT) AS models
FROM (VALUES ('first', 1), ('again', 1), ('other parameters', 2), ('new data', 3), ('forced', 4)) v(request, fits)
""")
def model_reuse(spark, sf_dir):
    """M15 + SC17: a model is reused for the same data and parameters, and refitted when the data in
    the same folder change, when parameters change, or when asked for."""
    data = _scratch(spark, "model-data")
    name = f"reuse-{uuid.uuid4().hex[:12]}"
    h = H.hourly_wide(lineitem_readings(spark, sf_dir), value_types=["P2"]).where(F.col("P2").isNotNull())
    h.select(F.col("location").cast("string").alias("model_key"), F.col("timestamp").alias("ds"), F.col("P2").alias("y")) \
        .write.parquet(data)
    fits = []

    def request(label, spec, force=False):
        def fit():
            fits.append(label)
            return FC.fit_additive(spark.read.parquet(data), spec)
        path = sinks.model_path(spark, name, [data], vars(spec))
        models = sinks.load_or_fit(spark, path, fit, force).count()
        return label, len(fits), models

    plain, other = FC.AdditiveSpec([]), FC.AdditiveSpec([], daily_order=2)
    rows = [request("first", plain), request("again", plain), request("other parameters", other)]
    spark.read.parquet(data).limit(0).write.mode("append").parquet(data)  # a new file in the folder
    rows += [request("new data", plain), request("forced", plain, force=True)]
    return spark.createDataFrame(rows, "request STRING, fits BIGINT, models BIGINT")


@register("explicit_locations", f"""
WITH {readings_cte()},
r2 AS (SELECT * FROM r WHERE location IN (1, 3, 5)),
{pivot_cte(src='r2')}, {hourly_cte()}
SELECT location, CAST(count(*) AS BIGINT) AS rows, min(timestamp) AS start, max(timestamp) AS "end" FROM h GROUP BY location
""")
def explicit_locations(spark, sf_dir):
    """F16 + A29: an explicit location list instead of the eligibility rule."""
    r = H.keep_eligible(events_readings(spark, sf_dir), locations=[1, 3, 5])
    return H.manifest(H.hourly_wide(r))


@register("dashboard_range_weekdays", f"""
WITH {hourly_chain()}, {features_cte()},
t AS (SELECT location, avg(P1) AS mean, min(P1) AS mn, max(P1) AS mxv FROM f
      WHERE timestamp >= TIMESTAMP '2024-01-08 00:00:00' AND timestamp <= TIMESTAMP '2024-01-21 00:00:00' + INTERVAL 1 DAY
        AND periode = 'semaine'
      GROUP BY location)
SELECT location, {r6('mean', 'mean')}, {r6('mn', 'min')}, {r6('mxv', 'max')}, {aqi_sql('mean', 'PM10')} AS aqi,
       {aqi_category_sql(aqi_sql('mean', 'PM10'), 'label')} AS label,
       {aqi_category_sql(aqi_sql('mean', 'PM10'), 'color')} AS color,
       mean > 45 AS exceeds, CAST(45 AS DOUBLE) AS threshold FROM t
""")
def dashboard_range_weekdays(spark, sf_dir):
    """Entry B with a custom date range and weekdays only (F8 + F9 + A9 + X18 + X24), PM10."""
    series = add_features(_hourly(spark, sf_dir))
    return D.current_tiles(series, "PM10", hours=None, day_kind="weekday",
                           date_from="2024-01-08", date_to="2024-01-21")
