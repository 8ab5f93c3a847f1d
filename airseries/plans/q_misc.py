"""Landing-zone queries: a resource listing derived from the
``pages`` table (id, <title> text as name, url, format from the URL language,
position = page_id) drives naming, ordinals and new/updated/exists
classification against a download state and a landed-file list both derived
from the same listing."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from airseries.sources import landing as L
from airseries.plans.oracle import lineitem_readings_cte
from airseries.plans.registry import register
from airseries.session import scratch_path
from airseries.sources.readings import table
from airseries.sources.state_log import StateLog


def pages_listing(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    lang = F.regexp_extract("url", r"/([a-z]{2})/", 1)
    server_month = F.lpad(((F.col("page_id") % 12) + 1).cast("string"), 2, "0")
    return p.select(
        F.concat(F.lit("res-"), F.col("page_id").cast("string")).alias("id"),
        F.regexp_extract("html", r"<title>(.*?)</title>", 1).alias("name"),
        "url",
        F.when(lang == "en", F.lit("CSV")).when(lang == "fr", F.lit("csv"))
         .when(lang == "de", F.lit("json")).alias("format"),
        F.col("page_id").cast("int").alias("position"),
        F.when(F.col("page_id") % 4 == 0, F.lit(""))
         .otherwise(F.concat(F.lit("2025-"), server_month, F.lit("-01"))).alias("last_modified"),
        F.lit("2025-01-15").alias("metadata_modified"),
        F.col("page_id"))


def _state_and_files(csv):
    named = L.assign_filenames(csv)
    server = F.coalesce(F.nullif(F.col("last_modified"), F.lit("")),
                        F.nullif(F.col("metadata_modified"), F.lit("")), F.lit(""))
    state = csv.where(F.col("page_id") % 3 != 0).select(
        F.col("id").alias("resource_id"),
        F.when(F.col("page_id") % 2 == 0, server).otherwise(F.lit("2024-12-31")).alias("last_modified"))
    files = (named.where(F.col("page_id") % 3 != 0).select("filename")
             .unionByName(named.where((F.col("page_id") % 3 == 0) & (F.col("page_id") % 7 == 0))
                          .select(F.col("url_filename").alias("filename"))))
    return state, files


def _classified(spark, sf_dir):
    csv = L.csv_resources(pages_listing(spark, sf_dir))
    state, files = _state_and_files(csv)
    return L.classify(csv, state, files), state


# ------------------------------------------------------------ SQL mirrors
_SEM = ("CASE WHEN {s} = '' THEN '' ELSE {s} || '.csv' END").format(
    s="regexp_replace(regexp_replace(regexp_replace(lower(regexp_replace(coalesce(name, 'unknown'), "
      "'^\\s+|\\s+$', '', 'g')), '[^a-z0-9 ]', '', 'g'), '\\s+', '_', 'g'), '^_+|_+$', '', 'g')")
_URLF = ("regexp_extract(regexp_replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), "
         "'/+$', ''), '([^/]*)$', 1)")
_LISTING = """listing AS (SELECT 'res-' || CAST(page_id AS VARCHAR) AS id,
    regexp_extract(html, '<title>(.*?)</title>', 1) AS name, url,
    CASE regexp_extract(url, '/([a-z]{2})/', 1) WHEN 'en' THEN 'CSV' WHEN 'fr' THEN 'csv' WHEN 'de' THEN 'json' END AS format,
    CAST(page_id AS INTEGER) AS position,
    CASE WHEN page_id % 4 = 0 THEN '' ELSE '2025-' || lpad(CAST(page_id % 12 + 1 AS VARCHAR), 2, '0') || '-01' END AS last_modified,
    '2025-01-15' AS metadata_modified, page_id FROM pages),
csv AS (SELECT * FROM listing WHERE upper(coalesce(format, '')) = 'CSV')"""
_NAMED = f"""sem AS (SELECT *, {_SEM} AS semantic, {_URLF} AS url_filename FROM csv WHERE coalesce(url, '') <> ''),
ordn AS (SELECT *, CASE WHEN semantic <> '' THEN row_number() OVER (PARTITION BY semantic ORDER BY position, id) END AS ordinal FROM sem),
named AS (SELECT *, CASE WHEN semantic <> '' THEN
      (CASE WHEN ordinal > 1 THEN replace(semantic, '.csv', '_' || CAST(ordinal AS VARCHAR) || '.csv') ELSE semantic END)
    WHEN url_filename LIKE '%.csv' THEN url_filename ELSE coalesce(id, '') || '.csv' END AS filename FROM ordn)"""
_SERVER = "coalesce(nullif(last_modified, ''), nullif(metadata_modified, ''), '')"
_CLASSIFY = f"""{_LISTING}, {_NAMED},
state AS (SELECT id AS resource_id, CASE WHEN page_id % 2 = 0 THEN {_SERVER} ELSE '2024-12-31' END AS last_modified
          FROM csv WHERE page_id % 3 <> 0),
files AS (SELECT filename FROM named WHERE page_id % 3 <> 0
          UNION ALL SELECT url_filename AS filename FROM named WHERE page_id % 3 = 0 AND page_id % 7 = 0),
mx AS (SELECT max(coalesce(position, 0)) AS max_pos FROM csv),
j AS (SELECT n.*, {_SERVER} AS server_modified,
        EXISTS (SELECT 1 FROM files f WHERE f.filename = n.filename) AS dest_exists,
        EXISTS (SELECT 1 FROM files f WHERE f.filename = n.url_filename) AS url_exists,
        (SELECT s.last_modified FROM state s WHERE s.resource_id = n.id) AS recorded,
        coalesce(position, -1) >= (SELECT max_pos FROM mx) - 1 AS is_latest
      FROM named n),
cls AS (SELECT *, (url_filename <> filename AND url_exists AND NOT dest_exists) AS renamed FROM j),
act AS (SELECT *, CASE WHEN (dest_exists OR renamed) AND is_latest AND recorded IS DISTINCT FROM server_modified THEN 'updated'
                       WHEN dest_exists OR renamed THEN 'exists' ELSE 'new' END AS action FROM cls)"""


@register("clean_names", f"""
WITH {_LISTING}
SELECT CAST(page_id AS BIGINT) AS page_id, name, {_SEM} AS semantic, {_URLF} AS url_filename,
  (regexp_extract_all(replace(lower({_SEM}), '.csv', ''), '(?:^|_)([0-9]{{4}})(?:_|$)', 1))[1] AS year_tok
FROM listing
""")
def clean_names(spark, sf_dir):
    """X1 + X2 + X3: semantic file name, URL file name and year token of every listed resource."""
    lst = pages_listing(spark, sf_dir)
    sem = L.semantic_filename(F.coalesce(F.col("name"), F.lit("unknown")))
    return lst.select(F.col("page_id").cast("bigint").alias("page_id"), "name", sem.alias("semantic"),
                      L.filename_from_url("url").alias("url_filename"),
                      L.year_token(sem).alias("year_tok"))


@register("name_ordinals", f"""
WITH {_LISTING}, {_NAMED}
SELECT id, semantic, CAST(ordinal AS BIGINT) AS ordinal, filename FROM named
""")
def name_ordinals(spark, sf_dir):
    """W10 + X4 + F20 + X5: CSV resources, duplicate-name ordinals and final file names."""
    n = L.assign_filenames(L.csv_resources(pages_listing(spark, sf_dir)))
    return n.select("id", "semantic", "ordinal", "filename")


@register("listing_classify", f"""
WITH {_CLASSIFY}
SELECT id, filename, url_filename, CAST(position AS BIGINT) AS position, server_modified, renamed, is_latest, action FROM act
""")
def listing_classify(spark, sf_dir):
    """J5 + J6 + F21 + SC15: new / updated / exists per resource against state and landed files."""
    c, _ = _classified(spark, sf_dir)
    return c.drop("name")


@register("cycle_counters", f"""
WITH {_CLASSIFY}
SELECT CAST(count(*) AS BIGINT) AS checked, CAST(count(*) FILTER (WHERE action = 'new') AS BIGINT) AS downloaded,
  CAST(count(*) FILTER (WHERE action = 'updated') AS BIGINT) AS updated,
  CAST(count(*) FILTER (WHERE renamed) AS BIGINT) AS renamed,
  CAST(count(*) FILTER (WHERE action = 'exists') AS BIGINT) AS skipped_exists FROM act
""")
def cycle_counters(spark, sf_dir):
    """Cycle counters."""
    c, _ = _classified(spark, sf_dir)
    return L.cycle_counters(c)


@register("state_after_cycle", f"""
WITH {_CLASSIFY},
touched AS (SELECT id AS resource_id, server_modified AS last_modified FROM act WHERE action IN ('new', 'updated'))
SELECT resource_id, last_modified FROM state WHERE resource_id NOT IN (SELECT resource_id FROM touched)
UNION ALL SELECT resource_id, last_modified FROM touched
""")
def state_after_cycle(spark, sf_dir):
    """SC15: download state after the cycle."""
    c, state = _classified(spark, sf_dir)
    return L.next_state(c, state)


@register("state_committed", f"""
WITH {_CLASSIFY},
touched AS (SELECT id AS resource_id, server_modified AS last_modified FROM act WHERE action IN ('new', 'updated'))
SELECT resource_id, last_modified, CAST(3 AS BIGINT) AS cycles FROM (
SELECT resource_id, last_modified FROM state WHERE resource_id NOT IN (SELECT resource_id FROM touched)
UNION ALL SELECT resource_id, last_modified FROM touched)
""")
def state_committed(spark, sf_dir):
    """SC15: the state after committed cycles; one run stops between write and commit, one cycle is repeated."""
    csv = L.csv_resources(pages_listing(spark, sf_dir))
    state, files = _state_and_files(csv)
    log = StateLog(spark, scratch_path(spark, f"state-{uuid.uuid4().hex[:12]}"), every=2)
    # The recorded state arrives in two cycles (the second one after a snapshot), then the listing's cycle follows.
    half = F.xxhash64("resource_id") % 2 == 0
    done = log.commit("import-1", lambda _: state.where(half)) + log.commit("import-2", lambda _: state.where(~half))

    def cycle(now):
        c = L.classify(csv, now, files).where(F.col("action").isin("new", "updated"))
        return c.select(F.col("id").alias("resource_id"), F.col("server_modified").alias("last_modified"))

    log._write(cycle(log.read()).withColumn("last_modified", F.lit("lost")))  # written, never committed
    done += log.commit("cycle-1", cycle) + log.commit("cycle-1", cycle)       # the second one has no effect
    return log.read().withColumn("cycles", F.lit(done).cast("bigint"))


@register("missing_months", f"""
WITH {lineitem_readings_cte()},
rr AS (SELECT CAST(sensor_id AS BIGINT) AS supplier, date_trunc('month', timestamp) AS month FROM r),
present AS (SELECT DISTINCT supplier, month FROM rr),
bounds AS (SELECT min(month) AS lo, max(month) AS hi FROM rr),
expected AS (SELECT s.supplier, unnest(generate_series(b.lo, b.hi, INTERVAL 1 MONTH)) AS month
             FROM (SELECT DISTINCT supplier FROM rr) s, bounds b)
SELECT supplier, month FROM expected e WHERE NOT EXISTS
  (SELECT 1 FROM present p WHERE p.supplier = e.supplier AND p.month = e.month)
""")
def missing_months(spark, sf_dir):
    """SC12 + U6: expected monthly files (full span, per supplier) minus those present."""
    from airseries.sources.readings import lineitem_readings
    r = lineitem_readings(spark, sf_dir).select(
        F.col("sensor_id").cast("bigint").alias("supplier"),
        F.date_trunc("month", "timestamp").cast("timestamp_ntz").alias("month"))
    present = r.select("supplier", "month").distinct()
    # Expected months come from a generator over the span (scalar subqueries
    # for its bounds), not from a join: one row per supplier and month.
    lo = r.agg(F.min("month")).scalar()
    hi = r.agg(F.max("month")).scalar()
    expected = (r.select("supplier").distinct()
                .select("supplier", F.explode(F.sequence(lo, hi, F.expr("INTERVAL 1 MONTH"))).alias("month")))
    return expected.join(present, ["supplier", "month"], "left_anti")
