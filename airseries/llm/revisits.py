"""WARC not-modified revisits, resolved to the latest earlier full response.

A capture has record_id, url, captured (long, microseconds), kind ('response' or
'revisit'), http_status, headers (map of lower-case names) and payload_digest.
Full responses are those of kind 'response' and status 200; not-modified revisits are of
kind 'revisit' and status 304. Each revisit is joined as of its time, by canonical url, to the latest
full response captured strictly earlier (of equal times, the greatest record_id). Its
validators are checked against that response alone: the etag by weak comparison if it has one, else
last-modified. If they agree, the response's headers are updated by those of the revisit
that a 304 may change.

status: ``resolved``; ``validator-mismatch``; ``no-validator`` (the revisit has neither);
``no-earlier-response`` (also for a null url or time). Only resolved revisits have a
response_id, payload_digest and headers.

The as-of join looks at distinct (url, time) points: of responses alike in both only the greatest
record_id counts, and revisits alike in both share an answer. The points before a point are seen in three windows of a
stated bound: the times of one second of an url (10^6 at most), the seconds of one hour of it (3,600), and its hours;
the latter two hold one row per second and hour. So neither an url that holds a third of all
captures nor a burst of them meets in one task. Repeated
revisits are each resolved; of repeated responses one is used; null headers are an
empty map; other columns are ignored; an empty table gives an empty result.

The query's captures come from the pages; a page without an id has record ids made of a hash of its url and text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from airseries.llm.common import written

#: Microseconds of the coarse and the fine buckets of time.
BUCKETS = (3_600_000_000, 1_000_000)
#: Headers that a 304 never changes in the stored response (fixed values).
NOT_UPDATED = ["connection", "content-encoding", "content-length", "content-range", "content-type", "keep-alive",
               "proxy-authenticate", "proxy-authentication-info", "proxy-authorization", "te", "trailer",
               "transfer-encoding", "upgrade"]
#: Query parameters that do not name a resource (fixed pattern).
TRACKING = "^(utm_[a-z]+|ref|gclid|fbclid)(=.*)?$"


def canonical_url(url: Column) -> Column:
    """Host without case, ``www.`` and default port; path without trailing slashes; sorted query without tracking; no scheme or fragment."""
    rest = F.regexp_replace(url, "^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(rest, "^([^/?#]*)", 1)), ":(80|443)$", ""),
                            "^www[.]", "")
    path = F.regexp_replace(F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1), "/+$", "")
    params = F.split(F.regexp_extract(rest, "^[^?#]*[?]([^#]*)", 1), "&")
    query = F.array_join(F.array_sort(F.filter(params, lambda p: (p != "") & ~p.rlike(TRACKING))), "&")
    return F.concat(host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))


def weak(etag: Column) -> Column:
    return F.regexp_replace(etag, "^W/", "")


def latest_earlier(captures: DataFrame, buckets: tuple[int, int] = BUCKETS) -> DataFrame:
    """``row`` of each not-modified revisit with the record_id of its latest earlier full response."""
    rows = captures.select(
        "record_id", canonical_url(F.col("url")).alias("key"), F.col("captured").alias("t"),
        ((F.col("kind") == "response") & (F.col("http_status") == 200)).alias("full"), "row")
    rows = written(rows.where("key IS NOT NULL AND t IS NOT NULL AND (full OR row IS NOT NULL)"), "revisit-rows")
    points = rows.groupBy("key", "t").agg(
        F.max(F.when(F.col("full"), F.struct("t", "record_id"))).alias("last"),
        F.max(F.col("row").isNotNull()).alias("asked"))
    coarse, fine = (F.floor(F.col("t") / w).cast("long") for w in buckets)
    points = written(points.withColumn("hour", coarse).withColumn("second", fine), "revisit-points")

    def before(table: DataFrame, parts: list[str], order: str, name: str) -> DataFrame:
        w = Window.partitionBy(*parts).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
        return table.withColumn(name, F.max("last").over(w))

    seconds = points.groupBy("key", "hour", "second").agg(F.max("last").alias("last"))
    hours = before(seconds.groupBy("key", "hour").agg(F.max("last").alias("last")), ["key"], "hour", "of_hours")
    seconds = before(seconds, ["key", "hour"], "second", "of_seconds").join(hours.drop("last"), ["key", "hour"])
    found = before(points, ["key", "hour", "second"], "t", "of_times").where("asked").join(
        seconds.select("key", "second", F.coalesce("of_seconds", "of_hours").alias("carried")), ["key", "second"])
    answers = written(found.select(F.col("key").alias("of_key"), F.col("t").alias("of_t"),
                                   F.coalesce("of_times", "carried")["record_id"].alias("response_id")), "revisit-answers")
    # One answer for each url and time; revisits that share one are split as AQE sees their number.
    return rows.where("row IS NOT NULL").join(
        answers, (F.col("key") == F.col("of_key")) & (F.col("t") == F.col("of_t"))).select("row", "response_id")


def resolve_revisits(captures: DataFrame, buckets: tuple[int, int] = BUCKETS) -> DataFrame:
    """One row per not-modified revisit: record_id, url_key, status, response_id, payload_digest, headers."""
    none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    numbered = captures.select("record_id", "url", "captured", "kind", "http_status",
                               F.coalesce("headers", none).alias("headers"), "payload_digest")
    is_revisit = (F.col("kind") == "revisit") & (F.col("http_status") == 304)
    # `row` tells repeated revisits apart; it is read back, so it never changes
    numbered = written(numbered.withColumn("row", F.when(is_revisit, F.monotonically_increasing_id())), "revisit-captures")
    # Written, so that the join below shuffles both sides and a response that many revisits name can be split.
    responses = written(numbered.where("kind = 'response' AND http_status = 200").groupBy("record_id").agg(
        F.max_by(F.struct("headers", "payload_digest"), F.coalesce("payload_digest", F.lit(""))).alias("r")).select(
        F.col("record_id").alias("of"), F.col("r.headers").alias("stored"), F.col("r.payload_digest").alias("digest")),
        "revisit-responses")
    revisits = numbered.where("row IS NOT NULL").select(
        "row", "record_id", canonical_url(F.col("url")).alias("url_key"), "headers")
    found = revisits.join(latest_earlier(numbered, buckets), "row", "left")
    # Revisits without a response are dealt out by row instead of meeting at null.
    found = found.withColumn("wanted", F.coalesce("response_id", F.concat(F.lit("none "), F.col("row").cast("string"))))
    joined = found.join(responses, (F.col("wanted") == F.col("of")) & F.col("response_id").isNotNull(), "left")
    etag, modified = F.col("headers")["etag"], F.col("headers")["last-modified"]
    agrees = F.when(etag.isNotNull(), weak(etag) == weak(F.col("stored")["etag"])).otherwise(
        modified == F.col("stored")["last-modified"])
    status = (F.when(F.col("response_id").isNull(), "no-earlier-response")
              .when(etag.isNull() & modified.isNull(), "no-validator")
              .when(F.coalesce(agrees, F.lit(False)), "resolved").otherwise("validator-mismatch"))
    update = F.map_filter("headers", lambda k, v: ~k.isin(NOT_UPDATED))
    stays = F.map_filter("stored", lambda k, v: ~F.map_contains_key(F.col("update"), k))
    out = joined.withColumn("status", status).withColumn("update", update)
    ok = F.col("status") == "resolved"
    return out.select("record_id", "url_key", "status", F.when(ok, F.col("response_id")).alias("response_id"),
                      F.when(ok, F.col("digest")).alias("payload_digest"),
                      F.when(ok, F.map_concat(stays, "update")).alias("headers"))


def page_captures(pages: DataFrame) -> DataFrame:
    """Captures of each page over fifty days: up to three versions, a failed response and six revisits.

    Responses: ``-a`` at the start, ``-a2`` ten days on (even page_id) and ``-a3`` twenty days on (page_id divisible by three) with
    changed digests, ``-x`` with status 404. Revisits: a day before; with the first etag after 5 days and, by then often
    out of date, after 22; with the etag of the second version after 15; after 30 with the first etag, another one, only a
    last-modified date, or no validator, by page_id; and after 50 with the date of the third version.
    """
    second, day = 1_000_000, 86_400_000_000
    html, url = F.coalesce("html", F.lit("")), F.coalesce("url", F.lit(""))
    n = F.coalesce(F.col("page_id").cast("long"), F.lit(0).cast("long"))
    page = pages.select(
        n.alias("n"), F.coalesce(F.col("page_id").cast("long").cast("string"), F.concat(
            F.lit("none-"), F.md5(F.concat(url, F.lit("|"), html)))).alias("id"), "url",
        *(F.md5(F.concat(html, F.lit(v))).alias(f"digest{k}") for k, v in enumerate(("", "v2", "v3"), 1)),
        F.length(html).cast("string").alias("size"))
    t = F.lit(1_704_067_200 * second) + F.col("n") * second

    def tag(k: int) -> Column:
        return F.concat(F.lit('"'), F.col(f"digest{k}"), F.lit('"'))

    def stamp(days: int) -> Column:
        return F.concat(F.lit("t"), (t + days * day).cast("string"))

    def record(kind: str, suffix: str, days: int, status: int, headers: Column, digest: Column) -> Column:
        return F.struct(F.concat("id", F.lit(suffix)).alias("record_id"), F.col("url"), (t + days * day).alias("captured"),
                        F.lit(kind).alias("kind"), F.lit(status).alias("http_status"), headers.alias("headers"),
                        digest.alias("payload_digest"))

    fixed = [F.lit("cache-control"), F.lit("max-age=60"), F.lit("content-length"), F.lit("0")]
    etag, none = F.lit("etag"), F.lit(None).cast("string")

    def response(suffix: str, k: int, days: int, status: int = 200) -> Column:
        return record("response", suffix, days, status, F.create_map(
            etag, tag(k), F.lit("last-modified"), stamp(days), F.lit("content-type"), F.lit("text/html"),
            F.lit("content-length"), F.col("size"), F.lit("cache-control"), F.lit("no-cache")), F.col(f"digest{k}"))

    def revisit(suffix: str, days: int, headers: Column) -> Column:
        return record("revisit", suffix, days, 304, headers, none)

    weak_first = F.create_map(etag, F.concat(F.lit("W/"), tag(1)), *fixed)
    later = (F.when(F.col("n") % 11 == 0, F.create_map(*fixed))
             .when(F.col("n") % 3 == 1, F.create_map(
                 F.lit("last-modified"), F.when(F.col("n") % 2 == 0, stamp(10)).otherwise("t0"), *fixed))
             .when(F.col("n") % 5 == 0, F.create_map(etag, F.lit('"other"'), *fixed))
             .otherwise(weak_first))
    second_tag = F.when(F.col("n") % 2 == 0, tag(2)).otherwise(tag(1))
    records = F.array(
        response("-a", 1, 0), F.when(F.col("n") % 2 == 0, response("-a2", 2, 10)),
        F.when(F.col("n") % 3 == 0, response("-a3", 3, 20)), response("-x", 3, 25, 404),
        revisit("-b", -1, F.create_map(etag, tag(1), *fixed)), revisit("-c", 30, later), revisit("-e", 5, weak_first),
        revisit("-f", 15, F.create_map(etag, second_tag, *fixed)), revisit("-g", 22, weak_first),
        revisit("-h", 50, F.create_map(F.lit("last-modified"), stamp(20), *fixed)))
    return page.select(F.explode(F.filter(records, lambda r: r.isNotNull())).alias("r")).select("r.*")


def query(spark, sf_dir: str) -> DataFrame:
    resolved = resolve_revisits(page_captures(spark.read.parquet(f"{sf_dir}/pages.parquet")))
    lines = F.array_sort(F.transform(F.map_entries("headers"), lambda e: F.concat(e["key"], F.lit(": "), e["value"])))
    return resolved.withColumn("headers", F.array_join(lines, "\n"))


ORACLE = """
WITH p AS (
  SELECT coalesce(CAST(page_id AS BIGINT), 0) AS n, url,
         coalesce(CAST(CAST(page_id AS BIGINT) AS VARCHAR), 'none-' || md5(coalesce(url, '') || '|' || coalesce(html, ''))) AS id,
         md5(coalesce(html, '')) AS d1, md5(coalesce(html, '') || 'v2') AS d2, md5(coalesce(html, '') || 'v3') AS d3,
         CAST(length(coalesce(html, '')) AS VARCHAR) AS size,
         1704067200000000 + coalesce(CAST(page_id AS BIGINT), 0) * 1000000 AS t,
         regexp_replace(url, '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS rest FROM pages),
q AS (
  SELECT *, regexp_replace(regexp_replace(lower(regexp_extract(rest, '^([^/?#]*)', 1)), ':(80|443)$', ''), '^www[.]', '')
         || regexp_replace(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '/+$', '') AS place,
         array_to_string(list_sort(list_filter(string_split(regexp_extract(rest, '^[^?#]*[?]([^#]*)', 1), '&'),
           lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_[a-z]+|ref|gclid|fbclid)(=.*)?$'))), '&') AS params FROM p),
k AS (SELECT *, place || CASE WHEN params <> '' THEN '?' || params ELSE '' END AS url_key, 86400000000 AS day FROM q),
r AS (
  SELECT id || '-a' AS rid, url_key, t AS rt, d1 AS rd, size FROM k
  UNION ALL SELECT id || '-a2', url_key, t + 10 * day, d2, size FROM k WHERE n % 2 = 0
  UNION ALL SELECT id || '-a3', url_key, t + 20 * day, d3, size FROM k WHERE n % 3 = 0),
v AS (
  SELECT id || '-b' AS record_id, url_key, t - day AS at, '"' || d1 || '"' AS etag, NULL AS modified FROM k
  UNION ALL
  SELECT id || '-c', url_key, t + 30 * day,
         CASE WHEN n % 11 = 0 OR n % 3 = 1 THEN NULL WHEN n % 5 = 0 THEN '"other"' ELSE 'W/"' || d1 || '"' END,
         CASE WHEN n % 11 = 0 OR n % 3 <> 1 THEN NULL WHEN n % 2 = 0 THEN 't' || (t + 10 * day) ELSE 't0' END FROM k
  UNION ALL SELECT id || '-e', url_key, t + 5 * day, 'W/"' || d1 || '"', NULL FROM k
  UNION ALL SELECT id || '-f', url_key, t + 15 * day, '"' || CASE WHEN n % 2 = 0 THEN d2 ELSE d1 END || '"', NULL FROM k
  UNION ALL SELECT id || '-g', url_key, t + 22 * day, 'W/"' || d1 || '"', NULL FROM k
  UNION ALL SELECT id || '-h', url_key, t + 50 * day, NULL, 't' || (t + 20 * day) FROM k),
m AS (SELECT row_number() OVER () AS i, * FROM v),
j AS (
  SELECT m.*, r.rid, r.rd, r.rt, r.size AS rsize,
         row_number() OVER (PARTITION BY m.i ORDER BY r.rt DESC NULLS LAST, r.rid DESC) AS pick
  FROM m LEFT JOIN r ON r.url_key = m.url_key AND r.rt < m.at),
s AS (
  SELECT *, CASE WHEN rid IS NULL THEN 'no-earlier-response'
                 WHEN etag IS NULL AND modified IS NULL THEN 'no-validator'
                 WHEN etag IS NOT NULL AND regexp_replace(etag, '^W/', '') = '"' || rd || '"' THEN 'resolved'
                 WHEN etag IS NULL AND modified = 't' || rt THEN 'resolved'
                 ELSE 'validator-mismatch' END AS status
  FROM j WHERE pick = 1)
SELECT record_id, url_key, status,
       CASE WHEN status = 'resolved' THEN rid END AS response_id,
       CASE WHEN status = 'resolved' THEN rd END AS payload_digest,
       CASE WHEN status = 'resolved' THEN array_to_string(list_sort([
         'cache-control: max-age=60', 'content-length: ' || rsize, 'content-type: text/html',
         'etag: ' || coalesce(etag, '"' || rd || '"'), 'last-modified: ' || coalesce(modified, 't' || rt)]), chr(10)) END AS headers
FROM s
"""
