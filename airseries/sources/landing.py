"""Landing-zone table logic (SC5, SC14-SC16, J5, J6, W10, X1-X5, A37, F20, F21).

The HTTP client and file renames of the original are not rebuilt; what is kept
is the table logic: which listed resources are CSV, what file name each gets,
and whether it is new, updated or already present — all as DataFrame joins
and windows over the listing, the download-state table and the landed-file
listing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

LISTING_SCHEMA = ("id STRING, name STRING, url STRING, format STRING, position INT, "
                  "last_modified STRING, metadata_modified STRING")


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def year_token(filename) -> Column:
    """First all-digit, 4-character '_'-separated token of the lower-cased name
    without '.csv' (NULL when there is none)."""
    parts = F.split(F.replace(F.lower(_c(filename)), F.lit(".csv"), F.lit("")), "_")
    return F.get(F.filter(parts, lambda p: p.rlike("^[0-9]{4}$")), 0)


def might_contain_year(filename, cutoff_year: int) -> Column:
    """SC5: keep a file unless its year token is before the cutoff year."""
    tok = year_token(filename)
    return tok.isNull() | (tok.cast("int") >= F.lit(cutoff_year))


def semantic_filename(name) -> Column:
    """Trim + lower, drop non-[a-z0-9 ], spaces -> '_', trim '_', add '.csv'; '' if empty."""
    s = F.lower(F.regexp_replace(_c(name), r"^\s+|\s+$", ""))
    s = F.regexp_replace(s, r"[^a-z0-9 ]", "")
    s = F.regexp_replace(s, r"\s+", "_")
    s = F.regexp_replace(s, r"^_+|_+$", "")
    return F.when(s == F.lit(""), F.lit("")).otherwise(F.concat(s, F.lit(".csv")))


def filename_from_url(url) -> Column:
    """Last segment of the URL path (query and fragment excluded)."""
    path = F.coalesce(F.try_parse_url(_c(url), F.lit("PATH")), F.lit(""))
    path = F.regexp_replace(path, r"/+$", "")
    return F.element_at(F.split(path, "/"), -1)


def csv_resources(listing: DataFrame) -> DataFrame:
    """Resources whose format is CSV (case-insensitive, missing -> '')."""
    return listing.where(F.upper(F.coalesce(F.col("format"), F.lit(""))) == F.lit("CSV"))


def resources_from_json(raw: DataFrame) -> DataFrame:
    """SC14: ``{"success":..., "result": {"resources": [...]}}`` documents -> rows."""
    return raw.where(F.col("success")).select(F.inline("result.resources"))


def assign_filenames(res: DataFrame, order: str = "position") -> DataFrame:
    """W10 + X4: semantic name with _2, _3 ... for repeats (listing order);
    fallback to the URL file name when it ends in .csv, else '<id>.csv'.
    Resources without URL are skipped, as in the original loop."""
    r = res.where(F.coalesce(F.col("url"), F.lit("")) != F.lit(""))
    r = r.withColumn("semantic", semantic_filename(F.coalesce(F.col("name"), F.lit("unknown"))))
    # Ordinals only matter for non-empty names; resources with an empty name
    # (possibly many) skip the window instead of forming one large partition.
    w = Window.partitionBy("semantic").orderBy(order, "id")
    named_part = r.where(F.col("semantic") != F.lit("")).withColumn("ordinal", F.row_number().over(w))
    empty_part = r.where(F.col("semantic") == F.lit("")).withColumn("ordinal", F.lit(None).cast("int"))
    r = named_part.unionByName(empty_part)
    url_file = filename_from_url("url")
    named = F.when(F.col("ordinal") > 1,
                   F.replace(F.col("semantic"), F.lit(".csv"), F.concat(F.lit("_"), F.col("ordinal").cast("string"),
                                                                        F.lit(".csv")))
                   ).otherwise(F.col("semantic"))
    fname = (F.when(F.col("semantic") != F.lit(""), named)
             .when(url_file.endswith(".csv"), url_file)
             .otherwise(F.concat(F.coalesce(F.col("id"), F.lit("")), F.lit(".csv"))))
    return r.withColumn("url_filename", url_file).withColumn("filename", fname)


def classify(resources: DataFrame, state: DataFrame, files: DataFrame) -> DataFrame:
    """J5 + J6 + F21: one action per resource.

    ``state``: (resource_id, last_modified) recorded at download; ``files``:
    (filename) already landed.  'renamed' = the URL-named file is present and
    the semantic one is not; afterwards the file counts as present.  A present
    file among the two latest positions whose server time differs from the
    recorded one is 'updated', else 'exists'; an absent file is 'new'.
    """
    # Scalar subquery: evaluated once, inlined as a value.
    max_pos = resources.agg(F.max(F.coalesce(F.col("position"), F.lit(0)))).scalar()
    r = assign_filenames(resources).withColumn("_max_pos", max_pos)
    server = F.coalesce(F.nullif(F.col("last_modified"), F.lit("")),
                        F.nullif(F.col("metadata_modified"), F.lit("")), F.lit(""))
    f1 = files.select(F.col("filename").alias("_f1")).distinct()
    f2 = files.select(F.col("filename").alias("_f2")).distinct()
    st = state.select(F.col("resource_id").alias("_sid"), F.col("last_modified").alias("_recorded"))
    j = (r.join(f1, F.col("filename") == F.col("_f1"), "left")
          .join(f2, F.col("url_filename") == F.col("_f2"), "left")
          .join(st, F.col("id") == F.col("_sid"), "left"))
    dest_exists = F.col("_f1").isNotNull()
    renamed = (F.col("url_filename") != F.col("filename")) & F.col("_f2").isNotNull() & ~dest_exists
    present = dest_exists | renamed
    is_latest = F.coalesce(F.col("position"), F.lit(-1)) >= F.col("_max_pos") - F.lit(1)
    changed = ~F.col("_recorded").eqNullSafe(server)
    action = (F.when(present & is_latest & changed, F.lit("updated"))
              .when(present, F.lit("exists"))
              .otherwise(F.lit("new")))
    return j.select("id", "name", "filename", "url_filename", "position", server.alias("server_modified"),
                    renamed.alias("renamed"), is_latest.alias("is_latest"), action.alias("action"))


def cycle_counters(classified: DataFrame) -> DataFrame:
    """Counters of one cycle."""
    return classified.agg(
        F.count(F.lit(1)).alias("checked"),
        F.count_if(F.col("action") == "new").alias("downloaded"),
        F.count_if(F.col("action") == "updated").alias("updated"),
        F.count_if(F.col("renamed")).alias("renamed"),
        F.count_if(F.col("action") == "exists").alias("skipped_exists"))


def next_state(classified: DataFrame, state: DataFrame) -> DataFrame:
    """SC15: state after the cycle: new/updated resources record the server time."""
    touched = classified.where(F.col("action").isin("new", "updated")).select(
        F.col("id").alias("resource_id"), F.col("server_modified").alias("last_modified"))
    kept = state.join(touched.select("resource_id"), "resource_id", "left_anti")
    return kept.unionByName(touched)


def _heads(batches):
    import pandas as pd

    from airseries.sources.csv_raw import read_head
    for pdf in batches:
        yield pd.DataFrame({"path": pdf["path"], "length": pdf["length"], "head": [
            read_head(p, 256).decode("utf-8", errors="replace") for p in pdf["path"]]})


def landed_files(spark, path: str) -> DataFrame:
    """SC16: (path, length, valid) of every landed file; valid ones are not HTML and hold >= 100 bytes.

    Lengths come from the listing, which leaves out files without bytes; only the first 256 bytes of a file are
    read, whatever its size.
    """
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length"))
    heads = files.mapInPandas(_heads, "path STRING, length BIGINT, head STRING")
    return heads.select("path", "length", valid_file(F.col("length"), F.col("head")).alias("valid"))


def valid_file(length: Column, head: Column, min_bytes: int = 100) -> Column:
    head = F.lower(head)
    return (length >= F.lit(min_bytes)) & ~(head.contains("<!doctype html") | head.contains("<html"))
