"""Exact deduplication by progressive refinement.

Documents are grouped by normalised length, the groups that survive (two or
more rows) by a hash of the first characters, and only the groups that still
survive by the SHA-256 of the whole normalised text. Each level moves narrow
rows alone (ids, lengths, hashes), all counting is partially aggregated before
its shuffle, and groups that hold a large share of the rows are joined by
broadcast (:func:`airseries.llm.common.join_groups`).

Two texts are equal when identical after deleting ``[\\x20\\x09-\\x0D]``.
Null text is empty; empty texts form one group. Of a group the row with most
code points in the original text stays, then the smallest id (null ids last);
of rows alike in both, one stays. An empty table gives an empty result; other
columns, whatever their names, are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from airseries.llm.common import SPACE_CLASS, id_and_text, join_groups, written

#: Code points of the normalised text that the second level hashes.
PREFIX = 128


def normalised(text: Column) -> Column:
    return F.regexp_replace(text, SPACE_CLASS, "")


def refine(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
           digest_all: bool = False) -> DataFrame:
    """One row per document: doc_id, n_cp, norm_len, prefix_hash, sha, copies.

    ``copies`` counts rows alike in id and text. ``sha`` is the binary SHA-256 of the
    normalised text; it is null for a document that an earlier level has
    already shown to be single, unless ``digest_all`` asks for every digest
    (then the one scan hashes it, and no second scan of the texts follows).
    """
    texts = id_and_text(docs, id_col, text_col).withColumn("norm", normalised(F.col("text")))
    sha = F.unhex(F.sha2("norm", 256))
    cols = ["doc_id", "n_cp", "norm_len", "prefix_hash"] + ["sha"] * digest_all
    keys = texts.select(
        "doc_id", F.length("text").cast("long").alias("n_cp"),
        F.length("norm").cast("long").alias("norm_len"),
        F.xxhash64(F.substring("norm", 1, PREFIX)).alias("prefix_hash"),
        *([sha.alias("sha")] if digest_all else []))
    keys = written(keys.groupBy(*cols).agg(F.count("*").alias("copies")), "dedup-keys")

    # The levels count groups, not rows: a hot group is one row for each task.
    by_prefix = ["norm_len", "prefix_hash"]
    lengths = written(keys.groupBy("norm_len").agg(F.sum("copies").alias("n")).where("n > 1").select("norm_len"),
                      "dedup-lengths")
    of_length = keys.join(lengths, ["norm_len"], "left_semi")  # documents of a length of their own end here
    survivors = written(of_length.groupBy(*by_prefix).agg(F.sum("copies").alias("n")).where("n > 1").select(*by_prefix),
                        "dedup-survivors")
    level2 = written(keys.join(survivors, by_prefix, "left_semi"), "dedup-level2")
    if digest_all:
        full = level2
    else:
        # The whole texts are hashed for the survivors only; rows of one id may differ in text.
        wanted = level2.select("doc_id").distinct()
        again = texts.join(wanted, texts.doc_id.eqNullSafe(wanted.doc_id), "left_semi").select(
            "doc_id", F.length("text").cast("long").alias("n_cp"),
            F.length("norm").cast("long").alias("norm_len"),
            F.xxhash64(F.substring("norm", 1, PREFIX)).alias("prefix_hash"), sha.alias("sha"))
        again = again.groupBy("doc_id", "n_cp", *by_prefix, "sha").agg(F.count("*").alias("copies"))
        # An id's other texts may have been single at the earlier levels; those come from `rest`.
        full = again.join(survivors, by_prefix, "left_semi")
    rest = keys.join(survivors, by_prefix, "left_anti")
    if not digest_all:
        rest = rest.withColumn("sha", F.lit(None).cast("binary"))
    order = ["doc_id", "n_cp", "norm_len", "prefix_hash", "sha", "copies"]
    shared = full.select(*order).withColumn("single", F.lit(False))
    return shared.unionByName(rest.select(*order).withColumn("single", F.lit(True)))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 digest_all: bool = False) -> DataFrame:
    """One row per document and text: doc_id, n_cp, keep_id, group_size, keeper, copies and the keys.

    ``keeper`` marks the document that stays of its group.
    """
    refined = written(refine(docs, id_col, text_col, digest_all), "dedup-refined")
    shared = refined.where(~F.col("single"))
    # min of a struct is a partial aggregate: no group meets in one task
    best = F.min(F.struct((-F.col("n_cp")).alias("m"), F.col("doc_id").isNull().alias("no_id"),
                          F.col("doc_id").alias("id")))
    groups = written(shared.groupBy("sha").agg(
        best.alias("best"), F.sum("copies").alias("group_size"), F.count("*").alias("members"))
        .select("sha", F.col("best.id").alias("keep_id"), (-F.col("best.m")).alias("keep_cp"),
                "group_size", "members"), "dedup-groups")
    joined = join_groups(shared, groups, ["sha"], "members").select(
        "doc_id", "n_cp", "keep_id", "group_size",
        (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("n_cp") == F.col("keep_cp"))).alias("keeper"),
        "copies", "norm_len", "prefix_hash", "sha")
    alone = refined.where("single").select(
        "doc_id", "n_cp", F.col("doc_id").alias("keep_id"), F.col("copies").alias("group_size"),
        F.lit(True).alias("keeper"), "copies", "norm_len", "prefix_hash", "sha")
    return joined.unionByName(alone)


def dedup_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document, dropped ones too: doc_id, keep_id, group_size, kept, text_sha256."""
    groups = exact_groups(docs, id_col, text_col, digest_all=True)
    rows = groups.select("*", F.posexplode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("nth", "copy"))
    return rows.select("doc_id", "keep_id", F.col("group_size").cast("long").alias("group_size"),
                       (F.col("keeper") & (F.col("nth") == 0)).alias("kept"),
                       F.lower(F.hex("sha")).alias("text_sha256"))


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns.

    Full hashes are computed for surviving groups only. Rows are matched by id
    and text length, and by the text itself where an id has several rows.
    """
    groups = exact_groups(docs, id_col, text_col).withColumn(
        "rows", F.sum("copies").over(Window.partitionBy("doc_id", "n_cp")))
    kept = written(groups.where("keeper"), "dedup-kept").select(
        *(F.col(c).alias(f"of_{c}") for c in ("doc_id", "n_cp", "norm_len", "prefix_hash", "sha", "rows")))
    # The documents' columns travel in a struct, where their names cannot clash.
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    rows = docs.select(F.struct("*").alias("row"), F.col(f"`{id_col}`").cast("long").alias("doc_id"),
                       F.length(text).cast("long").alias("n_cp"))
    norm = normalised(F.coalesce(F.col("row").getField(text_col).cast("string"), F.lit("")))
    # The text itself decides only where one id has several rows (`or` stops at its first true side).
    same_text = (F.col("of_rows") == 1) | (
        (F.length(norm) == F.col("of_norm_len")) & (F.xxhash64(F.substring(norm, 1, PREFIX)) == F.col("of_prefix_hash"))
        & (F.col("of_sha").isNull() | (F.unhex(F.sha2(norm, 256)) == F.col("of_sha"))))
    joined = rows.join(kept, F.col("doc_id").eqNullSafe(F.col("of_doc_id"))
                       & (F.col("n_cp") == F.col("of_n_cp")) & same_text)
    once = joined.where("of_rows = 1").select("row")
    again = joined.where("of_rows > 1").withColumn("digest", F.sha2(norm, 256)) \
        .dropDuplicates(["of_doc_id", "of_n_cp", "digest"]).select("row")
    return once.unionByName(again).select("row.*")


def query(spark, sf_dir: str) -> DataFrame:
    return dedup_report(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = """
WITH n AS (
  SELECT doc_id, length(coalesce(text, '')) AS n_cp,
         sha256(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', '', 'g')) AS h
  FROM documents),
k AS (
  SELECT *, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY h) AS group_size,
         row_number() OVER w AS r
  FROM n WINDOW w AS (PARTITION BY h ORDER BY n_cp DESC, doc_id NULLS LAST))
SELECT doc_id, keep_id, CAST(group_size AS BIGINT) AS group_size, r = 1 AS kept, h AS text_sha256 FROM k
"""
