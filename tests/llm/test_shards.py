import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from airseries.llm import histogram_sort as H
from tests.llm import cases


def check(rows, expected, shards, slack):
    """Rows are (doc_id, size, crc, shard, slot): all there, sorted, numbered without a gap, near equal."""
    assert sorted(((r[0], r[1], r[2]) for r in rows), key=str) == sorted(expected, key=str)
    by = defaultdict(list)
    for r in rows:
        by[r[3]].append(r)
    assert all(0 <= s < shards for s in by)
    assert all(sorted(r[4] for r in m) == list(range(len(m))) for m in by.values())
    order = [(r[0] is not None, r[0] or 0) for s in sorted(by) for r in sorted(by[s], key=lambda r: r[4])]
    assert order == sorted(order)
    total, largest = sum(r[1] for r in rows), max(r[1] for r in rows)
    for s in range(shards):
        got = sum(r[1] for r in by.get(s, []))
        assert abs(got - total / shards) <= slack * total / shards + largest, s
    return by


def want(rows):
    return [(d, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for d, t in rows]


@pytest.mark.parametrize("shards,probes", [(40, 1 << 14), (3, 1 << 14), (7, 200), (1, 64)])
def test_awkward_rows(spark, shards, probes):
    got = [tuple(r) for r in H.shard_documents(cases.documents(spark), shards, probes=probes).collect()]
    check(got, want([r[:2] for r in cases.rows()]), shards, H.TOLERANCE)


@pytest.mark.parametrize("rows", [
    [(None, "x" * 10)] * 900 + [(i, "y" * (i % 13)) for i in range(600)],  # rows alike in everything
    [(5, "x" * (i % 3)) for i in range(1000)],
    [(i, None) for i in range(-400, 400)],
    [(-2**63 + i, "a") for i in range(300)] + [(2**63 - 1 - i, "a") for i in range(300)] + [(0, "b")] * 300,
])
def test_hot_and_far_keys_are_cut(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    got = [tuple(r) for r in H.shard_documents(docs, 8, probes=256).collect()]
    by = check(got, want(rows), 8, H.TOLERANCE)
    assert len(by) == 8


def test_boundaries_meet_the_tolerance_exactly_counted(spark):
    rows = spark.range(20_000).select(F.col("id").alias("k"), (F.col("id") % 97 + 1).alias("w"))
    keyed = rows.withColumn("__key", F.array(*H.key_columns(F.col("k"))))
    found = H.splitters(keyed, "w", 10, 2, 1e-2, 1, 64)
    weights = [i % 97 + 1 for i in range(20_000)]
    assert len(found.levels) > 1  # refined
    for i, (cut, below) in enumerate(zip(found.cuts, found.weights)):
        assert below == sum(weights[:cut])
        assert abs(below - sum(weights) * (i + 1) / 10) <= 1e-2 * sum(weights) / 10


def test_whole_rows_are_written_once_each(spark, tmp_path):
    docs = cases.documents(spark)
    H.write_shards(docs, f"{tmp_path}/out", 4)
    back = spark.read.parquet(f"{tmp_path}/out")
    assert sorted(map(str, back.select("row.*").collect())) == sorted(map(str, docs.collect()))
    for r in back.groupBy("shard").agg(F.count("*").alias("n"), F.max("slot").alias("last"), F.countDistinct("slot").alias("d")).collect():
        assert r["n"] == r["last"] + 1 == r["d"]


def test_main_path_is_native(spark):
    plan = H.shard_documents(cases.documents(spark), 4)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_empty(spark):
    assert H.shard_documents(cases.empty(spark)).count() == 0


def test_query(spark):
    folder = "/root/testdata/sf0.001"
    docs = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    got = H.query(spark, folder)
    assert got.columns == ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    check([tuple(r) for r in got.select("doc_id", "size", "text_crc32", "shard", "slot").collect()], want(docs), 40, H.TOLERANCE)
