"""Landing files of any layout, order-true hours, late corrections (ST1-ST3)."""

import datetime as dt
import glob
import os

import pytest
from pyspark.sql import functions as F

from airseries.operators.hourly import hourly_wide
from airseries.sources import csv_raw
from airseries.streaming import streams as ST

T0 = dt.datetime(2024, 1, 10, 8, 0, 0)
CANON = ["sensor_id", "sensor_type", "location", "timestamp", "value_type", "value"]


def _readings(spark, rows):
    return spark.createDataFrame(
        rows, "location BIGINT, sensor_id STRING, timestamp TIMESTAMP_NTZ, value_type STRING, value STRING")


def _file(folder, name, text):
    os.makedirs(folder, exist_ok=True)
    with open(f"{folder}/{name}", "w", encoding="utf-8", newline="") as f:
        f.write(text)


def _table(df):
    cols = ["location", "sensor_id", "sensor_type", "timestamp", "value_type", "value"]
    return sorted(map(str, df.select(*cols).collect()))


def test_any_header_order_equals_the_batch_reader(spark, tmp_path):
    landing, out, ckpt = f"{tmp_path}/landing", f"{tmp_path}/readings", f"{tmp_path}/ckpt"
    _file(f"{landing}/m1", "a.csv", "﻿location;timestamp;value;value_type;sensor_id;sensor_type\r\n"
          "3966;2024-01-01T00:00:00+00:00;7;P2;77;SDS011\r\n3966;2024-01-01T00:05:00+00:00;8\r\n")
    _file(f"{landing}/m1", "b.csv", "timestamp;value;value_type;location;sensor_id;sensor_type;Colonne1\n"
          '2024-01-01T01:00:00+00:00;"9;5";P1;76;11;DHT22;\n2024-01-01T01:00:00+00:00;9;P1;76;11;DHT22;;too;many\n\n')
    ST.land_new_files(spark, landing, out, ckpt)
    first = spark.read.parquet(out).count()
    _file(f"{landing}/m2", "c.csv", '"value_type"; value ;location;timestamp\nP0;nan;76;2024-01-02T00:00:00+01:00\nP0;1;x;bad\n')
    _file(f"{landing}/m2", "d.csv", "")
    _file(f"{landing}/m2", "e.csv", "location;timestamp;value;value_type\n")
    ST.land_new_files(spark, landing, out, ckpt)
    got = spark.read.schema(ST.READINGS_SCHEMA).parquet(out)
    assert first == 3 and got.where("epoch = 1").count() == 2
    assert _table(got) == _table(csv_raw.read_raw(spark, landing))
    assert got.where("value_type = 'P1'").select("value", "sensor_id").collect() == [("9;5", "11")]
    assert spark.read.parquet(f"{out}_layouts").where("header IS NOT NULL").count() == 4


def test_a_restarted_epoch_is_not_written_twice(spark, tmp_path):
    landing, out = f"{tmp_path}/landing", f"{tmp_path}/readings"
    csv_raw.write_readings_csv(_readings(spark, [(1, "s", T0, "P2", "1.0")]), f"{landing}/m1", columns=CANON)
    ST.land_new_files(spark, landing, out, f"{tmp_path}/ckpt")
    before = glob.glob(f"{out}/epoch=0/*.parquet")
    ST.land_new_files(spark, landing, out, f"{tmp_path}/ckpt_lost")  # as if the run had stopped before its commit
    assert glob.glob(f"{out}/epoch=0/*.parquet") == before
    assert spark.read.parquet(out).count() == 1


def test_order_of_stream_readings_is_that_of_the_batch(spark, tmp_path):
    landing, out = f"{tmp_path}/landing", f"{tmp_path}/readings"
    head = "location;timestamp;value;value_type\n"
    rows = [("z.csv", 5.0), ("a.csv", 1.0), ("m.csv", 3.0)]
    for name, v in rows:  # the same timestamp in three files, landed in another order than their names'
        _file(f"{landing}/m", name, f"{head}1;2024-01-10T08:00:00+00:00;{v};P2\n1;2024-01-10T08:00:00+00:00;{v + 100};P2\n")
        ST.land_new_files(spark, landing, out, f"{tmp_path}/ckpt")
    got = hourly_wide(spark.read.parquet(out)).collect()
    assert [(r["location"], r["P2"]) for r in got] == [(1, 1.0)]
    assert [(r["location"], r["P2"]) for r in hourly_wide(csv_raw.read_raw(spark, landing)).collect()] == [(1, 1.0)]


def test_late_fix_touches_only_its_partitions(spark, tmp_path):
    landing, readings, out, store = (f"{tmp_path}/{x}" for x in ("landing", "readings", "out", "store"))
    first = [(loc, "s", T0 + dt.timedelta(minutes=10 * i), "P2", str(10.0 + loc)) for loc in (0, 1, 2) for i in range(3)]
    first += [(0, "s", T0 + dt.timedelta(days=40), "P2", "5.0")]
    csv_raw.write_readings_csv(_readings(spark, first), f"{landing}/part1", columns=CANON)
    handler = ST.late_fix_batch(spark, store, out)

    def run():
        ST.land_new_files(spark, landing, readings, f"{tmp_path}/ckpt")
        ST.run_batches(ST.ingest_stream(spark, readings), handler, f"{tmp_path}/ckpt_fix")

    run()
    before = {p: os.path.getmtime(p) for p in glob.glob(f"{out}/location=*/month=*/*.parquet")}
    stored = set(glob.glob(f"{store}/month=*/shard=*/*.parquet"))
    late = [(0, "s", T0 + dt.timedelta(minutes=35), "P2", "40.0")]   # a late reading for location 0 only
    csv_raw.write_readings_csv(_readings(spark, late), f"{landing}/part2", columns=CANON)
    run()
    after = {p: os.path.getmtime(p) for p in glob.glob(f"{out}/location=*/month=*/*.parquet")}
    touched = [p for p in before if "location=0/month=2024-01" in p]
    assert all(after.get(p) == before[p] for p in before if p not in touched)
    assert touched and not any(p in after for p in touched)          # rewritten
    h = spark.read.parquet(out).where("location = 0 AND month = '2024-01'").collect()
    assert len(h) == 1 and abs(h[0]["P2"] - (10.0 * 3 + 40.0) / 4) < 1e-9
    assert {p for p in stored if "month=2024-02" in p} <= set(glob.glob(f"{store}/month=*/shard=*/*.parquet"))


def test_merge_reads_only_the_touched_partitions(spark, tmp_path):
    store = f"{tmp_path}/store"
    ord_of = F.struct(F.lit("f").alias("file"), F.lit("p").alias("path"), F.lit(0).cast("long").alias("block"),
                      F.col("value").cast("double").cast("long").alias("line"))
    rows = [(loc, "s", T0 + dt.timedelta(days=31 * m), "P2", str(float(loc))) for loc in range(4) for m in range(3)]
    batch = _readings(spark, rows).withColumn("ord", ord_of)
    ST.merge_first_values(spark, batch, store)
    late = _readings(spark, [(2, "s", T0, "P2", "9.0"), (2, "s", T0 + dt.timedelta(hours=1), "P2", "7.0")]).withColumn("ord", ord_of)
    for _ in range(2):  # merging again changes nothing
        parts = ST.merge_first_values(spark, late, store)
        assert [p["month"] for p in parts] == ["2024-01"]
    got = spark.read.schema(ST.STORE_SCHEMA).parquet(store)
    assert got.count() == 13 and got.where("location = 2 AND month = '2024-01'").agg(F.min("value")).first()[0] == "2.0"
    plan = spark.read.schema(ST.STORE_SCHEMA).parquet(store).where(ST._only(parts))._jdf.queryExecution().executedPlan().toString()
    assert "2024-01" in plan.split("PartitionFilters: ")[1].split("]")[0] and "shard" in plan.split("PartitionFilters: ")[1]


def test_order_bits_that_do_not_fit_are_an_error(spark):
    one = F.lit(1).cast("long")
    ok = spark.range(3).select(csv_raw.packed_order(F.col("id"), one * 0, F.col("id"), (2, 1, 2)).alias("o"))
    assert [r["o"] for r in ok.collect()] == [0, 9, 18]
    for rank, block, row in ((4, 0, 0), (0, 2 << 20, 0), (0, 0, 4)):
        bad = spark.range(1).select(csv_raw.packed_order(one * rank, one * block, one * row, (2, 1, 2)).alias("o"))
        with pytest.raises(Exception, match="file order does not fit"):
            bad.collect()


def test_unreadable_files_are_named_and_counted(spark, tmp_path):
    from pyspark.sql import Observation
    _file(f"{tmp_path}/x", "good.csv", "location;timestamp;value;value_type\n1;2024-01-10T08:00:00+00:00;1;P2\n")
    os.symlink(f"{tmp_path}/x/good.csv", f"{tmp_path}/x/other.csv")
    rows = spark.createDataFrame([(f"file:{tmp_path}/x/good.csv",), (f"file:{tmp_path}/x/gone.csv",)], "path string")
    got = {r["path"].rsplit("/", 1)[1]: r for r in rows.mapInPandas(
        csv_raw._first_lines, "path string, header string, error string").collect()}
    assert got["good.csv"]["header"].startswith("location;") and got["good.csv"]["error"] is None
    assert got["gone.csv"]["header"] is None and "FileNotFoundError" in got["gone.csv"]["error"]
    obs = Observation()
    assert csv_raw.read_raw(spark, f"{tmp_path}/x", observation=obs).count() == 2
    assert obs.get["unreadable_files"] == 0


def test_workers_find_the_package_from_any_folder(tmp_path):
    import subprocess
    import sys
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = (f"import sys; sys.path.insert(0, {root!r})\n"
            "from pyspark.sql import SparkSession\n"
            "spark = SparkSession.builder.master('local[2]').config('spark.ui.enabled', 'false')"
            f".config('spark.checkpoint.dir', {str(tmp_path / 'ck')!r}).config('spark.sql.shuffle.partitions', '2').getOrCreate()\n"
            "import __spark_entry__ as E\n"
            "print('ROWS', E.queries()['pacf_48'](spark, '/root/testdata/sf0.001').count(),"
            " E.queries()['csv_round_trip'](spark, '/root/testdata/sf0.001').count())\n")
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "ROWS" in out.stdout, out.stderr[-2000:]
