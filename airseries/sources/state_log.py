"""SC15: the download state as a log of versions that only grows by conditional creates.

A cycle writes the rows it changed as a Parquet folder of its own and then
creates the next file of the log, which must not exist yet; that one create is
the commit.  A run that stops before it leaves the state as it was, a run that
loses the race to another one tries again on the newer state, and a cycle
already in the log has no effect.  Every ``every`` versions the whole state is
written as a snapshot, so a reader opens the last snapshot and the few versions
behind it, however long the log.
"""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkRuntimeError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

STATE_SCHEMA = "resource_id STRING, last_modified STRING"


def rename_new(spark: SparkSession, source: str, target: str) -> bool:
    """Rename a file or folder in one step; if the target exists, False, and the source is removed."""
    jvm = spark._jvm
    conf = spark._jsc.hadoopConfiguration()
    src, dst = (jvm.org.apache.hadoop.fs.Path(x) for x in (source, target))
    fs = dst.getFileSystem(conf)
    src, dst = fs.makeQualified(src), fs.makeQualified(dst)
    none = spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
    try:
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(dst.toUri(), conf).rename(src, dst, none)
        return True
    except Py4JJavaError as e:
        if "FileAlreadyExistsException" not in e.java_exception.getClass().getName():
            raise
        fs.delete(src, True)
        return False


class StateLog:
    """The log under ``root`` (any path that Spark can open)."""

    def __init__(self, spark: SparkSession, root: str, every: int = 10):
        self.spark, self.root, self.every = spark, root.rstrip("/"), every

    # The Hadoop file system gives the one thing Spark's writers do not: creating a file only if it is absent.
    def _path(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/log/{name}")
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _versions(self) -> list[int]:
        path, fs = self._path("")
        if not fs.exists(path):
            return []
        return sorted(int(s.getPath().getName().removesuffix(".json")) for s in fs.listStatus(path)
                      if s.getPath().getName().endswith(".json"))

    def _entry(self, version: int) -> dict:
        path, fs = self._path(f"{version:012d}.json")
        stream = fs.open(path)
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _create(self, version: int, entry: dict) -> bool:
        """False if this version exists.  The content is written aside; renaming it commits and never replaces a file."""
        aside, fs = self._path(f"_{uuid.uuid4().hex}")
        out = fs.create(aside, False)
        out.write(bytearray(json.dumps(entry).encode()))
        out.close()
        return rename_new(self.spark, str(aside.toString()), f"{self.root}/log/{version:012d}.json")

    def _tail(self) -> list[tuple[int, dict]]:
        """The last snapshot and what follows it, oldest first."""
        tail = []
        for v in reversed(self._versions()):
            tail.append((v, self._entry(v)))
            if tail[-1][1]["kind"] == "snapshot":
                break
        return tail[::-1]

    def read(self) -> DataFrame:
        """One row per resource, from its latest version."""
        rows = None
        for version, entry in self._tail():
            part = self.spark.read.schema(STATE_SCHEMA).parquet(entry["data"]).withColumn("v", F.lit(version))
            rows = part if rows is None else rows.unionByName(part)
        if rows is None:
            return self.spark.createDataFrame([], STATE_SCHEMA)
        return rows.groupBy("resource_id").agg(F.max_by("last_modified", "v").alias("last_modified"))

    def _write(self, rows: DataFrame) -> str:
        data = f"{self.root}/data/{uuid.uuid4().hex}"
        rows.select("resource_id", "last_modified").write.parquet(data)
        return data

    def commit(self, cycle: str, changed, attempts: int = 20) -> bool:
        """Commit ``changed(state)`` (the rows to record) as the cycle ``cycle``; False if it was there already.

        Cycles are remembered as far back as the last snapshot, which names those before it.
        """
        for _ in range(attempts):
            tail = self._tail()
            seen = {c for _, e in tail for c in e["cycles"]}
            if cycle in seen:
                return False
            version = tail[-1][0] + 1 if tail else 0
            if not self._create(version, {"kind": "delta", "cycles": [cycle], "data": self._write(changed(self.read()))}):
                continue
            if len(tail) + 1 >= self.every:
                self._compact(version + 1, [*seen, cycle])
            return True
        raise PySparkRuntimeError(f"no commit of {cycle} in {attempts} attempts")

    def _compact(self, version: int, cycles: list[str]) -> None:
        """A snapshot is a version like any other; if another run came first, a later commit makes one."""
        self._create(version, {"kind": "snapshot", "cycles": sorted(cycles)[-10_000:], "data": self._write(self.read())})
