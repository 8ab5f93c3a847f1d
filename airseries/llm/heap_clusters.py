"""Centroid clustering with heap-ordered bounds.

Vectors become integers (floor of ``scale`` times a component) and are clustered in exact integer
arithmetic: nearest centroid by squared Euclidean distance, ties to the smaller number, and
centroids moved to the floor of their vectors' mean.

A vector's gap is its distance to the second nearest centroid less that to its own. When centroids move, the
gap of a vector of cluster c shrinks by at most c's drift plus the largest drift of any other, and that sum
is accumulated per cluster. So each cluster keeps a heap of its vectors ordered by the gap plus the offset that
had been accumulated when it was measured: a key over the cluster's offset is a gap that still
holds, and only the vectors at the top whose gap has expired are popped and compared with all centroids. A
heap whose top holds is passed on as it is, and a block none of whose heaps expires does not look at its vectors.

Vectors are written once, in blocks of ``BLOCK`` dealt into buckets; the heaps of a block are a row of a table with the
same buckets, written once a round, so that blocks meet their heaps without a shuffle and a lost executor costs a
re-read. What moves in a round is, for each block and each cluster that gained or lost vectors, the change of its
sum; sums and centroids (``clusters`` rows) are all that reaches the driver.

Defined results: vectors of another length than ``components``, null, or with a null or non-finite component are left out.
Scaled components beyond 2^27 are cut there, so that a squared distance fits a long. The first centroids are
the vectors with the smallest SHA-256 of ``seed:vec_id`` (a null id is the empty text; of one id, smaller
vectors first); with fewer vectors than clusters each vector starts one. Repeated rows are
vectors of their own. An empty table gives an empty result. Other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from airseries.llm.common import shared_folder, written

CLUSTERS, COMPONENTS, ROUNDS, SCALE, SEED = 40, 64, 5, 256, 2
#: Vectors of a block, and of a bucket of blocks (one task) unless there are over MOST_BUCKETS.
BLOCK, BUCKET_ROWS, MOST_BUCKETS = 1024, 1 << 16, 20_000
LIMIT = 1 << 27
_STATE = ("block long, lens binary, keys binary, rows binary, scanned long, "
          "moved array<struct<cluster:int,n:long,sums:array<long>>>")


# --- vectors ----------------------------------------------------------------------

def integer_vectors(table: DataFrame, components: int = COMPONENTS, scale: int = SCALE, id_col: str = "vec_id",
                    vector_col: str = "embedding") -> DataFrame:
    """vec_id and v (array of ints) of the vectors that count."""
    v = F.col(f"`{vector_col}`").cast("array<double>")
    good = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    kept = table.where((F.size(v) == components) & good)
    edge = F.lit(float(LIMIT))
    return kept.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.transform(
        v, lambda x: F.floor(F.greatest(F.least(x * scale, edge), -edge)).cast("int")).alias("v"))


def _blocks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """block, n, ids, vectors: up to ``size`` vectors of a partition in one row."""
    first, held, count = TaskContext.get().partitionId() << 33, [], 0

    def pack(rows: pa.Table, number: int) -> pa.RecordBatch:
        flat = rows["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype("<i4")
        ids = pa.array([rows["vec_id"].to_pylist()], pa.list_(pa.int64()))
        return pa.RecordBatch.from_arrays([pa.array([first + number], pa.int64()), pa.array([rows.num_rows], pa.int32()), ids,
                                           pa.array([flat.tobytes()], pa.binary())], ["block", "n", "ids", "vectors"])

    for b in batches:
        held.append(b)
        rows = sum(x.num_rows for x in held)
        while rows >= size:
            whole = pa.Table.from_batches(held)
            yield pack(whole.slice(0, size), count)
            held, rows, count = whole.slice(size).to_batches(), rows - size, count + 1
    if sum(x.num_rows for x in held):
        yield pack(pa.Table.from_batches(held), count)


# --- distances, exact -------------------------------------------------------------

def _squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """All squared distances of integer rows x and c, exact: in doubles while every sum stays below 2^53."""
    most = max(int(np.abs(x).max(initial=0)), int(np.abs(c).max(initial=0)))
    if 4 * x.shape[1] * most * most < 1 << 53:
        a, b = x.astype(np.float64), c.astype(np.float64)
        return ((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)).astype(np.int64)
    out = np.empty((len(x), len(c)), np.int64)
    for k in range(len(c)):
        d = x.astype(np.int64) - c[k]
        out[:, k] = (d * d).sum(1)
    return out


def _nearest(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest centroid (ties: smaller number), and a lower bound of the gap to the second nearest."""
    d = _squared(x, c)
    own = d.argmin(1)
    if len(c) == 1:
        return own, np.full(len(x), np.inf)
    u = np.sqrt(d[np.arange(len(x)), own].astype(np.float64))
    d[np.arange(len(x)), own] = np.iinfo(np.int64).max
    second = np.sqrt(d.min(1).astype(np.float64))
    return own, second - u - 1e-9 * (second + u) - 1e-9


# --- heaps ------------------------------------------------------------------------

class Heaps:
    """One heap of (key, row) for each cluster of a block, kept as flat arrays between rounds."""

    def __init__(self, lens: np.ndarray, keys: np.ndarray, rows: np.ndarray):
        self.lens, self.keys, self.rows = lens, keys, rows
        self.starts = np.concatenate([[0], np.cumsum(lens)]).astype(np.int64)
        self.loaded: dict[int, list[tuple[float, int]]] = {}  # the heaps that something was popped from or pushed to

    @classmethod
    def new(cls, clusters: int) -> "Heaps":
        return cls(np.zeros(clusters, "<i4"), np.empty(0, "<f8"), np.empty(0, "<i4"))

    @classmethod
    def read(cls, lens: bytes, keys: bytes, rows: bytes) -> "Heaps":
        return cls(np.frombuffer(lens, "<i4"), np.frombuffer(keys, "<f8"), np.frombuffer(rows, "<i4"))

    def _heap(self, c: int) -> list[tuple[float, int]]:
        if c not in self.loaded:
            at = slice(self.starts[c], self.starts[c + 1])
            self.loaded[c] = list(zip(self.keys[at].tolist(), self.rows[at].tolist()))
        return self.loaded[c]

    def pop_expired(self, offsets: np.ndarray) -> tuple[list[int], list[int]]:
        """Rows whose gap has expired, and the clusters they were in."""
        rows, clusters = [], []
        for c in np.flatnonzero(self.lens):
            if self.keys[self.starts[c]] > offsets[c]:
                continue  # the smallest key still holds, so all do
            heap = self._heap(int(c))
            while heap and heap[0][0] <= offsets[c]:
                rows.append(heapq.heappop(heap)[1])
                clusters.append(int(c))
        return rows, clusters

    def push(self, cluster: np.ndarray, keys: np.ndarray, rows: np.ndarray) -> None:
        for c, key, row in zip(cluster.tolist(), keys.tolist(), rows.tolist()):
            heapq.heappush(self._heap(c), (key, row))

    def arrays(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        keys, rows, lens = [], [], self.lens.astype("<i4").copy()
        for c in range(len(lens)):
            if c in self.loaded:
                heap = self.loaded[c]
                lens[c] = len(heap)
                keys.append(np.array([k for k, _ in heap], "<f8"))
                rows.append(np.array([r for _, r in heap], "<i4"))
            else:
                at = slice(self.starts[c], self.starts[c + 1])
                keys.append(self.keys[at])
                rows.append(self.rows[at])
        return lens, np.concatenate(keys), np.concatenate(rows)

    def clusters(self, n: int) -> np.ndarray:
        lens, _, rows = self.arrays()
        out = np.empty(n, np.int64)
        out[rows] = np.repeat(np.arange(len(lens)), lens)
        return out


def _advance(x: np.ndarray, heaps: Heaps | None, centroids: np.ndarray, offsets: np.ndarray) -> tuple[Heaps, dict, int]:
    """One assignment of a block: heaps, change of count and sum by cluster, vectors compared with all centroids."""
    if heaps is None:
        heaps = Heaps.new(len(centroids))
        rows, before = np.arange(len(x)), np.full(len(x), -1)
    else:
        popped, left = heaps.pop_expired(offsets)
        rows, before = np.array(popped, np.int64), np.array(left, np.int64)
    if not len(rows):
        return heaps, {}, 0
    now, gap = _nearest(x[rows], centroids)
    heaps.push(now, gap + offsets[now], rows)
    moved: dict[int, list] = {}
    went = now != before
    for clusters, sign in ((now, 1), (before, -1)):
        for c in np.unique(clusters[went & (clusters >= 0)]):
            mine = x[rows[went & (clusters == c)]].astype(np.int64)
            change = moved.setdefault(int(c), [0, np.zeros(x.shape[1], np.int64)])
            change[0] += sign * len(mine)
            change[1] += sign * mine.sum(0)
    return heaps, moved, len(rows)


def _vectors(data: bytes, components: int) -> np.ndarray:
    return np.frombuffer(data, "<i4").reshape(-1, components)


def _read(row: dict) -> Heaps | None:
    return None if row.get("lens") is None else Heaps.read(row["lens"], row["keys"], row["rows"])


def _round(batches: Iterator[pa.RecordBatch], centroids: np.ndarray, offsets: np.ndarray) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("cluster", pa.int32()), ("n", pa.int64()), ("sums", pa.list_(pa.int64()))]))
    for batch in batches:
        for i in range(batch.num_rows):
            row = batch.slice(i, 1).to_pylist()[0]
            heaps, moved, scanned = _advance(_vectors(row["vectors"], centroids.shape[1]), _read(row), centroids, offsets)
            lens, keys, rows = heaps.arrays()
            change = [{"cluster": c, "n": n, "sums": s.tolist()} for c, (n, s) in moved.items()]
            yield pa.RecordBatch.from_arrays(
                [pa.array([row["block"]], pa.int64()), *(pa.array([a.tobytes()], pa.binary()) for a in (lens, keys, rows)),
                 pa.array([scanned], pa.int64()), pa.array([change], kind)],
                ["block", "lens", "keys", "rows", "scanned", "moved"])


def _labels(batches: Iterator[pa.RecordBatch], centroids: np.ndarray, offsets: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The last assignment, with the distance of every vector to its centroid."""
    for batch in batches:
        for i in range(batch.num_rows):
            row = batch.slice(i, 1).to_pylist()[0]
            x = _vectors(row["vectors"], centroids.shape[1])
            cluster = _advance(x, _read(row), centroids, offsets)[0].clusters(len(x))
            d = x.astype(np.int64) - centroids[cluster]
            yield pa.RecordBatch.from_arrays(
                [pa.array(row["ids"], pa.int64()), pa.array(cluster.astype(np.int32)), pa.array((d * d).sum(1))],
                ["vec_id", "cluster", "distance"])


# --- rounds -----------------------------------------------------------------------

@dataclass
class Centroids:
    """``k`` rows on the driver: exact sums and counts, positions, and the offsets of the heaps."""

    position: list[list[int]]
    counts: list[int]
    sums: list[list[int]]
    offsets: list[float]

    @classmethod
    def at(cls, position: list[list[int]]) -> "Centroids":
        k, d = len(position), len(position[0])
        return cls(position, [0] * k, [[0] * d for _ in range(k)], [0.0] * k)

    def arrays(self) -> tuple[np.ndarray, np.ndarray]:
        return np.array(self.position, np.int64), np.array(self.offsets)

    def move(self, changes: list) -> None:
        for c, n, sums in changes:
            self.counts[c] += n
            self.sums[c] = [a + b for a, b in zip(self.sums[c], sums)]
        new = [[s // n for s in sums] if n else old for sums, n, old in zip(self.sums, self.counts, self.position)]
        # Upwards, as an offset must not be too small.
        drift = [sum((a - b) ** 2 for a, b in zip(p, q)) ** 0.5 * (1 + 1e-9) for p, q in zip(self.position, new)]
        for c, own in enumerate(drift):
            self.offsets[c] += own + max((d for k, d in enumerate(drift) if k != c), default=0.0) + 1e-9
        self.position = new


def _bucketed(df: DataFrame, buckets: int, name: str) -> str:
    """Written to the shared folder in buckets by block; the name of the table."""
    table = f"llm_{name}_{uuid.uuid4().hex[:12]}"
    df.write.mode("overwrite").bucketBy(buckets, "block").option(
        "path", shared_folder(df.sparkSession, name)).format("parquet").saveAsTable(table)
    return table


def _changes(state: DataFrame, components: int) -> list:
    """At most one row a cluster, with exact sums."""
    m = state.select(F.explode("moved").alias("m"))
    sums = [F.sum(F.get("m.sums", F.lit(i)).cast("decimal(38,0)")) for i in range(components)]
    return [(r["cluster"], int(r["n"]), [int(s) for s in r["sums"]]) for r in m.groupBy(F.col("m.cluster").alias("cluster")).agg(
        F.sum("m.n").alias("n"), F.array(*sums).alias("sums")).collect()]


def clustered(table: DataFrame, clusters: int = CLUSTERS, components: int = COMPONENTS, rounds: int = ROUNDS,
              scale: int = SCALE, seed: int = SEED, id_col: str = "vec_id", vector_col: str = "embedding",
              block: int = BLOCK, stats: list | None = None) -> tuple[DataFrame, list[list[int]]]:
    """(vec_id, cluster, distance) of every vector that counts, and the final centroids.

    ``stats`` receives the number of vectors compared with all centroids in each round.
    """
    spark = table.sparkSession
    vectors = integer_vectors(table, components, scale, id_col, vector_col)
    start = vectors.select(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
                           .alias("hash"), "v").orderBy("hash", "v").limit(clusters).select("v").collect()
    if not start:
        return spark.createDataFrame([], "vec_id long, cluster int, distance long"), []
    model = Centroids.at([list(r["v"]) for r in start])
    blocks = vectors.mapInArrow(lambda it: _blocks(it, block), "block long, n int, ids array<long>, vectors binary")
    blocks = written(blocks, "cluster-blocks")
    n = blocks.agg(F.sum("n")).first()[0]
    buckets = min(MOST_BUCKETS, max(-(-n // BUCKET_ROWS), min(-(-n // block), spark.sparkContext.defaultParallelism)))
    names = [_bucketed(blocks.repartition(buckets, "block"), buckets, "cluster_vectors")]
    stored = spark.table(names[0])
    state = None
    for _ in range(rounds):
        args = model.arrays()
        met = stored if state is None else stored.join(state.hint("shuffle_hash"), "block")
        names.append(_bucketed(met.mapInArrow(lambda it, a=args: _round(it, *a), _STATE), buckets, "cluster_heaps"))
        state = spark.table(names[-1])
        if stats is not None:
            stats.append(state.agg(F.sum("scanned")).first()[0])
        model.move(_changes(state, components))
        state = state.select("block", "lens", "keys", "rows")
    args = model.arrays()
    met = stored if state is None else stored.join(state.hint("shuffle_hash"), "block")
    out = written(met.mapInArrow(lambda it: _labels(it, *args), "vec_id long, cluster int, distance long"), "cluster-labels")
    for name in names:
        spark.sql(f"DROP TABLE {name}")  # the catalog's entry; the result is a table of its own
    return out, model.position


def report(table: DataFrame, **options) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256."""
    labels, position = clustered(table, **options)
    spark = table.sparkSession
    sums = {r["cluster"]: int(r["s"]) for r in labels.groupBy("cluster").agg(
        F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    most = (1 << 63) - 1  # where the sum itself goes beyond a long
    rows = [(c, min(s, most), min(sum(sums.values()), most),
             hashlib.sha256(",".join(map(str, position[c])).encode()).hexdigest()) for c, s in sorted(sums.items())]
    # One row a cluster.
    by_cluster = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return labels.join(F.broadcast(by_cluster), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
