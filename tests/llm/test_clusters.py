import hashlib
import math

import numpy as np
import pytest

from airseries.llm import heap_clusters as C


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def brute(rows, clusters, components, rounds, scale=256, seed=2):
    """Plain Python integers, every vector against every centroid in every round."""
    kept = [(i, [max(-C.LIMIT, min(C.LIMIT, math.floor(max(-1e300, min(1e300, x * scale))))) for x in v]) for i, v in rows
            if v is not None and len(v) == components and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (sha(f"{seed}:{'' if r[0] is None else r[0]}"), r[1]))
    cents = [v for _, v in order[:clusters]]

    def assign():
        out = []
        for _, v in kept:
            d = [sum((a - b) ** 2 for a, b in zip(v, c)) for c in cents]
            out.append((d.index(min(d)), min(d)))
        return out

    for _ in range(rounds):
        mine = [[v for (_, v), (k, _) in zip(kept, labels) if k == c] for labels in [assign()] for c in range(len(cents))]
        cents = [[sum(x) // len(m) for x in zip(*m)] if m else c for m, c in zip(mine, cents)]
    labels = assign()
    per = [sum(d for k, d in labels if k == c) for c in range(len(cents))]
    return sorted(((i, k, d, per[k], sum(per), sha(",".join(map(str, cents[k])))) for (i, _), (k, d) in zip(kept, labels)), key=str)


def frame(spark, rows):
    return spark.createDataFrame([(i, v, "x", 1, "y") for i, v in rows],
                                 "vec_id long, embedding array<double>, v string, block int, `a.b` string").repartition(4)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def blobs(n, components, seed, spread=0.3):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, components))
    return [(i, (centres[rng.integers(6)] + spread * rng.normal(size=components)).tolist()) for i in range(n)]


@pytest.mark.parametrize("clusters,rounds,block", [(5, 5, 64), (12, 3, 7), (1, 2, 50), (4, 0, 64)])
def test_equals_plain_clustering(spark, clusters, rounds, block):
    rows = blobs(300, 8, clusters)
    out = C.report(frame(spark, rows), clusters=clusters, components=8, rounds=rounds, block=block)
    assert got(out) == brute(rows, clusters, 8, rounds)


def test_awkward_rows(spark):
    rows = blobs(60, 4, 1) + [
        (900, None), (901, [1.0, None, 0.0, 0.0]), (902, [1.0, float("nan"), 0.0, 0.0]), (903, [float("inf"), 0.0, 0.0, 0.0]),
        (904, [1.0]), (905, []), (None, [0.5, 0.5, 0.5, 0.5]), (None, [0.25, 0.5, 0.5, 0.5]), (7, [0.0, -0.0, -0.001, 1e-12]),
        (906, [1e300, -1e300, 1e9, 0.0]), (907, [1e6, 1.0, 1.0, 1.0])]
    rows += [(i, [1.0, 0.0, 0.0, 0.0]) for i in range(1000, 1060)] + [(5, [1.0, 0.0, 0.0, 0.0])] * 40  # copies and ties
    out = C.report(frame(spark, rows), clusters=9, components=4, rounds=4, block=16)
    assert got(out) == brute(rows, 9, 4, 4)


def test_ties_go_to_the_smaller_number(spark):
    rows = [(i, [float(i % 4), float(i // 4 % 4)]) for i in range(160)]  # a grid, where distances are often equal
    assert got(C.report(frame(spark, rows), clusters=7, components=2, rounds=5, scale=1, block=9)) == brute(rows, 7, 2, 5, 1)


def test_fewer_vectors_than_clusters_and_none(spark):
    rows = blobs(3, 4, 2)
    assert got(C.report(frame(spark, rows), clusters=9, components=4, rounds=2)) == brute(rows, 9, 4, 2)
    assert C.report(frame(spark, []), clusters=9, components=4).count() == 0
    assert C.report(frame(spark, [(1, None)]), clusters=9, components=4).count() == 0


def test_only_expired_gaps_are_scanned(spark):
    rows = blobs(600, 8, 5, spread=0.05)
    stats = []
    labels, _ = C.clustered(frame(spark, rows), clusters=6, components=8, rounds=5, stats=stats)
    assert labels.count() == 600
    assert stats[0] == 600 and sum(stats[1:]) < 600 * 4 and stats[-1] < 300


def test_heaps_stay_heaps():
    rng = np.random.default_rng(0)
    heaps = C.Heaps.new(3)
    keys, cluster = rng.random(200), rng.integers(0, 3, 200)
    heaps.push(cluster, keys, np.arange(200))
    heaps = C.Heaps.read(*(a.tobytes() for a in heaps.arrays()))
    rows, left = heaps.pop_expired(np.array([0.5, -1.0, 2.0]))
    assert sorted(rows) == sorted(np.flatnonzero((cluster == 0) & (keys <= 0.5) | (cluster == 2)).tolist())
    assert all(cluster[r] == c for r, c in zip(rows, left))


def test_blocks_meet_their_heaps_without_a_shuffle(spark):
    blocks = spark.range(40).withColumnRenamed("id", "block")
    a, b = (C._bucketed(blocks.repartition(4, "block"), 4, x) for x in ("ta", "tb"))
    plan = spark.table(a).join(spark.table(b).hint("shuffle_hash"), "block")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    for t in (a, b):
        spark.sql(f"DROP TABLE {t}")


def test_query_equals_brute_force(spark):
    folder = "/root/testdata/sf0.001"
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
    assert got(C.query(spark, folder)) == brute(rows, 40, 64, 5)
