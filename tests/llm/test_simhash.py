import numpy as np
import pytest
import xxhash

from airseries.llm import simhash_bk as S
from tests.llm import cases


def brute_fingerprint(text):
    t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words, word = [], ""
    for c in t + " ":
        if c in " \t\n\x0b\x0c\r":
            words += [word] * bool(word)
            word = ""
        else:
            word += c
    grams = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(ids, fps, radius):
    n, label = len(fps), list(range(len(fps)))
    near = [[j for j in range(n) if (fps[i] ^ fps[j]).bit_count() <= radius] for i in range(n)]
    changed = True
    while changed:
        changed = False
        for i in range(n):
            low = min(label[j] for j in near[i])
            if low < label[i]:
                label[i], changed = low, True
    best = {}
    for i, c in enumerate(label):
        if ids[i] is not None:
            best[c] = min(best.get(c, ids[i]), ids[i])
    return [best.get(c) for c in label]


def near_rows():
    """Copies with a few words changed, so that fingerprints differ by some bits."""
    out = []
    for g in range(12):
        words = cases.prose(900 + g, 400).split()
        for k in range(12):
            copy = list(words)
            for j in range(k % 5):
                copy[(37 * k + 101 * j) % 400] = "changed"
            out.append((1000 + 50 * g + k, " ".join(copy)))
    return out


@pytest.mark.parametrize("hot", [20_000, 3])
def test_components_match_all_pairs(spark, hot):
    rows = [(r[0], r[1]) for r in cases.rows() if len(r[1] or "") < 5000] + near_rows()
    fps = [brute_fingerprint(t) for _, t in rows]
    want = sorted(zip((str(i) for i, _ in rows), (f"{f:016x}" for f in fps),
                      brute_components([i for i, _ in rows], fps, 2)), key=str)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = sorted(((str(r[0]), r[1], r[2]) for r in S.near_report(docs, hot=hot).collect()), key=str)
    assert got == want
    assert len({w[2] for w in want}) < len({f for f in fps})  # some link between different fingerprints


def test_forest_finds_every_link_within_the_radius():
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**63, 300, dtype=np.uint64)
    flips = [base ^ (np.uint64(1) << rng.integers(0, 64, 300).astype(np.uint64)) for _ in range(3)]
    fp = np.unique(np.concatenate([base, *flips])).view(np.int64)
    shard = np.sort(rng.integers(0, 4, len(fp)))
    forest = S.BKForest(shard, fp)
    got = {(int(a), int(b)) for x, y in forest.links(2, block=100) for a, b in zip(x, y)}
    u = fp.view(np.uint64)
    want = {(i, j) for i in range(len(fp)) for j in range(len(fp))
            if i != j and shard[i] == shard[j] and int(u[i] ^ u[j]).bit_count() <= 2}
    assert got == want and want


def test_every_close_pair_shares_a_shard(spark):
    rng = np.random.default_rng(6)
    base = rng.integers(0, 2**63, 50, dtype=np.uint64)
    rows = []
    for x in base:
        for _ in range(4):
            a, b = rng.integers(0, 64, 2)
            rows.append((int(x), int(np.uint64(x) ^ (np.uint64(1) << np.uint64(a)) ^ (np.uint64(1) << np.uint64(b)))))
    signed = np.unique(np.array(rows, dtype=np.uint64)).view(np.int64)
    fps = spark.createDataFrame([(int(x),) for x in signed], "fp long")
    for hot in (10**6, 1):
        where = {}
        for r in S.shards(fps, hot).collect():
            where.setdefault(r["fp"], set()).add(r["shard"])
        for a, b in rows:
            a, b = (int(np.uint64(x).view(np.int64)) for x in (a, b))
            assert where[a] & where[b]


def test_filter_keeps_one_row_of_each_component(spark):
    docs = cases.documents(spark)
    report = S.near_report(docs).collect()
    kept = S.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(str(c) for c in {r["component_id"] for r in report})


def test_a_wider_radius_is_refused(spark):
    with pytest.raises(ValueError):
        S.near_links(spark.createDataFrame([(1,)], "fp long"), radius=3)


def test_empty(spark):
    assert S.near_report(cases.empty(spark)).count() == 0
    assert S.drop_near_duplicates(cases.empty(spark)).count() == 0


def test_masks_leave_no_pair_within_two_bits_apart():
    from itertools import combinations
    for step in S.shard_masks():
        for mask, after in step.items():
            free = [b for b in range(64) if not (mask >> b) & 1]
            covered = [{b for b in free if (m >> b) & 1} for m in after]
            assert all(any(not c & set(pair) for c in covered) for pair in combinations(free, 2))
    deepest = S.shard_masks()[-1].values()
    assert all(bin(m & (2**64 - 1)).count("1") >= 44 for after in deepest for m in after)
