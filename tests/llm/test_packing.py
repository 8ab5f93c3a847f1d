import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from airseries.llm import packing as P
from airseries.llm import tokens
from tests.llm import cases


def brute_pieces(rows, capacity):
    tok = Tokenizer.from_file(tokens.default_json())
    tok.encode_special_tokens = True
    out = []
    for i, t in rows:
        ids = np.array(tok.encode(t or "", add_special_tokens=False).ids + [0], dtype="<u4")
        at, end, k = 0, len(ids) % capacity or capacity, 0
        while at < len(ids):
            out.append((i, k, at, end - at, zlib.crc32(ids[at:end].tobytes())))
            at, end, k = end, end + capacity, k + 1
    return sorted(out, key=str)


def check_places(rows, capacity):
    by = defaultdict(list)
    for r in rows:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


@pytest.mark.parametrize("capacity", [2048, 256])
def test_pieces_and_places(spark, capacity):
    rows = P.pack_documents(cases.documents(spark), capacity).collect()
    got = sorted(((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows), key=str)
    assert got == brute_pieces([(r[0], r[1]) for r in cases.rows()], capacity)
    used, least = check_places(rows, capacity), -(-sum(r["length"] for r in rows) // capacity)
    assert used <= least + 2


def test_offsets_by_shuffle_when_too_large_to_broadcast(spark):
    """The table of offsets has a row for each partition and length; beyond the threshold it is joined by shuffle."""
    keys = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    old = {k: spark.conf.get(k, None) for k in keys}
    try:
        for k in keys:
            spark.conf.set(k, "-1")
        packed = P.pack_documents(cases.documents(spark), 256)
        rows = packed.collect()
        assert "BroadcastHashJoin" not in packed._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    got = sorted(((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows), key=str)
    assert got == brute_pieces([(r[0], r[1]) for r in cases.rows()], 256)
    check_places(rows, 256)


def test_sequences_hold_the_ids(spark):
    packed = P.pack_documents(cases.documents(spark), with_ids=True)
    rows = {(r["sequence_id"]): r for r in P.sequences(packed).collect()}
    for r in packed.collect():
        raw = bytes(rows[r["sequence_id"]]["ids"])[4 * r["offset"]:4 * (r["offset"] + r["length"])]
        assert raw == bytes(r["ids"]) and zlib.crc32(raw) == r["ids_crc32"]
    assert all(len(r["ids"]) == 4 * r["n_tokens"] for r in rows.values())


def best_fit_decreasing(counts, capacity):
    free, bins = Counter(), 0
    for length in range(capacity, 0, -1):
        for _ in range(int(counts[length])):
            room = next((r for r in range(length, capacity) if free[r]), None)
            if room is None:
                bins, room = bins + 1, capacity
            else:
                free[room] -= 1
            free[room - length] += 1
    return bins


@pytest.mark.parametrize("seed", range(6))
def test_plan_covers_exactly_and_is_no_worse_than_best_fit(seed):
    rng = np.random.default_rng(seed)
    capacity = 300
    counts = np.zeros(capacity + 1, dtype=np.int64)
    lengths = [rng.integers(1, 301, 900), rng.integers(80, 160, 900), rng.normal(100, 9, 900).astype(int),
               np.repeat([101, 99, 100, 150, 51], 200), rng.integers(140, 170, 500), np.array([300, 300, 1])][seed]
    np.add.at(counts, lengths, 1)
    plan = P.solve(counts, capacity)
    held = np.zeros_like(counts)
    for config, times in plan.items():
        assert sum(k * m for k, m in config) <= capacity and times > 0
        for k, m in config:
            held[k] += m * times
    assert (held == counts).all()
    assert sum(plan.values()) <= best_fit_decreasing(counts, capacity)


def fewest(pieces, capacity):
    """The least number of sequences, by trying all placements."""
    pieces = sorted(pieces, reverse=True)
    best = len(pieces)

    def place(i, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if i == len(pieces):
            best = len(rooms)
            return
        for room in set(rooms):
            if room >= pieces[i]:
                rest = list(rooms)
                rest[rest.index(room)] -= pieces[i]
                place(i + 1, rest)
        place(i + 1, [*rooms, capacity - pieces[i]])

    place(0, [])
    return best


@pytest.mark.parametrize("seed", range(12))
def test_plan_and_bound_beside_the_optimum(seed):
    rng = np.random.default_rng(seed)
    low, high = [(1, 101), (20, 61), (30, 55), (34, 52)][seed % 4]
    pieces = rng.integers(low, high, 11).tolist()
    counts = np.bincount(pieces, minlength=101)
    optimum, plan, bound = fewest(pieces, 100), P.solve(counts, 100), P.least_sequences(counts, 100)
    assert bound <= optimum <= sum(plan.values()) <= optimum + 1
    assert bound >= -(-sum(pieces) // 100)


def test_bound_sees_what_tokens_do_not():
    def counts(**n):
        out = np.zeros(101, dtype=np.int64)
        for k, m in n.items():
            out[int(k[1:])] = m
        return out

    for c, least in ((counts(n51=40), 40), (counts(n34=90), 45), (counts(n51=30, n26=60), 40), (counts(n100=7, n1=1), 8),
                     (counts(), 0)):
        assert P.least_sequences(c, 100) == least == sum(P.solve(c, 100).values())


def test_pricing_matches_brute_force():
    rng = np.random.default_rng(1)
    weight = np.zeros(31)
    weight[rng.choice(np.arange(3, 31), 6, replace=False)] = rng.uniform(0.1, 3, 6)
    best, pick = P._price(weight, 30)
    items = np.flatnonzero(weight)

    def value(room):
        return max([weight[i] + value(room - i) for i in items if i <= room], default=0.0)

    for room in range(31):
        assert abs(best[room] - value(room)) < 1e-9
        taken = P._configuration(pick, room, 0)
        assert abs(sum(weight[k] * m for k, m in taken.items()) - value(room)) < 1e-9


def test_tokens_agree_with_the_library():
    texts = [t or "" for _, t, *_ in cases.rows()]
    tok = Tokenizer.from_file(tokens.default_json())
    tok.encode_special_tokens = True
    assert [x.tolist() for x in tokens.encode(texts)] == [e.ids for e in tok.encode_batch(texts, add_special_tokens=False)]


def test_empty(spark):
    assert P.pack_documents(cases.empty(spark)).count() == 0
