import zlib

import numpy as np
import pytest

from airseries.llm import repair_ids as R
from airseries.llm import tokens
from airseries.llm.common import shared_folder
from tests.llm import cases


@pytest.mark.parametrize("least", [2, 4, 16])
def test_round_trip_and_random_access(least):
    rng = np.random.default_rng(least)
    docs = [np.append(rng.integers(0, 9, rng.integers(0, 400)), 0).astype(np.uint32) for _ in range(40)]
    docs += [np.zeros(1, np.uint32), np.full(501, 7, np.uint32), np.tile([1, 2, 3, 4], 200).astype(np.uint32)]
    data = R.compress([*range(42), None], docs, rounds=8, least=least)
    shard = R.Shard(data)
    ids = np.concatenate(docs)
    assert (shard.all_ids() == ids).all() and shard.doc_ids == [*range(42), None]
    assert all((shard.document(k) == d).all() for k, d in enumerate(docs))
    for _ in range(200):
        a, b = sorted(rng.integers(0, len(ids) + 1, 2))
        if b > a:
            assert (shard.ids(int(a), int(b)) == ids[a:b]).all()
    assert len(shard.rules) and len(shard.seq) < len(ids)
    # every rule's stored length is that of its expansion, and is used twice or more
    flat, start, span = shard._table()
    for k in range(len(shard.rules)):
        expansion = [shard.first_rule + k]
        while any(s >= shard.first_rule for s in expansion):
            expansion = [x for s in expansion
                         for x in (shard.rules[s - shard.first_rule].tolist() if s >= shard.first_rule else [s])]
        assert len(expansion) == shard.expands[k]
    # symbols never reach over the end of a document
    assert (np.diff(np.append(shard.first_symbol, len(shard.seq))) > 0).all()


def test_large_ids_take_four_bytes():
    docs = [np.array([100_000, 5, 100_000, 5, 0] * 30, np.uint32)]
    assert (R.Shard(R.compress([1], docs, least=2)).all_ids() == docs[0]).all()


@pytest.mark.parametrize("least", [2, R.LEAST])
def test_rounds_go_on_until_no_pair_is_frequent(least):
    rng = np.random.default_rng(5)
    passage = rng.integers(1, 50_000, 600)  # shared by all documents
    docs = [np.concatenate([rng.integers(1, 40, rng.integers(50, 90)), passage, [0]]).astype(np.uint32) for _ in range(40)]
    shard = R.Shard(R.compress([*range(40)], docs, least=least))
    assert (shard.all_ids() == np.concatenate(docs)).all() and shard.expands.max() >= 600
    assert all((shard.document(k) == d).all() for k, d in enumerate(docs))
    seq = shard.seq.tolist()
    ends = set(np.append(shard.first_symbol[1:], len(seq)).tolist())
    times, after = {}, {}
    for k in range(len(seq) - 1):
        pair = (seq[k], seq[k + 1])
        if k + 1 not in ends and after.get(pair, 0) <= k:  # occurrences that do not overlap
            times[pair], after[pair] = times.get(pair, 0) + 1, k + 2
    assert max(times.values(), default=0) < least


def test_other_bytes_are_refused():
    with pytest.raises(ValueError):
        R.Shard(b"nope" + bytes(100))


def test_documents_from_files(spark):
    path = shared_folder(spark, "test-shards")
    R.write_shards(cases.documents(spark), path, shard_ids=3000)
    shards = R.read_shards(spark, path)
    assert shards.count() > 3
    got = sorted(((r["start"], r["doc_id"], r["n_tokens"], r["ids_crc32"])
                  for r in R.documents_of(shards).collect()))
    rows = sorted(((r[0] is not None, r[0] or 0, r[1] or "", r[0]) for r in cases.rows()))
    at, want = 0, []
    for (_, _, text, i), ids in zip(rows, tokens.encode([r[2] for r in rows])):
        raw = np.append(ids, np.uint32(0)).astype("<u4").tobytes()
        want.append((at, i, len(raw) // 4, zlib.crc32(raw)))
        at += len(raw) // 4
    assert got == want


def test_empty(spark):
    path = shared_folder(spark, "test-no-shards")
    R.write_shards(cases.empty(spark), path)
    assert R.documents_of(R.read_shards(spark, path)).count() == 0
