import hashlib
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from airseries.llm import merkle_manifest as M
from tests.llm import cases


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def enc(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def climb(nodes, fanout):
    """Root, and the siblings of every node on its way to it, as (place, others)."""
    ways, now = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for k, i in enumerate(now):
            run = nodes[i - i % fanout:i - i % fanout + fanout]
            ways[k].append((i % fanout, run[:i % fanout] + run[i % fanout + 1:]))
            now[k] = i // fanout
        nodes = [sha(*nodes[i:i + fanout]) for i in range(0, len(nodes), fanout)]
    return nodes[0], ways


def brute(rows, fanout=2):
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of (doc_id, text, lang, source, n_chars)."""
    groups = defaultdict(list)
    for d, t, lang, s, n in rows:
        leaf = sha(enc(d), enc(s), enc(lang), enc(n), enc(t))
        change = d is not None and zlib.crc32(str(d).encode()) % 7 == 0 and n is not None
        groups[(lang is not None, (lang or "").encode())].append(
            (d is not None, d or 0, leaf, d, sha(enc(d), enc(s), enc(lang), enc(n + 1), enc(t)) if change else leaf))
    trees = [(g, *climb([m[2] for m in sorted(groups[g], key=lambda m: m[:3])], fanout)) for g in sorted(groups)]
    root, tops = climb([r for _, r, _ in trees], fanout) if trees else (None, [])
    out = []
    for (g, sub, ways), top in zip(trees, tops):
        for m, way in zip(sorted(groups[g], key=lambda m: m[:3]), ways):
            h = m[4]
            for place, others in way + top:
                h = sha(*others[:place], h, *others[place:])
            out.append((m[3], m[2], sub, root, sha(*(x for _, o in way + top for x in o)), h, h == root))
    return sorted(out, key=str)


def report(docs, **options):
    found = M.manifest(docs, **options)
    return sorted((tuple(r) for r in found.withColumn("f", M.folded(F.coalesce("tampered_leaf", "leaf"), F.col("steps"))).select(
        "doc_id", "leaf", "subroot", "root", M.proof_digest(F.col("steps")), "f", F.col("f") == F.col("root")).collect()), key=str)


@pytest.mark.parametrize("fanout,levels", [(2, 12), (2, 3), (3, 1), (5, 1), (2, 0)])
def test_awkward_rows(spark, fanout, levels):
    assert report(cases.documents(spark), fanout=fanout, block_levels=levels) == brute([r[:5] for r in cases.rows()], fanout)


@pytest.mark.parametrize("n", [1, 2, 3, 7, 8, 9, 31, 100])
def test_ragged_trees(spark, n):
    rows = [(i, f"t{i}", ["de", None, "en", "", "日"][i * i % 5], None, i) for i in range(n)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert report(docs, block_levels=1) == brute(rows)


def test_partners_of_missing_members_are_served(spark):
    for n, fanout in ((11, 2), (13, 3), (29, 4), (64, 4)):
        nodes = spark.createDataFrame([("", i, n, sha(str(i))) for i in range(n)], "grp string, at long, n long, digest string")
        root, ways = climb([sha(str(i)) for i in range(n)], fanout)
        got = {r["at"]: (r["digest"], [(s["place"], s["others"]) for s in r["steps"]]) for r in M.butterfly(nodes, fanout, n).collect()}
        assert got == {i: (root, ways[i]) for i in range(n)}


def test_equal_rows_and_one_group(spark):
    rows = [(None, "same", "en", "s", 4)] * 50 + [(7, "same", "en", "s", 4)] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert report(docs, block_levels=2) == brute(rows)


def test_empty(spark):
    assert M.manifest(cases.empty(spark)).count() == 0


def test_query_equals_brute_force(spark):
    folder = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").collect()]
    assert sorted((tuple(r) for r in M.query(spark, folder).collect()), key=str) == brute(rows)
