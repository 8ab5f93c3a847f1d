import hashlib
import re
from collections import defaultdict

import pytest

from airseries.llm import exact_dedup as D
from tests.llm import cases


def brute(rows):
    groups = defaultdict(list)
    for i, t in rows:
        t = t or ""
        groups[re.sub(r"[\x20\x09-\x0D]", "", t)].append((-len(t), i is None, i if i is not None else 0, i))
    out = []
    for norm, members in groups.items():
        members.sort()
        for k, m in enumerate(members):
            out.append((m[3], members[0][3], len(members), k == 0, hashlib.sha256(norm.encode()).hexdigest()))
    return sorted(out, key=str)


def test_report(spark):
    got = sorted((tuple(r) for r in D.dedup_report(cases.documents(spark)).collect()), key=str)
    assert got == brute([(r[0], r[1]) for r in cases.rows()])


@pytest.mark.parametrize("everything", [True, False])
def test_group_sizes_agree(spark, everything):
    groups = D.exact_groups(cases.documents(spark), digest_all=everything)
    want = defaultdict(int)
    for i, keep, size, kept, sha in brute([(r[0], r[1]) for r in cases.rows()]):
        want[i, size] += 1
    got = defaultdict(int)
    for r in groups.collect():
        got[r["doc_id"], r["group_size"]] += r["copies"]
    assert got == want


def test_filter_keeps_one_row_of_each_text_with_its_columns(spark):
    docs = cases.documents(spark)
    kept = D.drop_exact_duplicates(docs)
    assert kept.columns == docs.columns
    got = sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=str)
    norm = [re.sub(r"[\x20\x09-\x0D]", "", t or "") for _, t in got]
    assert len(set(norm)) == len(norm)
    want = sorted(str(b[0]) for b in brute([(r[0], r[1]) for r in cases.rows()]) if b[3])
    assert sorted(str(i) for i, _ in got) == want


def test_full_hash_is_for_survivors_only(spark):
    refined = D.refine(cases.documents(spark)).collect()
    assert all((r["sha"] is None) == r["single"] for r in refined)
    assert any(r["single"] for r in refined)


def test_prefix_ties_are_told_apart(spark):
    a, b = "x" * 500 + "a", "x" * 500 + "b"  # equal length and prefix
    docs = spark.createDataFrame([(1, a), (2, b), (3, a)], "doc_id long, text string")
    assert {(r["doc_id"], r["keep_id"], r["kept"]) for r in D.dedup_report(docs).collect()} == {
        (1, 1, True), (2, 2, True), (3, 1, False)}
    assert sorted(r["doc_id"] for r in D.drop_exact_duplicates(docs).collect()) == [1, 2]


def test_empty(spark):
    assert D.dedup_report(cases.empty(spark)).count() == 0
    assert D.drop_exact_duplicates(cases.empty(spark)).count() == 0
