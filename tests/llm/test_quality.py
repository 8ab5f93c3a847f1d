import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from airseries.llm import quality_qda as Q
from airseries.llm import quality_rules as R
from airseries.llm import text_stats
from airseries.llm.isolation import IsolationForest, average_path
from tests.conftest import SF01
from tests.llm import cases


def brute_counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(tuple(words[i:i + 8]) for i in range(len(words) - 7))
    covered = {j for i in range(len(words) - 7) if windows[tuple(words[i:i + 8])] > 1 for j in range(i, i + 8)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered))


def test_counts_match_brute_force():
    rng = random.Random(3)
    texts = [t for _, t, *_ in cases.rows()] + ["".join(rng.choices(["a ", "b ", "c ", "\n", " \t", "#", "é", "a\r\n", "\x1c", "\x85", "\xa0"], k=rng.randint(0, 300)))
                                              for _ in range(300)]
    for t in texts:
        got = dict(zip(text_stats.COUNTS, text_stats.counts(t or "")))
        assert tuple(got[k] for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == brute_counts(t)


def test_report(spark):
    docs = cases.documents(spark)
    rows = R.judge(docs, cases.labels(spark)).collect()
    got = sorted(((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"])
                  for r in rows), key=str)
    want = []
    for i, t, *_ in cases.rows():
        c = brute_counts(t)
        want.append((i, *c, c[0] < 20 or 100 * c[4] > 30 * c[0]))
    assert got == sorted(want, key=str)
    assert not any(r["kept"] for r in rows if r["base_failed"])
    assert any(r["kept"] for r in rows)
    kept = R.keep_by_rules(docs, cases.labels(spark))
    assert kept.columns == docs.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(str(r["doc_id"]) for r in rows if r["kept"])


def test_forest_separates_on_held_out_rows(spark):
    """Fitted and calibrated on half of the labels, judged on the other half."""
    docs = spark.read.parquet(f"{SF01}/documents.parquet")
    labels = spark.read.parquet(f"{SF01}/labels.parquet")
    train = labels.where(F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0)
    rows = R.judge(docs, train).join(labels.join(train, "doc_id", "left_anti"), "doc_id").where(~F.col("base_failed")).collect()
    good = [r["kept"] for r in rows if r["quality"] == 1]
    bad = [r["kept"] for r in rows if r["quality"] == 0]
    assert np.mean(good) > 0.97 and np.mean(bad) < 0.2


def test_forest_paths():
    assert average_path(1) == 0 and average_path(2) == 1
    rng = np.random.default_rng(0)
    sample = np.concatenate([rng.normal(0, 1, (500, 3)), [[9, 9, 9]]])
    forest = IsolationForest.fit(sample, trees=50, size=128)
    score = forest.score(np.array([[0.0, 0, 0], [9, 9, 9]]))
    assert score[1] > score[0] + 0.15
    # a path is walked as the arrays say
    x, total = sample[3], 0.0
    for root in forest.roots:
        at = root
        while forest.feature[at] >= 0:
            at = forest.left[at] + (x[forest.feature[at]] > forest.value[at])
        total += forest.value[at]
    assert abs(2 ** (-total / len(forest.roots) / forest.norm) - forest.score(sample[3:4])[0]) < 1e-12
    assert len(set(IsolationForest.fit(np.ones((5, 2))).score(np.array([[1.0, 1], [4, 4]])))) == 1


def test_cut():
    assert R.best_cut([(b, 1, 10) for b in range(400, 500)] + [(b, 0, 3) for b in range(600, 650)], 10.0) == pytest.approx(0.55, abs=0.01)
    assert R.best_cut([(1, 1, 5)], 10.0) == 2.0 and R.best_cut([], 10.0) == 2.0


@pytest.mark.parametrize("labelled", ["none", "one kind"])
def test_without_both_labels_nothing_is_judged_by_the_models(spark, labelled):
    labels = cases.labels(spark).where("quality = 1" if labelled == "one kind" else "false")
    rows = R.judge(cases.documents(spark), labels).collect()
    assert all(r["kept"] != r["base_failed"] for r in rows)
    assert {r["score"] for r in Q.classify(cases.documents(spark), labels).collect()} == {1.0}


def test_classifier_on_held_out_rows(spark):
    rows = Q.classify(spark.read.parquet(f"{SF01}/documents.parquet"), spark.read.parquet(f"{SF01}/labels.parquet")).join(
        spark.read.parquet(f"{SF01}/labels.parquet"), "doc_id").collect()
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3)
    held = [r for r in rows if r["held_out"]]
    assert np.mean([r["predicted"] == r["quality"] for r in held]) > 0.97


def test_held_out_labels_are_never_used(spark):
    docs, labels = cases.documents(spark), cases.labels(spark).where("doc_id IS NOT NULL")
    flipped = labels.withColumn("quality", F.when(Q.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    a = {(r[0], round(r[2], 9)) for r in Q.classify(docs, labels).collect()}
    b = {(r[0], round(r[2], 9)) for r in Q.classify(docs, flipped).collect()}
    assert a == b


def test_discriminant_matches_a_direct_formula():
    rng = np.random.default_rng(1)
    x = [rng.normal(0, 1, (80, 3)) @ rng.normal(0, 1, (3, 3)), rng.normal(1, 2, (120, 3))]
    n = np.array([80.0, 120.0])
    model = Q.Discriminant(n, np.array([v.sum(axis=0) for v in x]), np.array([v.T @ v for v in x]))
    covs = [np.cov(v.T, bias=True) for v in x]
    pooled = (80 * covs[0] + 120 * covs[1]) / 200
    point, logs = rng.normal(0, 1, 3), []
    for c in (0, 1):
        s = (1 - Q.TO_POOLED) * covs[c] + Q.TO_POOLED * pooled
        s = (1 - Q.TO_DIAGONAL) * s + Q.TO_DIAGONAL * np.diag(np.diag(s)) + Q.FLOOR * np.eye(3)
        d = point - x[c].mean(axis=0)
        logs.append(np.log(n[c] / 200) - 0.5 * np.log(np.linalg.det(s)) - 0.5 * d @ np.linalg.inv(s) @ d)
    assert model.difference(point[None])[0] == pytest.approx(logs[1] - logs[0])


def test_classifier_filter_and_awkward_rows(spark):
    docs = cases.documents(spark)
    rows = Q.classify(docs, cases.labels(spark)).collect()
    assert len(rows) == docs.count()
    kept = Q.keep_good(docs, cases.labels(spark))
    assert kept.columns == docs.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(str(r["doc_id"]) for r in rows if r["predicted"])


def test_empty(spark):
    for labels in (cases.labels(spark), cases.labels(spark).limit(0)):
        assert R.judge(cases.empty(spark), labels).count() == 0
        assert R.keep_by_rules(cases.empty(spark), labels).count() == 0
        assert Q.classify(cases.empty(spark), labels).count() == 0
        assert Q.keep_good(cases.empty(spark), labels).count() == 0


def test_only_listed_rows_are_looked_at(spark, monkeypatch):
    from airseries.llm import common
    docs, ids = cases.documents(spark), cases.labels(spark).select("doc_id")
    want = {r["doc_id"] for r in ids.collect()} - {None}
    for bound in (10**6, 3):  # broadcast, and joined by shuffle
        monkeypatch.setattr(common, "BROADCAST_IDS", bound)
        got = common.only_listed(docs, ids)
        assert got.columns == docs.columns
        assert sorted(r["doc_id"] for r in got.collect()) == sorted(r[0] for r in cases.rows() if r[0] in want)
    assert common.only_listed(docs, ids.where("false")).count() == 0
