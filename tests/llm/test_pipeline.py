import pytest

import corpus_pipeline
from airseries.llm import exact_dedup, packing, quality_qda, quality_rules, simhash_bk
from tests.conftest import SF01
from tests.llm import cases
from tests.llm.test_packing import brute_pieces, check_places


def test_stages():
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "quality_rules", "quality_classifier", "exact_dedup", "simhash_near_dedup", "best_fit_packing"]


def test_run_equals_the_reports_applied_by_hand(spark):
    """Each stage's decisions are taken from its operator's report and applied with plain Python."""
    labels = spark.read.parquet(f"{SF01}/labels.parquet")
    docs = spark.read.parquet(f"{SF01}/documents.parquet").cache()

    def left(ids):
        return docs.where(docs.doc_id.isin(sorted(ids)))

    ids = {r["doc_id"] for r in quality_rules.judge(docs, labels).collect() if r["kept"]}
    ids = {r["doc_id"] for r in quality_qda.classify(left(ids), labels).collect() if r["predicted"]}
    ids = {r["doc_id"] for r in exact_dedup.dedup_report(left(ids)).collect() if r["kept"]}
    ids = {r["component_id"] for r in simhash_bk.near_report(left(ids)).collect()}
    texts = [(r["doc_id"], r["text"]) for r in left(ids).collect()]
    rows = corpus_pipeline.run(spark, SF01).collect()
    got = sorted(((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows), key=str)
    assert got == brute_pieces(texts, 2048)
    assert check_places(rows, 2048) <= -(-sum(r["length"] for r in rows) // 2048) + 2
    docs.unpersist()


@pytest.fixture(scope="module")
def labelled(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("labels"))
    cases.labels(spark).write.parquet(f"{path}/labels.parquet")
    return path


def test_stages_keep_the_columns_and_bear_awkward_rows(spark, labelled):
    docs = cases.documents(spark)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, labelled)
        if name != "best_fit_packing":
            assert out.columns == docs.columns, name
            assert 0 < out.count() <= docs.count()
        else:
            assert out.count() >= docs.count()


def test_stages_on_an_empty_table(spark, labelled):
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, cases.empty(spark), labelled).count() == 0


def test_packing_is_the_last_stage(spark):
    assert set(packing.pack_documents(cases.empty(spark)).columns) >= {"doc_id", "piece", "sequence_id", "offset"}


def test_classifier_learns_from_rows_that_the_rules_removed(spark, tmp_path):
    """The rules leave no labelled bad row, yet an unlabelled bad document is scored."""
    def junk(seed):
        return " ".join(w + "%&#"[k % 3] * 3 for k, w in enumerate(cases.prose(seed, 60).split()))

    good = [(i, cases.prose(300 + i, 80) + ".") for i in range(60)]
    bad = [(100 + i, junk(500 + i)) for i in range(20)]
    rows = good + bad + [(900, cases.prose(900, 80) + "."), (901, junk(901))]
    whole = spark.createDataFrame(rows, "doc_id long, text string")
    whole.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1) for i, _ in good] + [(i, 0) for i, _ in bad], "doc_id long, quality int").write.parquet(
        f"{tmp_path}/labels.parquet")
    left = whole.where("doc_id NOT BETWEEN 100 AND 199")
    kept = {r["doc_id"] for r in dict(corpus_pipeline.STAGES)["quality_classifier"](spark, left, str(tmp_path)).collect()}
    assert 901 not in kept and 900 in kept and len(kept) == 61
