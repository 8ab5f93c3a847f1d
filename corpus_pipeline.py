"""The corpus pipeline: quality rules, quality classifier, exact and near dedup, packing.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and
returns a DataFrame, which is written as Parquet and read again as the next
stage's ``docs``. All but the last return the columns of ``documents``.
Nulls, empty and long texts, repeated rows, empty tables and further columns are
treated as each stage's operator states in its module.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from airseries.llm import exact_dedup, packing, quality_qda, quality_rules, simhash_bk
from airseries.llm.common import ready, written


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def _whole(spark: SparkSession, sf_dir: str) -> DataFrame | None:
    """The table ``documents`` as it was before any stage; None where a folder has none."""
    try:
        return spark.read.parquet(f"{sf_dir}/documents.parquet")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules (base rules and isolation forest) keep."""
    return quality_rules.keep_by_rules(docs, _labels(ready(spark), sf_dir))


def classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quadratic discriminant predicts to be good.

    It is fitted on the training labels of the whole table, as the rules before it leave hardly a bad row; a folder
    without ``documents`` has only this stage's input to learn from.
    """
    return quality_qda.keep_good(docs, _labels(ready(spark), sf_dir), train_docs=_whole(spark, sf_dir))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts equal up to white space."""
    ready(spark)
    return exact_dedup.drop_exact_duplicates(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of SimHash fingerprints within two bits."""
    ready(spark)
    return simhash_bk.drop_near_duplicates(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The places of the documents' pieces in sequences of 2048 tokens."""
    ready(spark)
    return packing.pack_documents(docs)


STAGES = [
    ("quality_rules", rules),
    ("quality_classifier", classifier),
    ("exact_dedup", exact),
    ("simhash_near_dedup", near),
    ("best_fit_packing", pack),
]

#: Forest, classifier, tokenizer and packing have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again."""
    docs = ready(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
