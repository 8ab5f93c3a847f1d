"""Register of the training-data queries and their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from airseries.llm import exact_dedup, heap_clusters, histogram_sort, merkle_manifest, packing, piece_encoding, quality_qda, quality_rules, repair_ids, revisits, simhash_bk, token_rollups, url_filter
from airseries.llm.common import ready

_MODULES = {
    "op1_best_fit_packing": packing,
    "op2_warc_revisits": revisits,
    "op3_quality_rules": quality_rules,
    "op4_simhash_near_dedup": simhash_bk,
    "op5_token_rollups": token_rollups,
    "op6_piece_encoding": piece_encoding,
    "op7_repair_ids": repair_ids,
    "op8_exact_dedup": exact_dedup,
    "op9_url_filter": url_filter,
    "op10_quality_classifier": quality_qda,
    "op11_merkle_manifest": merkle_manifest,
    "op12_histogram_sort": histogram_sort,
    "op13_heap_clusters": heap_clusters,
}

ORACLE: dict[str, str] = {name: m.ORACLE for name, m in _MODULES.items() if hasattr(m, "ORACLE")}


def _bound(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(ready(spark), sf_dir)
    run.__doc__ = fn.__doc__
    return run


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    name: _bound(m.query) for name, m in _MODULES.items()}
