"""Quality rules: base rules, then an isolation forest on rule statistics.

Words are runs of ``[^\\x20\\x09-\\x0D]`` over the whole text (null: none). The base
rules fail a document of fewer than 20 words or with over 30 % of its words in
repeated 8-word windows. For the others an isolation forest judges ratios
that do not depend on length (word length, symbols, capitals, exclamation marks,
words that repeat the one before, bars): documents that random splits separate early are
anomalous. The forest is fitted on a bounded sample of labelled documents (those that fail
the base rules included: more kinds of anomaly to split off); the
threshold is calibrated on all labelled documents that pass the base rules, as
the cut with the least cost, where rejecting a good document weighs ``good_cost``
times as much as keeping a bad one.

Repeated rows get equal verdicts, a null doc_id stays null and unlabelled,
labels without an id or value are ignored and of several for one document the
lowest counts. Without labelled documents of both kinds the forest rejects
nothing. An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from airseries.llm import text_stats
from airseries.llm.common import id_and_text, only_listed, written
from airseries.llm.isolation import IsolationForest

#: Labelled documents that the forest is fitted on at most.
SAMPLE = 8192
#: Columns of :func:`airseries.llm.text_stats.ratios` that the forest sees.
STATISTICS = [0, 1, 4, 5, 6, 7]
MIN_WORDS, MAX_REPEATED_PERCENT = 20, 30
BINS = 1000


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the counts of :data:`airseries.llm.text_stats.COUNTS` of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = np.array([text_stats.counts(t) for t in b.column(1).to_pylist()],
                            dtype=np.int64).reshape(-1, len(text_stats.COUNTS))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c) for c in rows.T)],
                                             ["doc_id", *text_stats.COUNTS])

    return id_and_text(docs, id_col, text_col).mapInArrow(
        run, "doc_id long, " + ", ".join(f"{c} long" for c in text_stats.COUNTS))


def one_label(labels: DataFrame, column: str = "quality") -> DataFrame:
    """doc_id and label (0 or 1), one row per document."""
    return labels.where(F.col("doc_id").isNotNull() & F.col(column).isNotNull()).groupBy(
        F.col("doc_id").cast("long").alias("doc_id")).agg(F.min(F.col(column).cast("int")).alias("label"))


def base_failed() -> F.Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED_PERCENT * F.col("n_words"))


def _matrix(frame: pd.DataFrame) -> np.ndarray:
    return text_stats.ratios(frame[text_stats.COUNTS].to_numpy(dtype=float))[:, STATISTICS]


def anomaly(model: IsolationForest):
    """Score of a row's counts, as a Column function."""

    @F.pandas_udf("double")
    def score(cols: pd.DataFrame) -> pd.Series:
        return pd.Series(model.score(_matrix(cols)))

    return lambda: score(F.struct(*text_stats.COUNTS))


def best_cut(histogram: list, good_cost: float) -> float:
    """Middle of the scores with the least cost; rows are (bin, label, n). 2.0 rejects nothing."""
    n = np.zeros((2, BINS + 1))
    for b, label, count in histogram:
        n[label, b] += count
    if not n[0].sum() or not n[1].sum():
        return 2.0
    above = n[:, ::-1].cumsum(axis=1)[:, ::-1] / n.sum(axis=1, keepdims=True)  # share at or above each bin
    cost = good_cost * above[1] + 1 - above[0]
    least = np.flatnonzero(cost <= cost.min() + 1e-12)
    runs = np.split(least, np.flatnonzero(np.diff(least) > 1) + 1)
    widest = max(runs, key=len)
    return float((widest[0] + widest[-1]) / 2 / BINS)


def fit(stats: DataFrame, labels: DataFrame, good_cost: float = 10.0) -> tuple[IsolationForest | None, float]:
    """Forest and threshold from a written table of statistics."""
    labelled = written(stats.join(one_label(labels), "doc_id"), "rules-labelled")
    # Thinned by hash before it is ordered, so that no task sends more than its share to the driver.
    share = min(1.0, 1.2 * SAMPLE / max(labelled.count(), 1))
    order = F.xxhash64("doc_id", *text_stats.COUNTS)
    thinned = labelled.where(F.pmod(order, F.lit(1 << 30)) < int(share * (1 << 30)))
    sample = thinned.orderBy(order).limit(SAMPLE).select(*text_stats.COUNTS).toPandas()
    if not len(sample):
        return None, 2.0
    forest = IsolationForest.fit(_matrix(sample))
    binned = labelled.where(~base_failed()).select(F.floor(anomaly(forest)() * BINS).cast("int").alias("bin"),
                           (F.col("label") > 0).cast("int").alias("label"))
    return forest, best_cut([tuple(r) for r in binned.groupBy("bin", "label").count().collect()], good_cost)


def judge(docs: DataFrame, labels: DataFrame, good_cost: float = 10.0) -> DataFrame:
    """One row per document: doc_id, n_words, the four counts, base_failed, anomaly, kept."""
    stats = written(statistics(docs), "rules-stats")
    forest, cut = fit(stats, labels, good_cost)
    score = anomaly(forest)() if forest else F.lit(None).cast("double")
    scored = stats.withColumn("base_failed", base_failed()).withColumn("anomaly", score)
    return scored.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "anomaly",
        (~F.col("base_failed") & (F.coalesce("anomaly", F.lit(0.0)) < cut)).alias("kept"))


def keep_by_rules(docs: DataFrame, labels: DataFrame, text_col: str = "text", good_cost: float = 10.0) -> DataFrame:
    """The rows of ``docs`` that the rules keep, judged where they lie (texts are not shuffled)."""
    # Only labelled documents are looked at to fit; every document is looked at once to be judged.
    known = only_listed(docs, labels.select("doc_id"))
    forest, cut = fit(written(statistics(known, text_col=text_col), "rules-stats"), labels, good_cost)

    @F.pandas_udf("boolean")
    def kept(texts: pd.Series) -> pd.Series:
        rows = np.array([text_stats.counts(t) for t in texts], dtype=np.int64).reshape(-1, len(text_stats.COUNTS))
        words, repeated = rows[:, 0], rows[:, text_stats.COUNTS.index("n_repeat_words")]
        ok = ~((words < MIN_WORDS) | (100 * repeated > MAX_REPEATED_PERCENT * words))
        if forest is not None and ok.any():
            ok[ok] = forest.score(text_stats.ratios(rows[ok])[:, STATISTICS]) < cut
        return pd.Series(ok)

    return docs.where(kept(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))))


def query(spark, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
