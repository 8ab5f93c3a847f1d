"""Quality classifier: regularised quadratic discriminant on transformed text statistics.

Per class (label 0 or 1) the mean and covariance of the transformed statistics
come from distributed sums over all training rows. A covariance is shrunk towards
the pooled one and then towards its own diagonal. A score is the difference of
the classes' Gaussian log densities (Mahalanobis distances by cached Cholesky
factors) plus the log prior odds, put on a probability scale by a logistic fit on
the training rows' binned differences.

Training rows are labelled rows whose crc32(doc_id as text) mod 5 is not 0; ids,
labels, languages and sources are never inputs of a score. Null text is
empty; an empty text has its own (degenerate) statistics and is scored by them.
A null doc_id is not held out and not trained on. Repeated rows score alike; of several
labels for one document the lowest counts; without training rows of both classes every
score is 1 (nothing is known against a document). An empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from airseries.llm import text_stats
from airseries.llm.common import only_listed, written
from airseries.llm.quality_rules import one_label, statistics

#: Columns of :func:`airseries.llm.text_stats.ratios` that the classifier uses.
USED = 8
TO_POOLED, TO_DIAGONAL, FLOOR = 0.3, 0.02, 1e-4
THRESHOLD = 0.3
#: Bins of the log-density difference for the calibration: width and largest absolute value.
WIDTH, LARGEST = 0.05, 100.0


def transformed(counts: np.ndarray) -> np.ndarray:
    """Log word length and square roots of the ratios (which spread their small values)."""
    r = text_stats.ratios(counts)[:, :USED]
    return np.column_stack([np.log(np.maximum(r[:, 0], 0.5)), np.sqrt(r[:, 1:])])


class Discriminant:
    """Means, inverse Cholesky factors and log constants of the two classes, and the calibration."""

    def __init__(self, n: np.ndarray, total: np.ndarray, cross: np.ndarray):
        d = total.shape[1]
        means = total / n[:, None]
        scatter = [cross[c] - n[c] * np.outer(means[c], means[c]) for c in (0, 1)]
        pooled = (scatter[0] + scatter[1]) / n.sum()
        self.means, self.whiten, self.constant = means, [], []
        for c in (0, 1):
            cov = (1 - TO_POOLED) * scatter[c] / n[c] + TO_POOLED * pooled
            cov = (1 - TO_DIAGONAL) * cov + TO_DIAGONAL * np.diag(np.diag(cov)) + FLOOR * np.eye(d)
            factor = np.linalg.cholesky(cov)
            self.whiten.append(np.linalg.inv(factor))
            self.constant.append(np.log(n[c] / n.sum()) - np.log(np.diag(factor)).sum())
        self.slope, self.shift = 1.0, 0.0

    def difference(self, x: np.ndarray) -> np.ndarray:
        """Log density with prior of class 1 less that of class 0."""
        logs = []
        for c in (0, 1):
            z = (x - self.means[c]) @ self.whiten[c].T
            logs.append(self.constant[c] - 0.5 * (z * z).sum(axis=1))
        return np.clip(logs[1] - logs[0], -LARGEST, LARGEST)

    def calibrate(self, value: np.ndarray, label: np.ndarray, n: np.ndarray) -> None:
        """Logistic regression on binned differences with smoothed targets, by Newton steps."""
        ones, zeros = n[label == 1].sum(), n[label == 0].sum()
        target = np.where(label == 1, (ones + 1) / (ones + 2), 1 / (zeros + 2))
        x = np.column_stack([value, np.ones_like(value)])
        w = np.array([0.1, 0.0])

        def loss(w):
            m = x @ w
            return float((n * (np.logaddexp(0, m) - target * m)).sum())

        for _ in range(100):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -500, 500)))
            g = x.T @ (n * (p - target))
            h = (x * (n * p * (1 - p))[:, None]).T @ x + 1e-9 * np.eye(2)
            step, size = np.linalg.solve(h, g), 1.0
            while loss(w - size * step) > loss(w) and size > 1e-6:
                size /= 2
            w = w - size * step
            if np.abs(step * size).max() < 1e-9:
                break
        if np.isfinite(w).all() and w[0] > 0:
            self.slope, self.shift = float(w[0]), float(w[1])

    def score(self, counts: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.difference(transformed(counts)) + self.shift, -500, 500)))


def held_out(id_col: Column) -> Column:
    crc = F.crc32(id_col.cast("string").cast("binary"))
    return F.coalesce(F.pmod(crc, F.lit(5)) == 0, F.lit(False))


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each class and moment of a partition; moments are 1, x and the products of x."""
    d = USED
    sums = np.zeros((2, 1 + d + d * d))
    for b in batches:
        f = b.to_pandas()
        x = transformed(f[text_stats.COUNTS].to_numpy(dtype=float))
        for c in (0, 1):
            xc = x[(f["label"] > 0).to_numpy() == bool(c)]
            sums[c] += np.concatenate([[len(xc)], xc.sum(axis=0), (xc.T @ xc).ravel()])
    yield pa.RecordBatch.from_arrays(
        [pa.array(np.repeat([0, 1], sums.shape[1]), pa.int32()), pa.array(np.tile(np.arange(sums.shape[1]), 2), pa.int32()),
         pa.array(sums.ravel())], ["label", "k", "value"])


def fit(stats: DataFrame, labels: DataFrame) -> Discriminant | None:
    """Learn from a written table of statistics; the driver gets about 150 sums and a histogram."""
    train = written(stats.where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
                    .join(one_label(labels), "doc_id").drop("doc_id"), "qda-train")
    sums = np.zeros((2, 1 + USED + USED * USED))
    for r in train.mapInArrow(_moments, "label int, k int, value double").groupBy("label", "k").agg(
            F.sum("value").alias("value")).collect():
        sums[r["label"], r["k"]] = r["value"]
    n = sums[:, 0]
    if n.min() < 1:
        return None
    model = Discriminant(n, sums[:, 1:1 + USED], sums[:, 1 + USED:].reshape(2, USED, USED))

    @F.pandas_udf("int")
    def binned(cols: pd.DataFrame) -> pd.Series:
        return pd.Series(np.rint(model.difference(transformed(cols.to_numpy(dtype=float))) / WIDTH).astype(np.int32))

    rows = train.groupBy(binned(F.struct(*text_stats.COUNTS)).alias("bin"),
                         (F.col("label") > 0).cast("int").alias("label")).count().collect()
    rows = np.array(sorted(tuple(r) for r in rows), dtype=float)
    model.calibrate(rows[:, 0] * WIDTH, rows[:, 1], rows[:, 2])
    return model


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    stats = written(statistics(docs), "qda-stats")
    model = fit(stats, labels)

    @F.pandas_udf("double")
    def score(cols: pd.DataFrame) -> pd.Series:
        return pd.Series(model.score(cols.to_numpy(dtype=float)))

    scored = stats.withColumn("score", score(F.struct(*text_stats.COUNTS)) if model else F.lit(1.0))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                         (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, text_col: str = "text", threshold: float = THRESHOLD,
              train_docs: DataFrame | None = None) -> DataFrame:
    """The rows of ``docs`` predicted 1, scored where they lie (texts are not shuffled).

    The discriminant is fitted on the training rows of ``train_docs``, or of ``docs`` if that is not given: where
    an earlier filter has removed bad rows, those that are left do not show what a bad row is.
    """
    known = docs if train_docs is None else train_docs
    id_col = F.col("doc_id").cast("long")
    known = only_listed(known.where(id_col.isNotNull() & ~held_out(id_col)), labels.select("doc_id"))
    model = fit(written(statistics(known, text_col=text_col), "qda-stats"), labels)
    if model is None:
        return docs

    @F.pandas_udf("boolean")
    def good(texts: pd.Series) -> pd.Series:
        rows = np.array([text_stats.counts(t) for t in texts], dtype=float).reshape(-1, len(text_stats.COUNTS))
        return pd.Series(model.score(rows) >= threshold)

    return docs.where(good(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))))


def query(spark, sf_dir: str) -> DataFrame:
    return classify(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
