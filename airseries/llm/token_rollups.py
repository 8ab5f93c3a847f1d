"""Token counts: delta-maintained rollups with idempotent batch commits.

A batch of changes (insert, revise, delete) becomes signed rows: the count a
document had is taken away, the count it gets is added. The batch's sums by
source, language and tokenizer version are one small table, and totals are sums
of such tables, so nothing is recounted. A ledger keeps the last count of each document and
tokenizer version, as the next change needs the one before.

A batch writes its ledger rows, then its sums, each to a folder of its own named by
the batch id. It is committed when Spark has marked the second as complete; a
committed batch is skipped when it comes again, and one that broke off is
written anew over its remains. Totals read committed batches only. New
batch ids must ascend.

Every ``every`` batches ledger and sums are folded into snapshots: the last live count of each document and version, and
the sums so far. A commit reads the last snapshot and the batches behind it, however many came before; a
snapshot counts once Spark has marked it as complete, and one that broke off only leaves a longer tail.

Of several changes to one document and version in a batch the highest ``seq``
counts; then a delete; then the largest count, source and language. An insert of a known document replaces its count, a
revision of an unknown one inserts it, a delete of an unknown one does nothing. Documents
without an id cannot be changed later: their inserts add up, their other changes
do nothing. Null counts are zero; null sources and languages are groups of their own. An
empty batch commits and changes nothing. Further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from airseries.llm import tokens
from airseries.llm.common import shared_folder, written

GROUP = ["source", "lang", "tokenizer"]
_LEDGER = "doc_id long, tokenizer string, source string, lang string, n_tokens long, live boolean"
_SUMS = "source string, lang string, tokenizer string, n_docs long, n_tokens long"


class TokenRollup:
    """A rollup in the folder ``path`` (shared by driver and executors)."""

    def __init__(self, spark: SparkSession, path: str, every: int = 8):
        self.spark, self.path, self.every = spark, path.rstrip("/"), every

    def _folder(self, kind: str, batch: int) -> str:
        return f"{self.path}/{kind}/batch={int(batch)}"

    def _complete(self, kind: str) -> list[int]:
        top = f"{self.path}/{kind}"
        store, at = pafs.FileSystem.from_uri(top if ":" in top else f"file://{top}")
        found = store.get_file_info(pafs.FileSelector(at, allow_not_found=True, recursive=True))
        return sorted(int(f.path.rsplit("/", 2)[-2].removeprefix("batch=")) for f in found if f.base_name == "_SUCCESS")

    def committed(self) -> list[int]:
        """Ids of the committed batches, ascending."""
        return self._complete("sums")

    def reads(self, kind: str, batches: list[int]) -> list[str]:
        """Folders that hold ``kind`` up to now: the last snapshot and the committed batches behind it."""
        last = batches[-1] if batches else -1
        snapshots = [b for b in self._complete(f"{kind}-snapshot") if b <= last]
        since = snapshots[-1] if snapshots else None
        tail = [self._folder(kind, b) for b in batches if since is None or b > since]
        return ([self._folder(f"{kind}-snapshot", since)] if snapshots else []) + tail

    def _read(self, kind: str, schema: str, batches: list[int]) -> DataFrame:
        """Rows of ``kind`` with the number of their folder, later ones higher."""
        out = self.spark.createDataFrame([], f"{schema}, batch long")
        for k, folder in enumerate(self.reads(kind, batches)):
            out = out.unionByName(self.spark.read.schema(schema).parquet(folder).withColumn("batch", F.lit(k).cast("long")))
        return out

    def _last(self, batches: list[int], touched: DataFrame | None = None) -> DataFrame:
        """The last ledger row of each document and version, or of those in ``touched``."""
        keys = ["doc_id", "tokenizer"]
        rows = self._read("ledger", _LEDGER, batches)
        if touched is not None:
            rows = rows.join(touched.select(*keys), keys, "left_semi")
        value = F.struct("source", "lang", "n_tokens", "live")
        return rows.groupBy(*keys).agg(F.max_by(value, "batch").alias("v")).select(*keys, "v.*")

    def compact(self) -> None:
        """Fold what is committed into snapshots; a second time without a new batch changes nothing."""
        done = self.committed()
        if not done or len(self.reads("ledger", done)) < 2 and len(self.reads("sums", done)) < 2:
            return
        # A deleted document is as good as one never seen.
        self._last(done).where("live").write.mode("overwrite").parquet(self._folder("ledger-snapshot", done[-1]))
        self._summed(done).write.mode("overwrite").parquet(self._folder("sums-snapshot", done[-1]))

    def _summed(self, batches: list[int]) -> DataFrame:
        return self._read("sums", _SUMS, batches).groupBy(*GROUP).agg(
            F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))

    def commit(self, batch: int, changes: DataFrame) -> bool:
        """Apply ``changes`` (op, doc_id, source, lang, tokenizer, n_tokens, seq); False if it was applied before."""
        done = self.committed()
        if batch in done:
            return False
        if done and batch < done[-1]:
            raise ValueError(f"batch {batch} comes after batch {done[-1]} was committed")
        deleted = F.col("op") == "delete"
        rows = changes.where(F.col("op").isin("insert", "revise", "delete")).select(
            F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("tokenizer", F.lit("")).alias("tokenizer"),
            F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"),
            F.coalesce(F.col("n_tokens").cast("long"), F.lit(0)).alias("n_tokens"), (~deleted).alias("live"),
            F.coalesce(F.col("seq").cast("long"), F.lit(0)).alias("seq"),
            F.col("op"))
        rank = F.struct("seq", deleted.alias("gone"), "n_tokens", "source", "lang")
        new = rows.where("doc_id IS NOT NULL").groupBy("doc_id", "tokenizer").agg(
            F.max_by(F.struct("source", "lang", "n_tokens", "live"), rank).alias("v")).select(
            "doc_id", "tokenizer", "v.*")
        ledger = self._folder("ledger", batch)
        new.write.mode("overwrite").parquet(ledger)
        new = self.spark.read.schema(_LEDGER).parquet(ledger)

        old = self._last(done, new).where("live")
        minus = old.select(*GROUP, F.lit(-1).cast("long").alias("n_docs"), (-F.col("n_tokens")).alias("n_tokens"))
        plus = new.where("live").select(*GROUP, F.lit(1).cast("long").alias("n_docs"), "n_tokens")
        nameless = rows.where("doc_id IS NULL AND op = 'insert'").select(
            *GROUP, F.lit(1).cast("long").alias("n_docs"), "n_tokens")
        signed = minus.unionByName(plus).unionByName(nameless)
        sums = signed.groupBy(*GROUP).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
        sums.write.mode("overwrite").parquet(self._folder("sums", batch))  # its success mark is the commit
        if len(self.reads("ledger", [*done, batch])) > self.every:
            self.compact()
        return True

    def totals(self) -> DataFrame:
        """source, lang, tokenizer, n_docs, n_tokens over all committed batches; groups without documents are left out."""
        return self._summed(self.committed()).where("n_docs <> 0")


def without_repeated_lines(text: str) -> str:
    """Every line but those equal to an earlier one."""
    return "\n".join(dict.fromkeys(text.split("\n")))


def count_tokens(docs: DataFrame, json_path: str | None = None, multi_path: str | None = None) -> DataFrame:
    """doc_id, source, lang, n_first, n_multi and n_revised (null where no line repeats) of every document.

    A null text is empty and has no tokens; rows without an id, and repeated rows, are counted as rows of their own.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import public_tokenizers
        multi = tokens._ranked(multi_path or public_tokenizers.path("byte_bpe_multi_50k.tiktoken"),
                               public_tokenizers.PATTERN)
        for b in batches:
            texts = b.column(3).to_pylist()
            shorter = [without_repeated_lines(t) for t in texts]
            changed = [i for i, t in enumerate(texts) if shorter[i] != t]
            revised: list[int | None] = [None] * len(texts)
            for i, ids in zip(changed, tokens.encode([shorter[i] for i in changed], json_path)):
                revised[i] = len(ids)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), b.column(2), pa.array([len(x) for x in tokens.encode(texts, json_path)], pa.int64()),
                 pa.array([len(tokens.ordinary(multi, t)) for t in texts], pa.int64()), pa.array(revised, pa.int64())],
                ["doc_id", "source", "lang", "n_first", "n_multi", "n_revised"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"),
                        F.col("lang").cast("string").alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    return texts.mapInArrow(
        run, "doc_id long, source string, lang string, n_first long, n_multi long, n_revised long")


def query(spark, sf_dir: str) -> DataFrame:
    """Four batches over all documents, one of them sent twice.

    1 inserts every document's count under the first vocabulary, 2 under the second, 3
    deletes toxic documents under both, 4 revises the first counts of documents that hold
    repeated lines to those without them.
    """
    counts = written(count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet")), "token-counts")
    toxic = spark.read.parquet(f"{sf_dir}/labels.parquet").where("toxic = 1").select("doc_id").distinct()
    rollup = TokenRollup(spark, shared_folder(spark, "token-rollup"))

    def change(rows: DataFrame, op: str, tokenizer: str, n: str) -> DataFrame:
        return rows.select(F.lit(op).alias("op"), "doc_id", "source", "lang", F.lit(tokenizer).alias("tokenizer"),
                           F.col(n).alias("n_tokens"), F.lit(0).alias("seq"))

    first, second = "byte_bpe_50k", "byte_bpe_multi_50k"
    rollup.commit(1, change(counts, "insert", first, "n_first"))
    rollup.commit(2, change(counts, "insert", second, "n_multi"))
    gone = counts.join(toxic, "doc_id", "left_semi")
    deletes = change(gone, "delete", first, "n_first").unionByName(change(gone, "delete", second, "n_multi"))
    rollup.commit(3, deletes)
    revised = counts.where("n_revised IS NOT NULL").join(toxic, "doc_id", "left_anti")
    rollup.commit(4, change(revised, "revise", first, "n_revised"))
    rollup.commit(2, change(counts, "insert", second, "n_multi"))  # comes again: no effect
    return rollup.totals()
