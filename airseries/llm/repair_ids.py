"""Token ids as binary shards, compressed by Re-Pair grammars.

Documents are ordered by doc_id over range partitions, tokenized, and cut into
shards of about ``shard_ids`` ids. In each shard frequent adjacent id pairs are
repeatedly replaced by nonterminals: a round counts the pairs that lie inside a document,
gives a rule to every pair that occurs at least ``least`` times, and replaces its
non-overlapping occurrences from left to right; the next round pairs the
nonterminals, until no pair is left that can be replaced. A shard stores the rules, the length each rule expands to, the
compressed sequence and an index of its documents, so any document or range of
ids is decoded alone (:meth:`Shard.document`, :meth:`Shard.ids`).

Shard layout (little-endian): magic ``RPR1``; seven uint64 (documents, ids, rules,
symbols, first rule's symbol, bytes per symbol, bytes per rule side); doc ids (int64) and
their null flags (uint8), documents' first symbols and first ids (uint64), rule
sides, rule lengths (uint32), symbols. The files are Parquet files of one row per
shard (part, shard, n_docs, n_ids, data) in ascending doc_id order: Spark's committer makes
a retried or lost task's file appear once or not at all.

Every document ends with the end id. Null text is empty and stored as the end id
alone; a null doc_id sorts first; rows of one doc_id follow each other ordered by text;
other columns are ignored; an empty table gives no shard. A text of any length is kept
whole in one shard.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from airseries.llm import tokens
from airseries.llm.common import id_and_text, shared_folder

END_ID = 0
SHARD_IDS = 1 << 20
MAGIC = b"RPR1"
LEAST = 16
_BITS = 19


def _bucket(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of symbol pairs (uint32) to 19 bits."""
    mixed = a * np.uint32(0x9E3779B1) + b * np.uint32(0x85EBCA77)
    mixed ^= mixed >> np.uint32(15)
    return (mixed * np.uint32(0x2C1B3C6D)) >> np.uint32(32 - _BITS)


def _round(seq: np.ndarray, last: np.ndarray, live: np.ndarray, base: int, least: int):
    """One round: (new sequence, new last flags, new live flags, rule sides), or None if no pair can be replaced.

    ``live`` marks where a pair starts that may be frequent: replacing makes no new pair of old symbols, so all
    places of such a pair were counted before, and a pair that was rare stays rare.
    """
    spots = np.flatnonzero(live[:-1] & ~last[:-1])  # pairs do not reach over the end of a document
    bucket = _bucket(seq[spots], seq[spots + 1])
    spots = spots[(np.bincount(bucket, minlength=1 << _BITS) >= least)[bucket]]  # no pair is more frequent than its bucket
    key = (seq[spots].astype(np.uint64) << np.uint64(32)) | seq[spots + 1]
    pairs, times = np.unique(key, return_counts=True)
    pairs = pairs[times >= least]
    if not len(pairs):
        return None
    rule = np.minimum(np.searchsorted(pairs, key), len(pairs) - 1)
    match = pairs[rule] == key
    spots, rule = spots[match], rule[match]
    frequent = np.zeros(len(seq), dtype=bool)
    frequent[spots] = True
    sides = np.column_stack([pairs >> np.uint64(32), pairs & np.uint64(0xFFFFFFFF)]).astype(np.uint32)
    # occurrences that overlap form runs; every other one of a run is replaced
    start = np.concatenate([[True], spots[1:] != spots[:-1] + 1])
    at = np.arange(len(spots))
    odd = (at - np.maximum.accumulate(np.where(start, at, 0))) & 1
    spots, rule = spots[odd == 0], rule[odd == 0]
    used = np.bincount(rule, minlength=len(pairs)) >= 2  # a rule used once saves nothing
    keep = used[rule]
    spots, rule = spots[keep], (np.cumsum(used) - 1)[rule[keep]]
    if not len(spots):
        return None
    out = seq.copy()
    out[spots] = base + rule
    flags = last.copy()
    flags[spots] = last[spots + 1]
    frequent[spots[spots > 0] - 1] = True  # a new pair starts before a replaced one too
    stay = np.ones(len(seq), dtype=bool)
    stay[spots + 1] = False
    return out[stay], flags[stay], frequent[stay], sides[used]


def compress(doc_ids: list[int | None], docs: list[np.ndarray], rounds: int | None = None, least: int = LEAST) -> bytes:
    """The bytes of one shard; no document may be empty (each has at least its end id).

    Without ``rounds`` it goes on until no pair can be replaced.
    """
    lengths = np.array([len(d) for d in docs], dtype=np.int64)
    ids = np.concatenate(docs).astype(np.uint32) if docs else np.empty(0, np.uint32)
    last = np.zeros(len(ids), dtype=bool)
    last[np.cumsum(lengths) - 1] = True
    first_rule = int(ids.max()) + 1 if len(ids) else 0
    seq, sides = ids, [np.empty((0, 2), np.uint32)]
    live, symbols = np.ones(len(seq), dtype=bool), first_rule
    while len(sides) - 1 != rounds and len(seq) > 1 and (found := _round(seq, last, live, symbols, least)) is not None:
        seq, last, live, new = found
        sides.append(new)
        symbols += len(new)
    rules = np.concatenate(sides)
    expands = np.ones(first_rule + len(rules), dtype=np.int64)
    at = 0
    for level in sides:  # a level's sides are ids or rules of earlier levels
        span = expands[level[:, 0]] + expands[level[:, 1]]
        expands[first_rule + at:first_rule + at + len(level)] = span
        at += len(level)
    ends = np.flatnonzero(last) + 1
    first_symbol = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
    first_id = np.cumsum(lengths) - lengths
    wide = np.uint32 if first_rule + len(rules) > 0xFFFF else np.uint16
    head = np.array([len(docs), len(ids), len(rules), len(seq), first_rule, np.dtype(wide).itemsize,
                     np.dtype(wide).itemsize], dtype="<u8")
    parts = [np.array([0 if i is None else i for i in doc_ids], "<i8"), np.array([i is None for i in doc_ids], "u1"),
             first_symbol.astype("<u8"), first_id.astype("<u8"), rules.astype(np.dtype(wide).newbyteorder("<")),
             expands[first_rule:].astype("<u4"), seq.astype(np.dtype(wide).newbyteorder("<"))]
    return MAGIC + head.tobytes() + b"".join(p.tobytes() for p in parts)


class Shard:
    """A shard's arrays, read in place from its bytes."""

    def __init__(self, data: bytes):
        if data[:4] != MAGIC:
            raise ValueError("not a shard of this format")
        docs, self.n_ids, rules, symbols, self.first_rule, wide, side = (int(x) for x in np.frombuffer(data, "<u8", 7, 4))
        at = 4 + 56

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(data, kind, n, at)
            at += out.nbytes
            return out

        self.ids_of, null = take("<i8", docs), take("u1", docs)
        self.doc_ids = [None if z else int(i) for i, z in zip(self.ids_of, null)]
        self.first_symbol, self.first_id = take("<u8", docs).astype(np.int64), take("<u8", docs).astype(np.int64)
        self.rules = take(f"<u{side}", 2 * rules).reshape(-1, 2)
        self.expands = take("<u4", rules)
        self.seq = take(f"<u{wide}", symbols)
        self._expanded = None
        self.lengths = np.diff(np.append(self.first_id, self.n_ids))

    def _table(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Every symbol's expansion, end to end: (ids, start of each symbol, length of each symbol)."""
        if self._expanded is None:
            span = np.concatenate([np.ones(self.first_rule, np.int64), self.expands])
            start = np.cumsum(span) - span
            flat = np.arange(self.first_rule + int(self.expands.sum()), dtype=np.uint32)
            for k, (left, right) in enumerate(self.rules.tolist(), self.first_rule):  # sides precede their rule
                at, cut = int(start[k]), int(start[k] + span[left])
                flat[at:cut] = flat[start[left]:start[left] + span[left]]
                flat[cut:cut + span[right]] = flat[start[right]:start[right] + span[right]]
            self._expanded = flat, start.astype(np.int32), span.astype(np.int32)
        return self._expanded

    def _span(self, seq: np.ndarray) -> np.ndarray:
        """How many ids each symbol stands for."""
        return self._table()[2][seq].astype(np.int64)

    def _expand(self, seq: np.ndarray) -> np.ndarray:
        flat, start, span = self._table()
        n = span[seq]
        ends = np.cumsum(n, dtype=np.int64)
        place = np.repeat(start[seq] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)
        return flat[place]

    def ids(self, start: int, stop: int) -> np.ndarray:
        """Ids ``start`` to ``stop`` of the shard; only the symbols that cover them are expanded."""
        k = int(np.searchsorted(self.first_id, start, side="right")) - 1
        z = int(np.searchsorted(self.first_id, stop, side="left"))
        symbols = self.seq[self.first_symbol[k]:self.first_symbol[z] if z < len(self.first_symbol) else len(self.seq)]
        begin = self.first_id[k] + np.cumsum(span := self._span(symbols)) - span
        lo = int(np.searchsorted(begin, start, side="right")) - 1
        hi = int(np.searchsorted(begin, stop, side="left"))
        return self._expand(symbols[lo:hi])[start - begin[lo]:][:stop - start]

    def document(self, k: int) -> np.ndarray:
        return self.ids(int(self.first_id[k]), int(self.first_id[k] + self.lengths[k]))

    def all_ids(self) -> np.ndarray:
        return self._expand(self.seq)


def write_shards(docs: DataFrame, path: str, shard_ids: int = SHARD_IDS, json_path: str | None = None) -> None:
    """Tokenize, order by doc_id and write the shard files to ``path``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, shard = TaskContext.get().partitionId(), 0
        ids: list[int | None] = []
        rows: list[np.ndarray] = []
        held = 0

        def batch():
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([shard], pa.int32()), pa.array([len(rows)], pa.int64()),
                 pa.array([held], pa.int64()), pa.array([compress(ids, rows)], pa.large_binary())],
                ["part", "shard", "n_docs", "n_ids", "data"])

        for b in batches:
            for doc_id, row in zip(b.column(0).to_pylist(), tokens.encode(b.column(1).to_pylist(), json_path)):
                ids.append(doc_id)
                rows.append(np.append(row, np.uint32(END_ID)))
                held += len(rows[-1])
                if held >= shard_ids:
                    yield batch()
                    ids, rows, held, shard = [], [], 0, shard + 1
        if rows:
            yield batch()

    spark = docs.sparkSession
    ordered = id_and_text(docs).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    use_large = spark.conf.get("spark.sql.execution.arrow.useLargeVarTypes")
    spark.conf.set("spark.sql.execution.arrow.useLargeVarTypes", "true")
    try:
        ordered.mapInArrow(run, "part int, shard int, n_docs long, n_ids long, data binary").write.mode(
            "overwrite").parquet(path)
    finally:
        spark.conf.set("spark.sql.execution.arrow.useLargeVarTypes", use_large)


def read_shards(spark, path: str) -> DataFrame:
    return spark.read.schema("part int, shard int, n_docs long, n_ids long, data binary").parquet(path)


def shard_starts(shards: DataFrame) -> DataFrame:
    """part, shard, shard_start: ids of all shards before it. One row per partition meets in one task, no more."""
    sizes = shards.select("part", "shard", "n_ids")
    inside = F.sum("n_ids").over(Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    parts = sizes.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = parts.select("part", F.sum("n").over(
        Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)).alias("before"))
    return sizes.withColumn("inside", inside).join(before, "part").select(
        "part", "shard", (F.coalesce("inside", F.lit(0)) + F.coalesce("before", F.lit(0))).alias("shard_start"))


def documents_of(shards: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the decoded shards."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                shard = Shard(b.column(2)[k].as_py())
                raw = memoryview(shard.all_ids().astype("<u4").tobytes())
                ends = np.append(shard.first_id, shard.n_ids) * 4
                crc = [zlib.crc32(raw[a:z]) for a, z in zip(ends[:-1].tolist(), ends[1:].tolist())]
                n = len(crc)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([b.column(i)[k].as_py()] * n, pa.int32()) for i in (0, 1)]
                    + [pa.array(shard.doc_ids, pa.int64()), pa.array(shard.first_id), pa.array(shard.lengths),
                       pa.array(crc, pa.int64())], ["part", "shard", "doc_id", "at", "n_tokens", "ids_crc32"])

    rows = shards.select("part", "shard", "data").mapInArrow(
        run, "part int, shard int, doc_id long, at long, n_tokens long, ids_crc32 long")
    return rows.join(shard_starts(shards), ["part", "shard"]).select(
        "doc_id", (F.col("shard_start") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def query(spark, sf_dir: str) -> DataFrame:
    path = shared_folder(spark, "repair-shards")
    write_shards(spark.read.parquet(f"{sf_dir}/documents.parquet"), path)
    return documents_of(read_shards(spark, path))
