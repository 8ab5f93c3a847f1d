"""Best-fit packing of documents into token sequences.

Documents become pieces of at most ``capacity`` tokens (ids of the byte-level
BPE vocabulary, then the end id). Only longer documents are cut, into pieces
of ``capacity``; what is left over comes first. Which piece lengths share a
sequence is decided on the length histogram alone, whose size is bounded by the
capacity whatever the number of documents:

1. the configuration linear program over the histogram is solved by
   multiplicative weights: a length's weight falls with its coverage, and a
   knapsack dynamic program over the weights prices the configurations (for
   each length, the best one that holds it) which are then taken in part;
2. the solution is rounded down, the lengths that remain are solved again in
   whole steps, and the last few are placed best-fit into the fullest sequence
   that takes them.

The driver holds the histogram and the configurations (bounded); pieces find
their places in parallel: a piece's rank among those of its length, which is
the number of such pieces in earlier partitions plus its rank in its own,
points into the slot table of that length. No length is gathered in one task,
so a length that a third of all pieces have does no harm.

Null text is empty and gives one piece with the end id alone. Repeated rows
are packed as often as they occur; a null doc_id stays null; other columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from airseries.llm import tokens
from airseries.llm.common import id_and_text, written

END_ID = 0
Pattern = tuple[tuple[int, int], ...]  # (length, how often), longest first


# --- the configuration program (driver, on the histogram) ---------------------

def _price(weight: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Knapsack by dynamic programming: best value of each room, and the length to take (0: leave a unit)."""
    best, pick = np.zeros(capacity + 1), np.zeros(capacity + 1, dtype=np.int64)
    lengths = np.flatnonzero(weight > 0)
    values = weight[lengths]
    upto = np.searchsorted(lengths, np.arange(capacity + 1), side="right")
    for room in range(1, capacity + 1):
        best[room] = best[room - 1]
        if k := upto[room]:
            value = values[:k] + best[room - lengths[:k]]
            j = int(value.argmax())
            if value[j] > best[room] + 1e-15:
                best[room], pick[room] = value[j], lengths[j]
    return best, pick


def _configuration(pick: np.ndarray, room: int, first: int) -> dict[int, int]:
    """The best configuration that holds ``first`` beside ``room`` more tokens."""
    out = {first: 1}
    while room > 0:
        taken = int(pick[room])
        if taken:
            out[taken] = out.get(taken, 0) + 1
        room -= taken or 1
    return out


def solve_fractional(counts: np.ndarray, capacity: int, step: float, eta: float = 1.0,
                     rounds: int = 100) -> Counter[Pattern]:
    """Multiplicative weights: how often to take each configuration, in fractions.

    No length is covered more often than it occurs. ``step`` bounds the share of a
    length's pieces that one configuration may cover at once; ``eta`` is the learning rate.
    """
    total = counts.astype(float)
    left, covered = total.copy(), np.zeros(len(total))
    lengths = np.arange(len(total))
    taken: Counter[Pattern] = Counter()
    for _ in range(rounds):
        open_ = left > 1e-9
        if not open_.any():
            break
        _, pick = _price(np.where(open_, lengths * np.exp(-eta * covered), 0.0), capacity)
        before = left.sum()
        for length in np.flatnonzero(open_)[::-1].tolist():
            if left[length] <= 0:
                continue
            config = _configuration(pick, capacity - length, length)
            ks = np.fromiter(config, dtype=np.int64)
            times = np.fromiter(config.values(), dtype=float)
            amount = float((np.minimum(left[ks], step * total[ks]) / times).min())
            if amount > 0:
                taken[tuple(sorted(config.items(), reverse=True))] += amount
                left[ks] -= amount * times
                covered[ks] += amount * times / total[ks]
        if before - left.sum() < 1e-9:
            break
    return taken


def _place_best_fit(counts: np.ndarray, capacity: int) -> Counter[Pattern]:
    """Best-fit decreasing on the histogram; sequences alike are one entry with a count."""
    by_room: list[dict[Pattern, int]] = [{} for _ in range(capacity + 1)]

    def put(pattern: dict[int, int], n: int) -> None:
        room = capacity - sum(k * m for k, m in pattern.items())
        key = tuple(sorted(pattern.items(), reverse=True))
        by_room[room][key] = by_room[room].get(key, 0) + n

    for length in range(capacity, 0, -1):
        left = int(counts[length])
        while left:
            room = next((r for r in range(length, capacity) if by_room[r]), None)
            if room is None:
                each = capacity // length
                if left >= each:
                    put({length: each}, left // each)
                if left % each:
                    put({length: left % each}, 1)
                break
            key, n = by_room[room].popitem()
            each = room // length
            whole, rest = (n, 0) if left >= n * each else divmod(left, each)
            old = dict(key)
            for m, times in ((each, whole), (rest, 1 if rest else 0)):
                if times:
                    put(old | {length: old.get(length, 0) + m}, times)
            if n - whole - (1 if rest else 0):
                put(old, n - whole - (1 if rest else 0))
            left -= whole * each + rest
    out: Counter[Pattern] = Counter()
    for patterns in by_room:
        out.update(patterns)
    return out


def solve(counts: np.ndarray, capacity: int) -> Counter[Pattern]:
    """Whole numbers of each configuration that hold every piece exactly once.

    ``counts[l]`` is the number of pieces of length ``l``. Two learning rates are
    tried and the packing with fewer sequences is taken.
    """
    best: Counter[Pattern] | None = None
    counts = counts.astype(np.int64)
    for eta in (1.0, 0.5):
        left, plan = counts.copy(), Counter()
        plan_full = {((capacity, 1),): int(left[capacity])} if left[capacity] else {}
        plan.update(plan_full)
        left[capacity] = 0
        for step in (0.5, 1.0):
            for config, amount in solve_fractional(left, capacity, step, eta).most_common():
                if whole := int(amount + 1e-6):
                    plan[config] += whole
                    for length, m in config:
                        left[length] -= whole * m
        plan.update(_place_best_fit(left, capacity))
        if best is None or sum(plan.values()) < sum(best.values()):
            best = plan
        if sum(best.values()) * capacity - int((counts * np.arange(capacity + 1)).sum()) < capacity:
            break  # fewer sequences cannot hold the tokens
    return best


def least_sequences(counts: np.ndarray, capacity: int, rounds: int = 200, step: float = 0.2) -> int:
    """A number of sequences that no packing can go below (0 without pieces).

    It is the dual of the configuration program: if no configuration weighs more than 1, the
    weights of all pieces together are a bound, whatever the weights. Tried are the lengths
    themselves with those over ``capacity - a`` rounded up to a sequence and those under ``a``
    left out, for every ``a``, and then multiplicative steps from the best of these: the
    knapsack program finds the heaviest configuration, which scales the weights, and the
    lengths it covers lose weight.
    """
    total = counts.astype(float)
    total[0] = 0.0
    if not total.any():
        return 0
    lengths = np.arange(capacity + 1)

    def cut(a: int) -> np.ndarray:
        return np.where(lengths > capacity - a, 1.0, np.where(lengths >= a, lengths / capacity, 0.0))

    bounds = [float(total @ cut(a)) for a in range(capacity // 2 + 1)]
    bound, weight = max(bounds), cut(int(np.argmax(bounds)))
    weight = np.where(total > 0, np.maximum(weight, lengths / capacity / 2), 0.0)
    for _ in range(rounds):
        weight /= weight.max()
        best, pick = _price(weight, capacity)
        bound = max(bound, float(total @ weight) / best[capacity])
        config = _configuration(pick, capacity, 0)
        ks = np.array([k for k in config if k], dtype=np.int64)
        share = np.array([config[k] for k in ks]) / total[ks]
        weight[ks] *= np.exp(-step * share / share.max())
    return int(np.ceil(bound * (1 - 1e-9) - 1e-6))  # rounding errors must not raise it


def slot_table(plan: Counter[Pattern], capacity: int) -> dict[str, np.ndarray]:
    """Where the slots of each length lie, ordered by length, as parallel arrays.

    ``first[l]`` is the number of slots of shorter lengths; slot ``first[l] + rank``
    belongs to the entry that a search in ``lo`` finds.
    """
    rows, base = [], 0
    for config, times in sorted(plan.items(), reverse=True):
        offset = 0
        for length, m in config:
            rows.append((length, base, m, offset, m * times))
            offset += length * m
        base += times
    rows.sort(key=lambda r: (r[0], r[1]))
    cols = np.array(rows, dtype=np.int64).reshape(-1, 5)
    lo = np.concatenate([[0], np.cumsum(cols[:, 4])])[:len(cols)]
    slots = np.bincount(cols[:, 0], weights=cols[:, 4], minlength=capacity + 1).astype(np.int64)
    return {"lo": lo, "length": cols[:, 0], "base": cols[:, 1], "each": cols[:, 2], "offset": cols[:, 3],
            "first": np.concatenate([[0], np.cumsum(slots)])[:capacity + 1]}


# --- pieces and their places (executors) ----------------------------------------

def token_pieces(docs: DataFrame, capacity: int, json_path: str | None = None,
                 with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, part, nth: ``nth`` counts the pieces of one length in a partition."""
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, nth long"
    if with_ids:
        schema += ", ids binary"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, dtype=np.int64)
        for batch in batches:
            rows = []
            encoded = tokens.encode(batch.column(1).to_pylist(), json_path)
            for doc_id, ids in zip(batch.column(0).to_pylist(), encoded):
                ids = np.append(ids, np.uint32(END_ID)).astype("<u4")
                at, end = 0, len(ids) % capacity or capacity
                piece = 0
                while at < len(ids):
                    raw = ids[at:end].tobytes()
                    row = (doc_id, piece, at, end - at, zlib.crc32(raw), part, int(seen[end - at]))
                    rows.append(row + ((raw,) if with_ids else ()))
                    seen[end - at] += 1
                    piece, at, end = piece + 1, end, end + capacity
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth"] + ["ids"] * with_ids
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()] + [pa.binary()] * with_ids
            cols = list(zip(*rows)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names)

    return id_and_text(docs).mapInArrow(cut, schema)


def pack(pieces: DataFrame, capacity: int) -> DataFrame:
    """Add sequence_id and offset to pieces that have part, nth and length columns.

    ``pieces`` must be a written table, as it is read more than once.
    """
    spark = pieces.sparkSession
    counted = written(pieces.groupBy("part", "length").agg(F.count("*").alias("n")), "pack-counts")
    # At most `capacity` rows reach the driver.
    histogram = counted.groupBy("length").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(capacity + 1, dtype=np.int64)
    for row in histogram:
        counts[row["length"]] = row["n"]
    # The slot table has under 100 rows for each of a few thousand configurations.
    table = spark.sparkContext.broadcast(slot_table(solve(counts, capacity), capacity))

    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = counted.select("part", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        t = table.value
        slot = t["first"][length.to_numpy()] + rank.to_numpy()
        entry = np.searchsorted(t["lo"], slot, side="right") - 1
        nth = slot - t["lo"][entry]
        each = t["each"][entry]
        return pd.DataFrame({"sequence_id": t["base"][entry] + nth // each,
                             "offset": t["offset"][entry] + nth % each * t["length"][entry]})

    ranked = pieces.join(before, ["part", "length"]).withColumn("place", place("length", F.col("nth") + F.col("before")))
    keep = [c for c in pieces.columns if c not in ("part", "nth")]
    return ranked.select(*keep, "place.sequence_id", "place.offset")


def pack_documents(docs: DataFrame, capacity: int = 2048, json_path: str | None = None,
                   with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, (ids,) sequence_id, offset."""
    return pack(written(token_pieces(docs, capacity, json_path, with_ids), "pack-pieces"), capacity)


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id, n_tokens and the sequence's little-endian uint32 ids (from ``with_ids=True`` pieces)."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))  # at most `capacity` ids
    return packed.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), parts.alias("parts")).select(
        "sequence_id", "n_tokens",
        F.aggregate("parts", F.unhex(F.lit("")), lambda acc, p: F.concat(acc, p["ids"])).alias("ids"))


def query(spark, sf_dir: str) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
