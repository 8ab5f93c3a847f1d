"""Sharding by histogram sort: exact counts below candidate boundaries, then one exchange.

Rows are ordered by a key and cut into shards of nearly equal bytes. A round counts, on
all partitions at once, the bytes and rows below candidate key boundaries; a splitter whose
best candidate is within the tolerance of its target is settled, and the interval that
holds any other target gets closer candidates in the next round. Only counts travel
(``PROBES`` intervals a round at most, whatever the input). When all splitters are settled
the rows move once, each to its part, and are numbered there.

A key is a list of columns of 32-bit range compared one after the other, and its last ones
number the rows of the written table, so that keys are distinct: a third of all rows may
share an id, a text or the whole row and is still cut in between. Boundaries form
a tree: a node cuts one key column into equal steps, and a step that holds an unsettled
target is a node of the next level. Rows find their place by array look-ups on literals.

Defined results: a null text has no bytes (crc32 0); null ids come first; repeated rows
are rows of their own; a row larger than a shard fills one of its own, next to which shards
may stay empty; an empty table gives an empty result; other columns, whatever
their names, are ignored. Everything here is DataFrame functions.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from airseries.llm.common import written

SHARDS = 40
#: Bytes that a row counts besides its text.
ROW_BYTES = 16
#: Intervals counted in one round, over all open splitters.
PROBES = 1 << 14
#: Distance of a settled splitter from its target, as a share of a shard's bytes.
TOLERANCE = 1e-3
#: Rows that one task numbers, and parts of a shard.
PART_ROWS, LEAST_PARTS, MOST_PARTS = 500_000, 4, 64
#: Whole rows of a shard that one task writes.
FILE_ROWS = 50_000
_KEY = "__key"


@dataclass
class _Node:
    """One key column cut into equal steps from ``lo`` on; ``rows`` and ``weight`` lie before it."""

    column: int
    lo: int
    step: int
    steps: int
    rows: int
    weight: int
    #: bucket -> (rows before it, node of the next level or None)
    buckets: dict[int, tuple[int, int | None]] = field(default_factory=dict)


@dataclass
class Splitters:
    """The boundaries found: ``cuts`` are row positions, ``weights`` the bytes before them."""

    levels: list[list[_Node]]
    cuts: list[int]
    weights: list[int]
    rows: int
    weight: int


def key_columns(*longs: Column) -> list[Column]:
    """Long columns as pairs of 32-bit ones in the same order."""
    return [half for c in longs
            for half in (F.shiftright(c, 32), c.bitwiseAND(F.lit(0xFFFFFFFF).cast("long")))]


def _literal(values: Sequence[int]) -> Column:
    """A literal array of longs (one text literal, folded to an array by the optimizer)."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<long>")


def _walk(rows: DataFrame, levels: list[list[_Node]], leaf) -> DataFrame:
    """Adds ``at``: the node of the last level (0 or more) that a row is in, or -1 - leaf(...) outside of it."""
    out = rows.withColumn("at", F.lit(0).cast("long"))
    for depth, nodes in enumerate(levels):
        table, base = [], []
        for node in nodes:
            base.append(len(table))
            table += [leaf(node, b) if b not in node.buckets or node.buckets[b][1] is None else node.buckets[b][1]
                      for b in range(node.steps)]
        column, lo, step, start = (F.get(_literal(x), F.col("at").cast("int"))
                                   for x in ([n.column for n in nodes], [n.lo for n in nodes],
                                             [n.step for n in nodes], base))
        out = out.withColumn("cut", F.when(F.col("at") >= 0, F.struct(
            F.get(F.col(_KEY), column.cast("int")).alias("k"), lo.alias("lo"), step.alias("step"), start.alias("start"))))
        bucket = F.expr("cast(cut.start + (cut.k - cut.lo) div cut.step as int)")
        out = out.withColumn("at", F.when(F.col("at") < 0, F.col("at")).otherwise(F.get(_literal(table), bucket)))
    return out.drop("cut")


def _count(rows: DataFrame, levels: list[list[_Node]], weight: str, width: int) -> dict:
    """Exact bytes, rows and key ranges of every interval of the last level; nothing else reaches the driver."""
    *above, last = levels
    walked = _walk(rows, above, lambda node, b: -1).where("at >= 0")
    column, lo, step = (F.get(_literal(x), F.col("at").cast("int"))
                        for x in ([n.column for n in last], [n.lo for n in last], [n.step for n in last]))
    walked = walked.withColumn("cut", F.struct(F.get(F.col(_KEY), column.cast("int")).alias("k"),
                                               lo.alias("lo"), step.alias("step")))
    ends = [f(F.get(F.col(_KEY), i)) for i in range(width) for f in (F.min, F.max)]
    counted = walked.groupBy("at", F.expr("(cut.k - cut.lo) div cut.step").alias("bucket")).agg(
        F.sum(weight).alias("weight"), F.count("*").alias("rows"), F.array(*ends).alias("ends"))
    found: dict[int, dict[int, tuple]] = {}
    for r in counted.collect():
        found.setdefault(r["at"], {})[r["bucket"]] = (r["weight"], r["rows"], r["ends"])
    return found


def _node(ends: Sequence[int], probes: int, rows: int, weight: int) -> _Node:
    """Equal steps over the first key column that is not the same in all rows."""
    column = next((i for i in range(len(ends) // 2) if ends[2 * i] < ends[2 * i + 1]), 0)
    lo, span = ends[2 * column], ends[2 * column + 1] - ends[2 * column] + 1
    step = -(-span // max(2, probes))
    return _Node(column, lo, step, -(-span // step), rows, weight)


def splitters(rows: DataFrame, weight: str, parts: int, width: int, tolerance: float = TOLERANCE,
              every: int = 1, probes: int = PROBES) -> Splitters:
    """Boundaries that cut ``rows`` (array column ``__key`` of ``width`` longs) into ``parts`` of equal weight.

    Each ``every``-th boundary is a shard's; ``tolerance`` is a share of a shard's weight, and a boundary is off by
    half of it at most, except that a target inside a single row takes the nearer side of that row.
    """
    ends = [f(F.get(F.col(_KEY), i)) for i in range(width) for f in (F.min, F.max)]
    whole = rows.agg(F.count("*").alias("rows"), F.sum(weight).alias("weight"), F.array(*ends).alias("ends")).first()
    if not whole["rows"]:
        return Splitters([], [], [], 0, 0)
    total = whole["weight"]
    slack = tolerance * total / parts * every / 2
    targets = {i: total * (i + 1) // parts for i in range(parts - 1)}
    cuts: dict[int, tuple[int, int]] = {}
    levels = [[_node(whole["ends"], probes, 0, 0)]]
    open_at = [list(targets)]  # targets of each node of the last level
    while True:
        found = _count(rows, levels, weight, width)
        below: list[tuple[_Node, list[int]]] = []
        for n, node in enumerate(levels[-1]):
            seen_rows, seen = node.rows, node.weight
            waiting = sorted(open_at[n])
            for b, (w, r, e) in sorted(found.get(n, {}).items()):
                inside = []
                while waiting and targets[waiting[0]] <= seen + w:
                    i = waiting.pop(0)
                    near_lo = targets[i] - seen <= seen + w - targets[i]
                    gap = min(targets[i] - seen, seen + w - targets[i])
                    if gap <= slack or r == 1 or e[::2] == e[1::2]:
                        cuts[i] = (seen_rows, seen) if near_lo else (seen_rows + r, seen + w)
                    else:
                        inside.append(i)
                if inside:
                    below.append((_Node(0, 0, 1, 1, seen_rows, seen), inside, e))
                node.buckets[b] = (seen_rows, len(below) - 1 if inside else None)
                seen_rows, seen = seen_rows + r, seen + w
            for i in waiting:  # the last row's end
                cuts[i] = (seen_rows, seen)
        if not below:
            break
        share = probes // sum(len(inside) for _, inside, _ in below)
        levels.append([_node(e, share * len(inside), at.rows, at.weight) for at, inside, e in below])
        open_at = [inside for _, inside, _ in below]
    ordered = [cuts[i] for i in range(parts - 1)]
    return Splitters(levels, [c for c, _ in ordered], [w for _, w in ordered], whole["rows"], total)


def numbered(spark: SparkSession, rows: DataFrame, name: str = "keyed") -> DataFrame:
    """``rows`` written to the shared folder with a number for each row, which makes keys distinct for good."""
    return written(rows.withColumn("row_number", F.monotonically_increasing_id()), f"shards-{name}")


def shard_rows(rows: DataFrame, key: list[Column], weight: str, shards: int = SHARDS,
               tolerance: float = TOLERANCE, probes: int = PROBES) -> DataFrame:
    """``rows`` with ``shard`` and ``slot`` (gapless from 0, in key order), shards of nearly equal ``weight``.

    ``rows`` is a written table of narrow rows; ``key`` are columns of 32-bit range that together tell rows apart.
    """
    keyed = rows.withColumn(_KEY, F.array(*(c.cast("long") for c in key)))
    n = rows.count()
    each = min(MOST_PARTS, max(LEAST_PARTS, -(-n // (PART_ROWS * shards))))
    found = splitters(keyed, weight, shards * each, len(key), tolerance, each, probes)
    if not found.rows:
        return rows.withColumn("shard", F.lit(0)).withColumn("slot", F.lit(0).cast("long"))

    def leaf(node: _Node, bucket: int) -> int:
        return -1 - bisect_right(found.cuts, node.buckets.get(bucket, (0, None))[0])

    starts = [0, *found.cuts]  # rows before each part
    shard_starts = [starts[p - p % each] for p in range(shards * each)]
    placed = _walk(keyed, found.levels, leaf).withColumn("part", (-1 - F.col("at")).cast("int"))
    # The one exchange of rows: each part is sorted where it lands, and its exact start is known.
    order = Window.partitionBy("part").orderBy(_KEY)
    first = F.get(_literal([a - b for a, b in zip(starts, shard_starts)]), F.col("part"))
    return placed.withColumn("shard", F.floor(F.col("part") / each).cast("int")).withColumn(
        "slot", first + F.row_number().over(order) - 1).drop(_KEY, "at", "part")


def document_key() -> list[Column]:
    """Order of documents: null ids, then ids; of one id smaller texts, then the row's number."""
    return [F.col("doc_id").isNotNull().cast("long"), *key_columns(F.coalesce("doc_id", F.lit(0).cast("long"))),
            F.col("size"), F.col("text_crc32"), *key_columns(F.col("row_number"))]


def shard_documents(docs: DataFrame, shards: int = SHARDS, tolerance: float = TOLERANCE, id_col: str = "doc_id",
                    text_col: str = "text", probes: int = PROBES) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot of every document; the texts are read once."""
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    narrow = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"),
                         (F.octet_length(text) + ROW_BYTES).cast("long").alias("size"),
                         F.crc32(text.cast("binary")).alias("text_crc32"))
    rows = numbered(docs.sparkSession, narrow, "documents")
    return shard_rows(rows, document_key(), "size", shards, tolerance, probes).drop("row_number")


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, id_col: str = "doc_id",
                 text_col: str = "text") -> None:
    """Whole rows (column ``row``) with their slot, one folder per shard, in files of sorted slot ranges.

    The rows are written once with their numbers, so that each finds its place again whatever it holds.
    """
    tagged = numbered(docs.sparkSession, docs.select(F.struct("*").alias("row")), "whole")
    text = F.coalesce(F.col("row").getField(text_col).cast("string"), F.lit(""))
    rows = written(tagged.select(
        "row_number", F.col("row").getField(id_col).cast("long").alias("doc_id"),
        (F.octet_length(text) + ROW_BYTES).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32")), "shards-narrow")
    placed = shard_rows(rows, document_key(), "size", shards).select("row_number", "shard", "slot")
    whole = tagged.join(placed, "row_number").drop("row_number")
    spread = whole.repartition("shard", F.floor(F.col("slot") / FILE_ROWS)).sortWithinPartitions("shard", "slot")
    spread.write.mode("overwrite").partitionBy("shard").parquet(path)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = shard_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                         F.lit(None).cast("int").alias("grown_shard"))
