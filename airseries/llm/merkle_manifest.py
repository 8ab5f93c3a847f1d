"""Merkle manifest of a dataset whose proofs come from a butterfly exchange.

Every row is a leaf. Per group the leaves stand in order, and runs of ``fanout`` nodes become
their hash until one node, the group's root, remains; group roots in order give the dataset's root alike.

Leaves are dealt into partitions of ``fanout ** BLOCK_LEVELS`` neighbours, aligned to the tree, and each
partition hashes its own subtree. Then partitions exchange roots: in round r those whose
numbers agree but for their digit r (in base ``fanout``) form a group and send each other
the subtree root they hold; each hashes the common ancestor itself, so that after
the last round every partition holds the root and the siblings on its way to it, and no second
pass goes down the tree. A partition receives ``fanout - 1`` digests a round, whatever the input. Where
the last subtree of a round is incomplete, its members send to the partners of the missing ones in
turn. The rounds are one chain of shuffles over one small row per partition; the leaves
move by themselves, twice.

Defined results: a field is ``-`` if null, else its UTF-8 byte count, ``:`` and its text. Leaves of a group are
ordered by id (null first), then by their hash; rows alike in all fields are leaves of their own
side by side. The group of null comes first, then groups by their UTF-8 bytes. A group of one leaf has that leaf as its
root, and a proof without siblings is the hash of an empty text. An empty table gives an empty result. Other
columns, whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from airseries.llm.common import written

FANOUT = 2
#: Levels of the tree inside one partition of leaves.
BLOCK_LEVELS = 10
#: Rows of one range when leaves are ranked.
RANK_ROWS = 1_000_000
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
TAMPER_EVERY = 7
_STEPS = "array<struct<place:int,others:array<string>>>"


def sha256_hex(data: bytes | str) -> str:
    return hashlib.sha256(data.encode() if isinstance(data, str) else data).hexdigest()


def field(c: Column) -> Column:
    """``-`` if null, else byte count, ``:`` and text."""
    text = c.cast("string")
    return F.when(c.isNull(), F.lit("-")).otherwise(
        F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_hash(columns: list[Column]) -> Column:
    return F.sha2(F.concat(*(field(c) for c in columns)).cast("binary"), 256)


def ordered_text(c: Column) -> Column:
    """A text that sorts null first and then by bytes, and is never null."""
    return F.when(c.isNull(), F.lit("")).otherwise(F.concat(F.lit("="), c.cast("string")))


# --- ranks ------------------------------------------------------------------------

def ranked(rows: DataFrame, group: str, order: list, name: str, count: int | None = None) -> DataFrame:
    """``rows`` (a written table) with ``at`` (0, 1, ... in its group) and ``n`` (rows of the group).

    Sorted ranges are numbered where they lie and shifted by counts of the ranges before, so that no
    group meets in one task. The last order column should tell equal rows apart.
    """
    spark = rows.sparkSession
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranges = max(least, -(-(rows.count() if count is None else count) // RANK_ROWS))
    dealt = rows.repartitionByRange(ranges, group, *order).sortWithinPartitions(group, *order)
    dealt = written(dealt.withColumn("__id", F.monotonically_increasing_id()), f"merkle-ranked-{name}")
    dealt = dealt.withColumn("__range", F.shiftright("__id", 33))
    # One row for each range and group in it; a group's rows of a range follow each other.
    ends = dealt.groupBy(group, "__range").agg(F.count("*").alias("__rows"), F.min("__id").alias("__first"))
    before = Window.partitionBy(group).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select(group, "__range", "__first", F.coalesce(F.sum("__rows").over(before), F.lit(0)).alias("__before"),
                       F.sum("__rows").over(Window.partitionBy(group)).alias("n"))
    return dealt.join(ends, [group, "__range"]).withColumn("at", F.col("__before") + F.col("__id") - F.col("__first")) \
        .drop("__id", "__range", "__first", "__before")


# --- subtrees ---------------------------------------------------------------------

def _levels(digests: list[str], fanout: int, height: int | None) -> list[list[str]]:
    """All levels from the leaves up; to one node, or to ``height`` levels above the leaves."""
    levels = [digests]
    while len(levels[-1]) > 1 if height is None else len(levels) <= height:
        last = levels[-1]
        levels.append([sha256_hex("".join(last[i:i + fanout])) for i in range(0, len(last), fanout)])
    return levels


def _block_height(leaves_of_group: int, fanout: int, levels: int) -> int | None:
    """A lone partition stops at its root; others go on to a node of the common level."""
    return levels if leaves_of_group > fanout ** levels else None


def subtree_roots(leaves: DataFrame, fanout: int, levels: int) -> DataFrame:
    """grp, at, n, digest: one row per partition of leaves (``grp``, ``block``, ``at``, ``n``, ``leaf``)."""

    def root(key, table):
        rows = sorted(zip(table["at"].to_pylist(), table["leaf"].to_pylist()))
        n = table["n"][0].as_py()
        top = _levels([d for _, d in rows], fanout, _block_height(n, fanout, levels))[-1][0]
        return pa.table({"grp": [key[0].as_py()], "at": [key[1].as_py()], "n": [-(-n // fanout ** levels)], "digest": [top]})

    return leaves.select("grp", "block", "at", "n", "leaf").groupBy("grp", "block").applyInArrow(
        root, "grp string, at long, n long, digest string")


# --- butterfly exchange -----------------------------------------------------------

def butterfly(nodes: DataFrame, fanout: int, most: int) -> DataFrame:
    """Every node of ``nodes`` (grp, at, n, digest) with the digest of its group's root and its ``steps`` to it.

    ``most`` is the largest ``n``. A step is the place in a run and the others of the run, in order.
    """
    state = nodes.select("grp", "at", "n", "digest", F.array().cast(_STEPS).alias("steps"))
    size = 1
    while size < most:
        # A node's subtree has number `sub` and `size` members, the last one fewer; it holds the same digest in all of them.
        # What a node keeps and what it sends come from one pass over the state, so that the plan grows by one shuffle a round.
        state = state.withColumn("sub", F.expr(f"at div {size}")).withColumn("subs", F.expr(f"(n + {size - 1}) div {size}"))
        peers = (f"filter(sequence(sub div {fanout} * {fanout}, least(sub div {fanout} * {fanout} + {fanout - 1}, subs - 1)), "
                 "p -> p != sub)")
        # Members l, l + mine, l + 2 mine, ... of a peer's subtree hear from member l of this one.
        place_in, mine, theirs = f"(at - sub * {size})", f"least({size}, n - sub * {size})", f"least({size}, n - p * {size})"
        heard = (f"if({place_in} < {theirs}, sequence(p * {size} + {place_in}, p * {size} + {theirs} - 1, {mine}), "
                 "cast(array() as array<bigint>))")
        rows = (f"concat(array(struct(at as to, n as n, steps as steps)), transform(flatten(transform({peers}, p -> {heard})), "
                f"d -> struct(d as to, cast(null as bigint) as n, cast(null as {_STEPS}) as steps)))")
        sent = state.select("grp", F.struct(F.expr(f"cast(sub % {fanout} as int)").alias("place"), "digest").alias("member"),
                            F.explode(F.expr(rows)).alias("r"))
        sent = sent.select("grp", F.col("r.to").alias("at"), "member", F.col("r.n").alias("n"), F.col("r.steps").alias("steps"))
        met = sent.groupBy("grp", "at").agg(
            F.max("n").alias("n"), F.first("steps", ignorenulls=True).alias("steps"),
            F.sort_array(F.collect_list("member")).alias("run"))  # `fanout` members at most
        place = F.expr(f"cast(at div {size} % {fanout} as int)")
        others = F.filter("run", lambda m: m["place"] != place)["digest"]
        going = F.col("n") > size
        step = F.array(F.struct(place.alias("place"), others.alias("others"))).cast(_STEPS)
        state = met.select(
            "grp", "at", "n",
            F.when(going, F.sha2(F.array_join(F.col("run")["digest"], "").cast("binary"), 256))
            .otherwise(F.get("run", F.lit(0))["digest"]).alias("digest"),
            F.when(going, F.concat("steps", step)).otherwise(F.col("steps")).alias("steps"))
        size *= fanout
    return state


def _largest(rows: DataFrame) -> int:
    return rows.agg(F.max("n")).first()[0] or 0


def proofs(leaves: DataFrame, fanout: int = FANOUT, block_levels: int = BLOCK_LEVELS) -> DataFrame:
    """grp, at, leaf, subroot, root, steps and the column ``row`` of each row of ``leaves`` (grp, order, leaf, row).

    ``leaves`` is a written table; ``grp`` a text (see :func:`ordered_text`), ``order`` a struct that sorts leaves.
    """
    if fanout < 2:
        raise ValueError("a run needs two nodes or more")
    placed = written(ranked(leaves, "grp", ["order"], "leaves").select("grp", "at", "n", "leaf", "row").withColumn(
        "block", F.expr(f"at div {fanout ** block_levels}")), "merkle-leaves")
    blocks = written(subtree_roots(placed, fanout, block_levels), "merkle-blocks")
    upper = written(butterfly(blocks, fanout, _largest(blocks)), "merkle-upper")
    # Every partition of leaves knows its group's root now; one of each group takes it to the groups' tree.
    tops = written(upper.where("at = 0").select("grp", "digest", F.lit("").alias("whole")), "merkle-groups")
    top_nodes = written(ranked(tops, "whole", ["grp"], "groups").select(F.lit("").alias("whole"), "grp", "at", "n", "digest"),
                        "merkle-group-nodes")
    top = butterfly(top_nodes.select(F.lit("").alias("grp"), "at", "n", "digest"), fanout, _largest(top_nodes))
    top = top_nodes.select("grp", "at").join(top.select("at", F.col("digest").alias("root"), F.col("steps").alias("top_steps")), "at")
    heads = upper.join(top.drop("at"), "grp").select(
        "grp", F.col("at").alias("block"), F.col("digest").alias("subroot"), "root",
        F.concat("steps", "top_steps").alias("steps"))
    heads = written(heads, "merkle-heads")

    def finish(rows: pa.Table, head: pa.Table) -> Iterator[pa.RecordBatch]:
        at, n = rows["at"].to_pylist(), rows["n"][0].as_py()
        order = sorted(range(len(at)), key=at.__getitem__)
        leaf = rows["leaf"].to_pylist()
        levels = _levels([leaf[i] for i in order], fanout, _block_height(n, fanout, block_levels))
        above = head["steps"][0].as_py()
        rows = rows.take(pa.array(order))
        for start in range(0, len(order), 256):
            part = rows.slice(start, 256)
            steps = []
            for i in range(start, start + part.num_rows):
                own = []
                for level in levels[:-1]:
                    run = i - i % fanout
                    own.append({"place": i % fanout, "others": level[run:i] + level[i + 1:run + fanout]})
                    i //= fanout
                steps.append(own + above)
            kind = pa.list_(pa.struct([("place", pa.int32()), ("others", pa.list_(pa.string()))]))
            columns = [part["grp"], part["at"], part["leaf"], part["row"],
                       pa.array([head["subroot"][0].as_py()] * part.num_rows, pa.string()),
                       pa.array([head["root"][0].as_py()] * part.num_rows, pa.string()), pa.array(steps, kind)]
            yield from pa.table(columns, ["grp", "at", "leaf", "row", "subroot", "root", "steps"]).to_batches()

    row_type = placed.schema["row"].dataType.simpleString()
    out = f"grp string, at long, leaf string, row {row_type}, subroot string, root string, steps {_STEPS}"

    def both(rows, head):
        return pa.Table.from_batches(list(finish(rows, head)))

    return placed.groupBy("grp", "block").cogroup(heads.groupBy("grp", "block")).applyInArrow(both, out)


# --- use of proofs ----------------------------------------------------------------

def folded(leaf: Column, steps: Column) -> Column:
    """The root that a leaf and its steps lead to."""

    def up(h: Column, step: Column) -> Column:
        before = F.slice(step["others"], 1, step["place"])
        after = F.slice(step["others"], step["place"] + 1, F.size(step["others"]))
        return F.sha2(F.array_join(F.concat(before, F.array(h), after), "").cast("binary"), 256)

    return F.aggregate(steps, leaf, up)


def proof_digest(steps: Column) -> Column:
    """Hash of all siblings, level by level and from left to right."""
    return F.sha2(F.array_join(F.flatten(F.transform(steps, lambda s: s["others"])), "").cast("binary"), 256)


def manifest(docs: DataFrame, fanout: int = FANOUT, block_levels: int = BLOCK_LEVELS) -> DataFrame:
    """doc_id, leaf, subroot, root, steps, tampered_leaf: proofs of all rows of ``docs``, per language.

    ``tampered_leaf`` is the leaf that the row would have with one more character claimed, for every seventh id.
    """
    columns = {c: F.col(f"`{c}`") for c in FIELDS}
    columns["doc_id"], columns["n_chars"] = (columns[c].cast("long") for c in ("doc_id", "n_chars"))
    other = {**columns, "n_chars": columns["n_chars"] + 1}
    tampered = F.when((F.crc32(columns["doc_id"].cast("string").cast("binary")) % TAMPER_EVERY == 0)
                      & columns["n_chars"].isNotNull(), leaf_hash(list(other.values())))
    leaves = docs.select(ordered_text(columns["lang"]).alias("grp"), leaf_hash(list(columns.values())).alias("leaf"),
                         F.struct(columns["doc_id"].alias("doc_id"), tampered.alias("tampered")).alias("row"),
                         F.monotonically_increasing_id().alias("number"))
    leaves = written(leaves, "merkle-hashed")
    leaves = leaves.select("grp", "leaf", "row", F.struct(F.col("row.doc_id"), "leaf", "number").alias("order"))
    found = proofs(leaves, fanout, block_levels)
    return found.select(F.col("row.doc_id").alias("doc_id"), "leaf", "subroot", "root", "steps",
                        F.col("row.tampered").alias("tampered_leaf"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = manifest(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    again = folded(F.coalesce("tampered_leaf", "leaf"), F.col("steps"))
    return found.withColumn("folded_root", again).select(
        "doc_id", "leaf", "subroot", "root", proof_digest(F.col("steps")).alias("proof_sha256"), "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"))


_FIELD = "CASE WHEN {0} IS NULL THEN '-' ELSE strlen(CAST({0} AS VARCHAR)) || ':' || CAST({0} AS VARCHAR) END"
_LEAF = "sha256(" + " || ".join(_FIELD.format(c) for c in ("doc_id", "source", "lang", "{n_chars}", "text")) + ")"
#: CRC-32 of a short ASCII text, bit by bit.
_CRC = ("xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(1, length(t) + 1), "
        "lambda i: CAST(ascii(t[i]) AS BIGINT))), lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], "
        "lambda x, z: xor(x >> 1, 3988292384 * (x & 1)))))")

ORACLE = f"""
WITH RECURSIVE
d AS MATERIALIZED (
  SELECT row_number() OVER () AS k, doc_id, CASE WHEN lang IS NULL THEN '' ELSE '=' || lang END AS grp,
         {_LEAF.format(n_chars='n_chars')} AS leaf, {_LEAF.format(n_chars='(n_chars + 1)')} AS other,
         n_chars, CAST(doc_id AS VARCHAR) AS t
  FROM documents),
p AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place,
         count(*) OVER (PARTITION BY grp) AS n_leaves,
         CASE WHEN n_chars IS NOT NULL AND t IS NOT NULL AND {_CRC} % 7 = 0 THEN other ELSE leaf END AS claimed
  FROM d),
node AS (
  SELECT grp, 0 AS lvl, place AS a, n_leaves AS n, leaf AS h FROM p
  UNION ALL
  SELECT grp, lvl + 1, a // 2, (max(n) + 1) // 2, sha256(string_agg(h, '' ORDER BY a)) FROM node WHERE n > 1 GROUP BY grp, lvl, a // 2),
sub AS (SELECT grp, lvl AS height, h AS subroot, row_number() OVER (ORDER BY grp) - 1 AS place, count(*) OVER () AS n FROM node WHERE n = 1),
high AS (
  SELECT 0 AS lvl, place AS a, n, subroot AS h FROM sub
  UNION ALL
  SELECT lvl + 1, a // 2, (max(n) + 1) // 2, sha256(string_agg(h, '' ORDER BY a)) FROM high WHERE n > 1 GROUP BY lvl, a // 2),
tree AS (
  SELECT grp, lvl, a, h FROM node WHERE n > 1
  UNION ALL
  SELECT s.grp, s.height + high.lvl, high.a, high.h FROM high, sub s WHERE high.n > 1),
start AS (
  SELECT p.k, p.grp, CASE WHEN sub.height = 0 THEN sub.place ELSE p.place END AS a, p.claimed AS h, sub.height, sub.place AS sub_place,
         sub.height + (SELECT max(lvl) FROM high) AS depth
  FROM p JOIN sub ON p.grp = sub.grp),
fold AS (
  SELECT k, grp, CAST(0 AS BIGINT) AS lvl, CAST(a AS BIGINT) AS a, h, '' AS proof, height, sub_place, depth FROM start
  UNION ALL
  SELECT f.k, f.grp, f.lvl + 1, CASE WHEN f.lvl + 1 = f.height THEN f.sub_place ELSE f.a // 2 END,
         sha256(CASE WHEN s.h IS NULL THEN f.h WHEN f.a % 2 = 0 THEN f.h || s.h ELSE s.h || f.h END),
         f.proof || coalesce(s.h, ''), f.height, f.sub_place, f.depth
  FROM fold f LEFT JOIN tree s ON s.grp = f.grp AND s.lvl = f.lvl AND s.a = xor(f.a, 1)
  WHERE f.lvl < f.depth),
done AS (SELECT k, h AS folded_root, proof FROM fold WHERE lvl = depth),
r AS (SELECT h AS root FROM high WHERE n = 1)
SELECT p.doc_id, p.leaf, sub.subroot, r.root, sha256(done.proof) AS proof_sha256, done.folded_root, done.folded_root = r.root AS verified
FROM p JOIN sub ON p.grp = sub.grp JOIN done ON p.k = done.k, r
"""
