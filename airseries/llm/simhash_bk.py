"""SimHash near-deduplication with BK-trees over shards of fingerprints.

Texts are lower-cased (A-Z), split into words ``[^\\x20\\x09-\\x0D]+`` and into
shingles of three words, repeats included (fewer words: the whole sequence; no
word: fingerprint zero). A fingerprint bit is set if it is set in over half of
the shingles' XXH64 hashes (seed 42). Fingerprints link at ``radius`` or fewer
differing bits, and linked ones form components.

Search runs on distinct fingerprints, so copies cost one row. The 64 bits are
cut into three blocks of 21 or 22; two fingerprints within two bits agree in at least
one block, so the blocks name shards such that every link lies inside some
shard. Each shard has a BK-tree (children keyed by integer Hamming distance
to the parent; a search follows only edges within the radius), built and
searched by all of the shard's fingerprints in the task that holds it: one
vectorised forest serves the many shards of a partition. A tree is sent to
where its queries are instead of to all tasks, because sending every shard to every
task would be a comparison of all pairs in blocks. Shards with more than
``hot`` fingerprints are cut again by thirds of the remaining bits, by the same pigeonhole
argument, and once more; as its fingerprints are distinct and agree in 44 bits or more, such a shard
has at most 2^20 rows, 16 MB. A shard passes on a star for each of its own components, never all
pairs, and the stars are joined into components over all shards.

A component's id is its smallest doc_id. Null text is empty; rows of a null
doc_id are linked like others but never name a component that has an id;
repeated rows share their fingerprint; other columns are ignored; an empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from airseries.llm.common import id_and_text, join_groups, written
from airseries.llm.components import connected_components

BITS, RADIUS, SHINGLE, SEED = 64, 2, 3, 42
#: Times a shard is cut by a third of the bits that are left; after three a shard agrees in 44 bits or more.
LEVELS = 3
#: Rows of the shards that one forest holds, unless a single shard has more.
FOREST_ROWS = 200_000
#: A-Z to a-z on bytes.
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


# --- fingerprints ----------------------------------------------------------------

def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    # bytes.split() splits at exactly \x20 and \x09-\x0D
    words = text.encode("utf-8", "surrogatepass").translate(LOWER).split()
    if not words:
        return 0
    grams = map(b" ".join, zip(*(words[i:] for i in range(shingle)))) if len(words) >= shingle else [b" ".join(words)]
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(g, SEED) for g in grams], dtype="<u8")
    counts = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 16):  # a very long text in slices
        bits = np.unpackbits(hashes[at:at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 shingle: int = SHINGLE) -> DataFrame:
    """doc_id, text_hash (of the whole text, to tell rows of one id apart) and fp as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(t, shingle) for t in b.column(2).to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fps.view(np.int64))],
                                             ["doc_id", "text_hash", "fp"])

    texts = id_and_text(docs, id_col, text_col).select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    return texts.mapInArrow(run, "doc_id long, text_hash long, fp long")


# --- BK-forest --------------------------------------------------------------------

class BKForest:
    """BK-trees of many shards in flat arrays; rows must be sorted by shard and distinct in it."""

    def __init__(self, shard: np.ndarray, fp: np.ndarray):
        self.fp = fp.view(np.uint64)
        n = len(fp)
        first = np.concatenate([[True], shard[1:] != shard[:-1]])
        self.root = np.flatnonzero(first)[np.cumsum(first) - 1]  # of each row's shard
        codes, children = [], []
        rows = np.flatnonzero(~first)
        at = self.root[rows]
        while len(rows):  # one level of all trees at a time
            code = at * (BITS + 1) + self._distance(rows, at)
            order = np.argsort(code, kind="stable")
            code, rows = code[order], rows[order]
            new = np.concatenate([[True], code[1:] != code[:-1]])
            codes.append(code[new])
            children.append(rows[new])
            at = rows[new][np.cumsum(new) - 1][~new]
            rows = rows[~new]
        self.codes = np.concatenate([*codes, np.empty(0, np.int64)]).astype(np.int64)  # parent and distance
        order = np.argsort(self.codes)
        self.codes, self.children = self.codes[order], np.concatenate([*children, np.empty(0, np.int64)]).astype(np.int64)[order]
        self.n = n

    def _distance(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.bitwise_count(self.fp[a] ^ self.fp[b]).astype(np.int64)

    def links(self, radius: int, block: int = 8192) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(row, earlier or later row) pairs within the radius, for blocks of queries."""
        for start in range(0, self.n, block):
            query = np.arange(start, min(start + block, self.n))
            node = self.root[query]
            while len(query):
                d = self._distance(query, node)
                hit = (d <= radius) & (query != node)
                yield query[hit], node[hit]
                lo = np.searchsorted(self.codes, node * (BITS + 1) + np.maximum(d - radius, 1), side="left")
                hi = np.searchsorted(self.codes, node * (BITS + 1) + np.minimum(d + radius, BITS), side="right")
                n = np.maximum(hi - lo, 0)
                query = np.repeat(query, n)
                node = self.children[np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())]


def _label(n: int, a: np.ndarray, b: np.ndarray, label: np.ndarray) -> np.ndarray:
    """Smallest row reachable, starting from labels found so far."""
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        while True:
            jump = new[new]
            if (jump == new).all():
                break
            new = jump
        if (new == label).all():
            return label
        label = new


def stars(shard: np.ndarray, fp: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges (fp, first fp of its component in the shard) over all the shards given."""
    several = np.zeros(len(shard), dtype=bool)
    same = shard[1:] == shard[:-1]
    several[1:] |= same
    several[:-1] |= same
    shard, fp = shard[several], fp[several]
    if not len(fp):
        return fp, fp
    forest = BKForest(shard, fp)
    label = np.arange(len(fp))
    for a, b in forest.links(radius):
        if len(a):
            label = _label(len(fp), a, b, label)
    moved = label != np.arange(len(fp))
    return fp[moved], fp[label[moved]]


def _search(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by (shard, fp); a shard's rows follow each other."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    rows = 0

    def emit(shard, fp):
        distinct = np.concatenate([[True], (shard[1:] != shard[:-1]) | (fp[1:] != fp[:-1])]) if len(fp) else []
        u, v = stars(shard[distinct], fp[distinct], radius) if len(fp) else (fp, fp)
        return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

    for batch in batches:
        held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
        rows += batch.num_rows
        if rows >= FOREST_ROWS:
            shard, fp = (np.concatenate(x) for x in zip(*held))
            cut = int(np.searchsorted(shard, shard[-1], side="left"))  # the last shard may go on
            if cut:
                yield emit(shard[:cut], fp[:cut])
            held, rows = [(shard[cut:], fp[cut:])], len(shard) - cut
    if held:
        yield emit(*(np.concatenate(x) for x in zip(*held)))


# --- shards -----------------------------------------------------------------------

def _thirds(bits: list[int]) -> list[list[int]]:
    """The bit numbers in three runs of nearly equal length."""
    n, ends = len(bits), [len(bits) * k // 3 for k in range(4)]
    return [bits[ends[k]:ends[k + 1]] for k in range(3)] if n >= 3 else [bits]


def _mask(bits: list[int]) -> int:
    m = sum(1 << b for b in bits)
    return m - (1 << BITS) if m >> (BITS - 1) else m  # as a signed long


def shard_masks(levels: int = LEVELS) -> list[dict[int, list[int]]]:
    """For each level the masks that follow a mask (0 before the first): its bits and a third of the others.

    Two fingerprints that differ in two bits at most agree in one third at least, at every level.
    """
    out, fixed = [], {0: []}
    for _ in range(levels):
        step, after = {}, {}
        for mask, bits in fixed.items():
            rest = [b for b in range(BITS) if b not in bits]
            step[mask] = []
            for third in _thirds(rest):
                both = sorted(bits + third)
                step[mask].append(_mask(both))
                after[_mask(both)] = both
        out.append(step)
        fixed = after
    return out


def shards(fps: DataFrame, hot: int) -> DataFrame:
    """(shard, fp) rows such that fingerprints within two bits share a shard.

    A shard is a mask and the fingerprint's bits under it; one with over ``hot`` rows is cut by further bits.
    """
    crowded, dealt = fps.select("fp", F.lit(0).cast("long").alias("mask")), None
    for level, masks in enumerate(shard_masks()):
        follows = F.create_map(*[x for m, after in masks.items() for x in (
            F.lit(m).cast("long"), F.array(*[F.lit(a).cast("long") for a in after]))])
        rows = crowded.select("fp", F.explode(F.element_at(follows, F.col("mask"))).alias("mask")).withColumn(
            "shard", F.xxhash64("mask", F.col("fp").bitwiseAND(F.col("mask"))))
        if level == LEVELS - 1:
            plain = rows
        else:
            many = written(rows.groupBy("shard").agg(F.count("*").alias("n")).where(F.col("n") > hot).select("shard"),
                           "simhash-crowded")
            plain = rows.join(many, "shard", "left_anti")
            crowded = rows.join(many, "shard", "left_semi").select("fp", "mask")
        plain = plain.select("shard", "fp")
        dealt = plain if dealt is None else dealt.unionByName(plain)
        if level < LEVELS - 1 and many.isEmpty():
            break
    return dealt


def near_links(fps: DataFrame, radius: int = RADIUS, hot: int = 20_000) -> DataFrame:
    """Edges (u, v) between fingerprints that connect all that are within ``radius`` bits."""
    if not 0 <= radius <= RADIUS:
        raise ValueError(f"the shards guarantee links of up to {RADIUS} bits")
    dealt = shards(fps, hot).repartition("shard").sortWithinPartitions("shard", "fp")
    return dealt.mapInArrow(lambda it: _search(it, radius), "u long, v long")


def near_groups(docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE, hot: int = 20_000,
                id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, text_hash, fp, component_id, keeper_hash.

    The row of a component that stays is the one with doc_id = component_id and
    text_hash = keeper_hash.
    """
    rows = written(fingerprints(docs, id_col, text_col, shingle), "simhash-rows")
    first = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")
    fps = written(rows.groupBy("fp").agg(F.min(first).alias("first"), F.count("*").alias("n")), "simhash-fps")
    linked = connected_components(near_links(fps.select("fp"), radius, hot))
    rooted = written(fps.join(linked.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "n", "first", F.coalesce("root", "fp").alias("root")), "simhash-roots")
    heads = written(rooted.groupBy("root").agg(F.min("first").alias("head"), F.count("*").alias("fps")), "simhash-heads")
    by_fp = written(join_groups(rooted.select("root", "fp", "n"), heads, ["root"], "fps").select(
        "fp", "n", F.col("head.doc_id").alias("component_id"), F.col("head.text_hash").alias("keeper_hash")),
        "simhash-by-fp")
    return join_groups(rows, by_fp, ["fp"], "n").select("doc_id", "text_hash", "fp", "component_id", "keeper_hash")


def near_report(docs: DataFrame, **options) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id."""
    return near_groups(docs, **options).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that stay, one of each component, with all their columns."""
    groups = near_groups(docs, id_col=id_col, text_col=text_col, **options)
    stays = F.col("doc_id").eqNullSafe(F.col("component_id")) & (F.col("text_hash") == F.col("keeper_hash"))
    kept = written(groups.where(stays).groupBy("doc_id", "text_hash").agg(F.count("*").alias("rows")), "simhash-kept")
    kept = kept.select(*(F.col(c).alias(f"of_{c}") for c in kept.columns))
    # The documents' columns travel in a struct, where their names cannot clash.
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    texts = docs.select(F.struct("*").alias("row"), F.col(f"`{id_col}`").cast("long").alias("doc_id"),
                        F.xxhash64(text).alias("text_hash"))
    joined = texts.join(kept, F.col("doc_id").eqNullSafe(F.col("of_doc_id"))
                        & (F.col("text_hash") == F.col("of_text_hash")))
    again = joined.where("of_rows > 1").dropDuplicates(["of_doc_id", "of_text_hash"])  # repeated rows
    return joined.where("of_rows = 1").select("row").unionByName(again.select("row")).select("row.*")


def query(spark, sf_dir: str) -> DataFrame:
    return near_report(spark.read.parquet(f"{sf_dir}/documents.parquet"))
