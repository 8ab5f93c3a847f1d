"""Second-order gradient boosting with L2 regularisation, many models at once.

Squared loss: a node with gradient sum G over H rows has leaf value
-G / (H + l2), and a split gains GL^2/(HL + l2) + GR^2/(HR + l2) - G^2/(H + l2).
Trees grow level by level on features that are binned once, to one byte, at
exact quantiles of the table.

All models of a call (folds, parameter combinations) advance together: one job
per level counts, for every model, node, feature and bin, the rows and their
gradients, and sums them over the partitions; only these histograms reach the
driver, whose size depends on models, nodes and bins and never on rows.  A model
with fewer rounds is a prefix of the same model with more, so it is scored on the way.

Rows lie in blocks of numpy arrays, written once in the shared folder; a
partition's running predictions are kept beside its blocks between rounds and
checkpointed every ``CUT`` rounds, so a lost executor recomputes a few rounds.
Partitions follow the number of (row, model) pairs (``PARTITION_ROWS`` each).  Where that is one
partition, there is nothing to add up between levels, and the same rounds run inside its task.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from airseries.operators.quantiles import order_statistics
from airseries.session import checkpoint_dir, cut_lineage

BINS = 256
#: (row, model) pairs of one partition; rounds between checkpoints.
PARTITION_ROWS, CUT = 1_000_000, 40
#: Smallest gain of a split and smallest number of rows in a leaf (fixed defaults of the original's library).
LEAST_GAIN, LEAST_ROWS = 1e-6, 1.0
TREE_SCHEMA = ("model STRING, tree INT, level INT, node INT, feature STRING, threshold DOUBLE, gain DOUBLE, "
               "rows DOUBLE, value DOUBLE, base DOUBLE")


@dataclass(frozen=True)
class Boosting:
    """One model: its parameters and the segments of rows it learns from (0 .. ``train_upto``)."""

    name: str
    rounds: int = 100
    depth: int = 3
    eta: float = 0.3
    subsample: float = 1.0
    l2: float = 1.0
    train_upto: int = 0
    #: Rounds after which the error on segment ``train_upto + 1`` is taken.
    score_at: tuple[int, ...] = ()


@dataclass
class _Tree:
    """Complete levels; ``feature`` is -1 where a node is not split."""

    feature: list[np.ndarray] = field(default_factory=list)
    bin: list[np.ndarray] = field(default_factory=list)
    gain: list[np.ndarray] = field(default_factory=list)
    rows: list[np.ndarray] = field(default_factory=list)
    value: list[np.ndarray] = field(default_factory=list)


# --- blocks -----------------------------------------------------------------------

def bin_edges(df: DataFrame, features: list[str], bins: int = BINS) -> dict[str, list[float]]:
    """At most ``bins - 1`` exact order statistics per feature; a value goes left of an edge if it is <= the edge."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(f).alias("f"), F.col(f).cast("double").alias("v"))
                                         for f in features])).alias("s")).select("s.f", "s.v")

    def ranks(n):
        return F.transform(F.sequence(F.lit(1), F.lit(bins - 1)), lambda i: F.floor(i * (n - 1) / bins).cast("long"))

    found = order_statistics(long, ["f"], "v", ranks).select("k.f", "v").distinct().collect()
    return {f: sorted(r["v"] for r in found if r["f"] == f) for f in features}


def _packed(features: list[str], edges: dict[str, list[float]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols = {n: b.column(i) for i, n in enumerate(b.schema.names)}
            x = np.column_stack([np.searchsorted(np.array(edges[f]), cols[f].to_numpy(zero_copy_only=False), side="left")
                                 for f in features]).astype(np.uint8)
            yield pa.RecordBatch.from_arrays(
                [pa.array([b.num_rows], pa.int32()), pa.array([x.tobytes()], pa.binary()),
                 *(pa.array([cols[c].to_numpy(zero_copy_only=False).astype(t).tobytes()], pa.binary())
                   for c, t in (("__y", "<f8"), ("__segment", "i1"), ("__key", "<i8")))], ["n", "x", "y", "segment", "key"])
    return run


def _uniform(key: np.ndarray, salt: int) -> np.ndarray:
    """A number in [0, 1) per row and round, the same wherever and whenever it is computed."""
    z = key.astype(np.uint64) + np.uint64((salt * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) % (1 << 64))
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((z ^ (z >> np.uint64(31))) >> np.uint64(11)).astype(np.float64) / float(1 << 53)


# --- on the partitions ------------------------------------------------------------

def _place(x: np.ndarray, tree: _Tree, levels: int) -> tuple[np.ndarray, np.ndarray]:
    """Node of each row after ``levels`` splits, and whether it got there (else it stopped at a leaf above)."""
    node, alive = np.zeros(len(x), np.int64), np.ones(len(x), bool)
    rows = np.arange(len(x))
    for level in range(levels):
        f = tree.feature[level][node]
        alive &= f >= 0
        node = 2 * node + (alive & (x[rows, np.maximum(f, 0)] > tree.bin[level][node]))
    return node, alive


def _apply(x: np.ndarray, tree: _Tree) -> np.ndarray:
    node, out, open_ = np.zeros(len(x), np.int64), np.zeros(len(x)), np.ones(len(x), bool)
    rows = np.arange(len(x))
    for level, f_of in enumerate(tree.feature):
        f = f_of[node]
        leaf = open_ & (f < 0)
        out[leaf] = tree.value[level][node[leaf]]
        open_ &= ~leaf
        if not open_.any():
            break
        node = 2 * node + (open_ & (x[rows, np.maximum(f, 0)] > tree.bin[level][node]))
    return out


def _histograms(blocks, specs, trees, level: int, round_: int, n_features: int) -> np.ndarray:
    """[model, node, feature, bin, (gradient, rows)] of a partition."""
    out = np.zeros((len(specs), 1 << level, n_features, BINS, 2))
    size = (1 << level) * BINS
    for x, y, segment, key, pred in blocks:
        u = _uniform(key, round_)
        for m, (spec, tree) in enumerate(zip(specs, trees)):
            if level >= spec.depth:
                continue
            node, alive = _place(x, tree, level)
            take = np.flatnonzero(alive & (segment <= spec.train_upto) & (u < spec.subsample))
            g, at = pred[m, take] - y[take], node[take] * BINS
            for f in range(n_features):
                code = at + x[take, f]
                out[m, :, f, :, 0] += np.bincount(code, weights=g, minlength=size).reshape(-1, BINS)
                out[m, :, f, :, 1] += np.bincount(code, minlength=size).reshape(-1, BINS)
    return out


def _errors(blocks, specs) -> np.ndarray:
    out = np.zeros((len(specs), 2))
    for _, y, segment, _, pred in blocks:
        for m, spec in enumerate(specs):
            on = segment == spec.train_upto + 1
            out[m] += np.abs(pred[m, on] - y[on]).sum(), on.sum()
    return out


def _summed(rdd, f) -> np.ndarray:
    """The sum of one array per partition; through a tree when partitions are many."""
    parts = rdd.mapPartitions(lambda it: [f(it)])
    add = lambda a, b: a + b
    return parts.treeReduce(add, 2) if rdd.getNumPartitions() > 32 else parts.reduce(add)


# --- on the driver ----------------------------------------------------------------

def _split(h: np.ndarray, spec: Boosting) -> tuple[np.ndarray, ...]:
    """Best (feature, bin, gain) of each node of one model, with its rows and leaf value; ties: first feature, lowest bin."""
    left = h.cumsum(axis=2)[:, :, :-1]
    total = h.sum(axis=2)[:, :1, None]  # the same for every feature
    right = total - left

    def score(s):
        return s[..., 0] ** 2 / (s[..., 1] + spec.l2)

    gain = np.round(score(left) + score(right) - score(total), 6)  # equal splits of two features tie in spite of rounding
    gain[(left[..., 1] < LEAST_ROWS) | (right[..., 1] < LEAST_ROWS)] = -np.inf
    flat = gain.reshape(len(h), -1)
    best = flat.argmax(axis=1)
    g, rows = total[:, 0, 0, 0], total[:, 0, 0, 1]
    top = flat[np.arange(len(h)), best]
    feature = np.where(top > LEAST_GAIN, best // gain.shape[2], -1)
    return feature, best % gain.shape[2], np.where(feature >= 0, top, 0.0), rows, np.where(rows > 0, -g / (rows + spec.l2), 0.0)


def _leaves(tree: _Tree, h: np.ndarray, spec: Boosting) -> tuple[np.ndarray, ...]:
    """Rows and values below the last splits, from the histograms these were chosen by."""
    nodes = len(h)
    f, b = np.maximum(tree.feature[-1], 0), tree.bin[-1]
    at = np.arange(nodes)
    left = h.cumsum(axis=2)[at, f, b]
    both = np.stack([left, h.sum(axis=2)[:, 0] - left], axis=1).reshape(2 * nodes, 2)
    rows = both[:, 1]
    none = np.full(2 * nodes, -1)
    return none, np.zeros(2 * nodes, np.int64), np.zeros(2 * nodes), rows, np.where(rows > 0, -both[:, 0] / (rows + spec.l2), 0.0)


# --- rounds -----------------------------------------------------------------------

class _Here:
    """Blocks in this process, with the running predictions of each model."""

    def __init__(self, blocks: list, base: np.ndarray, n_features: int):
        self.blocks = [[*b, np.tile(base[:, None], len(b[1]))] for b in blocks]
        self.n_features = n_features

    def keep(self, models: list[int]) -> None:
        for b in self.blocks:
            b[4] = b[4][models]

    def histograms(self, specs, trees, level: int, round_: int) -> np.ndarray:
        return _histograms(self.blocks, specs, trees, level, round_, self.n_features)

    def advance(self, trees) -> None:
        for b in self.blocks:
            b[4] = b[4] + np.stack([_apply(b[0], t) for t in trees])

    def errors(self, specs) -> np.ndarray:
        return _errors(self.blocks, specs)


class _Spread:
    """The same over the partitions of an RDD of blocks: one job per histogram."""

    def __init__(self, blocks, base: np.ndarray, n_features: int):
        self.state = blocks.map(lambda b: (*b, np.tile(base[:, None], len(b[1])))).cache()
        self.cached, self.rounds, self.n_features = [self.state], 0, n_features

    def keep(self, models: list[int]) -> None:
        self.state = self.state.map(lambda b: (*b[:4], b[4][models]))

    def histograms(self, specs, trees, level: int, round_: int) -> np.ndarray:
        n = self.n_features
        out = _summed(self.state, lambda it: _histograms(it, specs, trees, level, round_, n))
        while len(self.cached) > 1:  # the newest predictions have been computed from the ones before
            self.cached.pop(0).unpersist()
        return out

    def advance(self, trees) -> None:
        self.state = self.state.map(lambda b: (*b[:4], b[4] + np.stack([_apply(b[0], t) for t in trees]))).cache()
        self.cached.append(self.state)
        self.rounds += 1
        if self.rounds % CUT == 0:
            self.state.checkpoint()
            self.state.count()

    def errors(self, specs) -> np.ndarray:
        return _summed(self.state, lambda it: _errors(it, specs))


def _grow(rows, specs: list[Boosting]) -> tuple[list[list[_Tree]], list[tuple]]:
    """All trees of all models and their scores (model, rounds, mae, n)."""
    active, grown, scores = list(range(len(specs))), [[] for _ in specs], []
    for round_ in range(max(s.rounds for s in specs)):
        keep = [i for i, m in enumerate(active) if specs[m].rounds > round_]
        if len(keep) < len(active):
            rows.keep(keep)
            active = [active[i] for i in keep]
        now = [specs[m] for m in active]
        trees, last = [_Tree() for _ in active], None
        for level in range(max(s.depth for s in now) + 1):
            deep = [level < s.depth for s in now]
            h = rows.histograms(now, trees, level, round_) if any(deep) else None
            for i, (spec, tree) in enumerate(zip(now, trees)):
                if deep[i]:
                    f, b, gain, count, value = _split(h[i], spec)
                elif level == spec.depth:  # the leaves below the last splits
                    f, b, gain, count, value = _leaves(tree, last[i], spec)
                else:
                    continue
                for column, x in ((tree.feature, f), (tree.bin, b), (tree.gain, gain), (tree.rows, count),
                                  (tree.value, spec.eta * value)):
                    column.append(x)
            last = h
        for m, tree in zip(active, trees):
            grown[m].append(tree)
        rows.advance(trees)
        wanted = [i for i, s in enumerate(now) if round_ + 1 in s.score_at]
        if wanted:
            err = rows.errors(now)
            scores += [(now[i].name, round_ + 1, float(err[i, 0] / err[i, 1]) if err[i, 1] else None, int(err[i, 1])) for i in wanted]
    return grown, scores


def _base(blocks, specs) -> np.ndarray:
    """Sum and number of the rows that each model learns from."""
    out = np.zeros((len(specs), 2))
    for _, y, segment, _ in blocks:
        out += np.array([[y[segment <= s.train_upto].sum(), (segment <= s.train_upto).sum()] for s in specs])
    return out


def fit(df: DataFrame, features: list[str], label: str, segment: str, key: list[str], specs: list[Boosting],
        bins: int = BINS, partition_rows: int = PARTITION_ROWS) -> tuple[DataFrame, DataFrame]:
    """Fit all ``specs`` on ``df``; returns the trees (TREE_SCHEMA) and the scores (model, rounds, mae, n).

    Rows with a NULL feature or label are skipped.  ``key`` names the columns that tell rows apart (for subsampling).
    """
    spark = df.sparkSession
    rows = df.select(*[F.col(f).cast("double").alias(f) for f in features], F.col(label).cast("double").alias("__y"),
                     F.col(segment).cast("int").alias("__segment"), F.xxhash64(*key).alias("__key")).dropna()
    rows = cut_lineage(rows)
    n = rows.count()
    # Edges come from rows that some model learns from; test rows have no part in them.
    edges = bin_edges(rows.where(F.col("__segment") <= max(s.train_upto for s in specs)), features, bins)
    if not n:
        return spark.createDataFrame([], TREE_SCHEMA), spark.createDataFrame([], "model STRING, rounds INT, mae DOUBLE, n BIGINT")
    blocks = cut_lineage(rows.mapInArrow(_packed(features, edges), "n int, x binary, y binary, segment binary, key binary"))
    parts = max(1, min(blocks.rdd.getNumPartitions(), -(-n * len(specs) // partition_rows)))
    n_features = len(features)

    def arrays(r):
        return (np.frombuffer(r["x"], np.uint8).reshape(r["n"], n_features), np.frombuffer(r["y"], "<f8"),
                np.frombuffer(r["segment"], "i1"), np.frombuffer(r["key"], "<i8"))

    def mean(sums):
        return sums[:, 0] / np.maximum(sums[:, 1], 1.0)

    def alone(it):
        held = list(it)
        base = mean(_base(held, specs))
        return [(base, *_grow(_Here(held, base, n_features), specs))]

    loaded = blocks.coalesce(parts).rdd.map(arrays)
    if parts == 1:  # at most `partition_rows` (row, model) pairs: no sums to add up, the rounds run in the one task
        base, grown, scores = loaded.mapPartitions(alone).collect()[0]
    else:
        checkpoint_dir(spark)
        base = mean(_summed(loaded, lambda it: _base(it, specs)))
        grown, scores = _grow(_Spread(loaded, base, n_features), specs)
    table = pd.DataFrame([r for m, s in enumerate(specs) for r in _rows(s, grown[m], float(base[m]), features, edges)],
                         columns=["model", "tree", "level", "node", "feature", "threshold", "gain", "rows", "value", "base"])
    table = table.astype(object).where(table.notna(), None)
    return (spark.createDataFrame(table.values.tolist(), TREE_SCHEMA),
            spark.createDataFrame(scores, "model STRING, rounds INT, mae DOUBLE, n BIGINT"))


def _rows(spec: Boosting, trees: list[_Tree], base: float, features: list[str], edges: dict[str, list[float]]):
    """The nodes that a row can reach; ``value`` is set in leaves."""
    for t, tree in enumerate(trees):
        there = np.ones(1, bool)
        for level in range(len(tree.feature)):
            f = tree.feature[level]
            for i in np.flatnonzero(there):
                name = features[f[i]] if f[i] >= 0 else None
                yield (spec.name, t, level, int(i), name, edges[name][tree.bin[level][i]] if name else None,
                       float(tree.gain[level][i]) if name else None, float(tree.rows[level][i]),
                       None if name else float(tree.value[level][i]), base)
            there = np.repeat(there & (f >= 0), 2)


# --- use of the trees -------------------------------------------------------------

def compiled(nodes: list, names: dict[str, str], rounds: int | None = None) -> str:
    """One model's trees (rows of TREE_SCHEMA) as a native SQL expression; ``names`` gives each feature's expression."""
    by_tree = _by_tree(nodes, rounds)

    def expr(tree, level, node) -> str:
        r = tree[level, node]
        if r["feature"] is None:
            return f"{r['value']!r}D"
        return (f"CASE WHEN {names[r['feature']]} <= {r['threshold']!r}D THEN {expr(tree, level + 1, 2 * node)} "
                f"ELSE {expr(tree, level + 1, 2 * node + 1)} END")

    return " + ".join([f"{nodes[0]['base']!r}D", *(expr(by_tree[t], 0, 0) for t in sorted(by_tree))]) if nodes \
        else "CAST(NULL AS DOUBLE)"


def _by_tree(nodes: list, rounds: int | None = None) -> dict[int, dict]:
    out: dict[int, dict] = {}
    for r in nodes:
        if rounds is None or r["tree"] < rounds:
            out.setdefault(r["tree"], {})[r["level"], r["node"]] = r
    return out


def predicted(nodes: list, features: list[str], rounds: int | None = None) -> Column:
    """One model's prediction from the columns ``features``, in Arrow batches; NULL without trees."""
    if not nodes:
        return F.lit(None).cast("double")
    names, trees = {f: i for i, f in enumerate(features)}, []
    for t, tree in sorted(_by_tree(nodes, rounds).items()):
        depth = max(level for level, _ in tree) + 1
        arrays = [(np.full(1 << level, -1), np.zeros(1 << level), np.zeros(1 << level)) for level in range(depth)]
        for (level, node), r in tree.items():
            feature, threshold, value = arrays[level]
            if r["feature"] is None:
                value[node] = r["value"]
            else:
                feature[node], threshold[node] = names[r["feature"]], r["threshold"]
        trees.append(_Tree([a[0] for a in arrays], [a[1] for a in arrays], value=[a[2] for a in arrays]))
    base = nodes[0]["base"]

    @F.pandas_udf("double")
    def run(columns: pd.DataFrame) -> pd.Series:
        x = columns.to_numpy(dtype=float)
        return pd.Series(base + sum((_apply(x, t) for t in trees), np.zeros(len(x))))

    return run(F.struct(*[F.col(f).cast("double").alias(f"x{i}") for i, f in enumerate(features)]))


def importance(trees: DataFrame, features: list[str]) -> DataFrame:
    """Mean gain of a feature's splits, as a share of the sum over features."""
    spark = trees.sparkSession
    mean = trees.where(F.col("feature").isNotNull()).groupBy("model", "feature").agg(F.avg("gain").alias("g"))
    share = mean.join(mean.groupBy("model").agg(F.sum("g").alias("all")), "model").select(
        "model", "feature", (F.col("g") / F.col("all")).alias("importance"))
    names = spark.createDataFrame([(f,) for f in features], "feature STRING")
    return names.join(share, "feature", "left").select("feature", F.coalesce("importance", F.lit(0.0)).alias("importance"))
