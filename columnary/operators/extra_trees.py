"""Extremely randomised trees (Geurts, Ernst and Wehenkel 2006) on Spark.

A node draws some features that are not constant in it, one threshold for each,
uniform between its least and largest value there, and keeps the split with the
least impurity. All rows train every tree. The draws are a hash of tree, node and
feature, so they do not depend on the partitioning.

Groups of trees grow one level at a time, in two aggregations: ranges of the features
per node, then sums of the labels on both sides of each drawn threshold. Only the
nodes of one group come to the driver, at most ``GROUP * 2 ** (depth + 1)``, and a pass
treats a bounded number of them. Where all copies of the training table together are
small, each tree grows in a task of its own by the same steps. The nodes are stored
below the checkpoint folder and read a group at a time to score.

Defined cases: features without missing values are expected; a node whose rows
agree in the label or in all features is a leaf, also the root; rows without
weight count as rows but pull nothing.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import DenseVector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import collect_garbage, ensure_checkpoint_dir
from .forests import added_votes, batches, group_sizes, voted

#: Bytes of one copy of the training table per tree, up to which each tree grows in one task.
LOCAL_BYTES = 1024 * 1024 * 1024
#: Trees that grow together by levels and score together.
GROUP = 12
#: Feature ranges that one pass brings together.
PASS_RANGES = 2_000_000
#: Nodes that are handed to Spark at once.
STORED_NODES = 200_000
#: Nodes of the groups that score together, and of the trees that are fetched together (or one tree's, where it has more).
SCORED_NODES, FETCHED_NODES = 2**18, 2**17
_NODES = "tree int, node long, feature int, threshold double, low double, high double, gain double, n long, stats array<double>"


def _hashed(salt: int, tree: np.ndarray, node: np.ndarray, d: int) -> np.ndarray:
    """One even number in [0, 1) for every node and feature."""
    with np.errstate(over="ignore"):
        key = (tree.astype(np.uint64) << np.uint64(40)) ^ node.astype(np.uint64)
        x = key[:, None] * np.uint64(0x9E3779B97F4A7C15) + np.uint64(salt * 1_000_003) + np.arange(1, d + 1, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03)
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
        x ^= x >> np.uint64(31)
    return (x >> np.uint64(11)).astype(float) / float(1 << 53)


def draw(seed: int, tree: np.ndarray, node: np.ndarray, low: np.ndarray, high: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Features (-1: none left) and thresholds that each node tries, ``k`` a node."""
    d = low.shape[1]
    rank = np.where(high > low, _hashed(2 * seed, tree, node, d), 2.0)
    chosen = np.argsort(rank, axis=1, kind="stable")[:, :k]
    rows = np.arange(len(low))[:, None]
    lo, hi = low[rows, chosen], high[rows, chosen]
    cut = lo + _hashed(2 * seed + 1, tree, node, d)[rows, chosen] * (hi - lo)
    return np.where(rank[rows, chosen] < 2.0, chosen, -1), np.where(cut < hi, cut, lo)


def impurity(stats: np.ndarray, classes: int) -> np.ndarray:
    """Weighted Gini impurity or sum of squared errors of sums over labels; the last entry counts rows."""
    if classes:
        weight = stats[..., :-1].sum(axis=-1)
        return weight - (stats[..., :-1] ** 2).sum(axis=-1) / np.where(weight > 0, weight, 1.0)
    weight, total, squares = stats[..., 0], stats[..., 1], stats[..., 2]
    return np.maximum(squares - total**2 / np.where(weight > 0, weight, 1.0), 0.0)


def label_stats(y: np.ndarray, w: np.ndarray, classes: int) -> np.ndarray:
    ones = np.ones(len(y))
    if not classes:
        return np.column_stack([w, w * y, w * y * y, ones])
    out = np.zeros((len(y), classes + 1))
    out[np.arange(len(y)), y.astype(np.int64)] = w
    out[:, classes] = ones
    return out


def _is_leaf(stats: np.ndarray, depth: int, limit: int, classes: int) -> np.ndarray:
    weight = stats[:, :-1].sum(axis=1) if classes else stats[:, 2]
    return (stats[:, -1] < 2) | (depth >= limit) | (impurity(stats, classes) <= 1e-12 * np.abs(weight))


def best_splits(total: np.ndarray, left: np.ndarray, feature: np.ndarray, classes: int) -> tuple[np.ndarray, np.ndarray]:
    """Which of the drawn splits each node takes (-1: none), and what it gains."""
    after = impurity(left, classes) + impurity(total[:, None, :] - left, classes)
    after = np.where(feature >= 0, after, np.inf)
    best = after.argmin(axis=1)
    least = after[np.arange(len(best)), best]
    return np.where(np.isfinite(least), best, -1), np.where(np.isfinite(least), impurity(total, classes) - least, 0.0)


def grow(x: np.ndarray, y: np.ndarray, w: np.ndarray, tree: int, seed: int, k: int, limit: int, classes: int) -> pd.DataFrame:
    """One tree over rows held in memory, level by level."""
    stats, made = label_stats(y, w, classes), []
    rows, at = np.arange(len(x)), np.ones(len(x), np.int64)
    for depth in range(limit + 1):
        if not len(rows):
            break
        order = np.argsort(at, kind="stable")
        rows, at = rows[order], at[order]
        node, starts, sizes = np.unique(at, return_index=True, return_counts=True)
        total = np.add.reduceat(stats[rows], starts)
        low, high = np.empty((len(node), x.shape[1])), np.empty((len(node), x.shape[1]))
        for j in range(x.shape[1]):  # a feature at a time: no second copy of the rows
            values = x[rows, j]
            low[:, j], high[:, j] = np.minimum.reduceat(values, starts), np.maximum.reduceat(values, starts)
        feature, cut = draw(seed, np.full(len(node), tree), node, low, high, k)
        feature[_is_leaf(total, depth, limit, classes)] = -1
        group = np.repeat(np.arange(len(node)), sizes)
        goes = np.stack([x[rows, feature[group, j]] <= cut[group, j] for j in range(feature.shape[1])], axis=1)
        left = np.stack([np.add.reduceat(stats[rows] * goes[:, [j]], starts) for j in range(feature.shape[1])], axis=1)
        best, gain = best_splits(total, left, feature, classes)
        made.append(_node_table(np.full(len(node), tree), node, feature, cut, low, high, best, gain, total))
        inner = best[group] >= 0
        at = 2 * at + ~goes[np.arange(len(rows)), best[group]]
        rows, at = rows[inner], at[inner]
    return pd.concat(made)


def _node_table(tree, node, feature, cut, low, high, best, gain, total) -> pd.DataFrame:
    one = np.arange(len(node))
    inner = best >= 0
    f = np.where(inner, feature[one, best], -1)
    return pd.DataFrame({
        "tree": tree.astype(np.int32), "node": node, "feature": f.astype(np.int32), "threshold": np.where(inner, cut[one, best], 0.0),
        "low": np.where(inner, low[one, f], 0.0), "high": np.where(inner, high[one, f], 0.0), "gain": gain,
        "n": total[:, -1].astype(np.int64), **{f"s{i}": total[:, i] for i in range(total.shape[1] - 1)},
    })


def _stored(nodes: pd.DataFrame) -> pa.Table:
    """Nodes as they are stored: their label sums as one array each."""
    sums = nodes.filter(regex=r"^s\d+$")
    offsets = np.arange(len(nodes) + 1, dtype=np.int32) * sums.shape[1]
    lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(sums.to_numpy().ravel()))
    return pa.Table.from_pandas(nodes.drop(columns=sums.columns), preserve_index=False).append_column("stats", lists)


@dataclass
class Forest:
    """Nodes of all trees as arrays, in order of (tree, node), with places of their children."""

    trees: int
    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray

    @staticmethod
    def of(nodes: pd.DataFrame, trees: int) -> Forest:
        """``nodes`` sorted by tree and node; children that are not there yet have the place -1."""
        key = (nodes["tree"].to_numpy(np.int64) << 40) + nodes["node"].to_numpy(np.int64)
        base = nodes["tree"].to_numpy(np.int64) << 40

        def place(child: np.ndarray) -> np.ndarray:
            at = np.minimum(np.searchsorted(key, base + child), len(key) - 1)
            return np.where(key[at] == base + child, at, -1)

        double = 2 * nodes["node"].to_numpy(np.int64)
        roots = np.searchsorted(key, (np.arange(trees, dtype=np.int64) << 40) + 1)
        return Forest(trees, roots, nodes["feature"].to_numpy(), nodes["threshold"].to_numpy(), place(double), place(double + 1))

    def leaves(self, x: np.ndarray, tree: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Place of the last known node of every row, whether it goes on from there, and on which side (1: right)."""
        at = np.full(len(x), self.roots[tree])
        one, side = np.arange(len(x)), np.zeros(len(x), np.int64)
        while True:
            f = self.feature[at]
            side = np.where(f >= 0, x[one, f] > self.threshold[at], 0).astype(np.int64)
            down = np.where(side == 1, self.right[at], self.left[at])
            move = (f >= 0) & (down >= 0)
            if not move.any():
                return at, f >= 0, side
            at = np.where(move, down, at)


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), d)


@dataclass
class ExtraTreesModel:
    """Fitted trees as a stored table of nodes; ``transform`` adds ``prediction`` and, for classes, ``probability``."""

    table: DataFrame
    trees: int
    classes: int
    width: int
    sent: list = field(default_factory=list, repr=False)

    @cached_property
    def nodes(self) -> pd.DataFrame:
        """All nodes in order of (tree, node): for forests that fit on the driver."""
        return _sorted(self.table)

    @property
    def featureImportances(self) -> DenseVector:  # noqa: N802 - the name Spark's models use
        """Mean share of each feature in what the splits of a tree gain."""
        share = np.zeros((self.trees, self.width))
        gains = self.table.where("feature >= 0").groupBy("tree", "feature").agg(F.sum("gain").alias("gain")).toArrow()
        share[gains["tree"].to_numpy(), gains["feature"].to_numpy()] = gains["gain"].to_numpy()
        sums = share.sum(axis=1, keepdims=True)
        mean = (share / np.where(sums > 0, sums, 1.0)).mean(axis=0)
        return DenseVector(mean / mean.sum() if mean.sum() > 0 else mean)

    def transform(self, rows: DataFrame) -> DataFrame:
        width = self.width
        counted = self.table.groupBy("tree").agg(F.count(F.lit(1)).alias("n")).toArrow()
        sizes = np.zeros(self.trees, np.int64)
        sizes[counted["tree"].to_numpy()] = counted["n"].to_numpy()
        groups = group_sizes(self.trees, GROUP)
        together = [[[groups[i] for i in some]] for some in batches([sizes[a : a + n].sum() for a, n in groups], SCORED_NODES, len(groups))]

        def votes(some: list[tuple[int, int]], part: DataFrame) -> tuple[DataFrame, Column]:
            forests = []
            for first, size in some:
                nodes, stats = self._voters(range(first, first + size), sizes)
                weight = stats.sum(axis=1, keepdims=True) if self.classes else stats[:, :1]
                values = (stats if self.classes else stats[:, 1:2]) / np.where(weight > 0, weight, 1.0)
                forests.append((first, size, Forest.of(nodes, self.trees), values))
                del nodes, stats
            collect_garbage(part.sparkSession)
            sent = part.sparkSession.sparkContext.broadcast(forests)  # bounded by SCORED_NODES, or for one group by GROUP and depth
            self.sent.append(sent)

            @F.pandas_udf("array<double>")
            def vote(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
                for batch in batches:
                    x = np.stack(batch.to_numpy()) if len(batch) else np.empty((0, width))
                    out = np.zeros((len(x), sent.value[0][3].shape[1]))
                    for first, size, forest, known in sent.value:
                        told = np.zeros_like(out)
                        for t in range(first, first + size):
                            told += known[forest.leaves(x, t)[0]]
                        out += told
                    yield pd.Series(list(out))

            return part, vote(vector_to_array("features"))

        return voted(added_votes(rows, together, votes, max(1, self.classes), self.forget), self.classes, self.trees)

    def _voters(self, trees: range, sizes: np.ndarray) -> tuple[pd.DataFrame, np.ndarray]:
        """Nodes of some trees in order and their label sums, fetched a few trees at a time; inner nodes tell nothing."""
        nodes, sums = [], []
        for some in batches(sizes[trees.start : trees.stop], FETCHED_NODES, len(trees)):
            mine = self.table.where(F.col("tree").between(trees[some.start], trees[some.stop - 1]))
            told = mine.select("tree", "node", "feature", "threshold", F.when(F.col("feature") < 0, F.col("stats")).alias("stats")).toArrow()
            part = told.drop_columns("stats").to_pandas()
            order, leaf = np.lexsort((part["node"].to_numpy(), part["tree"].to_numpy())), part["feature"].to_numpy() < 0
            known = told.column("stats").drop_null().combine_chunks().flatten().to_numpy()
            stats = np.zeros((len(part), len(known) // leaf.sum()))
            stats[leaf] = known.reshape(leaf.sum(), -1)
            nodes.append(part.iloc[order])
            sums.append(stats[order])
        return pd.concat(nodes, ignore_index=True), np.concatenate(sums)

    def forget(self) -> None:
        """Drops what the trees that have voted were sent by."""
        while self.sent:
            self.sent.pop().destroy()


def _sorted(table: DataFrame) -> pd.DataFrame:
    return table.toArrow().to_pandas().sort_values(["tree", "node"], ignore_index=True)


@dataclass
class ExtraTrees:
    """``fit`` on ``features, label, weight``; ``classes`` 0 is a regression."""

    classes: int
    trees: int
    depth: int
    share: float | str
    seed: int
    local_bytes: int = LOCAL_BYTES

    def fit(self, train: DataFrame) -> ExtraTreesModel:
        rows = train.select(vector_to_array("features").alias("x"), F.col("label").cast("double").alias("y"), F.col("weight").cast("double").alias("w"))
        size = rows.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("x")).alias("d")).first()
        if not size.n or not size.d:
            raise ValueError("Extremely randomised trees need rows and features.")
        k = max(1, int(size.d**0.5 if self.share == "sqrt" else size.d * self.share))
        path = f"{ensure_checkpoint_dir(train.sparkSession)}/trees-{uuid.uuid4().hex}"
        if size.n * (size.d + 2) * 8 * self.trees <= self.local_bytes:
            self._one_task_a_tree(rows, size.d, k).write.parquet(path)
        else:
            for first, trees in group_sizes(self.trees, GROUP):
                made = _stored(self._level_by_level(rows, size.d, k, np.arange(first, first + trees)))
                for start in range(0, len(made), STORED_NODES):
                    train.sparkSession.createDataFrame(made.slice(start, STORED_NODES), _NODES).write.mode("append").parquet(path)
                del made
        return ExtraTreesModel(train.sparkSession.read.parquet(path), self.trees, self.classes, size.d)

    def _one_task_a_tree(self, rows: DataFrame, d: int, k: int) -> DataFrame:
        seed, limit, classes = self.seed, self.depth, self.classes

        def build(key: tuple, part: pa.Table) -> pa.Table:
            x = _matrix(part.column("x").combine_chunks(), d)
            made = grow(x, part.column("y").to_numpy(), part.column("w").to_numpy(), key[0].as_py(), seed, k, limit, classes)
            return _stored(made)

        copies = rows.withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(self.trees - 1))))
        # few trees a task: the tasks of some cores do not wait for those that were dealt more
        parts = min(self.trees, 4 * rows.sparkSession.sparkContext.defaultParallelism)
        return copies.repartition(parts, "tree").groupBy("tree").applyInArrow(build, _NODES)

    def _level_by_level(self, rows: DataFrame, d: int, k: int, tree: np.ndarray) -> pd.DataFrame:
        """All nodes of some of the trees."""
        classes = self.classes
        if classes:
            per = rows.groupBy("y").agg(F.sum("w").alias("w"), F.count(F.lit(1)).alias("n")).toArrow().to_pandas()  # one row a class
            root = np.zeros(classes + 1)
            root[per["y"].astype(int)], root[classes] = per["w"], per["n"].sum()
        else:
            root = np.array(rows.agg(F.sum("w"), F.sum(F.col("w") * F.col("y")), F.sum(F.col("w") * F.col("y") * F.col("y")), F.count(F.lit(1))).first(), float)
        node = np.ones(len(tree), np.int64)
        total, done = np.tile(root, (len(tree), 1)), []
        for depth in range(self.depth + 1):
            if not len(node):
                break
            leaf = _is_leaf(total, depth, self.depth, classes)
            none = np.zeros((leaf.sum(), 1))
            made = [_node_table(tree[leaf], node[leaf], none.astype(int) - 1, none, none, none, np.full(leaf.sum(), -1), none[:, 0], total[leaf])]
            children = []
            waiting = np.flatnonzero(~leaf)
            for start in range(0, len(waiting), max(1, PASS_RANGES // d)):
                part = waiting[start : start + max(1, PASS_RANGES // d)]
                known = pd.concat([t[["tree", "node", "feature", "threshold"]] for t in done]) if done else None
                low, high = self._ranges(rows, known, tree[part], node[part], d)
                feature, cut = draw(self.seed, tree[part], node[part], low, high, k)
                left = self._sums(rows, known, tree[part], node[part], feature, cut, d, total.shape[1])
                best, gain = best_splits(total[part], left, feature, classes)
                made.append(_node_table(tree[part], node[part], feature, cut, low, high, best, gain, total[part]))
                inner = np.flatnonzero(best >= 0)
                goes = left[inner, best[inner]]
                children += [(tree[part][inner], 2 * node[part][inner], goes), (tree[part][inner], 2 * node[part][inner] + 1, total[part][inner] - goes)]
            done += made
            collect_garbage(rows.sparkSession)
            if not children:
                break
            tree, node, total = (np.concatenate(c) for c in zip(*children))
        return pd.concat(done)

    def _in_tasks(self, rows: DataFrame, known: pd.DataFrame | None, tree, node, width: int, schema: str, each, sums: list[Column]) -> pd.DataFrame:
        """Runs ``each(x, stats, group)`` per batch and tree, on the rows in the given nodes with their positions in
        the list of nodes, and brings together by ``sums`` what it tells about (place, item). What the tasks were
        sent is dropped then: the driver would hold it for all passes."""
        order = np.lexsort((node, tree))
        key = (tree[order].astype(np.int64) << 40) + node[order]
        forest = heap = None
        if known is not None:
            known = known.sort_values(["tree", "node"], ignore_index=True)
            forest, heap = Forest.of(known, self.trees), known["node"].to_numpy(np.int64)
        sent = rows.sparkSession.sparkContext.broadcast((forest, heap, key, order))
        classes, trees = self.classes, sorted({int(t) for t in tree})

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            forest, heap, key, order = sent.value
            for batch in batches:
                x = _matrix(batch.column(0), width)
                stats = label_stats(batch.column(1).to_numpy(), batch.column(2).to_numpy(), classes)
                for t in trees:
                    if forest is None:
                        here, open_ = np.ones(len(x), np.int64), np.ones(len(x), bool)
                    else:
                        at, open_, side = forest.leaves(x, t)
                        here = 2 * heap[at] + side
                    want = (t << 40) + here
                    place = np.minimum(np.searchsorted(key, want), len(key) - 1)
                    hit = np.flatnonzero(open_ & (key[place] == want))
                    if len(hit):
                        group = order[place[hit]]
                        sort = np.argsort(group, kind="stable")
                        hit, group = hit[sort], group[sort]
                        ids, starts = np.unique(group, return_index=True)
                        yield each(x[hit], stats[hit], group, ids, starts)

        try:
            return rows.mapInArrow(work, schema).groupBy("place", "item").agg(*sums).toArrow().to_pandas()
        finally:
            sent.destroy()

    def _ranges(self, rows: DataFrame, known, tree, node, d: int) -> tuple[np.ndarray, np.ndarray]:
        def each(x, stats, group, ids, starts) -> pa.RecordBatch:
            low, high = np.minimum.reduceat(x, starts), np.maximum.reduceat(x, starts)
            return pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(ids, d).astype(np.int32)), pa.array(np.tile(np.arange(d, dtype=np.int32), len(ids))), pa.array(low.ravel()), pa.array(high.ravel())],
                names=["place", "item", "low", "high"])

        merged = [F.min("low").alias("low"), F.max("high").alias("high")]
        found = self._in_tasks(rows, known, tree, node, d, "place int, item int, low double, high double", each, merged)  # PASS_RANGES at most
        low, high = np.zeros((len(node), d)), np.zeros((len(node), d))
        low[found["place"], found["item"]], high[found["place"], found["item"]] = found["low"], found["high"]
        return low, high

    def _sums(self, rows: DataFrame, known, tree, node, feature, cut, d: int, width: int) -> np.ndarray:
        drawn = rows.sparkSession.sparkContext.broadcast((feature, cut))
        k = feature.shape[1]

        def each(x, stats, group, ids, starts) -> pa.RecordBatch:
            feature, cut = drawn.value
            goes = x[np.arange(len(x))[:, None], feature[group]] <= cut[group]
            sums = np.stack([np.add.reduceat(stats * goes[:, [j]], starts) for j in range(k)], axis=1).reshape(len(ids), -1)
            g, item = np.nonzero(sums)
            return pa.RecordBatch.from_arrays([pa.array(ids[g].astype(np.int32)), pa.array(item.astype(np.int32)), pa.array(sums[g, item])], names=["place", "item", "v"])

        try:
            found = self._in_tasks(rows, known, tree, node, d, "place int, item int, v double", each, [F.sum("v").alias("v")])
        finally:
            drawn.destroy()
        left = np.zeros((len(node), k * width))
        left[found["place"], found["item"]] = found["v"]
        return left.reshape(len(node), k, width)
