"""Isolation forest (Liu, Ting and Zhou 2008) on Spark.

Each tree grows on 256 rows, so growing is cheap whatever the table size: a tree
takes the rows whose hash lies next to its mark. Scoring walks all trees for a batch of
rows at once, with the trees (at most 80 x 511 nodes) sent to the tasks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import vocab
from .sampling import HASH_BITS

NODE_SCHEMA = "tree int, node int, feature int, threshold double, left int, right int, depth double"


def average_path(n: np.ndarray | float) -> np.ndarray:
    """Mean path length of an unsuccessful search in a tree of n points."""
    n = np.asarray(n, dtype=float)
    safe = np.maximum(n, 3.0)
    long = 2.0 * (np.log(safe - 1.0) + np.euler_gamma) - 2.0 * (safe - 1.0) / safe
    return np.where(n <= 1, 0.0, np.where(n <= 2, 1.0, long))


def grow_tree(points: np.ndarray, tree: int, limit: int, seed: int) -> pd.DataFrame:
    """One random tree as a node table; leaves carry their expected depth."""
    rng = np.random.default_rng([seed, tree])
    nodes: list[list] = []
    waiting = [(np.arange(len(points)), 0, -1, "left")]
    while waiting:
        rows, depth, parent, side = waiting.pop()
        here = len(nodes)
        if parent >= 0:
            nodes[parent][4 if side == "left" else 5] = here
        block = points[rows]
        low, high = block.min(axis=0), block.max(axis=0)
        open_features = np.flatnonzero(high > low)
        if depth >= limit or len(rows) <= 1 or len(open_features) == 0:
            nodes.append([tree, here, -1, 0.0, -1, -1, float(depth + average_path(len(rows)))])
            continue
        feature = int(rng.choice(open_features))
        cut = float(rng.uniform(low[feature], high[feature]))
        nodes.append([tree, here, feature, cut, -1, -1, 0.0])
        goes_left = block[:, feature] <= cut
        if goes_left.all():
            goes_left = block[:, feature] < high[feature]
            nodes[here][3] = float(np.nextafter(high[feature], low[feature]))
        waiting.append((rows[goes_left], depth + 1, here, "left"))
        waiting.append((rows[~goes_left], depth + 1, here, "right"))
    return pd.DataFrame(nodes, columns=["tree", "node", "feature", "threshold", "left", "right", "depth"])


def draw_rows(vectors: DataFrame, rows: int, trees: int, size: int) -> DataFrame:
    """``tree, place, x``: exactly ``size`` rows for each tree (all, where there are fewer).

    Every row has a place on a circle (``place``, from a hash of the row), and tree
    t takes the rows next to its mark at t / trees. Rows too far from any mark
    to be among the ``size`` nearest go before anything is moved; should a tree
    find too few in that reach, the reach is doubled. One pass as a rule, no
    pool, the same rows under any partitioning.
    """
    circle = 1 << HASH_BITS
    marked = vectors.select("x", F.col("place").alias("u")).withColumn("slot", F.shiftrightunsigned(F.col("u") * trees, HASH_BITS))
    share = min(1.0, (size + 10.0 * math.sqrt(size) + 50.0) / max(rows, 1))
    while True:
        reach = min(circle, math.ceil(share * circle))
        marks = min(trees, math.ceil(share * trees) + 1)  # how many marks a row can be near to
        tree = F.pmod(F.col("slot") - F.col("back"), F.lit(trees))
        near = marked.withColumn("back", F.explode(F.sequence(F.lit(0), F.lit(marks - 1)))).withColumn("tree", tree.cast("int"))
        far = F.pmod(F.col("u") - F.expr(f"tree * {circle} DIV {trees}"), F.lit(circle))
        found = near.select("tree", far.alias("far"), "x").where(F.col("far") < reach).persist(StorageLevel.MEMORY_AND_DISK)
        least = found.groupBy("tree").agg(F.count(F.lit(1)).alias("n")).agg(F.count(F.lit(1)).alias("trees"), F.min("n").alias("n")).first()
        if share >= 1.0 or (least.trees == trees and least.n >= size):
            break
        found.unpersist()
        share = min(1.0, 2.0 * share)
    order = Window.partitionBy("tree").orderBy("far", "x")  # little more than ``size`` rows
    return found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= size).select("tree", "place", "x")


def grow_forest(vectors: DataFrame, rows: int, trees: int = vocab.ISOLATION_TREES, sample: int = vocab.ISOLATION_SAMPLE) -> DataFrame:
    """Node table of the forest. ``vectors``: ``place long`` below 2^52 and ``x array<double>``."""
    size = min(sample, rows)
    chosen = draw_rows(vectors, rows, trees, size)
    limit = max(1, math.ceil(math.log2(max(size, 2))))
    seed = vocab.SEED

    def grow(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("place")
        return grow_tree(np.stack(group["x"].to_numpy()).astype(float), int(group["tree"].iloc[0]), limit, seed)

    return chosen.groupBy("tree").applyInPandas(grow, NODE_SCHEMA)


def score_rows(vectors: DataFrame, forest: pd.DataFrame, size: int) -> DataFrame:
    """``vectors`` with ``raw_score``: -2^(-mean depth / expected depth)."""
    trees = []
    for _, t in forest.sort_values(["tree", "node"]).groupby("tree"):
        trees.append(tuple(t[c].to_numpy() for c in ("feature", "threshold", "left", "right", "depth")))
    expected = float(max(average_path(size), 1e-9))
    shared = vectors.sparkSession.sparkContext.broadcast(trees)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        local = shared.value
        for batch in batches:
            if len(batch) == 0:
                yield pd.Series([], dtype=float)
                continue
            x = np.stack(batch.to_numpy()).astype(float)
            rows = np.arange(len(x))
            total = np.zeros(len(x))
            for feature, threshold, left, right, depth in local:
                node = np.zeros(len(x), dtype=int)
                while True:
                    f = feature[node]
                    inner = f >= 0
                    if not inner.any():
                        break
                    goes_left = x[rows, np.maximum(f, 0)] <= threshold[node]
                    node = np.where(inner, np.where(goes_left, left[node], right[node]), node)
                total += depth[node]
            yield pd.Series(-np.power(2.0, -(total / len(local)) / expected))

    return vectors.withColumn("raw_score", score("x"))
