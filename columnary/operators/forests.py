"""Forests of many trees that are held a few trees at a time.

MLlib keeps a whole forest on the driver, and each of its trees has as many nodes
as rows and depth allow. Here a forest is fitted in groups of trees, each group
with a seed of its own. A group is written below the checkpoint folder and dropped,
and is read again to score, so the driver holds ``GROUP_TREES * 2 ** (depth + 1)``
nodes at most, whatever the number of trees. The groups are the same for any input.

A group of small trees is mostly waiting for its many short jobs. Groups therefore run side by
side, as many as have ``HELD_NODES`` nodes together at most, where each has its largest size.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
from pyspark import inheritable_thread_target
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import DenseVector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import collect_garbage, ensure_checkpoint_dir

#: Trees fitted, written and read together.
GROUP_TREES = 4
#: Nodes that the groups of MLlib's trees in work have together: one group of full trees of depth 15.
HELD_NODES = GROUP_TREES * 2**16
#: Groups in work at once.
SIDE_BY_SIDE = 2
_VOTES, _RAW = "__votes", "__raw"


def group_sizes(trees: int, most: int = GROUP_TREES) -> list[tuple[int, int]]:
    """First tree and number of trees of every group."""
    return [(start, min(most, trees - start)) for start in range(0, trees, most)]


def batches(sizes: Sequence[int], bound: int, most: int) -> list[range]:
    """Runs of neighbours, each of ``most`` items at most that are ``bound`` together at most, or of one larger item."""
    out, held = [], 0
    for i, size in enumerate(sizes):
        if out and held + size <= bound and len(out[-1]) < most:
            out[-1], held = range(out[-1].start, i + 1), held + size
        else:
            out.append(range(i, i + 1))
            held = size
    return out


def side_by_side(spark: SparkSession, work: Callable, items: Sequence) -> list:
    """``work`` of every item in their order, all in work at once, each under its own copy of the local properties."""
    with ThreadPoolExecutor(max(1, len(items))) as pool:
        return [done.result() for done in [pool.submit(inheritable_thread_target(spark)(work), item) for item in items]]


def added_votes(rows: DataFrame, groups: Iterable[Sequence], votes: Callable[[object, DataFrame], tuple[DataFrame, Column]], width: int, forget: Callable[[], None] = lambda: None) -> DataFrame:
    """``rows`` with the sums of what each group of trees says of them.

    ``votes`` gives for a group and rows these rows and an array of ``width``
    numbers. The sums pass through a checkpoint behind each sequence of groups, so one sequence
    at a time is held by the driver and the executors; ``forget`` drops what it was sent by.
    """
    ensure_checkpoint_dir(rows.sparkSession)
    out = rows.withColumn(_VOTES, F.array(*[F.lit(0.0)] * width))
    for together in groups:
        for group in together:
            told, vote = votes(group, out)
            out = told.select(*rows.columns, F.zip_with(_VOTES, vote, lambda a, b: a + F.coalesce(b, F.lit(0.0))).alias(_VOTES))
            del told, vote, group
        out = out.checkpoint()
        del together
        forget()
        collect_garbage(rows.sparkSession)
    return out


def voted(rows: DataFrame, classes: int, trees: int) -> DataFrame:
    """``prediction`` and, for classes, ``probability`` from the sums over all trees."""
    mean = F.transform(_VOTES, lambda v: v / trees)
    if not classes:
        return rows.withColumn("prediction", mean[0]).drop(_VOTES)
    top = F.array_position(_VOTES, F.array_max(_VOTES)) - 1
    return rows.withColumn("prediction", top.cast("double")).withColumn("probability", array_to_vector(mean)).drop(_VOTES)


@dataclass
class GroupedForestModel:
    """Fitted groups as stored models; ``transform`` adds ``prediction`` and, for classes, ``probability``."""

    kind: type
    paths: list[str]
    nodes: list[int]
    trees: int
    classes: int
    featureImportances: DenseVector  # noqa: N815 - the name Spark's models use

    def transform(self, rows: DataFrame) -> DataFrame:
        def votes(model, part: DataFrame) -> tuple[DataFrame, Column]:
            if self.classes:
                return model.setPredictionCol("").setProbabilityCol("").setRawPredictionCol(_RAW).transform(part), vector_to_array(_RAW)
            return model.setPredictionCol(_RAW).transform(part), F.array(F.col(_RAW) * model.getNumTrees)

        def read(path: str):
            model = self.kind.load(path)
            collect_garbage(rows.sparkSession)
            return model

        together = batches(self.nodes, HELD_NODES, SIDE_BY_SIDE)
        loaded = (side_by_side(rows.sparkSession, read, [self.paths[i] for i in some]) for some in together)
        return voted(added_votes(rows, loaded, votes, max(1, self.classes)), self.classes, self.trees)


@dataclass
class GroupedForest:
    """``estimator`` is MLlib's random forest, ``kind`` its model; ``classes`` 0 is a regression."""

    estimator: object
    kind: type
    classes: int
    trees: int
    seed: int

    def fit(self, train: DataFrame) -> GroupedForestModel:
        folder = f"{ensure_checkpoint_dir(train.sparkSession)}/forest-{uuid.uuid4().hex}"
        groups = group_sizes(self.trees)

        def fitted(group: tuple[int, int]) -> tuple[str, int, np.ndarray]:
            start, size = group
            model = self.estimator.fit(train, {self.estimator.numTrees: size, self.estimator.seed: self.seed + start})
            model.write().save(path := f"{folder}/{start}")
            told = path, model.totalNumNodes, model.featureImportances.toArray() * size
            del model  # its trees and the garbage of its jobs go before the next ones are fitted
            collect_garbage(train.sparkSession)
            return told

        # a leaf has a number of rows at least, and a draw of all rows from themselves about as many again
        leaves = min(2**self.estimator.getMaxDepth(), train.count() // self.estimator.getMinInstancesPerNode() + 1)
        paths, nodes, importance = [], [], 0.0
        for some in batches([size * 2 * leaves for _, size in groups], HELD_NODES, SIDE_BY_SIDE):
            for path, known, share in side_by_side(train.sparkSession, fitted, [groups[i] for i in some]):
                paths.append(path)
                nodes.append(known)
                importance = importance + share
        total = importance.sum()
        return GroupedForestModel(self.kind, paths, nodes, self.trees, self.classes, DenseVector(importance / total if total > 0 else np.zeros(len(importance))))
